"""Conversation repair and license scans against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
import regex
from awkward import corpus, documents, nothing, rows_of  # noqa: F401  (fixtures)

from storeline.llm import conversation_repair, license_scan, queries

SOLID = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(letters: str) -> tuple[int, str]:
    """Least (cost, audit) over an automaton of the grammar: states of what came last, a plain memoised search."""

    @lru_cache(None)
    def go(i: int, state: str, inserted: int) -> tuple[int, str]:
        options = []
        if i == len(letters) and state in ("empty", "a"):
            options.append((0, ""))
        following = {"empty": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(letters):
            own, extra = letters[i].lower(), int(letters[i].isupper())
            c, a = go(i + 1, state, 0)
            options.append((c + 3, "D" + a))
            if own != "-":
                for role in following:
                    if role == own or role != "s":
                        c, a = go(i + 1, role, 0)
                        options.append((c + extra + (0 if role == own else 2), ("K" if role == own else "R") + a))
        if inserted < 3:
            for role in following.replace("s", ""):
                c, a = go(i, role, inserted + 1)
                options.append((c + 2, "I" + a))
        return min(options, default=(10**9, ""))

    return go(0, "empty", 0)


def test_alignment():
    for n in range(5):
        for letters in itertools.product("suax-SA", repeat=n):
            assert conversation_repair.align("".join(letters))[:2] == cheapest("".join(letters)), letters
    rng = random.Random(3)
    for n in [*range(5, 30)] * 6 + [120, 121]:
        letters = "".join(rng.choice(rng.choice(["suaxSUAX-", "ua", "uuuuua", "-sA"])) for _ in range(n))
        assert conversation_repair.align(letters)[:2] == cheapest(letters), letters


def test_long_alignment():
    rng = random.Random(5)
    letters = "".join("ua"[i % 2] if rng.random() < 0.9 else rng.choice("suaxUA-") for i in range(3000))
    cost, audit, rows, roles = conversation_repair.align(letters)
    assert cost <= conversation_repair.incumbent(letters) and len(rows) == len(roles) == sum(c != "D" for c in audit)
    spent = sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in audit) + sum(letters[r].isupper() for r in rows if r >= 0)
    final = "".join(letters[r].lower() if role == "k" else role for r, role in zip(rows, roles))
    assert spent == cost and re.fullmatch("(s?(ua)+)?", final)


def repaired(rows: list[tuple], damage: bool = True) -> list[tuple]:
    """What op12 has to return, row by row in plain Python."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        letters, faults, seen = "", [], set()
        for _, role, text in mine:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest(letters)
        final, at, last = [], 0, None
        for edit in audit:
            if edit in "DK":
                if edit == "K":
                    final.append(f"{mine[at][1]}:{mine[at][2]}")
                    last = mine[at][1][:1]
                at += 1
            else:
                last = "a" if last == "u" else "u"
                final.append(f"{'user' if last == 'u' else 'assistant'}:{mine[at][2] if edit == 'R' else ''}")
                at += edit == "R"
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(final).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations() -> list[tuple]:
    rng = random.Random(9)
    texts = ["Fine.", "what now?", "no stop", "", "  \t", "Fine.", "a.b. ", "end!\n", None, "ü" * 5000 + "."]
    rows = [(conv, turn, rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None]), rng.choice(texts))
            for conv in range(200) for turn in range(rng.randrange(1, 9))]
    rows += [(300, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(150)]
    rows += [(301, None, "user", "first."), (301, None, None, None), (301, 2**40, "assistant", "far."), (302, None, "system", "alone.")]
    rows += [(303, 1, "user", "same.")] * 4 + [(None, 1, "user", "no id."), (None, 2, "assistant", "none.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def in_folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_registered_repair(spark, tmp_path):
    got = queries.QUERIES["op12_conversation_repair"](spark, in_folder(spark, tmp_path, "conversations", conversations(), SCHEMA))
    assert rows_of(got, *COLUMNS) == repaired(conversations())


def test_repair_on_generated_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.QUERIES["op12_conversation_repair"](spark, folder), *COLUMNS) == repaired(rows)


def test_repair_cases(spark):
    assert conversation_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([("c", 1, "user", "hi.", 1, "x")], "id string, no int, who string, said string, turn int, turns string")
    got = conversation_repair.repair(odd, "id", "no", "who", "said").collect()
    assert [(r["conv_id"], r["audit"], [tuple(t) for t in r["repaired"]]) for r in got] == [("c", "KI", [("user", "hi."), ("assistant", "")])]


def lines() -> list[tuple]:
    """Notices with planted edits, at borders, next to each other, far from words, and texts without any."""
    rng = random.Random(4)
    out = []
    for i, notice in enumerate([*license_scan.NOTICES] * 6):
        chars = list(notice)
        for _ in range(rng.randrange(0, license_scan.errors(notice) + 2)):
            k = rng.randrange(len(chars))
            chars[k] = rng.choice(["", "x", chars[k] + "q", " ", chars[k].upper()])
        out.append((i, f"{rng.choice(['', 'see the ', 'x'])}{''.join(chars)}{rng.choice(['', ', all of it.', 's', '. ' + notice])}"))
    out += [(200, "MIT License; MIT--license\nthe mit license, apache license 2.0 cc-by CC BY cc bye"), (201, "emit license mit licence " * 400),
            (202, "gnu general public license " * 3), (203, "é" * 50_000 + " mit license"), (204, "gnu general public　license"), (None, "mit license"), (205, None)]
    return out + corpus()


def brute_scan(text: str | None) -> tuple:
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    norm, labels, score = " ".join(words), {b[1] for b in base}, 1.0 * bool(base)
    for notice, label in license_scan.NOTICES.items():
        e = len(notice) // 10
        for m in regex.finditer(rf"(?<![^ ])(?:{regex.escape(notice)}){{e<={e}}}(?![^ ])", norm, regex.ENHANCEMATCH) if e else ():
            labels.add(label)
            score = max(score, 1 - sum(m.fuzzy_counts) / (e + 1))
    starts = [b[0] for b in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[1] for b in base})),
            ",".join(sorted(labels)), score)


def test_registered_licenses(spark, tmp_path):
    got = queries.QUERIES["op13_license_scans"](spark, in_folder(spark, tmp_path, "documents", lines(), "doc_id long, text string"))
    want = sorted([(i, *brute_scan(t)) for i, t in lines()], key=repr)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == want


def test_license_spans(spark, documents, nothing):
    one = spark.createDataFrame([(1, "Éa - The MIT\nLicence. GNU general Public License")], "doc_id long, text string")
    row = license_scan.scan(one).collect()[0]
    assert [tuple(s) for s in row["base"]] == [("gpl", 4, 7, 22, 48, 0)]
    assert ("mit", 2, 3, 9, 20, 1) in [tuple(s) for s in row["fuzzy"]]
    assert license_scan.scan(documents).count() == len(corpus())
    assert license_scan.scan(nothing).count() == 0


def test_pieces_cover_notices():
    for notice in license_scan.NOTICES:
        found = license_scan.pieces(notice)
        assert "".join(p for _, p in found) == notice and len(found) == license_scan.errors(notice) + 1


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_lose_nothing(seed):
    rng = random.Random(seed)
    asked = (("ab ba ab ba ab", "x"), ("baab baab aa", "y"))
    for _ in range(300):
        norm = " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(40))
        want = sorted((k, m.start(), m.end(), sum(m.fuzzy_counts)) for k, (notice, _) in enumerate(asked)
                      for m in regex.finditer(rf"(?<![^ ])(?:{notice}){{e<=1}}(?![^ ])", norm, regex.ENHANCEMATCH))
        assert license_scan.fuzzy_spans(norm, asked) == want
