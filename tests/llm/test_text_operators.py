"""Operators on texts against brute force or the library, over the awkward corpus and over empty tables."""

from __future__ import annotations

import re
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from awkward import corpus, documents, nothing, rows_of  # noqa: F401  (fixtures)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storeline.llm import decontaminate, line_dedup, secret_scan, sentencepiece_codec, simhash, substring_dedup, token_count
from storeline.llm.queries import byte_bpe_path, piece_bpe_path

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(n: int, linked) -> list[int]:
    """Smallest member of each one's component, by plain search."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_token_counts(documents, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus()]
    got = token_count.count_tokens(documents, byte_bpe_path)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert token_count.count_tokens(nothing, byte_bpe_path).count() == 0


def test_sentencepiece(documents, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    two_steps = sentencepiece_codec.decode(sentencepiece_codec.encode(documents, piece_bpe_path), piece_bpe_path).collect()
    coded = sentencepiece_codec.round_trip(documents, piece_bpe_path).collect()
    assert sorted(coded, key=repr) == sorted(two_steps, key=repr) and len(coded) == len(corpus())
    for r in coded:
        assert r["pieces"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
        assert r["body"] == "own body"
    assert sentencepiece_codec.encode(nothing, piece_bpe_path).count() == 0


def test_unigram_relaxation():
    model = sentencepiece_codec.PieceModel(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    unit, score = "▁thering", lambda t: model.score[model.ids[t]]
    best = [(0.0, [])]
    for end in range(1, len(unit) + 1):
        best.append(max(((best[s][0] + score(unit[s:end]), best[s][1] + [unit[s:end]]) for s in range(end)
                         if unit[s:end] in model.ids and best[s] is not None), default=None))
    ids, _ = model.encode_units([unit])
    assert [model.pieces[i] for i in ids] == best[-1][1]


def simhash_of(text: str, n: int) -> int:
    words = [w.encode() for w in WHITE.findall(text.translate(ASCII_LOWER))]
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_near_duplicates(documents, nothing):
    docs = corpus()
    fps = [simhash_of(t or "", 4) for _, t in docs]
    root = groups(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = defaultdict(lambda: None)
    for r, (i, _) in zip(root, docs):
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    want = sorted(((i, f if f < 1 << 63 else f - (1 << 64), least[r]) for (i, _), f, r in zip(docs, fps, root)), key=repr)
    assert rows_of(simhash.near_duplicates(documents), "doc_id", "fp", "component_id") == want
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert kept.count() == len(set(root))
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {v for v in least.values() if v is not None}
    assert simhash.near_duplicates(nothing).count() == 0


def test_fingerprint_matches_sql_hash(spark):
    text = "one two three"
    assert spark.sql(f"SELECT xxhash64('{text}') AS h").first()["h"] == simhash.fingerprint(text.encode(), 4)


def cut(docs, window):
    """Plain removal of the words of windows that start in a document of a smaller id."""
    first = {}
    for i, t in docs:
        words = WHITE.findall(t or "")
        for p in range(len(words) - window + 1 if i is not None else 0):
            g = tuple(words[p:p + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        words = WHITE.findall(t or "")
        gone = {p + j for p in range(len(words) - window + 1 if i is not None else 0) if first[tuple(words[p:p + window])] < i for j in range(window)}
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [13, 5])
def test_substring_dedup(documents, nothing, window):
    got = substring_dedup.cut_repeats(documents, window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == cut(corpus(), window)
    assert substring_dedup.cut_repeats(nothing, window).count() == 0


def test_fm_index_ranges_hold_all_places():
    import numpy as np

    rng = np.random.default_rng(3)
    words = np.append(rng.integers(1, 5, 400), 0)
    index = substring_dedup.FMIndex(words, 6)
    for start in range(0, 390, 7):
        lo, hi = np.array([0]), np.array([index.n])
        for w in words[start:start + 6][::-1]:
            lo, hi = index.extend(np.array([w]), lo, hi)
        want = [p for p in range(395) if (words[p:p + 6] == words[start:start + 6]).all()]
        assert sorted(index.sa[lo[0]:hi[0]].tolist()) == want


ITEMS = [(1, None), (2, ""), (3, "ren"), (10, corpus()[82][1]), (11, corpus()[82][1].upper()), (12, corpus()[60][1]), (12, "lova mix tux"), (None, "stone tuzon")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 200])
def test_decontamination(spark, documents, nothing, max_bytes):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    want = []
    for i, t in corpus():
        words, hit, items = words_of(t), set(), set()
        for item, text in ITEMS:
            w = words_of(text)
            k = min(10, len(w))
            windows = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if w else set()
            at = [p for p in range(len(words) - k + 1) if k and tuple(words[p:p + k]) in windows]
            hit |= {p + j for p in at for j in range(k)}
            items |= {item} if at and item is not None else set()
        want.append((i, len(words), len(hit), sorted(items)))
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(documents, tests, 10, max_bytes)
    assert rows_of(got.withColumn("items", F.array_sort("items")), "doc_id", "n_words", "n_hit", "items") == sorted(want, key=repr)
    clean = decontaminate.remove_contaminated(documents, tests, 10, max_bytes)
    assert clean.columns == documents.columns and clean.count() == sum(1 for w in want if not w[2])
    assert decontaminate.contamination(nothing, tests).count() == 0
    assert decontaminate.remove_contaminated(documents, tests.limit(0)).count() == len(want)


def test_secret_scan(documents, nothing):
    patterns = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
                (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    want = [(i, *([(m.start(), m.end()) for m in p.finditer(t or "") if ok(m)] for p, ok in patterns)) for i, t in corpus()]
    model = secret_scan.ratios(secret_scan.samples(documents))
    found = secret_scan.scan(documents, model)
    got = [(r["doc_id"], *([(s["start"], s["end"]) for s in r[k]] for k in secret_scan.KINDS)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert secret_scan.scan(nothing, secret_scan.ratios(secret_scan.samples(nothing))).count() == 0


def test_markov_models_tell_random_strings(spark):
    import random

    rng = random.Random(5)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(signs) for _ in range(n))
    names = ["request_handler", "connection_pool", "maximum_retries", "configuration", "interpreter", "document_index", "serialized_value"]
    labelled = spark.createDataFrame([(key(40), True) for _ in range(200)] + [(rng.choice(names) + "_" + rng.choice(names), False) for _ in range(200)],
                                     "value string, random boolean")
    keys = [key(32) for _ in range(20)]
    texts = [(i, f"😀 see {k} and connection_pool_configuration_index") for i, k in enumerate(keys)]
    texts.append((99, f"password={keys[0]} {keys[1][:10]}"))
    found = {r["doc_id"]: r["random"] for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), secret_scan.ratios(labelled)).collect()}
    for i, k in enumerate(keys):
        assert [(s["start"], s["end"], s["value"]) for s in found[i]] == [(6, 38, k)]
    assert found[99] == []  # the pattern has it already, and short runs are not judged


def line_simhash(norm: str) -> int:
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in norm.split(" ")]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


def plain_lines(docs):
    """Occurrences (rank of the document, id, text, line, key) and the group of each key; key: the normalised line, or a short one as it stands."""
    normal = lambda s: re.sub(r"[^\w]+|_+", " ", re.sub("[0-9]+", "0", s.lower())).strip(" ")
    key = lambda s: n if len(n := normal(s)) >= 8 else ("short", s.strip(" \t\n\x0b\f\r")) if n else None
    text_key = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    occurrences = [((i is None, i or 0, text_key(t)), i, t, k, key(line)) for i, t in docs if t is not None for k, line in enumerate(t.split("\n"))]
    norms = sorted({o[4] for o in occurrences if isinstance(o[4], str)})
    fps = [line_simhash(n) for n in norms]

    def linked(i, j):
        a, b = norms[i], norms[j]
        if (fps[i] ^ fps[j]).bit_count() > 3 or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
            return False
        return edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9

    group = dict(zip(norms, groups(len(norms), linked)))
    group |= {o[4]: o[4] for o in occurrences if isinstance(o[4], tuple)}
    return occurrences, group


def plain_dedup(docs):
    """(id, text that stays) of every document, and how many lines it has and loses."""
    occurrences, group = plain_lines(docs)
    best, keep = {}, defaultdict(dict)
    for rank, i, t, k, n in occurrences:
        if n in group:
            best[group[n]] = min(best.get(group[n], (rank, k)), (rank, k))
    for rank, i, t, k, n in occurrences:
        keep[i, t][k] = n not in group or best[group[n]] == (rank, k)
    out = []
    for i, t in docs:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if keep[i, t][k]]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_documents():
    docs = corpus()
    docs += [(200 + k, f"this is a boiler plate line that stands in document number {k} of the whole set of texts and is long enough to be "
              f"near to its kin {'alpha' if k % 3 else 'beta'}") for k in range(9)]
    return docs + [(300 + k, f"Menu\n}}\n\n {k % 2}\t\nmenu\nown line of document {'abcdefgh'[k] * 9}") for k in range(5)]


def test_line_dedup(spark, nothing):
    docs = line_documents()
    want = sorted(((i, t) for i, t, _, _ in plain_dedup(docs)), key=repr)
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node long").repartition(3)
    got = line_dedup.dedup_lines(table)
    assert got.columns == table.columns
    assert rows_of(got, "doc_id", "text") == want
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_simhash_counts_whole_long_lines(spark):
    norm = " ".join(f"w{k % 97}" for k in range(5000))
    fp = lambda text: line_dedup.simhash(spark.range(1).select(text.alias("norm")), "norm", "fp").first()["fp"]
    got = fp(F.lit(norm))
    want = line_simhash(norm)
    assert got == (want if want < 1 << 63 else want - (1 << 64))
    long = fp(F.array_join(F.array_repeat(F.lit("ab cd"), 600_000), " "))
    assert isinstance(long, int)
