"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from awkward import corpus, documents, nothing, rows_of  # noqa: F401  (fixtures)

from storeline.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, misspell=97) -> Counter:
    found = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 5 and n >= 3})


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def brute(words: Counter) -> list[tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words), key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def family(seed: int) -> list[tuple]:
    """Texts of words with their one-edit variants, chains of them, runs of one letter and long words."""
    rng = random.Random(seed)
    letters = "abcé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 12))) for _ in range(60)]
    base += ["a" * k for k in range(4, 14)] + ["ab" * k for k in range(2, 7)] + ["x" * 3000, "x" * 2999, "y" + "x" * 2999, "x" * 1500 + "y" + "x" * 1500]
    bag = []
    for w in base:
        bag += [w] * rng.randrange(1, 40)
        for _ in range(4):
            k = rng.randrange(len(w))
            bag += [rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])] * rng.randrange(1, 9)
    rng.shuffle(bag)
    return [(i, " ".join(bag[i::25])) for i in range(25)]


@pytest.mark.parametrize("docs", [family(1), family(2), corpus()], ids=["family", "other family", "awkward"])
def test_variants(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = spelling.variants(spelling.vocabulary(rows, misspell=97))
    assert rows_of(got, *COLUMNS) == brute(counted(docs))


def test_neighbours_come_once_and_both_ways(spark):
    words = counted(family(3), misspell=None)
    table = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    got = sorted(tuple(r) for r in spelling.neighbours(table).collect())
    assert got == sorted((a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b))


def test_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)  # workers get the module by value of the closure, so both paths are used
    docs = family(4)
    got = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), misspell=97)
    assert Counter({r["word"]: r["n"] for r in got.collect()}) == counted(docs)


def test_cases(spark, documents, nothing):
    assert rows_of(spelling.variants(spelling.vocabulary(documents, misspell=97)), *COLUMNS) == brute(counted(corpus()))
    assert spelling.variants(spelling.vocabulary(nothing)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "12 ; 34")], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(blank)).count() == 0


def test_chain_of_forms(spark):
    words = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("bbbbb", 95), ("zzzzz", 9)], "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.variants(words).collect()}
    assert got == {"aaaaa": "abbbb", "aaaab": "abbbb", "aaabb": "abbbb", "aabbb": "abbbb", "abbbb": "abbbb", "bbbbb": "bbbbb", "zzzzz": "zzzzz"}


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_spelling_variants"](spark, folder), *COLUMNS) == brute(counted(docs))
