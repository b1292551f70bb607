"""Benchmark decontamination by suffix arrays over the training text.

Every task indexes its shard of documents (a bounded Arrow slice): words become numbers of the test vocabulary, and the
suffixes that can hold a match (those in runs of test words as long as the shortest window) are sorted by prefix doubling,
as deep as the longest test item. Every suffix of every test item that starts a window is binary-searched in that array,
word by word, for its longest verbatim match and for the range of places where its window stands. A document word inside
any such place is hit; documents with hit words are contaminated and can be removed.

The tests reach the tasks as a broadcast whose size is checked: a larger benchmark is dealt to slices of at most
``max_test_bytes``, each searched by a pass of its own that adds to the hits so far.

Cases: null text and null items have no words; items of fewer words than a window are one window; repeated items count
once by id, items without an id mark words but are not listed; repeated documents are judged one by one; without items
nothing is hit; empty tables give empty results; extra columns are kept by remove_contaminated() and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeline.llm.common import slices
from storeline.session import cut_lineage

WINDOW = 10
MAX_TEST_BYTES = 48 << 20
#: Bytes of words after lower-casing A-Z: 0-9, a-z and everything beyond ASCII; all else separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(WORD_BYTES).split()


class TestWindows:
    """The windows of a slice of test items as numbered words."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        text, start, size, owner, left = [], [], [], [], []
        self.longest, self.shortest = 0, window
        for item_id, body in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words_of(body)]
            if not ids:
                continue
            w = min(window, len(ids))
            self.shortest, self.longest = min(self.shortest, w), max(self.longest, len(ids))
            for i in range(len(ids) - w + 1):
                start.append(len(text) + i)
                size.append(w)
                owner.append(item_id)
                left.append(len(ids) - i)
            text += [*ids, 0]
        self.text = np.array([*text, 0], np.int64)
        self.start, self.size, self.left = (np.array(x, np.int64) for x in (start, size, left))
        self.item = np.array([-1 if x is None else x for x in owner], np.int64)
        self.named = np.array([x is not None for x in owner], bool)


def suffix_array(x: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the word sequences that start there, compared to ``depth`` words at least.

    x ends with a zero; zero words end a sequence. Prefix doubling: the rank of the first h words and the rank of the h
    words behind them give the rank of 2 h words."""
    rank, h = x.copy(), 1
    order = np.argsort(rank[places], kind="stable")
    while h < depth and len(places) > 1:
        key = rank[places] * (len(x) + x.max() + 2) + rank[np.minimum(places + h, len(x) - 1)]
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)])
        rank = np.zeros(len(x), np.int64)
        rank[places[order]] = np.cumsum(fresh)
        if rank[places[order[-1]]] == len(places):
            break
        h *= 2
    return places[order]


def bound(x: np.ndarray, sa: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all ranges at once: the first place in [lo, hi) whose word at ``depth`` is not before ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = x[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(x) - 1)]
        go = open_ & ((at <= word) if after else (at < word))
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def search(x: np.ndarray, sa: np.ndarray, tests: TestWindows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range of the suffix array where each test window stands, and the longest verbatim match of each test suffix."""
    n = len(tests.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    found = np.zeros((2, n), np.int64)
    longest = np.zeros(n, np.int64)
    live = np.flatnonzero(hi > lo)
    depth = 0
    while len(live):
        word = tests.text[tests.start[live] + depth]
        a = bound(x, sa, depth, lo[live], hi[live], word, False)
        b = bound(x, sa, depth, a, hi[live], word, True)
        more = b > a
        live, a, b = live[more], a[more], b[more]
        lo[live], hi[live] = a, b
        depth += 1
        longest[live] = depth
        whole = tests.size[live] == depth
        found[:, live[whole]] = a[whole], b[whole]
        live = live[tests.left[live] > depth]
    return found[0], found[1], longest


def scan(bodies: list[bytes | None], tests: TestWindows, window: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each text of a shard: hit flags of its words, ids of the items found, longest match in words."""
    get = tests.vocabulary.get
    ids = []
    for body in bodies:
        words = words_of(body)
        ids.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
    size = np.array([len(i) for i in ids], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    x = np.zeros(begin[-1] + 1, np.int64)
    for at, i in zip(begin, ids):
        x[at:at + len(i)] = i
    # runs of test words that are shorter than every window can't hold one
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (x > 0).astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    for s, e in zip(*(v[b - a < tests.shortest] for v in (a, b))) if tests.shortest > 1 else ():
        x[s:e] = 0
    places = np.flatnonzero(x)
    flags = np.zeros(len(x) + 1, np.int64)
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bodies)
    best = np.zeros(len(bodies), np.int64)
    if len(places) and len(tests.start):
        sa = suffix_array(x, places, tests.longest)
        lo, hi, longest = search(x, sa, tests)
        hit = np.flatnonzero(hi > lo)
        # equal windows have equal ranges: their places are marked once
        _, first, same = np.unique(np.stack([lo[hit], tests.size[hit]]), axis=1, return_index=True, return_inverse=True)
        ranges = hit[first]
        count = hi[ranges] - lo[ranges]
        which = np.repeat(np.arange(len(ranges)), count)
        place = sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[ranges][which]]
        np.add.at(flags, place, 1)
        np.add.at(flags, place + tests.size[ranges][which], -1)
        doc = np.searchsorted(begin, place, side="right") - 1
        pairs = np.unique(np.stack([doc, which], 1), axis=0)
        by = np.argsort(same.ravel(), kind="stable")
        of = np.searchsorted(same.ravel()[by], np.arange(len(ranges) + 1))
        named = tests.named[hit][by]
        ident = tests.item[hit][by]
        for d in np.unique(pairs[:, 0]):
            mine = pairs[pairs[:, 0] == d, 1]
            items[d] = np.unique(np.concatenate([ident[of[r]:of[r + 1]][named[of[r]:of[r + 1]]] for r in mine]))
        # how far each place goes on verbatim behind its window
        reach = np.zeros(len(place), np.int64)
        far = ranges if not len(hit) else hit[by][np.maximum.reduceat(longest[hit][by] * len(hit) + np.arange(len(hit)), of[:-1]) % len(hit)]
        t, p = tests.start[far][which] + tests.size[far][which], place + tests.size[far][which]
        going = np.arange(len(place))
        while len(going):
            going = going[(x[p[going]] > 0) & (x[p[going]] == tests.text[t[going]])]
            reach[going] += 1
            p[going] += 1
            t[going] += 1
        np.maximum.at(best, doc, tests.size[ranges][which] + reach)
    hit_word = np.cumsum(flags) > 0
    return [hit_word[s:s + n] for s, n in zip(begin, size)], items, best


def test_slices(tests: DataFrame, window: int, max_bytes: int, id_col: str, text_col: str) -> Iterator:
    """Broadcasts of the test windows, each made from at most about ``max_bytes`` of items."""
    spark = tests.sparkSession
    rows = tests.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // max_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(TestWindows([(r["i"], bytes(r["t"])) for r in part.toLocalIterator()], window))


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, max_test_bytes: int = MAX_TEST_BYTES,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, items, longest_match) for every row: hit words, item ids found, longest match in words."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    state = F.lit(None).cast("struct<n_words long, n_hit long, hits binary, items array<long>, longest_match long>")
    out = out.withColumn("found", state)
    for k, shared in enumerate(test_slices(tests, window, max_test_bytes, item_col, text_col)):
        out = out.withColumn("found", searcher(shared, window)("body", "found"))
        if k % 4 == 3:
            out = cut_lineage(out, "hits")
    return out.select("doc_id", *(F.col(f"found.{c}") for c in ("n_words", "n_hit", "items", "longest_match")))


def searcher(shared, window: int):
    """UDF (text, findings so far) -> findings with those of one slice of the tests."""

    @F.pandas_udf("struct<n_words long, n_hit long, hits binary, items array<long>, longest_match long>")
    def found(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for bodies, before in parts:
            out = []
            batch = pa.record_batch([pa.array(bodies, pa.binary())], names=["body"])
            at = 0
            for b in slices([batch], "body"):
                hits, items, best = scan(b.column("body").to_pylist(), shared.value, window)
                for h, i, m in zip(hits, items, best.tolist()):
                    old = before["hits"].iloc[at]
                    if old is not None:
                        h = h | np.unpackbits(np.frombuffer(old, np.uint8), count=len(h)).astype(bool)
                        i = np.union1d(i, np.asarray(before["items"].iloc[at], np.int64))
                        m = max(m, int(before["longest_match"].iloc[at]))
                    out.append((len(h), int(h.sum()), np.packbits(h).tobytes(), i, m))
                    at += 1
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "hits", "items", "longest_match"])

    return found


def remove_contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW, max_test_bytes: int = MAX_TEST_BYTES,
                        text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, in which no test window occurs; no shuffle."""
    names = docs.columns
    out = docs.toDF(*(f"c{i}" for i in range(len(names))))
    body = F.col(f"c{names.index(text_col)}").cast("binary")
    for shared in test_slices(tests, window, max_test_bytes, item_col, text_col):
        none = F.lit(None).cast("struct<n_words long, n_hit long, hits binary, items array<long>, longest_match long>")
        out = out.where(searcher(shared, window)(body, none)["n_hit"] == 0)
    return out.toDF(*names)
