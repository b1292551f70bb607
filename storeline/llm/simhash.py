"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: one bit per position, set if it is set in over half of the 64-bit hashes of a text's word shingles.
Two fingerprints at most ``radius`` bits apart have a variant in common that is at most ``radius // 2`` flips from one and
``radius - radius // 2`` from the other, so every distinct fingerprint emits all variants within half the radius, variants
are shuffled together, and the fingerprints that meet at one variant are deduplicated and verified.

The shuffle does not carry the variants themselves: they are dealt to slices by a linear code (the XOR of one random
column per set bit), so a fingerprint travels once to each slice that holds any of its variants, and the slice emits just
those. All variants of a slice are made, a bounded number at a time, sorted, and equal ones are linked to the first of
them. Each slice returns a spanning forest of its verified links, so a dense group of n fingerprints costs n links per
slice and never n squared. Components of the links give the groups.

Cases: null text, empty text and text of white space only have fingerprint zero, which links like any other; texts of
fewer words than a shingle are one shingle; repeated rows get the same fingerprint and component; a null doc_id takes no
part in the smallest id of its group (the component of a group without any id is null); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.llm.common import keyed_bytes, slices, xor_fold
from storeline.llm.components import components
from storeline.session import cut_lineage

SEED = 42
#: Variants that a slice should hold at most, and those a task makes at a time (memory bounds; no effect on results).
SLICE_VARIANTS, STEP_VARIANTS, LEAST_SLICES = 1 << 26, 1 << 21, 64


def fingerprint(body: bytes | None, words_per_shingle: int) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, repeats counted."""
    words = (body or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= words_per_shingle:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = words_per_shingle - 1
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n - k].tolist(), ends[k:].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint of every whole text as a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            fps = [fingerprint(x, words_per_shingle) for x in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps, pa.int64())],
                                              names=["doc_id", "text_key", "fp"])

    return keyed_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key long, fp long")


class Ball:
    """The variants around a fingerprint and the linear code that deals them to ``2 ** slice_bits`` slices."""

    def __init__(self, radius: int, slice_bits: int):
        flips = [c for r in range(radius - radius // 2 + 1) for c in combinations(range(64), r)]
        self.radius, self.slice_bits = radius, slice_bits
        self.masks = np.array([sum(1 << i for i in c) for c in flips], np.uint64)
        columns = xor_fold(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.tables = np.zeros((8, 256), np.uint64)  # code of each byte value at each place
        for place in range(8):
            for bit in range(8):
                self.tables[place][(np.arange(256) >> bit) & 1 == 1] ^= columns[8 * place + bit]

    def code(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        for place in range(8):
            out ^= self.tables[place][((values >> np.uint64(8 * place)) & np.uint64(255)).astype(np.intp)]
        return out

    def slices_of(self, values: np.ndarray) -> np.ndarray:
        """One row per value: the slices that hold any of its variants."""
        low = np.uint64((1 << self.slice_bits) - 1)
        return (self.code(values) & low)[:, None] ^ np.unique(self.code(self.masks) & low)[None, :]

    def links(self, values: np.ndarray, slice_no: int) -> np.ndarray:
        """Links of a spanning forest of what meets in one slice, as pairs of places in ``values`` (distinct)."""
        n = len(values)
        more = max(0, int(np.ceil(np.log2(max(1, n * len(self.masks) / (STEP_VARIANTS << self.slice_bits))))))
        low = np.uint64((1 << (self.slice_bits + more)) - 1)
        codes, mask_codes = self.code(values) & low, self.code(self.masks) & low
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        masks_by = {int(c): self.masks[mask_codes == c] for c in np.unique(mask_codes)}
        parent = np.arange(n)
        for step in range(1 << more):
            target = np.uint64(slice_no | step << self.slice_bits)
            wanted = np.array(list(masks_by), np.uint64) ^ target
            lo, hi = np.searchsorted(codes, wanted), np.searchsorted(codes, wanted, side="right")
            made, owner = [], []
            for c, a, b in zip(masks_by, lo.tolist(), hi.tolist()):
                if a < b:
                    who, masks = order[a:b], masks_by[c]
                    made.append((values[who][:, None] ^ masks[None, :]).ravel())
                    owner.append(np.repeat(who, len(masks)))
            if not made:
                continue
            variants, owner = np.concatenate(made), np.concatenate(owner)
            by = np.argsort(variants)
            variants, owner = variants[by], owner[by]
            same = np.flatnonzero(variants[1:] == variants[:-1]) + 1
            if not len(same):
                continue
            head = np.ones(len(variants), bool)
            head[same] = False
            first = owner[np.maximum.accumulate(np.where(head, np.arange(len(variants)), 0))[same]]
            pairs = np.unique(np.stack([first, owner[same]], 1), axis=0)
            apart = np.bitwise_count(values[pairs[:, 0]] ^ values[pairs[:, 1]])
            merge(parent, pairs[(apart <= self.radius) & (pairs[:, 0] != pairs[:, 1])])
        root = parent
        joined = np.flatnonzero(root != np.arange(n))
        return np.stack([joined, root[joined]], 1)


def merge(parent: np.ndarray, pairs: np.ndarray) -> None:
    """Join the ends of ``pairs`` in ``parent``, where every node points at the smallest of its group."""
    while len(pairs):
        a, b = parent[pairs[:, 0]], parent[pairs[:, 1]]
        apart = a != b
        pairs, a, b = pairs[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent[:] = up


def near_pairs(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect every two at most ``radius`` bits apart.

    A forest per slice: within a slice, what meets directly or over others is joined by as few links as needed, each
    between members of one component of the whole link relation."""
    n = fps.count()
    ball = Ball(radius, 0)
    wanted = max(LEAST_SLICES, n * len(ball.masks) // SLICE_VARIANTS)
    bits = int(np.ceil(np.log2(wanted)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ball(radius, bits)
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                part = values[at:at + 4096]
                to = own.slices_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.ravel().astype(np.int64)), pa.array(np.repeat(part, to.shape[1]))], names=["slice", "fp"])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(rows["fp"].to_numpy(np.int64))
        found = Ball(radius, bits).links(values.view(np.uint64), int(key[0]))
        return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})

    dealt = fps.mapInArrow(deal, "slice long, fp long")
    return dealt.groupBy("slice").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id, keeper) for every row of ``docs``.

    component_id is the smallest doc_id that links reach; keeper is true in the one row of each group that stands for it,
    by smallest doc_id (rows without an id last), then text hash; rows equal in both are keepers together."""
    rows = cut_lineage(fingerprints(docs, words_per_shingle, id_col, text_col), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    groups = cut_lineage(rows.groupBy("fp").agg(best.alias("best")), "groups")  # copies collapse map-side
    root = components(near_pairs(groups.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    named = groups.join(root, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("best").alias("best"))
    labels = cut_lineage(named.drop("best").join(smallest, "component").select("fp", "best"), "labels")
    keeper = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_key").eqNullSafe(F.col("best.text_key"))
    return rows.join(labels, "fp").select("doc_id", "text_key", "fp", F.col("best.doc_id").alias("component_id"),
                                          keeper.alias("keeper"))


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: one row of each."""
    kept = near_duplicates(docs, words_per_shingle, radius, id_col, text_col).where("keeper")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    mine = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__text": F.xxhash64(F.col(text_col))})
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    # after the join a kept row is alone but for exact repeats of it
    return mine.join(kept, same, "left_semi").dropDuplicates(["__doc", "__text"]).drop("__doc", "__text")
