"""Substring dedup: passages that already stand in an earlier document are cut, found with FM-indexes per shard.

Documents are cut into slices of bounded size, stored with the places of their segments. Every window of ``window`` words belongs to the shard of its minimiser (the
word triple of least hash in it), so equal windows meet in one shard and no shard has to be compared with another; runs of
windows with one minimiser travel together as a segment, equal segments of a slice once, with the smallest and largest
doc_id they stand in. A shard indexes the segments whose minimiser occurs in more than one document: suffix array,
Burrows-Wheeler transform, and a wavelet matrix of packed bits with popcount ranks. All its segments then stream through
the index: backward search extends every window word by word and gives up where only one place is left, so what reaches
the threshold are the windows that repeat, with the range of their places and so the smallest doc_id that has them. The
findings go back to the slices they came from, where each document drops the words of windows with an earlier document.

A hot passage costs a shard one segment per slice and not one per document; slices and shards are bounded in size.

Cases: null, empty and short texts (fewer words than a window) lose nothing; a document never loses words to itself, so a
passage that repeats inside one document only stays; rows that repeat a doc_id don't count as earlier than each other;
rows with a null doc_id lose nothing and count as earlier than none; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.llm.common import keyed_bytes, slices, xor_fold
from storeline.session import cut_lineage

WINDOW, GRAM = 13, 3
SLICE_BYTES = 8 << 20
#: Text bytes whose segments a shard should hold at most, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64
REMEMBERED = 400_000
#: Of compression: what is stored and shuffled is mostly text.
LEVEL = 6


class _Hashes(dict):
    """64-bit hashes of the words seen by this worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def segments(texts: list[bytes], has_id: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of a slice of documents, runs of windows that share a minimiser: first word (counted through the slice), words,
    content (numbered as they come; equal texts have one number), and the minimiser of each content (44 bits)."""
    words = [t.split() for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    n, none = len(flat), np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    h = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, n)
    gram = np.zeros(n, np.uint64)
    for j in range(GRAM):
        gram[:n - j] += h[j:] * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x632BE59B)
    gram = xor_fold(gram)
    low, span, count = np.uint64(4095), window - GRAM + 1, n - window + 1
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for j in range(span):  # least triple of each window, leftmost on ties
        np.minimum(least, (gram[j:j + count] & ~low) | np.uint64(j), out=least)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero((doc[:count] == doc[window - 1:]) & has_id[doc[:count]])
    if not len(at):
        return none, none, none, none
    least = least[at]
    place = at + (least & low).astype(np.int64)
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    heads = np.flatnonzero(fresh)
    start = at[heads]
    end = at[np.concatenate([heads[1:], [len(at)]]) - 1] + window
    text = b"\n".join(texts)
    begins, ends = word_bytes(text)
    number: dict[bytes, int] = {}
    content = np.fromiter((number.setdefault(text[x:y], len(number)) for x, y in zip(begins[start].tolist(), ends[end - 1].tolist())),
                          np.int64, len(heads))
    return start, end - start, content, (least[heads][first_places(content)] >> np.uint64(20)).astype(np.int64)


def word_bytes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end; they are parted by blanks and line ends only."""
    gap = np.frombuffer(b" " + text + b" ", np.uint8)
    gap = (gap == 32) | (gap == 10)
    return np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1


def first_places(content: np.ndarray) -> np.ndarray:
    """Where each number comes first, for numbers given out as they come."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(content), prepend=-1) > 0)


class Slice:
    """A stored slice of documents: ids, whole texts (words joined by one blank) and segments; their lengths and minimisers stand
    apart, as only the deal needs them."""

    def __init__(self, blob: bytes, marks: bytes | None = None):
        (self.ids, no_id, self.keys, start, content), self.text = unpack(blob)
        self.length, self.minimiser = unpack(marks)[0] if marks else (None, None)
        self.has_id, self.start, self.content = no_id == 0, np.cumsum(start), np.cumsum(content)
        self.texts = self.text.split(b"\n")
        self.doc_start = np.cumsum([0, *(t.count(b" ") + 1 if t else 0 for t in self.texts)])
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1

    @staticmethod
    def stored(ids: np.ndarray, no_id: np.ndarray, keys: np.ndarray, texts: list[bytes], window: int) -> tuple[bytes, bytes]:
        start, length, content, minimiser = segments(texts, ~no_id, window)
        return pack(ids, no_id, keys, np.diff(start, prepend=0), np.diff(content, prepend=0), text=b"\n".join(texts)), pack(length, minimiser)

    def segment_texts(self) -> list[bytes]:
        """The text of every content."""
        first = first_places(self.content)
        begins, ends = word_bytes(self.text)
        a, b = begins[self.start[first]], ends[self.start[first] + self.length[first] - 1]
        return [self.text[x:y] for x, y in zip(a.tolist(), b.tolist())]


def pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(a.astype(np.int64).tobytes() for a in arrays) + text)


def unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, k, 8)
    at, out = 8 * (k + 1), []
    for n in sizes.tolist():
        out.append(np.frombuffer(data, np.int64, n, at))
        at += 8 * n
    return out, data[at:]


class FMIndex:
    """Burrows-Wheeler transform of a word sequence in a wavelet matrix: backward search with packed bits."""

    def __init__(self, words: np.ndarray, depth: int):
        """words: numbers from 1 on, 0 between texts; suffixes are told apart to ``depth`` words at least."""
        n = len(words)
        sigma = int(words.max()) + 1
        bits = max(1, (sigma - 1).bit_length())
        per = max(1, 62 // bits)
        rank = np.zeros(n, np.int64)
        for j in range(per):
            rank <<= bits
            if j < n:
                rank[:n - j] |= words[j:]
        h = per
        while True:
            order = np.argsort(rank, kind="stable")
            key = rank[order]
            fresh = np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(fresh)
            if h >= depth or dense[order[-1]] == n - 1:
                break
            rank = (dense + 1) * (n + 2)
            if h < n:
                rank[:n - h] += dense[h:] + 1
            h *= 2
        self.sa, self.n = order, n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=sigma))])
        left = words[order - 1]
        self.levels = []
        for b in range(bits - 1, -1, -1):
            on = (left >> b) & 1 == 1
            packed = np.packbits(on, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = n - int(ones[-1])
            self.levels.append((b, packed, ones, zeros))
            left = np.concatenate([left[~on], left[on]])
        self.zero_of = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place at the bottom of the wavelet matrix of prefix length i, for each word."""
        for b, packed, ones, zeros in self.levels:
            block, bit = i >> 6, (i & 63).astype(np.uint64)
            r = ones[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << bit) - np.uint64(1)))
            i = np.where((word >> b) & 1 == 1, zeros + r, i - r)
        return i

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that start with ``word`` and go on with what [lo, hi) start with."""
        base = self.before[word] - self.zero_of[word]
        return base + self.descend(word, lo), base + self.descend(word, hi)


def repeated_windows(words: np.ndarray, starts: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows (by start) that stand at two or more places, with the suffix ranges of each: matching statistics at the
    threshold, by streaming all windows backwards through the index of all words."""
    index = FMIndex(words, window)
    for at in range(0, len(starts), 1 << 20):
        live = starts[at:at + (1 << 20)]
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
        for t in range(window - 1, -1, -1):
            lo, hi = index.extend(words[live + t], lo, hi)
            more = hi - lo > 1  # one place is the window's own
            live, lo, hi = live[more], lo[more], hi[more]
        if len(live):
            yield index.sa, np.stack([live, lo, hi])


def match_shard(blobs: list[tuple[int, bytes]], window: int) -> list[tuple[int, bytes]]:
    """Findings of one shard by slice: (content, offset of the window in it, smallest doc_id that has the window)."""
    parts = [(s, *unpack(b)) for s, b in blobs]
    minimiser = np.concatenate([a[0] for _, a, _ in parts])
    first = np.concatenate([np.cumsum(a[1]) for _, a, _ in parts])
    last = first + np.concatenate([a[2] for _, a, _ in parts])
    _, group = np.unique(minimiser, return_inverse=True)
    least, most = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, group, first)
    np.maximum.at(most, group, last)
    chosen = (least < most)[group]  # its minimiser occurs in more than one document
    if not chosen.any():
        return []
    by_text: dict[bytes, int] = {}
    flat, sizes, member_of = [], [], []  # equal segments of several slices are indexed once
    at = 0
    for _, a, text in parts:
        for line in compress(text.split(b"\n"), chosen[at:at + len(a[0])].tolist()):
            i = by_text.setdefault(line, len(sizes))
            if i == len(sizes):
                ws = line.split(b" ")
                sizes.append(len(ws) + 1)
                flat += ws
                flat.append(b"")
            member_of.append(i)
        at += len(a[0])
    number = {b"": 0}
    words = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    del flat, by_text
    sizes = np.array(sizes, np.int64)
    seg_of = np.repeat(np.arange(len(sizes)), sizes)
    seg_start = np.cumsum(sizes) - sizes
    member_of, flat_members = np.array(member_of, np.int64), np.flatnonzero(chosen)
    own_first, own_last = np.full(len(sizes), np.iinfo(np.int64).max), np.full(len(sizes), np.iinfo(np.int64).min)
    np.minimum.at(own_first, member_of, first[flat_members])
    np.maximum.at(own_last, member_of, last[flat_members])
    doc_of = own_first[seg_of]
    found_seg, found_off, found_doc = [], [], []
    left = np.repeat(seg_start + sizes, sizes) - np.arange(len(words))
    starts = np.flatnonzero(left > window)  # of whole windows: so many words and the sign behind the segment are left
    seen = np.zeros(len(words), bool)
    for sa, (live, lo, hi) in repeated_windows(words, starts, window):
        ranges, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
        docs = np.append(doc_of[sa], np.iinfo(np.int64).max)
        smallest = np.minimum.reduceat(docs, ranges.ravel())[::2][which.ravel()]
        s = seg_of[live]
        seen[live] = True
        found_seg.append(s), found_off.append(live - seg_start[s]), found_doc.append(smallest)
    # windows at one place only, in a segment that several documents have
    alone = starts[~seen[starts]]
    alone = alone[(own_first < own_last)[seg_of[alone]]]
    s = seg_of[alone]
    found_seg.append(s), found_off.append(alone - seg_start[s]), found_doc.append(own_first[s])
    s, off, small = (np.concatenate(x) for x in (found_seg, found_off, found_doc))
    keep = small < own_last[s]
    s, off, small = s[keep], off[keep], small[keep]
    # back to the slices: every member of a segment that has a later document than the window's first
    slice_no = np.repeat(np.arange(len(parts)), [len(a[0]) for _, a, _ in parts])
    content = np.concatenate([np.cumsum(a[3]) for _, a, _ in parts])
    counts = np.bincount(member_of, minlength=len(sizes))
    flat_members = flat_members[np.argsort(member_of, kind="stable")]
    begin = np.cumsum(counts) - counts
    rep = counts[s]
    who = flat_members[np.repeat(begin[s], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)]
    off, small = np.repeat(off, rep), np.repeat(small, rep)
    keep = small < last[who]
    who, off, small = who[keep], off[keep], small[keep]
    to = slice_no[who]
    return [(parts[k][0], pack(content[who[to == k]], off[to == k], small[to == k])) for k in np.unique(to).tolist()]


def cut_slice(mine: Slice, findings: list[bytes], window: int) -> list[tuple[int, int, bytes]]:
    """(words, words removed, kept text) of each document of a slice."""
    n = int(mine.doc_start[-1])
    edge = np.zeros(n + 1, np.int64)
    if findings and len(mine.content):
        content, off, small = (np.concatenate(x) for x in zip(*(unpack(f)[0] for f in findings)))
        by = np.argsort(mine.content, kind="stable")
        bound = np.searchsorted(mine.content[by], np.arange(int(mine.content.max()) + 2))
        rep = (bound[1:] - bound[:-1])[content]
        seg = by[np.repeat(bound[content], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)]
        off, small = np.repeat(off, rep), np.repeat(small, rep)
        hit = small < mine.ids[mine.doc[seg]]
        at = mine.start[seg[hit]] + off[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge)[:n] > 0
    out = []
    for text, a, b in zip(mine.texts, mine.doc_start[:-1].tolist(), mine.doc_start[1:].tolist()):
        cut = int(np.count_nonzero(gone[a:b]))
        out.append((b - a, cut, b" ".join(compress(text.split(b" "), (~gone[a:b]).tolist())) if cut else text))
    return out


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, n_removed, kept) for every row: kept holds the words that stay, joined by a space."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for b in slices(batches, "body", SLICE_BYTES):
            ids = b.column("doc_id")
            texts = [b" ".join((x or b"").split()) for x in b.column("body").to_pylist()]
            blob, marks = Slice.stored(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column("text_key").to_numpy(),
                                       texts, window)
            yield pa.RecordBatch.from_arrays([pa.array([base | k], pa.int64()), pa.array([blob], pa.binary()), pa.array([marks], pa.binary()),
                                              pa.array([sum(map(len, texts))], pa.int64())], names=["slice", "blob", "marks", "bytes"])
            k += 1

    table = cut_lineage(keyed_bytes(docs, id_col, text_col).mapInArrow(sliced, "slice long, blob binary, marks binary, bytes long"), "slices")
    total = table.agg(F.sum("bytes")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slice_no, blob, marks in zip(*(b.column(c).to_pylist() for c in ("slice", "blob", "marks"))):
                mine = Slice(blob, marks)
                n = len(mine.minimiser)
                if not n:
                    continue
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
                np.minimum.at(first, mine.content, mine.ids[mine.doc])
                np.maximum.at(last, mine.content, mine.ids[mine.doc])
                texts = mine.segment_texts()
                to = mine.minimiser % shards
                by = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[by], np.arange(shards + 1))
                for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    ours = by[cuts[s]:cuts[s + 1]]
                    packed = pack(mine.minimiser[ours] // shards, np.diff(first[ours], prepend=0), last[ours] - first[ours], np.diff(ours, prepend=0), text=b"\n".join([texts[i] for i in ours.tolist()]))
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([slice_no], pa.int64()), pa.array([packed], pa.binary())],
                                                     names=["shard", "slice", "blob"])

    def match(group: pa.Table) -> pa.Table:
        found = match_shard(list(zip(group.column("slice").to_pylist(), group.column("blob").to_pylist())), window)
        return pa.table({"slice": pa.array([s for s, _ in found], pa.int64()), "blob": pa.array([b for _, b in found], pa.binary())})

    def cut(mine: pa.Table, found: pa.Table) -> pa.Table:
        out = {"doc_id": [], "text_key": [], "n_words": [], "n_removed": [], "kept": []}
        for blob in mine.column("blob").to_pylist():
            own = Slice(blob)
            done = cut_slice(own, found.column("blob").to_pylist(), window)
            out["doc_id"] += [i if ok else None for i, ok in zip(own.ids.tolist(), own.has_id.tolist())]
            out["text_key"] += own.keys.tolist()
            for name, values in zip(("n_words", "n_removed", "kept"), zip(*done)):
                out[name] += values
        kinds = {"kept": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    shards_of = table.select("slice", "blob", "marks").mapInArrow(deal, "shard long, slice long, blob binary")
    findings = shards_of.groupBy("shard").applyInArrow(match, "slice long, blob binary")
    out = table.select("slice", "blob").groupBy("slice").cogroup(findings.groupBy("slice")).applyInArrow(
        cut, "doc_id long, text_key long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
