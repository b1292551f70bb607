"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pretokens by the byte-level pattern; each pretoken starts as one symbol per byte, and a heap hands out
the adjacent pair of lowest merge rank (leftmost first) until no pair is left. Symbols form a linked list over array
positions, so a merge is two pointer writes and at most two new heap entries: n log n for a pretoken of n bytes, however
long. The count is the initial symbols minus the merges; no identifiers are emitted.

Cases: null text counts as empty (0 bytes, 0 tokens); strings of the vocabulary's special tokens inside a text count as one
token each, as the library does by default; repeated rows are counted one by one; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from storeline.llm.common import id_and_bytes, slices

# The byte-level pretoken pattern of the vocabulary's library, white space by its Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

SPACED = re.compile(r" (?:\s|\Z)").search
SPLIT = re.compile(r" (?=\S)").split

#: Distinct pretokens a worker remembers before it starts afresh (memory bound; never changes a count).
REMEMBERED = 600_000


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: printable Latin-1 as is, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class MergeCounter:
    """Counts tokens with a byte-level BPE vocabulary file (the JSON form of the ``tokenizers`` library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        number: dict[str, int] = {c: b for b, c in enumerate(byte_alphabet())}
        for a, b in pairs:
            number.setdefault(a + b, len(number))
        self.bits = max(17, len(number).bit_length())
        #: (left symbol, right symbol) -> (rank, symbol made), packed into integers
        self.merges = {(number[a] << self.bits) | number[b]: (rank << self.bits) | number[a + b] for rank, (a, b) in enumerate(pairs)}
        self.first = [self.merges.get(((p >> 8) << self.bits) | (p & 255), -1) for p in range(1 << 16)]
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.known = _Remembered(lambda pretoken: self.merged(pretoken.encode("utf-8", "surrogatepass")))
        self.inner = _Remembered(lambda unit: sum(map(self.known.__getitem__, self.pretokens(" " + unit))))

    def merged(self, data: bytes) -> int:
        """Symbols that are left of one pretoken when no adjacent pair can merge."""
        n = len(data)
        if n < 2:
            return n
        first = self.first
        place = n.bit_length()
        made = [first[a << 8 | b] for a, b in zip(data, data[1:])]  # by left place: rank and symbol made, -1 if none
        heap = [(m << place) | i for i, m in enumerate(made) if m >= 0]
        if not heap:
            return n
        heapify(heap)
        get, bits = self.merges.get, self.bits
        low, mask = (1 << bits) - 1, (1 << place) - 1
        symbol = list(data)
        made.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            i = top & mask
            m = top >> place
            if made[i] != m:
                continue  # an entry of a pair that has changed since
            left -= 1
            j = after[i]
            made[j] = -1
            after[i] = k = after[j]
            symbol[i] = s = m & low
            if k < n:
                before[k] = i
                made[i] = m = get((s << bits) | symbol[k], -1)
                if m >= 0:
                    heappush(heap, (m << place) | i)
            else:
                made[i] = -1
            h = before[i]
            if h >= 0:
                made[h] = m = get((symbol[h] << bits) | s, -1)
                if m >= 0:
                    heappush(heap, (m << place) | h)
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. A pretoken starts at every space before a character that is not white
        space, whatever stands on either side, so the text falls into units there, which repeat and are remembered."""
        units = SPLIT(text) if SPACED(text) else text.split(" ")
        inner = self.inner
        return sum(map(self.known.__getitem__, self.pretokens(units[0]))) + sum(map(inner.__getitem__, units[1:]))

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


class _Remembered(dict):
    """Counts of pieces of text seen by this worker."""

    def __init__(self, counted: Callable[[str], int]):
        super().__init__()
        self.counted = counted

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.counted(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: Callable[[], str] | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; no shuffle.

    ``tokenizer_path`` is a path, or a function that returns it and is called on the executors (where the vocabulary file
    of an installed package lies at a place of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path() if callable(tokenizer_path) else tokenizer_path).count
        for b in slices(batches, "body"):
            bodies = [x or b"" for x in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, bodies), pa.int64()),
                 pa.array([count(x.decode("utf-8", "replace")) for x in bodies], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
