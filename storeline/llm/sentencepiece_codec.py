"""SentencePiece encoding and decoding by suffix-array matching.

Encoding indexes the concatenated text of a batch: its units (white space and the word behind it, each distinct unit once)
are written one behind the other, the suffixes are sorted to the length of the longest piece, and a binary search of every
piece gives the range of places where it occurs. The resulting edges (start, end, piece) are sorted by position and
relaxed from left to right, all units in step: a unigram model keeps the best score at each position; a BPE model keeps
the one piece whose merge order is compatible with the piece before it, which is exactly what merging the pairs of the
unit in rank order leaves. Characters that no piece covers fall back to bytes (or to the unknown piece).

Units are independent because no piece of the model goes on behind white space that follows other text, which is checked
when the model is opened; so are line ends that no piece contains, and the parts of a unit between two characters that no
piece holds side by side (a word and the comma behind it), so equal parts are indexed once. Runs of white space, whose pieces share one score, are
merged on their own by the library's order (leftmost first).

Cases: null text encodes as empty (no pieces) and decodes to empty text; texts of white space, of characters unknown to
the model and of any length are whole; repeated rows are encoded one by one; an empty table gives an empty result; extra
columns are kept. Input is taken as it is: models with a normaliser that changes text are refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from storeline.llm.common import slices

SPACE = "▁"
#: Distinct units a worker remembers and their characters, characters split and indexed at a time (memory bounds; never
#: change a result).
REMEMBERED, HELD, SPLIT, INDEXED = 500_000, 8 << 20, 1 << 20, 1 << 18
UNITS = re.compile(" *[^ \n]+| +|\n").findall
NO_MERGE = 1 << 40


class PieceModel:
    """Pieces, scores and byte fallback of a SentencePiece model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode(" a  b ", out_type=str) and sp.decode(sp.encode(" À ﬁ  b ")) != " À ﬁ  b ":
            raise ValueError("models that normalise text are not supported")
        n = sp.vocab_size()
        self.kind, self.pieces = kind, [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.normal = [i for i in range(n) if not special[i]]
        self.ids = {self.pieces[i]: i for i in self.normal}
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.raw = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i)
                    else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        words = [p for p in self.ids if p.strip(SPACE) or p == SPACE]
        if any(SPACE in p.lstrip(SPACE) or p.startswith(2 * SPACE) or "\n" in p for p in words):
            raise ValueError("pieces that go on behind white space or a line end are not supported")
        self.dense = {c: k + 1 for k, c in enumerate(sorted({c for p in words for c in p}))}
        self.longest = max(map(len, words))
        self.words = np.array([self.ids[p] for p in words], np.int64)
        self.length = np.array([len(p) for p in words], np.int64)
        self.size_of = np.zeros(n, np.int64)
        self.size_of[self.words] = self.length
        chars = np.zeros((len(words), self.longest), np.int64)
        for i, p in enumerate(words):
            chars[i, :len(p)] = [self.dense[c] for c in p]
        self.chars = chars
        #: which two characters stand side by side in some piece
        self.inner = np.zeros((len(self.dense) + 1,) * 2, bool)
        for p in words:
            for c, d in zip(p, p[1:]):
                self.inner[self.dense[c], self.dense[d]] = True
        if kind == "bpe":
            self.order()

    def order(self) -> None:
        """Merge order: the rank of every piece and the two pieces that its own merging joins last."""
        n = len(self.pieces)
        by_score = sorted(self.words.tolist(), key=lambda i: -self.score[i])
        multi = [i for i in by_score if len(self.pieces[i]) > 1]
        if len({self.score[i] for i in multi}) < len(multi):
            raise ValueError("BPE pieces of equal score are not supported")
        self.rank = np.full(n, -1, np.int64)  # single characters come before every merge
        self.rank[multi] = np.arange(len(multi))
        self.left, self.right = np.arange(n), np.arange(n)
        reachable = np.zeros(n, bool)
        pairs, made = [], []
        for i in multi:
            split = self.last_merge(self.pieces[i])
            if split:
                self.left[i], self.right[i] = split
                reachable[i] = True
                pairs.append(split[0] << 32 | split[1])
                made.append(self.rank[i])
        singles = [i for i in by_score if len(self.pieces[i]) == 1]
        reachable[singles] = True
        self.reachable = reachable
        by = np.argsort(np.array(pairs, np.int64))
        self.pair_key, self.pair_rank = np.array(pairs, np.int64)[by], np.array(made, np.int64)[by]

    def last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces joined last when a piece's own characters are merged; None if they don't end up as the piece."""
        symbols = list(piece)
        while len(symbols) > 2:
            best = min(((-self.score[i], k) for k in range(len(symbols) - 1) if (i := self.ids.get(symbols[k] + symbols[k + 1])) is not None), default=None)
            if best is None:
                return None
            symbols[best[1]:best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        if len(symbols) == 2 and symbols[0] in self.ids and symbols[1] in self.ids:
            return self.ids[symbols[0]], self.ids[symbols[1]]
        return None

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_MERGE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b apart or together ends in the two pieces a, b.

        Undo merges from the latest on, always in the piece made later: no pair across the border may have been due before
        the merges that are still in place."""
        a, b, out = a.copy(), b.copy(), np.ones(len(a), bool)
        due = np.full(len(a), NO_MERGE)  # a merge across the border counts if its rank is below (on the right: not above)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.merge_rank(x, y) < due[live]
            out[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            whole = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = (v[~bad & ~whole] for v in (live, x, y, rx, ry))
            undo_left = rx > ry
            a[live[undo_left]] = self.right[x[undo_left]]
            due[live[undo_left]] = rx[undo_left]
            # a tie of ranks is the same piece made twice: the left one merges first
            b[live[~undo_left]] = self.left[y[~undo_left]]
            due[live[~undo_left]] = ry[~undo_left] + 1
        return out

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges (place, index of the piece) of all pieces in a text of dense characters (0: none), by suffix array."""
        # only pieces whose characters all occur can occur; few characters pack into few sort keys
        here = np.zeros(len(self.dense) + 1, np.int64)
        alphabet = np.unique(text[text > 0])
        here[alphabet] = np.arange(1, len(alphabet) + 1)
        can = np.flatnonzero((((here[self.chars] > 0) | (self.chars == 0)).all(axis=1)))
        chars, length = here[self.chars[can]], self.length[can]
        text = here[text]
        bits = max(1, len(alphabet).bit_length())
        per = 62 // bits
        n, depth = len(text), -(-self.longest // per)
        chars = np.concatenate([chars, np.zeros((len(can), depth * per), np.int64)], axis=1)
        long = np.concatenate([text, np.zeros(depth * per, np.int64)])
        keys = np.zeros((depth, n), np.int64)
        for d in range(depth):
            for j in range(per):
                keys[d] = keys[d] << bits | long[d * per + j:d * per + j + n]
        sa = np.lexsort(keys[::-1])
        sorted_keys = keys[:, sa]
        want = np.zeros((depth, len(can)), np.int64)
        top = np.zeros((depth, len(can)), np.int64)
        for d in range(depth):
            for j in range(per):
                c = chars[:, d * per + j]
                want[d] = want[d] << bits | c
                top[d] = top[d] << bits | np.where(c > 0, c, (1 << bits) - 1)
        lo, hi = np.zeros(len(can), np.int64), np.full(len(can), n, np.int64)
        for d in range(depth):
            need = length > d * per
            a, b = lo[need], hi[need]
            lo[need] = first_not(sorted_keys[d], a, b, want[d][need], False)
            hi[need] = first_not(sorted_keys[d], a, b, top[d][need], True)
        count = np.maximum(hi - lo, 0)
        piece = np.repeat(can, count)
        place = sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        return place, piece

    def split(self, units: list[str]) -> tuple[list[str], list[int]]:
        """Parts of all units one behind the other, and where each unit's begin: cut between characters that no piece holds side by
        side, where neither an edge nor a merge can go across."""
        size = np.array([len(u) for u in units], np.int64)
        joined = "".join(units)
        text = self.dense_text(joined)
        border = np.ones(len(text) + 1, bool)
        border[1:-1] = ~self.inner[text[:-1], text[1:]]
        begin = np.concatenate([[0], np.cumsum(size)])
        border[begin] = True
        cuts = np.flatnonzero(border)
        at = np.searchsorted(cuts, begin).tolist()
        cuts = cuts.tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:])], at

    def dense_text(self, joined: str) -> np.ndarray:
        """Dense numbers of the characters; 0 for those without a piece."""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        seen, back = np.unique(codes, return_inverse=True)
        get = self.dense.get
        return np.array([get(chr(c), 0) if c else 0 for c in seen.tolist()], np.int64)[back]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units one behind the other, and where each unit's begin; a unit has no white space but one sign at
        its start at most."""
        size = np.array([len(u) for u in units], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        joined = "\0".join(units) + "\0"
        text = self.dense_text(joined)
        place, piece = self.occurrences(text)
        ids = self.words[piece]
        if self.kind == "bpe":
            ok = self.reachable[ids]
            place, piece, ids = place[ok], piece[ok], ids[ok]
        end = place + self.length[piece]
        unit_of = np.repeat(np.arange(len(units)), size + 1)
        stop = end - begin[unit_of[place]]  # relaxed in step: by how far the edge ends from the start of its unit
        by = np.argsort(stop, kind="stable")
        cuts = np.searchsorted(stop[by], np.arange(int(size.max(initial=0)) + 2))
        n = len(text) + 1
        last, best = np.full(n, -1, np.int64), np.full(n, -np.inf)
        best[begin[:-1]] = 0
        outside = np.flatnonzero(text == 0)  # characters without a piece stand for themselves
        lone_by = np.argsort(outside - begin[unit_of[outside]], kind="stable")
        lone = outside[lone_by]
        lone_cut = np.searchsorted((outside - begin[unit_of[outside]])[lone_by], np.arange(int(size.max(initial=0)) + 2))
        low = self.score[self.words].min() - 10
        for p in range(1, int(size.max(initial=0)) + 1):
            out = lone[lone_cut[p - 1]:lone_cut[p]]
            last[out + 1], best[out + 1] = -2, best[out] + low
            mine = by[cuts[p]:cuts[p + 1]]
            if not len(mine):
                continue
            s, e, t = place[mine], end[mine], ids[mine]
            if self.kind == "bpe":
                free = (s == begin[unit_of[s]]) | (last[s] == -2)
                open_ = ~free & (last[s] >= 0)
                good = free.copy()
                where = np.flatnonzero(open_)
                good[where] = self.compatible(last[s[where]], t[where])
                last[e[good]] = t[good]
            else:
                value = best[s] + self.score[t]
                order = np.lexsort((value, e))
                s, e, t, value = s[order], e[order], t[order], value[order]
                final = np.append(e[1:] != e[:-1], True)
                final &= value > best[e]
                last[e[final]], best[e[final]] = t[final], value[final]
        # walk back from the ends of all units in step, then put the pieces in order
        places, taken = [], []
        at, to = begin[:-1] + size, begin[:-1]
        while True:
            at, to = at[at > to], to[at > to]
            if not len(at):
                break
            t = last[at]
            at = at - np.where(t < 0, 1, self.size_of[np.maximum(t, 0)])
            places.append(at)
            taken.append(t)
        place, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, taken))
        order = np.argsort(place)
        place, ids = place[order], ids[order]
        own = ids < 0
        spread = np.ones(len(ids), np.int64)
        instead = [self.fallback(joined[p]) for p in place[own].tolist()]
        spread[own] = [len(x) for x in instead]
        unit = np.repeat(unit_of[place], spread)
        flat = np.repeat(ids, spread)
        flat[np.repeat(own, spread)] = [i for x in instead for i in x]
        return flat.astype(np.int32), np.searchsorted(unit, np.arange(len(units) + 1))

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def decode(self, ids) -> str:
        """Text of piece ids: the sign that encoding puts first is taken away, broken bytes become U+FFFD."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def run_bytes(self, k: int) -> bytes:
        return np.array(self.space_run(k), np.int32).tobytes()

    def space_run(self, k: int) -> list[int]:
        """Pieces of k signs of white space: merged leftmost first, as all pieces of a run have one score."""
        if not k:
            return []
        size, after, before = [1] * k, list(range(1, k + 1)), list(range(-1, k - 1))
        is_piece = lambda m: SPACE * m in self.ids
        if SPACE not in self.ids:
            return self.fallback(SPACE) * k
        heap = list(range(k - 1)) if is_piece(2) else []
        heapify(heap)
        while heap:
            i = heappop(heap)
            if not size[i] or (j := after[i]) >= k or not is_piece(size[i] + size[j]):
                continue
            size[i], size[j] = size[i] + size[j], 0
            after[i] = after[j]
            if after[i] < k:
                before[after[i]] = i
                heappush(heap, i)
            if before[i] >= 0:
                heappush(heap, before[i])
        return [self.ids[SPACE * m] for m in size if m]


def first_not(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all ranges at once in keys that are sorted within each."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = keys[np.minimum(mid, len(keys) - 1)]
        go = open_ & ((at <= want) if after else (at < want))
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def chunks(texts: list[str], chars: int) -> Iterator[list[str]]:
    """``texts`` cut into lists of at most ``chars`` characters (one text at least)."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield texts[at:to]
        at = to


class Encoder:
    """Encodes batches of texts; remembers units and their parts."""

    def __init__(self, model: PieceModel):
        self.model, self.known, self.parts, self.held = model, {}, {}, 0

    def learn(self, units: set[str]) -> None:
        fresh = [u for u in units if u not in self.known]
        size = sum(map(len, fresh))
        if len(self.known) + len(fresh) > REMEMBERED or self.held + size > HELD:
            self.known.clear()
            self.parts.clear()
            fresh = list(units)
            self.held = size = sum(map(len, fresh))
        else:
            self.held += size
        for some in chunks(fresh, SPLIT):
            self.take(some)

    def index(self, parts: list[str]) -> None:
        """Encodes parts that are not known yet, INDEXED characters at a time."""
        for some in chunks(parts, INDEXED):
            flat, cut = self.model.encode_units(some)
            data, cut = flat.tobytes(), (4 * cut).tolist()
            self.parts.update(zip(some, [data[a:b] for a, b in zip(cut, cut[1:])]))

    def take(self, units: list[str]) -> None:
        m = self.model
        cores = [u.lstrip(" ") for u in units]
        spaces = [len(u) - len(c) for u, c in zip(units, cores)]
        cores = [SPACE + c if k and c else c for k, c in zip(spaces, cores)]
        parts, cut = m.split(cores)
        self.index([p for p in dict.fromkeys(parts) if p not in self.parts])
        coded = list(map(self.parts.__getitem__, parts))
        sign = np.int32(m.ids.get(SPACE, -1)).tobytes()
        ids = [coded[a] if b - a == 1 else b"".join(coded[a:b]) for a, b in zip(cut, cut[1:])]
        self.known.update(zip(units, ids))
        for i, k in enumerate(spaces):
            if k > 1 or k and not cores[i]:
                if not cores[i]:
                    whole = m.run_bytes(k)
                elif ids[i][:4] == sign:
                    whole = m.run_bytes(k) + ids[i][4:]  # the sign before the word has joined nothing: it is one of the run
                else:
                    whole = m.run_bytes(k - 1) + ids[i]
                self.known[units[i]] = whole

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 512):
            cut = [UNITS(" " + t.replace(SPACE, " ")) if t else [] for t in texts[at:at + 512]]
            self.learn(set(chain.from_iterable(cut)))
            out += [np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32) for units in cut]
        return out


@lru_cache(maxsize=4)
def opened(path: str, kind: str) -> Encoder:
    return Encoder(PieceModel(path, kind))


def _path(path: Callable[[], str] | str) -> str:
    return path() if callable(path) else path


def encode(docs: DataFrame, model_path: Callable[[], str] | str, kind: str = "bpe", text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """``docs`` with the piece ids of the whole text of every row in ``out_col`` (array of int); no shuffle."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = opened(_path(model_path), kind)
        for bodies in parts:
            yield pd.Series(encoder.encode([(b or b"").decode("utf-8", "replace") for b in bodies]), dtype=object)

    return docs.withColumn(out_col, run(F.col(text_col).cast("binary")))


def decode(rows: DataFrame, model_path: Callable[[], str] | str, ids_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the piece ids of ``ids_col`` in ``out_col``; null ids decode to empty text."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = opened(_path(model_path), "decode").model
        for column in parts:
            yield pd.Series([model.decode(ids if ids is not None else ()) for ids in column], dtype=object)

    return rows.withColumn(out_col, run(ids_col))


def round_trip(docs: DataFrame, model_path: Callable[[], str] | str, kind: str = "bpe", text_col: str = "text",
               out_col: str = "pieces", decoded_col: str = "decoded") -> DataFrame:
    """decode(encode(docs)) in one pass: both columns from the same Python worker, a few MB of text at a time."""
    names = docs.columns
    body = f"c{names.index(text_col)}"
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = StructType([*plain.schema.fields, StructField("pieces", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(_path(model_path), kind)
        for b in slices(batches, body, 2 << 20):
            texts = [(x or b"").decode("utf-8", "replace") for x in b.column(body).cast(pa.binary()).to_pylist()]
            pieces = encoder.encode(texts)
            ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces)))
            decoded = pa.array([encoder.model.decode(p.tolist()) for p in pieces], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, lists, decoded], names=[*b.schema.names, "pieces", "decoded"])

    return plain.mapInArrow(run, schema).toDF(*names, out_col, decoded_col)
