"""License scans: exact phrases, and short notices found with a bounded number of errors.

A text is read as its words (letters, digits and signs beyond ASCII; A-Z lower-cased) joined by one space each. Base places
are where a phrase's words stand one behind the other. Each notice of ``NOTICES`` is also searched with up to e edits of
characters (e grows with its length): cut into e + 1 pieces, at least one piece of any such match stands unchanged, so the
pieces are exact seeds. All seeds of all notices are found in one pass by a keyword automaton; each gives a window that
holds every match around it; overlapping windows of a notice are joined, and the regex library's bounded-error matching
looks for the notice between word borders inside them only. A match says how many edits it took, of which the score is made.

Cases: null text is empty text; texts without words have no spans; whole texts are read however long (a task holds one
text and its words at a time); repeated rows are scanned each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.llm.common import id_and_bytes, slices

#: Phrases whose exact places are the base, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices that are searched with errors, beside the phrases themselves; all in words joined by one space.
NOTICES = PHRASES | {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
#: One error is allowed for so many characters of a notice; shorter notices allow none and are base phrases only.
CHARS_PER_ERROR = 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def errors(notice: str) -> int:
    return len(notice) // CHARS_PER_ERROR


def pieces(notice: str) -> list[tuple[int, str]]:
    """(place, piece): the notice cut into errors + 1 pieces of like length."""
    n = errors(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def searcher(notices: tuple[tuple[str, str], ...]):
    """The automaton over all pieces, and the bounded-error pattern of every notice; built once a worker."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for which, (notice, _) in enumerate(notices):
        e = errors(notice)
        # words only begin and end at borders; an inserted character may be a space
        patterns.append(regex.compile(rf"(?<![^ ])(?:{re.escape(notice)}){{e<={e}}}(?![^ ])", regex.ENHANCEMATCH))
        for place, piece in pieces(notice) if e else ():
            seeds.setdefault(piece, []).append((which, place))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, patterns


def windows(norm: str, notices: tuple[tuple[str, str], ...]) -> dict[int, list[tuple[int, int]]]:
    """For each notice, the joined windows (start, end) of its seeds; a window holds every match that holds its seed."""
    automaton, _ = searcher(notices)
    found: dict[int, list[tuple[int, int]]] = {}
    for end, (size, uses) in automaton.iter(norm):
        for which, place in uses:
            e, start = errors(notices[which][0]), end + 1 - size - place
            found.setdefault(which, []).append((max(0, start - e), min(len(norm), start + len(notices[which][0]) + e)))
    out: dict[int, list[tuple[int, int]]] = {}
    for which, spans in found.items():
        spans.sort()
        joined = [spans[0]]
        for a, b in spans[1:]:
            if a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        out[which] = joined
    return out


def fuzzy_spans(norm: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the matches of every notice, from left to right without overlap."""
    _, patterns = searcher(notices)
    out = []
    for which, spans in windows(norm, notices).items():
        for a, b in spans:
            # the borders of the first and last word may lie just outside the window
            for m in patterns[which].finditer(norm, a, min(len(norm), b + 1)):
                if m.end() <= b:
                    out.append((which, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(out)


def base_spans(norm: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of every place where a phrase's words stand one behind the other."""
    out = []
    for phrase, label in PHRASES.items():
        at = norm.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or norm[at - 1] == " ") and (end == len(norm) or norm[end] == " "):
                out.append((at, end, label))
            at = norm.find(phrase, at + 1)
    return sorted(out)


def in_words(norm: str, text: str, spans: list[tuple]) -> list[dict]:
    """Spans (start, end, label, edits) of the joined words as words and as code points of the text itself."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at, word = [], 0, 0
    for start, end, label, edits in sorted(spans):
        word += norm.count(" ", at, start)
        at = start
        last = word + norm.count(" ", start, end)
        out.append({"label": label, "first_word": word, "last_word": last, "start": places[word][0], "end": places[last][1], "edits": edits})
    return out


def scan_text(body: bytes | None, notices: tuple[tuple[str, str], ...]) -> tuple[int, list[dict], list[dict], float]:
    """(words, base spans, further spans, score) of one text; the score is 1 - edits / (errors allowed + 1) of the best span."""
    text = (body or b"").lower().decode("utf-8", "replace")
    words = WORD.findall(text)
    norm = " ".join(words)
    base = base_spans(norm)
    fuzzy = fuzzy_spans(norm, notices)
    if not base and not fuzzy:
        return len(words), [], [], 0.0
    score = max([1.0] * bool(base) + [1 - edits / (errors(notices[which][0]) + 1) for which, _, _, edits in fuzzy])
    exact = {(a, b, label) for a, b, label in base}
    more = {(a, b, notices[which][1], edits) for which, a, b, edits in fuzzy if (a, b, notices[which][1]) not in exact}
    return len(words), in_words(norm, text, [(*s, 0) for s in base]), in_words(norm, text, list(more)), score


SPANS = "array<struct<label string, first_word long, last_word long, start long, end long, edits long>>"


def scan(docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, fuzzy, score) for every row: the spans of base phrases, the further spans of notices within
    their errors, each with label, first and last word, start and end (code points, end exclusive) and edits."""
    asked = tuple((NOTICES if notices is None else notices).items())
    struct = pa.list_(pa.struct([("label", pa.string()), *((c, pa.int64()) for c in ("first_word", "last_word", "start", "end", "edits"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            found = [scan_text(x, asked) for x in b.column("body").to_pylist()]
            n, base, fuzzy, score = zip(*found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, struct), pa.array(fuzzy, struct),
                                              pa.array(score, pa.float64())], names=["doc_id", "n_words", "base", "fuzzy", "score"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_words long, base {SPANS}, fuzzy {SPANS}, score double")
