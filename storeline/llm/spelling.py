"""Spelling variants by a relational trie frontier.

The vocabulary (every word with its number of occurrences) becomes two tries, one over the words and one over the reversed
words, held as one distributed edge table: (node, first character, label, child). Chains without a branch are one edge, and
an edge of the empty character marks the end of a word, so a trie has fewer than three edges a word however long words are. A
node is known by the sum of hashes of the (character, depth) pairs that lead to it; a collision can only add candidates, and
every pair is checked by its edit distance in the end.

A state (word, position, node, edits) says that the characters before ``position`` lead to ``node`` with so many edits. The
frontier starts with the zero-edit states, which are the nodes on a word's own path. Joining the edge table, a state may
leave its word's path with one edit, where the edge's first character is not the word's next one, so every neighbour is
met at one place only: the end of the longest common prefix. From then on one-edit states join the edge table level by
level and must match exactly; those that reach the end of their word at the end of a word are neighbours. A word leaves its
path only in its second half: a neighbour that differs in the first half is found by the reversed trie. So states start
deep in the tries, where nodes have few edges, and the frontier never holds a word once for every letter at the root. No
state is dropped and no group of words is compared with itself; a hot node's states are split by the skew join, as its
edges are bounded by the alphabet.

Cases: null text has no words; repeated rows and repeated ids count every time they occur; a null doc_id is written as
nothing where a run's checksum is taken; very long runs are words like any other; ties go to the smaller word in
code-point order; an empty table, or one without words, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeline.llm.common import id_and_bytes, slices, xor_fold
from storeline.session import cut_lineage

MIN_CHARS, MIN_COUNT = 5, 3
#: Distinct words a task holds before it hands on partial counts (memory bound; no effect on results).
HELD = 1 << 18
#: Size (bytes, estimated from counts) up to which the states are broadcast to the edges; beyond it both shuffle.
BROADCAST_BYTES = 32 << 20

# In Latin-1 the letters of both ranges are one byte each; bytes.lower() changes A-Z alone, and every other sign becomes "?".
RUN = re.compile(rb"[a-z\xc0-\xff]+")


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def occurrences(docs: DataFrame, misspell: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): partial counts of the letter runs of whole texts, A-Z lower-cased; one word may stand in several rows.

    ``misspell``: where it divides h, the crc32 of ``<doc_id>:<run>``, the run loses its character h % length. It plants
    typing errors in a corpus, the same ones whatever the partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for b in slices(batches, "body"):
            for doc_id, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                runs = RUN.findall((body or b"").decode("utf-8", "replace").encode("latin-1", "replace").lower())
                held.update(runs)
                if misspell:
                    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                    hit = [w for w in set(runs) if not zlib.crc32(w if w.isascii() else _utf8(w), start) % misspell]
                    if hit:
                        number = Counter(runs)
                        for w in hit:
                            at = zlib.crc32(_utf8(w), start) % len(w)
                            held[w] -= number[w]
                            held[w[:at] + w[at + 1:]] += number[w]
                if len(held) > HELD:
                    yield given()
                    held.clear()
        yield given()

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, misspell: int | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, **columns) -> DataFrame:
    """(word, n) of the distinct words of at least ``min_chars`` characters that occur at least ``min_count`` times."""
    parts = occurrences(docs, misspell, **columns).where(F.length("word") >= min_chars)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def half(length: Column | np.ndarray, backward: Column | np.ndarray):
    """First depth at which a word of this length may leave its path."""
    return (length + backward) // 2 if isinstance(length, np.ndarray) else F.floor((length + backward) / 2).cast("int")


def prefixes(words: DataFrame) -> DataFrame:
    """(word, n, backward, depth, node, next) for both directions: the prefixes of every word from half its length on, and
    one before, as words longer by one need that node too. ``next`` is the code of the character behind the prefix, 0 at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                texts = b.column("word").to_pylist()
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                for backward in (0, 1):
                    codes = np.frombuffer("".join(t[::-1] for t in texts).encode("utf-32-le") if backward else "".join(texts).encode("utf-32-le"), np.uint32)
                    starts = np.cumsum(size) - size
                    depth = np.arange(len(codes)) - np.repeat(starts, size)
                    mixed = xor_fold(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + depth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                    least = half(size - 1, np.full(len(size), backward))
                    many = size - least + 1
                    who = np.repeat(np.arange(len(texts)), many)
                    d = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[who]
                    place = starts[who] + d
                    node = sums[place] - sums[starts[who]] + np.uint64(backward)
                    after = np.where(d < size[who], np.append(codes, 0)[place], 0)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("word").take(pa.array(who)), b.column("n").take(pa.array(who)), pa.array(np.full(len(d), backward, np.int32)),
                         pa.array(d.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(after.astype(np.int32))],
                        names=["word", "n", "backward", "depth", "node", "next"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, backward int, depth int, node long, next int")


def paths(words: DataFrame) -> DataFrame:
    """(spelt, n, backward, path): the nodes on each word's path that branch or end a word, as (depth, node) in order.

    spelt is the word in the direction it is read."""
    seen = prefixes(words)
    forks = seen.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi")).where("lo < hi").select("node")
    ends = seen.where("next = 0").select("word", "n", "backward", "depth", "node")
    inner = seen.where("next <> 0").join(forks, "node", "left_semi").select("word", "n", "backward", "depth", "node")
    by_word = inner.unionByName(ends).groupBy("word", "n", "backward").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    return by_word.select(F.when(F.col("backward") == 0, F.col("word")).otherwise(F.reverse("word")).alias("spelt"), "n", "backward", "path")


def edge_table(routes: DataFrame) -> DataFrame:
    """(node, first, label, child, end, end_n, follows, left): one row per edge; the edge of the empty character ends the word ``end``.

    follows and left say what lies below the child: bit c % 64 for every first character c of its edges (0: a word ends), bit
    r (at most 62) for every word with r characters left. They may let through a state that ends one edge further on, but
    stop none that could reach the end of a word."""
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.struct(
        F.col("path")[i]["node"].alias("node"), F.col("path")[i]["depth"].alias("depth"),
        F.when(i + 1 < F.size("path"), F.substring("spelt", F.col("path")[i]["depth"] + 1, F.get("path", i + 1)["depth"] - F.col("path")[i]["depth"]))
        .otherwise(F.lit("")).alias("label"), F.get("path", i + 1)["node"].alias("child")))
    edges = routes.select("spelt", "n", F.explode(steps).alias("e")).select(
        "e.node", F.left("e.label", F.lit(1)).alias("first"), "e.label", "e.child",
        F.when(F.col("e.child").isNull(), F.struct(F.col("spelt").alias("end"), F.col("n").alias("end_n"))).alias("e"),
        F.expr("shiftleft(1L, least(length(spelt) - e.depth, 62))").alias("left"))
    one = edges.groupBy("node", "first").agg(*(F.first(c).alias(c) for c in ("label", "child", "e")), F.bit_or("left").alias("left"))
    one = cut_lineage(one.select("node", "first", "label", "child", "e.end", "e.end_n", "left"), "edges")
    below = one.groupBy(F.col("node").alias("child")).agg(F.bit_or(F.expr("shiftleft(1L, ascii(first) % 64)")).alias("follows"), F.bit_or("left").alias("left"))
    # ends of words have no child: kept out of the join, where they would all meet in one task
    one = one.drop("left")
    both = one.where("child is not null").join(below, "child", "left").unionByName(one.where("child is null"), allowMissingColumns=True)
    return both.select("node", "first", "label", "child", "end", "end_n", "follows", "left")


def rest(at: Column, size: Column) -> Column:
    return F.substring("spelt", at + 1, size)


def alive(at: str) -> Column:
    """Whether the child of the edge at hand may lead a state at place ``at`` to the end of a word."""
    return F.expr(f"child IS NULL OR (shiftright(left, least(length(spelt) - {at}, 62)) & 1 = 1 "
                  f"AND shiftright(follows, ascii(substring(spelt, {at} + 1, 1)) % 64) & 1 = 1)")


def left_path(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """One-edit states right behind the edge by which they left their word's path, and the neighbours met there."""
    own = routes.select("spelt", "n", "backward", F.explode("path").alias("p")).where(
        F.col("p.depth") >= half(F.length("spelt"), F.col("backward"))).select("spelt", "n", "backward", F.col("p.depth").alias("at"), "p.node")
    met = own.join(edges, "node").where(F.col("first") != rest(F.col("at"), F.lit(1)))
    size, at, tail, left = F.length("label"), F.col("at"), F.substring("label", 2, 1 << 30), F.length("spelt") - F.col("at")
    replaced = (size > 0) & (left >= size) & (tail == rest(at + 1, size - 1))
    inserted = (size > 0) & (left >= size - 1) & (tail == rest(at, size - 1))
    # the end of a word is an edge without a label: it may only take the place of the word's last character
    deleted = (left > F.when(size > 0, size).otherwise(F.lit(0))) & (F.col("label") == rest(at + 1, size)) & ((size > 0) | (left == 1))
    states = F.array(F.when(replaced, at + size), F.when(inserted, at + size - 1), F.when(deleted, at + 1 + size))
    to = met.withColumn("to", F.explode(F.filter(states, lambda x: x.isNotNull()))).where(alive("to"))
    return to.select("spelt", "n", "backward", F.col("to").alias("at"), F.col("child").alias("node"), "end", "end_n")


def one_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One-edit states one edge further, without another edit."""
    there = states.select("spelt", "n", "backward", "at", "node", rest(F.col("at"), F.lit(1)).alias("first"))
    moved = there.join(edges, ["node", "first"]).where(F.col("label") == rest(F.col("at"), F.length("label")))
    moved = moved.withColumn("to", F.col("at") + F.length("label")).where(alive("to"))
    return moved.select("spelt", "n", "backward", F.col("to").alias("at"), F.col("child").alias("node"), "end", "end_n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words that differ by one inserted, deleted or replaced character.

    ``words``: distinct words and their counts, (word, n)."""
    routes = cut_lineage(paths(words), "paths")
    edges = cut_lineage(edge_table(routes), "edges")
    level = cut_lineage(left_path(routes, edges), "level")
    found = level.where("end is not null")
    while True:
        open_ = level.where("end is null")
        n, size = open_.agg(F.count(F.lit(1)), F.sum(F.length("spelt"))).first()
        if not n:
            break
        # the deeper, the fewer states: below the bound the edge table stays where it is
        open_ = F.broadcast(open_) if 64 * n + 2 * size <= BROADCAST_BYTES else open_
        level = cut_lineage(one_level(open_, edges), "level")
        found = found.unionByName(level.where("end is not null"))
    way = lambda c: F.when(F.col("backward") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = found.select(way("spelt").alias("word"), "n", way("end").alias("near"), F.col("end_n").alias("near_n"), "backward")
    # what both tries find counts once: the forward one finds all neighbours that share the first half
    both = F.floor(F.length("word") / 2).cast("int")
    twice = (F.col("backward") == 1) & (F.left("word", both) == F.left("near", both))
    return pairs.where(~twice & (F.expr("levenshtein(word, near, 1)") == 1)).drop("backward")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): the last word that forms lead to, by pointer jumping.

    Forms must not run in circles (here every form is more frequent than its word)."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = cut_lineage(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                 F.col("further").isNotNull().alias("moved")), "roots")
        now = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word: its form is the most frequent neighbour, if that occurs at least
    ``times`` as often as the word; root is where forms lead to."""
    words = cut_lineage(words.select("word", "n"), "words")
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    known = words.join(near, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    known = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "known")
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
