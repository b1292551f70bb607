"""Secret scans with character Markov models, in DataFrame functions only.

Patterns find the secrets that announce themselves (assignments, access keys, hex digests). The rest is told by two
character-pair models, one of random strings and one of ordinary identifiers: a long run of key characters that no pattern
span overlaps is a secret if the log-likelihood ratio of the two models over its pairs reaches a threshold. Both models
are counted from labelled samples: values that the patterns find are random, the words outside of their spans ordinary.

Places are code points from 0, ends exclusive. Runs are found with patterns that cannot back up, so a long text costs one
pass for each kind.

Cases: null text is empty text and has no spans; whole texts are scanned whatever their length; overlapping spans of
different kinds all stay, model spans only where no pattern span is; repeated rows are scanned one by one; without samples
of either label the models say nothing and add nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeline.session import cut_lineage

#: The kinds in their order, with their patterns (letters of keywords in either case).
KINDS = ["assign", "access", "hex"]
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LEAST_VALUE = 6
#: Characters of keys, and the runs of them that the models judge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = 20
RUNS = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN},}}+"
WORDS = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}+"
#: Least ratio (nats a pair, and in sum) of a secret; weight of the fall-back in each row.
LEAST_MEAN, LEAST_SUM, SMOOTHING = 1.0, 20.0, 5.0

SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches, leftmost and non-overlapping; value is the match's ``group``."""
    gaps = F.split(text, pattern, -1)  # one more than matches: a text without any is passed over once
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.length).alias("gap"), F.transform(found, F.length).alias("size"), value.alias("value"))
    placed = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(a["spans"], F.struct(
            (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))).alias("spans")))
    return F.when(F.size(gaps) > 1, placed["spans"]).otherwise(F.array().cast(SPAN))


def pattern_spans(text: Column) -> list[Column]:
    """Spans of the three kinds, in the order of KINDS."""
    assign = F.filter(located(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return [assign, located(text, ACCESS), located(text, HEX)]


def outside(runs: Column, spans: Column) -> Column:
    """The runs (disjoint) that no span overlaps, by one fold over both in the order of their starts.

    (A lambda that refers to the other array would have it made anew for every element.)"""
    tag = lambda c, run: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(run).alias("run"), s["end"].alias("end"), s["value"].alias("value")))
    none = F.lit(None).cast("struct<start:int,end:int,value:string>")
    add = lambda a: F.when(a["open"].isNotNull(), F.array_append(a["kept"], a["open"])).otherwise(a["kept"])
    last = F.aggregate(
        F.array_sort(F.concat(tag(runs, True), tag(spans, False))),
        F.struct(F.lit(0).alias("covered"), none.alias("open"), F.array().cast(SPAN).alias("kept")),
        lambda a, x: F.when(x["run"], F.struct(
            a["covered"].alias("covered"),
            F.when(x["start"] >= a["covered"], F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).otherwise(none).alias("open"),
            add(a).alias("kept"))).otherwise(F.struct(
                F.greatest(a["covered"], x["end"]).alias("covered"),
                F.when(a["open"]["end"] > x["start"], none).otherwise(a["open"]).alias("open"), a["kept"].alias("kept"))),
        add)
    return F.when(F.size(runs) > 0, last).otherwise(F.array().cast(SPAN))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, random): labelled samples of all documents, so that one secret in however many is learned from."""
    mine = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    value = F.transform(F.concat(*pattern_spans(F.col("body"))), lambda s: s["value"])
    rest = F.col("body")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    return mine.select(F.explode(value).alias("value"), F.lit(True).alias("random")).unionByName(
        mine.select(F.explode(F.regexp_extract_all(rest, F.lit(WORDS), F.lit(0))).alias("value"), F.lit(False).alias("random")))


def ratios(labelled: DataFrame) -> DataFrame:
    """One row, ``ratio``: log-likelihood ratio (random over ordinary) of every pair of ALPHABET, flattened by rows.

    Counted over all samples with partial sums; the result has one entry per pair of the alphabet."""
    n = len(ALPHABET)
    chars = F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", "")
    pairs = labelled.groupBy("random", chars.alias("value")).count().where(F.length("value") >= 2).select("random", "count", F.explode(
        F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, 2))).alias("pair"))
    counts = cut_lineage(pairs.groupBy("pair").agg(F.sum(F.when(F.col("random"), F.col("count")).otherwise(0)).alias("r"),
                                                   F.sum(F.when(F.col("random"), 0).otherwise(F.col("count"))).alias("o")), "pairs")
    spark = labelled.sparkSession
    grid = spark.range(n * n).select(F.col("id").alias("cell"), F.concat(
        F.substring(F.lit(ALPHABET), F.floor(F.col("id") / n).cast("int") + 1, F.lit(1)),
        F.substring(F.lit(ALPHABET), (F.col("id") % n).cast("int") + 1, F.lit(1))).alias("pair"))
    full = grid.join(counts, "pair", "left").select("cell", F.floor(F.col("cell") / n).alias("row"), (F.col("cell") % n).alias("to"),
                                                    *(F.coalesce(c, F.lit(0)).alias(c) for c in "ro"))
    rows = full.groupBy("row").agg(F.sum("r").alias("row_r"), F.sum("o").alias("row_o"))
    next_ = full.groupBy("to").agg(F.sum("r").alias("to_r"), F.sum("o").alias("to_o"))
    sums = full.agg(F.sum("r").alias("all_r"), F.sum("o").alias("all_o"))

    def chance(c: str) -> Column:
        """Of the next character; pairs without evidence fall back on how common that character is."""
        common = (F.col(f"to_{c}") + 1) / (F.col(f"all_{c}") + n)
        return (F.col(c) + SMOOTHING * common) / (F.col(f"row_{c}") + SMOOTHING)

    cells = full.join(rows, "row").join(next_, "to").join(sums).select("cell", (F.log(chance("r")) - F.log(chance("o"))).alias("x"))
    known = counts.agg(F.coalesce((F.sum("r") > 0) & (F.sum("o") > 0), F.lit(False)).alias("known"))
    table = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "x"))), lambda c: c["x"]).alias("ratio"))
    return table.join(known).select(F.when(F.col("known"), F.col("ratio")).otherwise(F.transform("ratio", lambda _: F.lit(0.0))).alias("ratio"))


def log_ratio(value: Column, ratio: Column) -> Column:
    """Sum of the ratios of a string's character pairs, in one pass over its characters."""
    n = len(ALPHABET)
    place = lambda c: F.position(c, F.lit(ALPHABET)) - 1
    return F.aggregate(
        F.split(value, ""), F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda a, c: F.struct((a["sum"] + F.when(a["last"] >= 0, F.get(ratio, a["last"] * n + place(c))).otherwise(0.0)).alias("sum"), place(c).alias("last")),
        lambda a: a["sum"])


def scan(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random) for every row: arrays of spans (start, end, value) by kind; no shuffle.

    ``model`` is the one row of ratios()."""
    mine = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    assign, access, hex_ = pattern_spans(F.col("body"))
    base = mine.select("doc_id", assign.alias("assign"), access.alias("access"), hex_.alias("hex"), located(F.col("body"), RUNS).alias("runs"))
    held = base.join(F.broadcast(model))  # one row
    score = lambda s: log_ratio(s["value"], F.col("ratio"))
    likely = F.filter("runs", lambda s: score(s) >= F.greatest(F.lit(LEAST_SUM), LEAST_MEAN * (F.length(s["value"]) - 1)))
    return held.select("doc_id", "assign", "access", "hex", outside(likely, F.concat("assign", "access", "hex")).alias("random"))


def listed(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans by start, then kind in the order given, comma-joined."""
    def named(order: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*(named(i, k, c) for i, (k, c) in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
