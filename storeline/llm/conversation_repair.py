"""Conversation repair: the cheapest edits that give a conversation the role order of ``(s?(ua)+)?``.

A conversation's rows, by turn, are faulty where they are blank, repeat an earlier row, or end without a stop. Edits keep a
row, give it another role, delete it (which blank and repeated rows need) or insert an empty turn; the cheapest ones win, and
of equally cheap ones those whose audit (initials of the edits in order) comes first in ASCII.

Method: Wagner-Fischer alignment of the rows to the grammar's strings, one for every feasible length. The strings end alike
(...uaua), so cells are counted from the end: cell (i, t) holds the least cost of aligning the rows from i on to the last t
characters, and one table has a column for every length. A string that starts with "s" adds one step in front of it.
The incumbent is the cost of a greedy repair; a cell on diagonal k = t - rows left needs k insertions, or -k deletions, so
only diagonals within the incumbent are filled (Ukkonen's band) and lengths outside it are not feasible. The cheapest
lengths are backtraced from the front, always by the edit first in ASCII, and their audits are compared. Every so many rows
of the table are kept and the rows between made again for the backtrace, so a conversation of n rows and cost c
holds about c * sqrt(n) cells.

Spark does the rest: faults and the repaired turns are DataFrame functions, only one letter for each row travels to the
alignment, and equal letter strings are aligned once a task.

Cases: null role or text is one space; a null conv_id is a conversation of its own; rows sort by turn (null first), then
role and text, and repeated rows stay; another role than system, user or assistant has its own initial and must be given
another role or go (roles are known by their first character, as the grammar reads initials); long texts are never copied to
Python; an empty table gives an empty result; further columns are ignored. A conversation is one row of the result, so it
has to fit a task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}


def damage(rows: DataFrame, one_in: int = 20) -> DataFrame:
    """``rows`` with planted faults by the crc32 of ``<conv_id>:<turn>`` modulo ``one_in`` (nulls are one space): 0 drops the
    row, 1 empties its text, 2 takes its stops away, 3 repeats it, 4 makes its role "user"."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % one_in
    seen = rows.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return seen.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


#: More than any cost, and small enough that sums of several stay whole numbers.
NEVER = 1 << 40


def row_costs(letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row, the cost of standing for "u", for "a", and for the "s" in front (NEVER where it may not)."""
    extra = np.array([TRUNCATED * c.isupper() for c in letters], np.int64)
    gone = np.array([c == "-" for c in letters], bool)
    as_u, as_a = (np.where(gone, NEVER, extra + [KEEP if c == who else REROLE for c in letters.lower()]) for who in "ua")
    return as_u, as_a, np.where([c == "s" for c in letters.lower()], extra + KEEP, NEVER)


def incumbent(letters: str) -> int:
    """Cost of a greedy repair: rows that must go are deleted, all others keep or change their role in turn."""
    cost, fronted, turns = 0, False, 0
    for c in letters:
        if c == "-":
            cost += DELETE
        elif c in "sS" and not fronted and not turns:
            fronted, cost = True, cost + TRUNCATED * c.isupper()
        else:
            cost += (KEEP if c.lower() == "ua"[turns % 2] else REROLE) + TRUNCATED * c.isupper()
            turns += 1
    missing = turns % 2 or (2 if fronted and not turns else 0)
    return min(cost + INSERT * missing, DELETE * len(letters))


class Table:
    """Alignment costs of one conversation, within the incumbent's band, every ``step``-th row kept."""

    def __init__(self, letters: str):
        self.n, self.letters = len(letters), letters
        self.as_u, self.as_a, self.as_s = row_costs(letters)
        best = incumbent(letters)
        self.below = best // DELETE
        self.k = np.arange(-self.below, best // INSERT + 1)
        self.step = max(2, int(self.n ** 0.5))
        cells = np.where(self.k >= 0, INSERT * self.k, NEVER)
        self.kept, self.block = {self.n: cells}, {self.n: cells}
        self.fronted: dict[int, int] = {}  # row that stays as the "s" in front: cost of the whole conversation then
        for i in range(self.n - 1, -1, -1):
            if self.as_s[i] < NEVER:
                two = 2 - (self.n - i - 1) + self.below  # where t = 2 lies; something has to follow the "s"
                self.fronted[i] = int(DELETE * i + self.as_s[i] + cells[max(two, two % 2)::2].min(initial=NEVER))
            cells = self.row(i, cells)
            if i % self.step == 0:
                self.kept[i] = cells

    def row(self, i: int, after: np.ndarray) -> np.ndarray:
        """Cells (i, t) with t = n - i + k from the cells of row i + 1, where the same t lies one diagonal higher."""
        t = self.n - i + self.k
        cells = np.where(t % 2, self.as_a[i], self.as_u[i]) + after
        cells[:-1] = np.minimum(cells[:-1], DELETE + after[1:])
        cells[t < 0] = NEVER
        cells = np.minimum.accumulate(cells - INSERT * self.k) + INSERT * self.k  # insertions, along the row
        cells[t < 0] = NEVER
        return np.minimum(cells, NEVER)

    def cell(self, i: int, t: int) -> int:
        at = t - (self.n - i) + self.below
        if t < 0 or not 0 <= at < len(self.k):
            return NEVER
        if i not in self.block:
            first = i // self.step * self.step
            top = min(self.n, first + self.step)
            self.block = {top: self.kept[top]}
            for j in range(top - 1, first - 1, -1):
                self.block[j] = self.row(j, self.block[j + 1])
        return int(self.block[i][at])

    def lengths(self, i: int) -> list[int]:
        """The t of row i that a whole string (ua)* can have, within the band."""
        return [t for t in (self.n - i + self.k).tolist() if t >= 0 and t % 2 == 0]

    def walk(self, i: int, t: int, left: int) -> tuple[str, list[int], str]:
        """From cell (i, t) of cost ``left``, the edits whose audit is first in ASCII; of each turn that then stands its row
        (-1: inserted) and its new role's letter ("k": keeps its own)."""
        audit, rows, roles = [], [], []
        while i < self.n or t:
            who = "a" if t % 2 else "u"
            if i < self.n and DELETE + self.cell(i + 1, t) == left:
                audit.append("D")
                i, left = i + 1, left - DELETE
                continue
            if t and INSERT + self.cell(i, t - 1) == left:
                audit.append("I")
                rows.append(-1)
                roles.append(who)
                t, left = t - 1, left - INSERT
                continue
            own = self.letters[i].lower() == who
            audit.append("K" if own else "R")
            rows.append(i)
            roles.append("k" if own else who)
            left -= int((self.as_a if t % 2 else self.as_u)[i])
            i, t = i + 1, t - 1
        return "".join(audit), rows, "".join(roles)


@lru_cache(maxsize=1 << 14)
def align(letters: str) -> tuple[int, str, list[int], str]:
    """(cost, audit, rows, roles) of the cheapest edits. One letter for each row: its initial (s, u, a, or x for any other),
    upper case where it is truncated, or "-" where it has to go."""
    table = Table(letters)
    cost = min([table.cell(0, t) for t in table.lengths(0)] + list(table.fronted.values()), default=0)
    found = [table.walk(0, t, cost) for t in table.lengths(0) if table.cell(0, t) == cost]
    for i, whole in table.fronted.items():
        if whole == cost:
            left = cost - DELETE * i - int(table.as_s[i])
            for t in table.lengths(i + 1):
                if t and table.cell(i + 1, t) == left:
                    audit, rows, roles = table.walk(i + 1, t, left)
                    found.append(("D" * i + "K" + audit, [i, *rows], "k" + roles))
    return cost, *min(found)


def aligned(letters: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(x) for x in letters], columns=["cost", "audit", "rows", "roles"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one row per conversation.

    blank, duplicate and truncated count rows by their first fault; gaps counts turn numbers that are missing between the
    least and the greatest; illegal counts neighbouring rows whose roles may not follow each other; repaired is the array
    of (role, text) after the edits."""
    spaced = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(to) for c, to in ((role_col, "role"), (text_col, "text")))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *spaced).repartition("conv_id")
    # both the window and the aggregate find the rows dealt by conversation already
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    turns = turns.withColumn("again", F.row_number().over(earlier) > 1)
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "again"))).alias("turns"))

    bare = lambda t: F.rtrim(t["text"], F.lit(" \t\n\x0b\x0c\r"))
    fault = F.transform("turns", lambda t: F.when(bare(t) == "", "blank").when(t["again"], "duplicate")
                        .when(~F.right(bare(t), F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none"))
    initial = F.transform("turns", lambda t: F.left(t["role"], F.lit(1)))
    whole = whole.withColumns({"fault": fault, "initial": initial})
    letter = F.zip_with("fault", "initial", lambda f, c: F.when(f.isin("blank", "duplicate"), "-").otherwise(
        F.when(f == "truncated", F.upper(known(c))).otherwise(known(c))))
    found = whole.withColumn("edits", F.pandas_udf(aligned, "cost long, audit string, rows array<int>, roles string")(F.array_join(letter, "")))

    count = lambda kind: F.size(F.filter("fault", lambda f: f == kind)).cast("long").alias(kind)
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0).cast("long"))
    pairs = F.zip_with("initial", F.slice("initial", 2, F.size("initial")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    role = F.split("edits.roles", "")
    repaired = F.transform("edits.rows", lambda r, i: F.struct(
        F.when(role[i] == "u", ROLES["u"]).when(role[i] == "a", ROLES["a"]).otherwise(F.get("turns", r)["role"]).alias("role"),
        F.when(r < 0, "").otherwise(F.get("turns", r)["text"]).alias("text")))
    return found.select("conv_id", gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), illegal.alias("illegal"),
                        "edits.cost", "edits.audit", repaired.alias("repaired"))


def known(initial: Column) -> Column:
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
