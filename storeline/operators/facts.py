"""Per-outlet and per-product fact aggregates (survey A1-A15, J1, J2, J5, P9, P11).

Plan shape shared by every fact:

1. project the fact to its bridge key ``outlet_menu_id`` and guarded numbers;
2. inner-join these narrow rows to the bridge (orphans vanish here, as
   they vanish from the masters in the reference; duplicated bridge ids fan
   out, as in the reference). Facts are as long as the bridge or longer, so
   this is their one shuffle by the bridge key; nothing is aggregated at that
   grain first, which would only make the shuffled rows wider. Where the joined
   rows are not stored, the bridge side is hashed, so neither side is sorted by
   its text key. A hot key is split by AQE's skew join;
3. aggregate per ``outlet_id`` / ``product_id`` with map-side partial sums, or
   first per (key, value) for distinct counts and modes.

Means are ``double(sum) / count`` so decimal inputs give exact, order-free
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeline.functions.numeric import canonical_id, guarded_ratio, num, num0
from storeline.session import cut_lineage

Tables = dict[str, DataFrame]


def _has(df: DataFrame | None, *cols: str) -> bool:
    return df is not None and all(c in df.columns for c in cols)


_BRIDGE = "__bridge__"


def bridge(tables: Tables) -> DataFrame | None:
    """Bridge rows (outlet_menu_id, outlet_id, product_id) with canonical string keys.

    One DataFrame per table set: every fact joins the *same* plan, so Spark
    plans its exchange once and re-uses it (ReusedExchange) for all facts."""
    if _BRIDGE in tables:
        return tables[_BRIDGE]
    om = tables.get("outlet_menu")
    if not _has(om, "outlet_menu_id"):
        return None
    b = om.select(canonical_id(om, "outlet_menu_id").alias("outlet_menu_id"),
                  canonical_id(om, "outlet_id").alias("outlet_id"),
                  canonical_id(om, "product_id").alias("product_id"))
    tables[_BRIDGE] = b
    return b


_MET = "__met__"


def share(tables: Tables) -> None:
    """Join the rows of all facts to the bridge at once and store them, for callers that build both masters.

    One shuffle of the facts instead of one a fact and master, in batches, each stored before the next is shuffled. The join
    sorts by the bridge key here: rows that lie together by outlet and product take half the space. The bridge's own rows are
    stored beside those of a batch, as the ``kind`` BRIDGE: those with a key are the rows that the join reads anyway."""
    b = bridge(tables)
    if _MET in tables or b is None:
        return
    parts = [met for met in (_all_met(tables, b, kinds) for kinds in _BATCHES) if met is not None]
    if not parts:
        return
    for rows in (b.where("outlet_menu_id is not null"), b.where("outlet_menu_id is null")):
        parts[-1] = parts[-1].unionByName(rows.withColumn("kind", F.lit(BRIDGE)), allowMissingColumns=True)
    met = None
    for part in parts:
        stored = cut_lineage(part.drop("outlet_menu_id"), "facts", compression="zstd")
        met = stored if met is None else met.unionByName(stored, allowMissingColumns=True)
    tables[_MET] = met


def _all_met(tables: Tables, b: DataFrame, kinds: tuple[int, ...]) -> DataFrame | None:
    """The rows of the facts ``kinds``, each with its ``kind``, joined to the bridge.

    Daily sales, which are sums by the bridge key, meet it on their own: they lie where the join reads them."""
    apart = {}
    for kind in kinds:
        rows = _FACT_ROWS[kind](tables)
        if rows is not None:
            rows, place = rows.withColumn("kind", F.lit(kind)), kind == DAILY
            apart[place] = apart[place].unionByName(rows, allowMissingColumns=True) if place in apart else rows
    met = None
    for rows in apart.values():
        one = rows.join(b, "outlet_menu_id")
        met = one if met is None else met.unionByName(one, allowMissingColumns=True)
    return met


def _of_key(key: str) -> str:
    return f"__grains_{key}__"


def _totals_of(key: str) -> str:
    return f"__totals_{key}__"


def _sales_of(key: str) -> str:
    return f"__sales_{key}__"


def _present(kind: int) -> str:
    return f"__n_{kind}__"


def share_totals(tables: Tables, key: str) -> None:
    """Store the measures of all facts by one ``key`` of the shared join, one row a key.

    A key's rows lie in many tasks, so every aggregate of them shuffles a row a key and task: one for all facts, not one each."""
    if _MET not in tables or _totals_of(key) in tables:
        return
    measures = {}
    for kind, of in _MEASURES.items():
        if _FACT_ROWS[kind](tables) is not None:
            measures |= {n: c for n, c in of().items() if n != "n"} | {_present(kind): F.count_if(F.col("kind") == kind)}
    met = tables[_MET].where((F.col("kind") != BRIDGE) & F.col(key).isNotNull())
    tables[_totals_of(key)] = cut_lineage(met.groupBy(key).agg(*(c.alias(n) for n, c in measures.items())), "totals")


def _totals(kind: int, tables: Tables, key: str) -> DataFrame | None:
    """(key, measures) of a fact where they are stored: one row per key that has rows of it."""
    if _totals_of(key) not in tables or _FACT_ROWS[kind](tables) is None:
        return None
    n = F.col(_present(kind))
    return tables[_totals_of(key)].where(n > 0).select(key, *(n.alias(m) if m == "n" else m for m in _MEASURES[kind]()))


def share_grains(tables: Tables, key: str) -> None:
    """Store the grains of all facts by one ``key``, for callers that build one master.

    A grain is what one ``key`` holds of a fact, apart for each status (quality): the rows that still answer sums, counts,
    extremes and modes. Of the orders the sums and distinct customers are stored, one row a ``key``: a pair of key and customer
    then travels without the measures. The bridge is hashed, a batch of facts is aggregated at once, and neither the joined
    rows nor the pairs are written. Where the joined rows are shared, they answer instead."""
    b = bridge(tables)
    if _MET in tables:
        return share_totals(tables, key)
    if _of_key(key) in tables or b is None:
        return
    b, grains = _hashed(b.select("outlet_menu_id", key)), None
    for kinds in _BATCHES:
        met = _all_met(tables, b, kinds)
        if met is None:
            continue
        met = met.where(F.col(key).isNotNull())
        if kinds == (ORDER,):
            tables[_sales_of(key)] = cut_lineage(_sold(met, key), "sales")
            continue
        measures, dim = {}, F.lit(None).cast("string")
        for kind in kinds:
            if _FACT_ROWS[kind](tables) is not None:
                measures |= _MEASURES[kind]()
                if kind in _DIMENSION:
                    dim = F.coalesce(dim, F.when(F.col("kind") == kind, F.col(_DIMENSION[kind])))
        of_batch = met.withColumn("dim", dim).groupBy(key, "kind", "dim").agg(*(c.alias(n) for n, c in measures.items()))
        stored = cut_lineage(of_batch, "grains")
        grains = stored if grains is None else grains.unionByName(stored, allowMissingColumns=True)
    if grains is not None:
        tables[_of_key(key)] = grains


def _sold(met: DataFrame, key: str) -> DataFrame:
    """(key, quantity, revenue, n_records, customers) of order lines that met the bridge.

    The filter takes nothing from the distinct customers, but has Spark count them in rows of their own, without the sums."""
    customers = F.expr("count(distinct customer_id) filter (where customer_id is not null)")
    return met.groupBy(key).agg(*(c.alias(n) for n, c in _MEASURES[ORDER]().items()), customers.alias("customers"))


def _hashed(b: DataFrame) -> DataFrame:
    """The bridge as the hashed side of a shuffled join: a task holds its partition's ids, which are narrow, and streams the facts."""
    return b.hint("shuffle_hash")


def _grains(kind: int, tables: Tables, key: str) -> DataFrame | None:
    """(key, dimension if the fact has one, measures) of a fact: one row per key and dimension, shared or made here."""
    rows, b = _FACT_ROWS[kind](tables), bridge(tables)
    if rows is None or b is None:
        return None
    dim, measures = _DIMENSION.get(kind), _MEASURES[kind]()
    if _MET in tables:
        met = tables[_MET].where((F.col("kind") == kind) & F.col(key).isNotNull())
    elif _of_key(key) in tables and kind != ORDER:
        kept = [F.col("dim").alias(dim)] if dim else []
        return tables[_of_key(key)].where(F.col("kind") == kind).select(key, *kept, *measures)
    else:
        met = rows.join(_hashed(b.select("outlet_menu_id", key)), "outlet_menu_id", "inner").where(F.col(key).isNotNull())
    return met.groupBy(key, *([dim] if dim else [])).agg(*(c.alias(n) for n, c in measures.items()))


def _one_row_a_key(kind: int, tables: Tables, key: str) -> DataFrame | None:
    """The stored totals of a fact, or else its grains, which are one row a key where the fact has no dimension."""
    totals = _totals(kind, tables, key)
    return _grains(kind, tables, key) if totals is None else totals


def _mode_pick(counts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent value per key from (key, value, n) rows; ties -> smallest value.

    ``counts`` already holds one row per (key, value), so the groups here are
    as small as the number of distinct values, never as large as the facts.
    """
    return (counts.groupBy(key)
            .agg(F.min_by(F.col(value), F.struct((-F.col("n")).alias("neg_n"), F.col(value).alias("v"))).alias(out)))


# ---------------------------------------------------------------- orders

def order_lines(tables: Tables) -> DataFrame | None:
    """Order lines with guarded numbers."""
    o = tables.get("order")
    if not _has(o, "outlet_menu_id"):
        return None
    return o.select(canonical_id(o, "outlet_menu_id").alias("outlet_menu_id"),
                    canonical_id(o, "customer_id").alias("customer_id"),
                    num0(o, "quantity").alias("quantity"),
                    num0(o, "unit_price").alias("unit_price"))


def orders_by_customer(tables: Tables, key: str) -> DataFrame | None:
    """Order lines, ``revenue = quantity * unit_price``, aggregated to (outlet or product, customer): the grain that still
    answers sums, counts and distinct customers."""
    return _grains(ORDER, tables, key)


def _sales(tables: Tables, key: str) -> DataFrame | None:
    """(key, quantity, revenue, n_records, customers): the sums and distinct customers of the order lines.

    Beside stored totals only the pairs of key and customer are left to shuffle."""
    if _sales_of(key) in tables:
        return tables[_sales_of(key)]
    sums = _totals(ORDER, tables, key)
    if sums is not None:
        pairs = tables[_MET].where((F.col("kind") == ORDER) & F.col(key).isNotNull() & F.col("customer_id").isNotNull())
        bought = pairs.select(key, "customer_id").distinct().groupBy(key).agg(F.count("customer_id").alias("customers"))
        return sums.join(bought, key, "left").withColumn("customers", F.coalesce("customers", F.lit(0).cast("long")))
    e = orders_by_customer(tables, key)
    return None if e is None else e.groupBy(key).agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), F.sum("n_records").alias("n_records"),
        F.count("customer_id").alias("customers"))


def sales_by_outlet(tables: Tables) -> DataFrame:
    """A1 + A3: units, revenue and distinct customers per outlet."""
    e = _sales(tables, "outlet_id")
    if e is None:
        return None
    return e.select("outlet_id", F.col("quantity").cast("double").alias("total_units_sold"),
                    F.col("revenue").cast("double").alias("total_revenue"), F.col("customers").alias("unique_customers"))


def _daily(tables: Tables) -> DataFrame | None:
    ds = tables.get("daily_sales")
    if not _has(ds, "outlet_product_id", "sales"):
        return None
    return ds.select(canonical_id(ds, "outlet_product_id").alias("outlet_menu_id"), num0(ds, "sales").alias("sales"))


def daily_sales_by_outlet(tables: Tables) -> DataFrame | None:
    """A2: daily sales summed per outlet."""
    e = _one_row_a_key(DAILY, tables, "outlet_id")
    if e is None:
        return None
    return e.select("outlet_id", F.col("sales_sum").cast("double").alias("total_sales"))


def sales_by_product(tables: Tables) -> DataFrame | None:
    """A10 + A15: units, revenue, distinct customers, purchase records, repeat rate."""
    e = _sales(tables, "product_id")
    if e is None:
        return None
    agg = e.select(
        "product_id", F.col("quantity").cast("double").alias("units_sold_total"),
        F.col("revenue").cast("double").alias("revenue_total"),
        F.col("customers").alias("num_unique_customers_bought"),
        F.col("n_records").alias("total_purchase_records"))
    return agg.withColumn("repeat_purchase_rate",
                          guarded_ratio(F.col("total_purchase_records"), F.col("num_unique_customers_bought")))


def outlets_by_product(tables: Tables) -> DataFrame | None:
    """Distinct outlets selling each product (from the bridge)."""
    b = tables[_MET].where(F.col("kind") == BRIDGE) if _MET in tables else bridge(tables)
    if b is None:
        return None
    return (b.where(F.col("product_id").isNotNull())
            .groupBy("product_id").agg(F.count_distinct("outlet_id").alias("num_outlets_selling")))


# ---------------------------------------------------------------- employees / promotion

def employee_metrics(tables: Tables) -> DataFrame | None:
    """A4 + A5: mean rating (invalid skipped, not zeroed) and most common position."""
    emp = tables.get("employment")
    if not _has(emp, "outlet_id"):
        return None
    e = emp.select(canonical_id(emp, "outlet_id").alias("outlet_id"),
                   num(emp, "performance_rating").alias("rating"),
                   (canonical_id(emp, "position_id") if "position_id" in emp.columns
                    else F.lit(None).cast("string")).alias("position_id"))
    e = e.where(F.col("outlet_id").isNotNull())
    parts = []
    if "performance_rating" in emp.columns:
        parts.append(e.groupBy("outlet_id").agg(
            F.sum("rating").cast("double").alias("__s"), F.count("rating").alias("__n"))
            .select("outlet_id", F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).alias("avg_employee_rating")))
    if "position_id" in emp.columns:
        counts = (e.where(F.col("position_id").isNotNull())
                  .groupBy("outlet_id", "position_id").agg(F.count(F.lit(1)).alias("n")))
        parts.append(_mode_pick(counts, "outlet_id", "position_id", "top_employee_role"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "outlet_id", "full")
    return out


def promotion_by_outlet(tables: Tables) -> DataFrame | None:
    """Promotion cost sum, most common source, promoted products sum."""
    pr = tables.get("promotion")
    if not _has(pr, "outlet_id"):
        return None
    p = pr.select(canonical_id(pr, "outlet_id").alias("outlet_id"),
                  num0(pr, "cost").alias("cost"),
                  num0(pr, "products").alias("products"),
                  (F.col("sources").cast("string") if "sources" in pr.columns
                   else F.lit(None).cast("string")).alias("sources")).where(F.col("outlet_id").isNotNull())
    sums = p.groupBy("outlet_id").agg(F.sum("cost").cast("double").alias("total_promotion_cost"),
                                      F.sum("products").cast("double").alias("num_promoted_products"))
    counts = (p.where(F.col("sources").isNotNull())
              .groupBy("outlet_id", "sources").agg(F.count(F.lit(1)).alias("n")))
    return sums.join(_mode_pick(counts, "outlet_id", "sources", "main_promotion_method"), "outlet_id", "left")


# ---------------------------------------------------------------- transport / reviews / quality

def _transport(tables: Tables) -> DataFrame | None:
    tr = tables.get("transportation")
    if not _has(tr, "outlet_menu_id"):
        return None
    return tr.select(canonical_id(tr, "outlet_menu_id").alias("outlet_menu_id"), num0(tr, "transportation_cost").alias("transport"))


def _transport_by(tables: Tables, key: str) -> DataFrame | None:
    e = _one_row_a_key(TRANSPORT, tables, key)
    if e is None:
        return None
    return e.select(
        key, (F.col("transport_sum").cast("double") / F.col("n")).alias("avg_transportation_cost"),
        F.col("transport_min").cast("double").alias("min_transportation_cost"),
        F.col("transport_max").cast("double").alias("max_transportation_cost"))


def transport_by_outlet(tables: Tables) -> DataFrame | None:
    """Mean / min / max transport cost per outlet (invalid -> 0 before the mean)."""
    return _transport_by(tables, "outlet_id")


def transport_by_product(tables: Tables) -> DataFrame | None:
    """Same per product."""
    return _transport_by(tables, "product_id")


REVIEW_SCORES = ("positive_score", "negative_score", "neutral_score")


def _reviews(tables: Tables) -> DataFrame | None:
    rv = tables.get("review")
    if not _has(rv, "outlet_menu_id"):
        return None
    return rv.select(canonical_id(rv, "outlet_menu_id").alias("outlet_menu_id"), *[num0(rv, c).alias(c) for c in REVIEW_SCORES])


def _reviews_by(tables: Tables, key: str, as_published: bool = False) -> DataFrame | None:
    e = _one_row_a_key(REVIEW, tables, key)
    if e is None:
        return None
    return e.select(
        key, *[(F.col(f"{c}_sum").cast("double") / F.col("n")).alias(f"avg_{c}") for c in (*REVIEW_SCORES, "sentiment_signal")],
        (F.lit(0).cast("bigint") if as_published else F.col("n")).alias("total_reviews"))


def reviews_by_outlet(tables: Tables, as_published: bool = False) -> DataFrame | None:
    """Review means and review count per outlet.

    ``as_published=True`` reproduces the reference's count of 0 everywhere (N5)."""
    return _reviews_by(tables, "outlet_id", as_published)


def reviews_by_product(tables: Tables, as_published: bool = False) -> DataFrame | None:
    """Same per product."""
    return _reviews_by(tables, "product_id", as_published)


def _quality(tables: Tables) -> DataFrame | None:
    fq = tables.get("food_quality")
    if not _has(fq, "outlet_menu_id"):
        return None
    return fq.select(canonical_id(fq, "outlet_menu_id").alias("outlet_menu_id"),
                     num0(fq, "total_stage").alias("stage"),
                     (F.col("quality_status").cast("string") if "quality_status" in fq.columns
                      else F.lit(None).cast("string")).alias("status"))


def quality_by_outlet(tables: Tables) -> DataFrame | None:
    """Mean quality stage and most common status per outlet (J5 folded in)."""
    by_status = _grains(QUALITY, tables, "outlet_id")
    if by_status is None:
        return None
    # a null status has no place in the order, so it is never picked
    place = F.when(F.col("status").isNotNull(), F.struct((-F.col("n")).alias("neg_n"), F.col("status").alias("v")))
    return by_status.groupBy("outlet_id").agg(
        (F.sum("stage_sum").cast("double") / F.sum("n")).alias("avg_quality_score"),
        F.min_by("status", place).alias("quality_status_most_common"))


def quality_by_product(tables: Tables) -> DataFrame | None:
    """Mean quality stage per product."""
    e = _one_row_a_key(QUALITY, tables, "product_id")
    if e is None:
        return None
    return e.groupBy("product_id").agg((F.sum("stage_sum").cast("double") / F.sum("n")).alias("avg_quality_score"))


ORDER, DAILY, TRANSPORT, REVIEW, QUALITY, BRIDGE = range(6)
#: The rows of each fact: outlet_menu_id and columns that no other fact has.
_FACT_ROWS = {ORDER: order_lines, DAILY: _daily, TRANSPORT: _transport, REVIEW: _reviews, QUALITY: _quality}
#: The column that a fact's grains are kept apart by.
_DIMENSION = {ORDER: "customer_id", QUALITY: "status"}


def _rows() -> dict[str, Column]:
    return {"n": F.count(F.lit(1))}


#: The facts that meet the bridge in one job. Its shuffles are deleted when its result is stored, so the disk holds those of
#: one batch at a time; a further batch costs a shuffle of the bridge.
_BATCHES = ((TRANSPORT, REVIEW), (QUALITY, DAILY), (ORDER,))
#: The measures of each fact's grains: aggregates whose values add up (or compare) over grains.
_MEASURES = {
    ORDER: lambda: {"quantity": F.sum("quantity"), "revenue": F.sum(F.col("quantity") * F.col("unit_price")),
                    "n_records": F.count("customer_id")},
    DAILY: lambda: {"sales_sum": F.sum("sales")},
    TRANSPORT: lambda: _rows() | {f"transport_{n}": of("transport") for n, of in (("sum", F.sum), ("min", F.min), ("max", F.max))},
    REVIEW: lambda: _rows() | {f"{c}_sum": F.sum(c) for c in REVIEW_SCORES}
    | {"sentiment_signal_sum": F.sum(F.col("positive_score") - F.col("negative_score"))},
    QUALITY: lambda: _rows() | {"stage_sum": F.sum("stage")},
}


def product_profit(products: DataFrame) -> DataFrame:
    """P9 + P11 on a product table with ``price``, ``product_cost``, ``units_sold_total``."""
    price, cost = num0(products, "price"), num0(products, "product_cost")
    units = num0(products, "units_sold_total")
    out = products.withColumn("price", price).withColumn("product_cost", cost)
    out = out.withColumn("profit_per_unit", F.col("price") - F.col("product_cost"))
    out = out.withColumn("total_profit", (F.col("profit_per_unit") * units).cast("double"))
    return out.withColumn("margin_percentage", guarded_ratio(F.col("profit_per_unit"), F.col("price")))
