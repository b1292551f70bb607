"""Master tables: one KPI row per outlet and per product (survey J3-J6, P7-P14).

Every per-key aggregate is hash-partitioned on the master key, so the chain of
left joins below re-uses one partitioning: the aggregates arrive already
partitioned by ``outlet_id`` / ``product_id`` and only the base table is
shuffled. AQE turns any side that proves small at run time into a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeline.functions.numeric import canonical_id, guarded_ratio, minmax_scale, num0
from storeline.operators import facts
from storeline.session import cut_lineage

Tables = dict[str, DataFrame]

# Fixed output column lists (intersected with what exists).
OUTLET_COLUMNS = [
    "outlet_id", "outlet", "city", "phone_no", "address", "location", "google_link", "employee_count",
    "total_sales", "total_units_sold", "total_revenue", "avg_monthly_sales", "unique_customers",
    "avg_spend_per_customer", "avg_employee_rating", "top_employee_role", "total_promotion_cost",
    "num_promoted_products", "main_promotion_method", "avg_transportation_cost", "min_transportation_cost",
    "max_transportation_cost", "avg_positive_score", "avg_negative_score", "avg_neutral_score",
    "avg_sentiment_signal", "total_reviews", "avg_quality_score", "quality_status_most_common", "outlet_score",
]
PRODUCT_COLUMNS = [
    "product_id", "category", "product_name", "price", "product_cost", "profit_per_unit", "total_profit",
    "margin_percentage", "units_sold_total", "revenue_total", "num_outlets_selling",
    "num_unique_customers_bought", "repeat_purchase_rate", "avg_quality_score", "avg_positive_score",
    "avg_negative_score", "avg_neutral_score", "avg_sentiment_signal", "total_reviews",
    "avg_transportation_cost", "product_score",
]

# Score weights (fixed values of the scoring rule).
OUTLET_WEIGHTS = {"norm_revenue": 0.30, "norm_quality": 0.20, "norm_employee": 0.20,
                  "norm_sentiment": 0.15, "norm_customers": 0.15}
PRODUCT_WEIGHTS = {"norm_units_sold": 0.35, "norm_quality": 0.20, "norm_reviews": 0.15,
                   "norm_sentiment": 0.15, "norm_profit": 0.15}

# Columns whose availability flag is derived.
OUTLET_FLAG_COLUMNS = ["total_sales", "total_units_sold", "total_revenue", "unique_customers", "avg_employee_rating",
                       "total_promotion_cost", "avg_transportation_cost", "total_reviews", "avg_quality_score"]
PRODUCT_FLAG_COLUMNS = ["units_sold_total", "revenue_total", "num_outlets_selling", "total_reviews",
                        "avg_quality_score", "avg_sentiment_signal", "total_profit"]

LONG_COLUMNS = {"employee_count", "unique_customers", "total_reviews", "num_outlets_selling",
                "num_unique_customers_bought"}


def weighted_sum(weights: dict[str, float]) -> Column:
    """sum_i w_i * c_i, left to right (the order is part of the result's bits)."""
    expr = None
    for name, w in weights.items():
        term = F.lit(w) * F.col(name)
        expr = term if expr is None else expr + term
    return expr


def _left_join_all(base: DataFrame, key: str, parts: list[DataFrame | None]) -> DataFrame:
    out = base
    for p in parts:
        if p is not None:
            out = out.join(p, key, "left")
    return out


def _fill(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``coalesce(col, default)`` when the column exists, else the default."""
    cols = {}
    for c, d in defaults.items():
        cols[c] = F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    return df.withColumns(cols)


def availability_flag(df: DataFrame, name: str) -> Column:
    """Numeric -> not null and != 0; text -> not null and not blank; absent -> false."""
    if name not in df.columns:
        return F.lit(False)
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.NumericType):
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (c != 0)
    return c.isNotNull() & F.regexp_like(c.cast("string"), F.lit(r"(?U)\S"))


def availability_flags(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"{n}_available": availability_flag(df, n) for n in names})


def outlet_base(tables: Tables) -> DataFrame:
    """The outlet table, or distinct outlet ids of the bridge when it has none."""
    outlet = tables.get("outlet")
    if outlet is not None and "outlet_id" in outlet.columns:
        return outlet.withColumn("outlet_id", canonical_id(outlet, "outlet_id"))
    b = facts.bridge(tables)
    if b is not None:
        return b.select("outlet_id").distinct()
    return tables["outlet"].sparkSession.createDataFrame([], "outlet_id string")


def outlet_kpis(tables: Tables, as_published: bool = False) -> DataFrame:
    """All outlet aggregates joined to the base, with defaults, before scoring."""
    base = outlet_base(tables)
    m = _left_join_all(base, "outlet_id", [
        facts.sales_by_outlet(tables), facts.daily_sales_by_outlet(tables), facts.employee_metrics(tables),
        facts.promotion_by_outlet(tables), facts.transport_by_outlet(tables),
        facts.reviews_by_outlet(tables, as_published), facts.quality_by_outlet(tables)])
    m = _fill(m, {"total_units_sold": 0.0, "total_revenue": 0.0, "total_sales": 0.0, "unique_customers": 0,
                  "avg_employee_rating": 0.0, "total_promotion_cost": 0.0, "num_promoted_products": 0.0,
                  "avg_transportation_cost": 0.0, "min_transportation_cost": 0.0,
                  "max_transportation_cost": 0.0, "avg_positive_score": 0.0, "avg_negative_score": 0.0,
                  "avg_neutral_score": 0.0, "avg_sentiment_signal": 0.0, "total_reviews": 0,
                  "avg_quality_score": 0.0, "quality_status_most_common": "unknown"})
    m = m.withColumn("avg_spend_per_customer", guarded_ratio(F.col("total_revenue"), F.col("unique_customers")))
    emp = num0(m, "employee_count") if "employee_count" in m.columns else F.lit(0)
    return m.withColumn("employee_count", emp.cast("bigint"))


def master_outlet(tables: Tables, as_published: bool = False, keep_components: bool = False, stored: bool = True) -> DataFrame:
    """One KPI row per outlet with ``outlet_score``.

    The KPIs are read for the global minima and maxima, and again for the rows: stored, so the facts are aggregated once.
    ``stored=False`` leaves all to the plan, for readers of a column or two."""
    if stored:
        facts.share_grains(tables, "outlet_id")
    m = outlet_kpis(tables, as_published)
    if stored:
        m = cut_lineage(m, "outlet_kpis")
    m = minmax_scale(m, {"norm_revenue": "total_revenue", "norm_quality": "avg_quality_score",
                         "norm_employee": "avg_employee_rating", "norm_sentiment": "avg_sentiment_signal",
                         "norm_customers": "unique_customers"})
    m = m.withColumn("outlet_score", weighted_sum(OUTLET_WEIGHTS))
    keep = [c for c in OUTLET_COLUMNS if c in m.columns]
    if keep_components:
        keep += list(OUTLET_WEIGHTS)
    return _typed(m.select(*keep))


def product_kpis(tables: Tables, as_published: bool = False) -> DataFrame:
    menu = tables.get("menu")
    if menu is not None and "product_id" in menu.columns:
        base = menu.withColumn("product_id", canonical_id(menu, "product_id"))
    else:
        base = tables["outlet"].sparkSession.createDataFrame([], "product_id string")
    m = _left_join_all(base, "product_id", [facts.sales_by_product(tables)])
    m = _fill(m, {"units_sold_total": 0.0, "revenue_total": 0.0})
    m = _left_join_all(m, "product_id", [facts.outlets_by_product(tables)])
    m = _fill(m, {"num_outlets_selling": 0})
    m = facts.product_profit(m)
    m = _left_join_all(m, "product_id", [facts.reviews_by_product(tables, as_published),
                                          facts.quality_by_product(tables), facts.transport_by_product(tables)])
    return _fill(m, {"avg_positive_score": 0.0, "avg_negative_score": 0.0, "avg_neutral_score": 0.0,
                     "avg_sentiment_signal": 0.0, "total_reviews": 0, "avg_quality_score": 0.0,
                     "avg_transportation_cost": 0.0, "min_transportation_cost": 0.0,
                     "max_transportation_cost": 0.0, "num_unique_customers_bought": 0,
                     "repeat_purchase_rate": 0.0})


def master_product(tables: Tables, as_published: bool = False, keep_components: bool = False) -> DataFrame:
    """One KPI row per product with ``product_score`` (P12, P14); the KPIs are stored, as the outlets' are."""
    facts.share_grains(tables, "product_id")
    m = cut_lineage(product_kpis(tables, as_published), "product_kpis")
    m = minmax_scale(m, {"norm_units_sold": "units_sold_total", "norm_quality": "avg_quality_score",
                         "norm_reviews": "total_reviews", "norm_sentiment": "avg_sentiment_signal",
                         "norm_profit": "total_profit"})
    m = m.withColumn("product_score", weighted_sum(PRODUCT_WEIGHTS))
    keep = [c for c in PRODUCT_COLUMNS if c in m.columns]
    if keep_components:
        keep += list(PRODUCT_WEIGHTS)
    return _typed(m.select(*keep))


def _typed(df: DataFrame) -> DataFrame:
    """Stable output types: counts BIGINT, other numbers DOUBLE, text STRING."""
    cols = {}
    for f in df.schema.fields:
        if f.name in LONG_COLUMNS:
            cols[f.name] = F.col(f.name).cast("bigint")
        elif isinstance(f.dataType, T.NumericType):
            cols[f.name] = F.col(f.name).cast("double")
    return df.withColumns(cols)
