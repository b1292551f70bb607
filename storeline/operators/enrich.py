"""Enriched masters (survey P15-P18, W1, W2, A16-A18) and best outlet / product.

Group totals (W1, W2) are computed as a ``groupBy`` with map-side partial
aggregation and joined back on the group key. This replaces a window
``partitionBy(city)``: with few distinct cities a window would put a whole
city -- possibly a third of all rows -- into one task. The aggregate side has
one row per group, so AQE broadcasts it when it is small and falls back to a
skew-split sort-merge join when it is not.

Global statistics (A16-A18) are one-row aggregates joined as a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeline.functions.numeric import finite_or_zero

OUTLET_LOWER = ("city", "address", "main_promotion_method", "quality_status_most_common")
PRODUCT_LOWER = ("category", "product_name")
EXACT = "decimal(38,4)"


def standardize_strings(df: DataFrame, lower: tuple[str, ...], trim_only: tuple[str, ...] = ()) -> DataFrame:
    """Trim (and lower-case) the named text columns that exist."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")  # noqa: E731  all white space, not blanks only
    cols = {c: F.lower(strip(c)) for c in lower if c in df.columns}
    cols.update({c: strip(c) for c in trim_only if c in df.columns})
    return df.withColumns(cols)


def clean_values(df: DataFrame) -> DataFrame:
    """Numbers inf / NaN / NULL -> 0, text NULL -> 'unknown'."""
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols[f.name] = finite_or_zero(F.col(f.name))
        elif isinstance(f.dataType, T.NumericType):
            cols[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            cols[f.name] = F.coalesce(F.col(f.name), F.lit("unknown"))
    return df.withColumns(cols)


def performance_score(revenue: Column, volume: Column, score: Column) -> Column:
    """0.4 * revenue + 0.3 * volume + score * 0.3 * 100, left to right."""
    return revenue * F.lit(0.4) + volume.cast("double") * F.lit(0.3) + score * F.lit(0.3) * F.lit(100.0)


def group_totals(df: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Per-group sums of several columns attached to every row.

    Sums run on exact decimals, so the result does not depend on the order in
    which partial sums are merged."""
    totals = df.groupBy(key).agg(*[F.sum(F.col(src).cast(EXACT)).cast("double").alias(out)
                                   for out, src in sums.items()])
    return df.join(totals, key, "left").select(*df.columns, *sums)  # the join would move the key to the front


def sample_std(c: Column) -> Column:
    return F.stddev_samp(c)


def enrich_outlet(mo: DataFrame) -> DataFrame:
    """Enriched outlet master: + performance_score, city_rev, city_customers, rev_std, needs_improvement."""
    m = clean_values(standardize_strings(mo, OUTLET_LOWER, ("outlet",)))
    m = m.withColumn("performance_score", performance_score(F.col("total_revenue"), F.col("unique_customers"),
                                                            F.col("outlet_score")))
    m = group_totals(m, "city", {"city_rev": "total_revenue", "city_customers": "unique_customers"})
    m = m.withColumn("city_customers", F.col("city_customers").cast("bigint"))
    stats = m.agg(F.coalesce(sample_std(F.col("total_revenue")), F.lit(0.0)).alias("rev_std"))
    m = m.crossJoin(F.broadcast(stats))
    return m.withColumn("needs_improvement", F.col("outlet_score") < 0.5)


def enrich_product(mp: DataFrame, mo: DataFrame) -> DataFrame:
    """Enriched product master: + performance_score, category_rev, category_units,
    price_rating_corr, avg_order_value, is_premium."""
    m = clean_values(standardize_strings(mp, PRODUCT_LOWER))
    m = m.withColumn("performance_score", performance_score(F.col("revenue_total"), F.col("units_sold_total"),
                                                            F.col("product_score")))
    m = group_totals(m, "category", {"category_rev": "revenue_total", "category_units": "units_sold_total"})
    x, y = F.col("price"), F.col("avg_quality_score")
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    # corr guarded: a constant column has no correlation (0), never a division error
    corr = F.when(sx * sy > 0, F.covar_samp(x, y) / (sx * sy)).otherwise(F.lit(0.0))
    pstats = m.agg(corr.alias("price_rating_corr"),
                   F.sum(F.col("revenue_total").cast(EXACT)).alias("__rev"),
                   F.sum(F.col("units_sold_total").cast(EXACT)).alias("__units"))
    ostats = mo.agg(F.sum(F.coalesce(F.col("unique_customers"), F.lit(0))).alias("__cust"))
    stats = pstats.crossJoin(ostats).select(
        "price_rating_corr",
        F.coalesce(F.try_divide(F.col("__rev").cast("double"), F.col("__units").cast("double"))
                   * F.col("__cust").cast("double"), F.lit(0.0)).alias("avg_order_value"))
    m = m.crossJoin(F.broadcast(stats))
    return m.withColumn("is_premium", F.col("price") > 50)


# ---------------------------------------------------------------- L6

BEST_OUTLET_WHY = "Highest weighted performance (40% revenue + 30% customers + 30% score)"
BEST_PRODUCT_WHY = "Highest weighted performance (40% revenue + 30% units + 30% score)"


def _best(df: DataFrame, pk: str, fields: dict[str, Column], group_col: str, pattern: str | None,
          why: str, error: str) -> DataFrame:
    if pattern:
        df = df.where(F.col(group_col).rlike(f"(?iU){pattern}"))
    pick = F.min_by(F.struct(*[c.alias(n) for n, c in fields.items()]),
                    F.struct((-F.col("performance_score")).alias("k"), F.col(pk).alias("pk")))
    one = df.agg(pick.alias("b"))
    return one.select(*[F.col(f"b.{n}").alias(n) for n in fields],
                      F.when(F.col("b").isNotNull(), F.lit(why)).alias("why"),
                      F.when(F.col("b").isNull(), F.lit(error)).alias("error"))


def best_outlet(eo: DataFrame, city: str | None = None) -> DataFrame:
    """Best outlet by performance_score, optionally among cities matching a regex (one row; error row if none)."""
    return _best(eo, "outlet_id", {"outlet": F.col("outlet"), "city": F.col("city"),
                                   "score": F.col("performance_score"), "revenue": F.col("total_revenue")},
                 "city", city, BEST_OUTLET_WHY, "No outlets found for filters.")


def best_product(ep: DataFrame, category: str | None = None) -> DataFrame:
    """Best product by performance_score, optionally among categories matching a regex."""
    return _best(ep, "product_id", {"product": F.col("product_name"), "category": F.col("category"),
                                    "score": F.col("performance_score"), "revenue": F.col("revenue_total")},
                 "category", category, BEST_PRODUCT_WHY, "No products found for filters.")


def top_performers(df: DataFrame, n: int, pk: str) -> DataFrame:
    """L3: n rows with the largest performance_score (ties -> smaller key); TakeOrderedAndProject."""
    return df.orderBy(F.col("performance_score").desc(), F.col(pk).asc()).limit(n)
