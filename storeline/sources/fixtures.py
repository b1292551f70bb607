"""Mapping of the generated TPC-H-like tables onto the retail model.

The engine's operators read the retail model (outlet, menu, outlet_menu,
order, daily_sales, review, food_quality, transportation, promotion,
employment). The test folders hold TPC-H-like tables instead, so this module
derives the model tables from them with plain DataFrame projections, joins
and one aggregate. Every derived table grows with the given tables.

Money and quantities are carried as DECIMAL so that sums are exact and do
not depend on the order in which partitions are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeline.sources.testdata import Tables

MONEY = "decimal(18,2)"


def bridge_id(supp: F.Column, part: F.Column) -> F.Column:
    return F.concat(supp.cast("string"), F.lit("-"), part.cast("string"))


def outlet(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    return (t.supplier.join(n, t.supplier.s_nationkey == n.n_nationkey, "left")
            .select(F.col("s_suppkey").cast("string").alias("outlet_id"),
                    F.col("s_name").alias("outlet"),
                    F.col("n_name").alias("city")))


def menu(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        (F.col("p_size") * 10).cast(MONEY).alias("product_cost"))


def outlet_menu(t: Tables) -> DataFrame:
    the_id = bridge_id(F.col("l_suppkey"), F.col("l_partkey"))
    # dealt by the id that the facts are joined on: one shuffle, of the keys alone, for the distinct pairs and for the joins
    pairs = t.lineitem.select("l_suppkey", "l_partkey").repartition(the_id).select(the_id.alias("outlet_menu_id"), "l_suppkey", "l_partkey")
    return pairs.distinct().select(
        "outlet_menu_id", F.col("l_suppkey").cast("string").alias("outlet_id"), F.col("l_partkey").cast("string").alias("product_id"))


def order(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey")
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "left")
            .select(bridge_id(F.col("l_suppkey"), F.col("l_partkey")).alias("outlet_menu_id"),
                    F.col("o_custkey").cast("string").alias("customer_id"),
                    F.col("l_quantity").cast(MONEY).alias("quantity"),
                    F.col("l_extendedprice").cast(MONEY).alias("unit_price"),
                    F.to_date("l_shipdate").alias("date")))


def daily_sales(t: Tables) -> DataFrame:
    the_id = bridge_id(F.col("l_suppkey"), F.col("l_partkey"))
    # as above: the day's sums stay where the join on the id reads them
    li = t.lineitem.select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast(MONEY).alias("quantity"))
    li = li.repartition(the_id).select(the_id.alias("outlet_product_id"), "date", "quantity")
    return li.groupBy("outlet_product_id", "date").agg(F.sum("quantity").alias("sales"))


def review(t: Tables) -> DataFrame:
    li = t.lineitem
    flag = F.col("l_returnflag")
    return li.select(
        bridge_id(F.col("l_suppkey"), F.col("l_partkey")).alias("outlet_menu_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("review_id"),
        F.when(flag == "A", 1).otherwise(0).alias("positive_score"),
        F.when(flag == "R", 1).otherwise(0).alias("negative_score"),
        F.when(flag == "N", 1).otherwise(0).alias("neutral_score"))


def food_quality(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        bridge_id(F.col("l_suppkey"), F.col("l_partkey")).alias("outlet_menu_id"),
        ((F.lit(0.10).cast("decimal(18,2)") - F.col("l_discount").cast("decimal(18,2)")) * 50)
        .cast("decimal(18,4)").alias("total_stage"),
        F.col("l_linestatus").alias("quality_status"))


def transportation(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        bridge_id(F.col("l_suppkey"), F.col("l_partkey")).alias("outlet_menu_id"),
        (F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast(MONEY)).cast("decimal(18,4)")
        .alias("transportation_cost"))


def _n_outlets(t: Tables) -> DataFrame:
    # one-row aggregate: safe to broadcast at any scale
    return F.broadcast(t.supplier.agg(F.count(F.lit(1)).alias("__n")))


def promotion(t: Tables) -> DataFrame:
    ev = t.events.select("user_id", "value", "event_type", "props").crossJoin(_n_outlets(t))
    return ev.select(
        F.pmod(F.col("user_id"), F.col("__n")).cast("string").alias("outlet_id"),
        F.col("value").cast(MONEY).alias("cost"),
        F.col("event_type").alias("sources"),
        F.get_json_object("props", "$.k").cast("decimal(18,0)").alias("products"))


def employment(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").crossJoin(_n_outlets(t))
    bal = F.col("c_acctbal").cast(MONEY)
    return c.select(
        F.pmod(F.col("c_custkey"), F.col("__n")).cast("string").alias("outlet_id"),
        F.col("c_mktsegment").alias("position_id"),
        F.when(bal < 0, F.lit(None)).otherwise(bal / 2000).cast("decimal(18,6)").alias("performance_rating"))


BUILDERS = {
    "outlet": outlet, "menu": menu, "outlet_menu": outlet_menu, "order": order, "daily_sales": daily_sales,
    "review": review, "food_quality": food_quality, "transportation": transportation,
    "promotion": promotion, "employment": employment, "customer": lambda t: t.customer,
}
UNFILLED = ("emp_position", "purchase_15", "purchase_month", "purchase_week")


class ModelTables(dict):
    """The model tables, each derived on first use (the ones the data cannot fill are empty)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._t = Tables(spark, sf_dir)
        self.spark = spark

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name)

    def __missing__(self, name: str) -> DataFrame:
        if name in BUILDERS:
            df = BUILDERS[name](self._t)
        elif name in UNFILLED:
            df = self.spark.createDataFrame([], "x string")
        else:
            raise KeyError(name)
        self[name] = df
        return df

    def get(self, name: str, default=None):
        try:
            return self[name]
        except KeyError:
            return default

    def names(self) -> list[str]:
        return list(BUILDERS) + list(UNFILLED)


def model_tables(spark: SparkSession, sf_dir: str) -> ModelTables:
    """All model tables of one folder (lazily derived)."""
    return ModelTables(spark, sf_dir)
