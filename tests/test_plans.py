"""Plan shapes the scale design relies on."""

from storeline.operators import select
from storeline.operators.facts import sales_by_outlet
from storeline.sources.fixtures import model_tables

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_a_partial_window_group_limit(spark):
    members = spark.createDataFrame(
        [("s", "product", str(i), float(i), None, 1.0 * i, 2.0, 3.0, None, 4.0, "n", None, "c") for i in range(30)],
        "sig string, tbl string, pk string, pkn double, city_l string, price double, revenue double, units double, "
        "customers double, rating double, name_l string, perf double, cat_l string")
    needs = spark.createDataFrame([("s", "price", False)], "esig string, kind string, asc boolean")
    top = select.ranked(members, needs, 5)
    assert "WindowGroupLimit" in _plan(top)
    assert top.count() == 5


def test_fact_scan_reads_only_needed_columns(spark):
    plan = _plan(sales_by_outlet(model_tables(spark, SF_SMALL)))
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "lineitem" in line]
    assert scans
    for s in scans:
        assert "l_comment" not in s and "l_returnflag" not in s and "l_tax" not in s
