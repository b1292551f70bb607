"""Hand-made edge tables (FIXTURES.md section 3)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeline.functions.numeric import canonical_id, minmax_scale, num0
from storeline.operators import enrich, facts, masters, responses, select


def _tables(spark, **kw):
    base = {
        "outlet": spark.createDataFrame([("1", "A", "surat"), ("2", "B", "pune")],
                                        "outlet_id string, outlet string, city string"),
        "menu": spark.createDataFrame([("10", "pizza", "food", "100", "40")],
                                      "product_id string, product_name string, category string, price string, product_cost string"),
        "outlet_menu": spark.createDataFrame([("m1", "1", "10"), ("m2", "2", "10")],
                                             "outlet_menu_id string, outlet_id string, product_id string"),
        "order": spark.createDataFrame([("m1", "c1", "2", "5"), ("m1", "c2", "1", "5"), ("m9", "c3", "7", "7")],
                                       "outlet_menu_id string, customer_id string, quantity string, unit_price string"),
    }
    base.update(kw)
    return base


def test_bad_numbers(spark):
    vals = ["3", " 4 ", "1,200", "12d", "0x1p3", "abc", "", None, "NaN"]
    df = spark.createDataFrame([(v,) for v in vals], "q string")
    got = [r.v for r in df.select(num0(df, "q").alias("v")).collect()]
    assert got == [3, 4, 0, 0, 0, 0, 0, 0, 0]


def test_id_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "id double")
    assert [r.k for r in df.select(canonical_id(df, "id").alias("k")).collect()] == ["1", "2", None]


def test_orphan_and_dup_bridge(spark):
    t = _tables(spark, outlet_menu=spark.createDataFrame(
        [("m1", "1", "10"), ("m1", "1", "10"), ("m2", "2", "10")], "outlet_menu_id string, outlet_id string, product_id string"))
    s = {r.outlet_id: r for r in facts.sales_by_outlet(t).collect()}
    # m1 fans out twice (duplicate bridge row); the orphan m9 reaches no outlet
    assert s["1"].total_units_sold == 6.0 and s["1"].total_revenue == 30.0
    assert "2" not in s


def test_mode_and_role_ties(spark):
    promo = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "b"), ("1", "a"), ("1", None), ("2", None)],
                                  "outlet_id string, sources string")
    emp = spark.createDataFrame([("1", "2"), ("1", "1"), ("1", "2"), ("1", "1")], "outlet_id string, position_id string")
    t = _tables(spark, promotion=promo, employment=emp)
    p = {r.outlet_id: r.main_promotion_method for r in facts.promotion_by_outlet(t).collect()}
    assert p == {"1": "a", "2": None}
    e = {r.outlet_id: r.top_employee_role for r in facts.employee_metrics(t).collect()}
    assert e == {"1": "1"}


def test_skip_versus_zero_fill(spark):
    emp = spark.createDataFrame([("1", "4"), ("1", "x")], "outlet_id string, performance_rating string")
    tr = spark.createDataFrame([("m1", "4"), ("m1", "x")], "outlet_menu_id string, transportation_cost string")
    t = _tables(spark, employment=emp, transportation=tr)
    assert facts.employee_metrics(t).first().avg_employee_rating == 4.0
    assert {r.outlet_id: r.avg_transportation_cost for r in facts.transport_by_outlet(t).collect()} == {"1": 2.0}


def test_constant_and_zero_div(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "k string, v double")
    assert [r.n for r in minmax_scale(df, {"n": "v"}).collect()] == [0.0, 0.0, 0.0]
    t = _tables(spark, menu=spark.createDataFrame([("10", "pizza", "food", "0", "0")],
                                                  "product_id string, product_name string, category string, price string, product_cost string"))
    mp = masters.master_product(t)
    assert mp.first().margin_percentage == 0.0
    mo = masters.master_outlet(t)
    ep = enrich.enrich_product(mp, mo).first()
    assert ep.price_rating_corr == 0.0 and not math.isnan(ep.price_rating_corr)


def test_missing_tables_defaults(spark):
    mo = {r.outlet_id: r for r in masters.master_outlet(_tables(spark)).collect()}
    assert mo["1"].quality_status_most_common == "unknown"
    assert mo["1"].total_promotion_cost == 0.0 and mo["1"].total_reviews == 0
    assert mo["1"].unique_customers == 2 and mo["2"].unique_customers == 0
    assert mo["2"].avg_spend_per_customer == 0.0


def test_reviews_count_and_as_published(spark):
    rv = spark.createDataFrame([("m1", "1", "0", "0")] * 3,
                               "outlet_menu_id string, positive_score string, negative_score string, neutral_score string")
    t = _tables(spark, review=rv)
    assert facts.reviews_by_outlet(t).first().total_reviews == 3
    assert facts.reviews_by_outlet(t, as_published=True).first().total_reviews == 0


def test_no_match_filter_falls_back(spark):
    from storeline.operators import intents
    from storeline.session import cut_lineage
    t = _tables(spark)
    mo = cut_lineage(masters.master_outlet(t))
    eo = cut_lineage(enrich.enrich_outlet(mo))
    ep = cut_lineage(enrich.enrich_product(masters.master_product(t), mo))
    it = spark.createDataFrame([(1, "show every store in Surat"), (2, "show every store in nowhere")],
                               "q_id long, question string")
    ints = intents.parse(it, eo)
    ev, _ = select.evidence(ints, eo, ep)
    rows = {}
    for r in ev.collect():
        rows.setdefault(r.q_id, []).append(r.pk)
    assert sorted(rows[1]) == ["1"]           # city surat selects outlet 1 only
    assert sorted(rows[2]) == ["1", "2"]      # no city matched: every outlet comes back


def test_responses(spark):
    vals = ['{"choices":[{"message":{"content":" a "}}]}', '{"content":"b"}', '{"text":"c"}', '{"answer":"d"}',
            "plain", "{broken"]
    df = spark.createDataFrame([(v,) for v in vals], "r string")
    got = [r.a for r in df.select(responses.extract_answer(F.col("r")).alias("a")).collect()]
    assert got == ["a", "b", "c", "d", "plain", "{broken"]


def test_chat_messages_defaults(spark):
    t = spark.createDataFrame([(1, 2, None, "x"), (1, 1, "system", None)], "conv_id long, turn long, role string, text string")
    m = responses.chat_messages(t).first().messages
    assert [(x.role, x.content) for x in m] == [("system", ""), ("user", "x")]


def test_vectors_topk_against_brute_force(spark):
    from storeline.operators.retrieval import cosine_topk
    rng = np.random.default_rng(7)
    docs = rng.normal(size=(60, 8))
    docs[0] = 0.0                # zero vector
    docs[1, 3] = np.nan          # NaN component
    qs = rng.normal(size=(9, 8))
    qs[0] = 0.0
    d = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(docs)], "id string, v array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "q_id long, v array<double>")
    got = {}
    for r in cosine_topk(q, d, k=5, query_block=4, doc_block=16).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.id, r.score))

    def unit_docs(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return np.nan_to_num(m / n, nan=0.0, posinf=0.0, neginf=0.0)

    def unit_queries(m):
        m = np.nan_to_num(m, nan=0.0, posinf=0.0, neginf=0.0)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return m / n
    s = unit_queries(qs) @ unit_docs(docs).T
    for qi in range(len(qs)):
        order = sorted(range(len(docs)), key=lambda j: (-s[qi, j], str(j)))[:5]
        assert [x[1] for x in sorted(got[qi])] == [str(j) for j in order]
        assert all(not math.isnan(x[2]) for x in got[qi])
    assert all(x[2] == 0.0 for x in got[0])     # zero query vector scores 0
    big = cosine_topk(q, d.limit(3), k=10).where("q_id = 1").count()
    assert big == 3                              # k larger than n -> n rows


def test_topk_cells_meet_without_coalescing(spark):
    """Query and document sides of a cell must land in the same partition at any partition count."""
    from storeline.operators.retrieval import cosine_topk
    old = (spark.conf.get("spark.sql.shuffle.partitions"),
           spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(3)
        d = spark.createDataFrame([(str(i), [float(x) for x in rng.normal(size=4)]) for i in range(50)],
                                  "id string, v array<double>")
        q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(20)],
                                  "q_id long, v array<double>")
        assert cosine_topk(q, d, k=3, query_block=7, doc_block=11).count() == 60
        assert cosine_topk(q, d, k=3).count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
