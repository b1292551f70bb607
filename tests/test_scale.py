"""Steps whose cost has to grow with the input only: facts read once, equal vectors scored once, blocks ranked in bounded memory."""

import time

import numpy as np
from pyspark.sql import functions as F

from storeline import session
from storeline.operators import approximate, facts, masters, retrieval
from storeline.sources.fixtures import model_tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masters_read_their_facts_once(spark):
    t = model_tables(spark, SF)
    assert _plan(masters.master_outlet(t)).count("Join") == 1  # the one-row minima and maxima
    assert _plan(masters.master_product(t)).count("Join") == 1


def test_facts_join_before_they_aggregate(spark):
    t = model_tables(spark, SF)
    for fact in (facts.sales_by_outlet, facts.quality_by_outlet, facts.reviews_by_product, facts.transport_by_product):
        above, _, below = _plan(fact(t)).partition("Join Inner")
        assert "Aggregate" in above and below.count("Aggregate [") <= 1  # the distinct pairs of the bridge


def test_shared_facts_are_the_same(spark):
    plain, shared = model_tables(spark, SF), model_tables(spark, SF)
    facts.share(shared)
    for fact in (facts.sales_by_outlet, facts.daily_sales_by_outlet, facts.quality_by_outlet, facts.sales_by_product,
                 facts.reviews_by_product, facts.transport_by_product):
        assert "Join" not in _plan(fact(shared))
        assert sorted(map(tuple, fact(shared).collect())) == sorted(map(tuple, fact(plain).collect()))


def test_grains_are_the_same(spark):
    for key, fs in (("outlet_id", (facts.sales_by_outlet, facts.daily_sales_by_outlet, facts.quality_by_outlet, facts.reviews_by_outlet,
                                   facts.transport_by_outlet)),
                    ("product_id", (facts.sales_by_product, facts.reviews_by_product, facts.quality_by_product, facts.transport_by_product))):
        plain, shared = model_tables(spark, SF), model_tables(spark, SF)
        facts.share_grains(shared, key)
        for fact in fs:
            assert "Join" not in _plan(fact(shared))
            assert sorted(map(str, fact(shared).collect())) == sorted(map(str, fact(plain).collect()))


def test_no_fact_is_sorted_by_the_bridge_key(spark):
    t = model_tables(spark, SF)
    plan = facts.transport_by_outlet(t)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_grains_of_awkward_facts(spark):
    bridge = spark.createDataFrame([("m", "o", "p"), ("m", "q", "p"), (None, "o", "p"), ("n", None, "r")],
                                   "outlet_menu_id string, outlet_id string, product_id string")
    def tables():
        return {"outlet_menu": bridge,
                "order": spark.createDataFrame([("m", None, 2.0, 3.0), ("m", "c", 1.0, 4.0), ("m", "c", 1.0, None), (None, "d", 9.0, 9.0),
                                                ("n", "e", 1.0, 1.0)], "outlet_menu_id string, customer_id string, quantity double, unit_price double"),
                "food_quality": spark.createDataFrame([("m", 1.0, None), ("m", 2.0, "b"), ("n", 4.0, "a")],
                                                      "outlet_menu_id string, total_stage double, quality_status string")}
    for key, fs in (("outlet_id", (facts.sales_by_outlet, facts.quality_by_outlet)), ("product_id", (facts.sales_by_product, facts.quality_by_product))):
        shared = tables()
        facts.share_grains(shared, key)
        for fact in fs:
            assert sorted(map(tuple, fact(shared).collect())) == sorted(map(tuple, fact(tables()).collect()))
    assert sorted(map(tuple, facts.sales_by_outlet(tables()).collect())) == [("o", 4.0, 10.0, 1), ("q", 4.0, 10.0, 1)]


def test_quality_status_skips_nulls(spark):
    t = {"outlet_menu": spark.createDataFrame([("m", "o", "p"), ("n", "q", "p")], "outlet_menu_id string, outlet_id string, product_id string"),
         "food_quality": spark.createDataFrame([("m", 1.0, None), ("m", 2.0, None), ("m", 3.0, "b"), ("m", None, "a"), ("n", 4.0, None)],
                                               "outlet_menu_id string, total_stage double, quality_status string")}
    assert sorted(map(tuple, facts.quality_by_outlet(t).collect())) == [("o", 1.5, "a"), ("q", 4.0, None)]


def test_block_topk_is_brute_force():
    rng = np.random.default_rng(1)
    for n, m, k in ((300, 20000, 5), (3, 4, 5), (10, 1026, 2000), (257, 9217, 7)):
        q, d = rng.integers(-2, 3, (n, 6)) / 4, rng.integers(-2, 3, (m, 6)) / 4  # many equal scores
        s = np.round(q @ d.T, retrieval.SCORE_DIGITS)
        rows = np.argsort(-s, axis=1, kind="stable")[:, :k]
        qi, di, scores = retrieval.block_topk(q, d, k)
        assert np.array_equal(di.reshape(n, -1), rows) and np.array_equal(scores, s[qi, di])


def test_equal_vectors_are_scored_once(spark, monkeypatch):
    asked = []
    exact = retrieval.cosine_topk
    monkeypatch.setattr(retrieval, "cosine_topk", lambda q, d, k: asked.append(q.count()) or exact(q, d, k))
    docs = spark.createDataFrame([("a", "s", "1", [1.0, 0.0]), ("b", "s", "2", [0.6, 0.8])], "id string, source string, pk string, embedding array<float>")
    vectors = spark.range(6).select(F.col("id").alias("q_id"), F.when(F.col("id") < 5, F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")).alias("v"))
    got = sorted((r.q_id, r.id, r["rank"]) for r in retrieval.hits_of(vectors, docs, 2).collect())
    assert asked == [1] and got == [(q, i, r) for q in range(5) for i, r in (("a", 2), ("b", 1))]


def test_a_query_travels_once_to_a_cell(spark, monkeypatch):
    """With every bucket open, few rows meet the scoring step: not one for each bucket."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "id string, v array<double>")
    queries = docs.select(F.col("id").cast("long").alias("q_id"), "v")
    buckets = approximate.Buckets(approximate.random_planes(1, 6, 8), 6)  # 64 buckets, all open
    plain = [sorted(map(tuple, x.withColumn("score", F.round("score", 8)).collect()))
             for x in (retrieval.cosine_topk(queries, docs, 5), approximate.approximate_topk(queries, docs, buckets, 5),
                       approximate.approximate_topk(queries, docs, buckets, 5, doc_block=40, query_block=50))]
    assert plain[0] == plain[1] == plain[2]
    monkeypatch.setattr(approximate, "_open_topk", lambda k: lambda q, d: q.assign(id="", score=float(len(q)))[["q_id", "id", "score"]].head(1))
    assert approximate.approximate_topk(queries, docs, buckets, 5).select(F.max("score")).first()[0] == 300  # one cell, each query once


def test_opened_are_the_probes():
    buckets = approximate.Buckets(approximate.random_planes(2, 6, 8), 3)
    vectors = np.random.default_rng(3).standard_normal((40, 8))
    own, loose = buckets.opened(vectors)
    for code in range(64):
        assert np.array_equal(((own ^ code) & ~loose) == 0, (buckets.probes(vectors) == code).any(axis=2))


def test_rows_that_come_twice(spark):
    """Rows of one q_id share its places; an id that stands twice in a cell takes one place."""
    docs = spark.createDataFrame([(i, "s", i, v) for i, v in (("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]))],
                                 "id string, source string, pk string, embedding array<float>")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "q_id long, v array<float>")
    got = sorted((r.q_id, r["rank"], r.id) for r in retrieval.hits_of(vectors, docs, 2).collect())
    exact = retrieval.cosine_topk(vectors, docs.select("id", F.col("embedding").alias("v")), 2)
    assert got == sorted((r.q_id, r["rank"], r.id) for r in exact.collect())
    twice = docs.union(docs).union(docs).select("id", F.col("embedding").alias("v"))
    buckets = approximate.Buckets(np.array([[[1.0, -0.5], [-0.5, 1.0]]]), 2)  # a, b and c lie in buckets of their own
    near = approximate.approximate_topk(vectors.where("q_id = 2"), twice, buckets, 3)
    assert sorted((r["rank"], r.id) for r in near.collect()) == [(1, "c"), (2, "b"), (3, "a")]


def test_shared_totals_are_the_same(spark):
    """One row a key for all facts, stored once: every fact still has the rows and values of its own join."""
    outlets = (facts.sales_by_outlet, facts.daily_sales_by_outlet, facts.transport_by_outlet, facts.reviews_by_outlet, facts.quality_by_outlet)
    products = (facts.sales_by_product, facts.outlets_by_product, facts.transport_by_product, facts.reviews_by_product, facts.quality_by_product)

    def tables():
        make = spark.createDataFrame
        return {
            "outlet_menu": make([("a", "o", "p"), ("b", "o", None), ("c", None, "r"), ("a", "q", "p"), (None, "s", "p"), ("d", "t", "u")],
                                "outlet_menu_id string, outlet_id string, product_id string"),
            "order": make([("a", "x", 1, 2.5), ("a", None, 2, None), ("b", "x", None, 1.0), ("c", "y", 3, 1.0), ("b", None, 1, 1.0), (None, "x", 1, 1.0)],
                          "outlet_menu_id string, customer_id string, quantity int, unit_price double"),
            "daily_sales": make([("a", 4), ("c", 1), ("z", 9)], "outlet_product_id string, sales int"),
            "review": make([("a", 1, 0, 0), ("b", 0, None, 1)], "outlet_menu_id string, positive_score int, negative_score int, neutral_score int"),
            "food_quality": make([("a", 3, "x"), ("a", None, None), ("c", 2, "y")], "outlet_menu_id string, total_stage int, quality_status string"),
            "transportation": make([("c", 1.5), ("d", None)], "outlet_menu_id string, transportation_cost double")}

    shared = tables()
    facts.share(shared)
    for key, fs in (("outlet_id", outlets), ("product_id", products)):
        facts.share_grains(shared, key)
        for fact in fs:
            got = fact(shared)
            assert facts._totals_of(key) in shared
            want = fact(tables())
            assert got.dtypes == want.dtypes
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    part = {k: v for k, v in tables().items() if k in ("outlet_menu", "review")}
    facts.share(part)
    facts.share_grains(part, "outlet_id")
    assert facts.sales_by_outlet(part) is None and facts.transport_by_outlet(part) is None
    assert sorted(r.outlet_id for r in facts.reviews_by_outlet(part).collect()) == ["o", "q"]
    # of outlets and products only the (key, customer) pairs of the orders are shuffled beside what is stored
    assert "sum(" not in _plan(facts.sales_by_outlet(shared))


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffles_go_with_the_write(spark):
    """What a stored table was shuffled through is deleted at its end, and the setting is as before."""
    before, setting = _shuffle_files(spark), spark.conf.get(session.FREE_SHUFFLES, None)
    rows = spark.range(1000).repartition("id").groupBy(F.col("id") % 7).count()
    assert session.cut_lineage(rows).count() == 7 and session.cut_lineage(rows).count() == 7
    left = {f for f in _shuffle_files(spark) - before if f.endswith(".data")}
    for _ in range(50):  # deleted by a message to the executors; each count leaves one of a row
        if len(left) <= 2:
            break
        time.sleep(0.1)
        left = {f for f in _shuffle_files(spark) - before if f.endswith(".data")}
    assert len(left) <= 2
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting


def test_few_facts_meet_the_bridge_in_one_job(spark, monkeypatch):
    """Never all facts at once: a job's shuffles lie on disk until its table is stored."""
    plans = []
    stored = facts.cut_lineage
    monkeypatch.setattr(facts, "cut_lineage", lambda df, *a, **b: plans.append(_plan(df)) or stored(df, *a, **b))
    names = ("transport", "positive_score", "stage", "sales", "unit_price")
    for store in (facts.share, lambda t: facts.share_grains(t, "outlet_id"), lambda t: facts.share_grains(t, "product_id")):
        plans.clear()
        store(model_tables(spark, SF))
        in_job = [[n for n in names if f"AS {n}#" in p] for p in plans]
        assert sorted(n for job in in_job for n in job) == sorted(names) and max(map(len, in_job)) <= 2
    # a pair of outlet and customer travels without the sums
    assert "Expand" in plans[-1]
