"""Errors as answer text, fallbacks without an index or without masters, and nested clean-up."""

import math

import pytest
from pyspark.sql import functions as F

from storeline.operators import enrich, masters, retrieval, select
from storeline.plans import answers, errors
from storeline.session import cut_lineage

from test_edges import _tables

SCHEMA = "q_id long, question string"


@pytest.fixture(scope="module")
def small_masters(spark):
    t = _tables(spark)
    mo, mp = cut_lineage(masters.master_outlet(t)), cut_lineage(masters.master_product(t))
    eo = cut_lineage(enrich.enrich_outlet(mo))
    return {"mo": mo, "mp": mp, "eo": eo, "ep": cut_lineage(enrich.enrich_product(mp, mo))}


def test_quarantine(spark):
    rows = [(1, "top 3 products"), (2, None), (3, "a"), (3, "b"), (None, "no id"), (4, ""), (5, None), (5, "x")]
    good, failed = errors.quarantine(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.q_id for r in good.collect()) == [1, 4]
    assert sorted(((r.q_id, r.error) for r in failed.collect()), key=repr) == sorted([
        (2, errors.PREFIX + errors.NO_QUESTION), (3, errors.PREFIX + errors.SHARED_ID), (3, errors.PREFIX + errors.SHARED_ID),
        (None, errors.PREFIX + errors.NO_ID), (5, errors.PREFIX + errors.NO_QUESTION), (5, errors.PREFIX + errors.SHARED_ID)], key=repr)


def picky_model():
    """A model that cannot read some texts, and fails on any batch that holds one."""

    def picky(texts):
        if any("unreadable" in t for t in texts):
            raise ValueError("the model cannot read this")
        return [[float(len(t)), 1.0] for t in texts]

    return picky


def test_failing_questions_harm_no_other(spark, small_masters):
    rows = [(1, "tell me about pizza"), (2, "tell me about unreadable things"), (3, None), (4, "where is A located?"), (5, "list all products"), (6, "")]
    qs = spark.createDataFrame(rows, SCHEMA)
    got = {r.q_id: r for r in answers.answers(qs, small_masters, vectoriser=errors.row_by_row(picky_model())).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[2].error == errors.PREFIX + "the model cannot read this" and got[2].messages is None
    assert got[3].error == errors.PREFIX + errors.NO_QUESTION
    alone = {r.q_id: r for r in answers.answers(qs.where("q_id in (1, 4, 5, 6)"), small_masters, vectoriser=errors.row_by_row(picky_model())).collect()}
    for k in (1, 4, 5, 6):
        assert got[k].error is None and (got[k].context, got[k].messages) == (alone[k].context, alone[k].messages)


def test_answer_texts(spark):
    asked = spark.createDataFrame([(1, None), (2, "Error processing query: x"), (3, None), (4, None)], "q_id long, error string")
    replies = spark.createDataFrame([(1, '{"content":" fine "}'), (2, "unused"), (4, None)], "q_id long, response string")
    assert {r.q_id: r.answer for r in errors.answer_texts(asked, replies).collect()} == {
        1: "fine", 2: "Error processing query: x", 3: errors.PREFIX + errors.NO_REPLY, 4: errors.PREFIX + errors.NO_REPLY}


def test_without_products(spark, small_masters):
    m = small_masters | {"mp": small_masters["mp"].limit(0), "ep": small_masters["ep"].limit(0)}
    qs = spark.createDataFrame([(1, "list all products"), (2, "top 3 outlet by revenue"), (3, "how many products are there?"), (4, "why is pizza good?")], SCHEMA)
    from storeline.operators import intents
    it = intents.parse(qs, m["eo"])
    hits, _ = answers.retrieved(qs, it, m)
    rows = [(r.q_id, r.pos, r.kind, r.tbl) for r in select.evidence(it, m["eo"], m["ep"], hits)[0].collect()]
    for q in (1, 3, 4):  # two outlets are all the documents there are
        assert sorted(r for r in rows if r[0] == q) == [(q, 1, "doc", "outlet"), (q, 2, "doc", "outlet")]
    assert sorted(r[1:] for r in rows if r[0] == 2) == [(1, "row", "outlet"), (2, "row", "outlet")]
    assert answers.answers(qs, m).where("error is not null").count() == 0


def test_placeholder(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "q_id long, v array<double>")
    docs = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<double>")
    full = retrieval.or_placeholder(retrieval.cosine_topk(asked, docs), asked, docs).collect()
    assert [(r.id, r.raw) for r in full] == [("a", None), ("a", None)]
    none = retrieval.or_placeholder(retrieval.cosine_topk(asked, docs.limit(0)), asked, docs.limit(0)).collect()
    assert sorted((r.q_id, r.id, r["rank"], r.score, r.raw["fallback"]) for r in none) == [
        (1, None, 1, 0.0, retrieval.NO_INDEX), (2, None, 1, 0.0, retrieval.NO_INDEX)]


def test_records_behind_evidence(spark, small_masters):
    ev = spark.createDataFrame([(1, 1, "row", "outlet", "1"), (1, 2, "doc", "product", "10"), (1, 3, "agg", "product", None), (2, 1, "row", "outlet", "1")],
                               "q_id long, pos int, kind string, tbl string, pk string")
    got = {(r.q_id, r.pos): r.raw for r in select.with_raw(ev, small_masters).collect()}
    assert got[(1, 1)]["outlet"] == "A" and got[(1, 1)]["total_revenue"] == "15.0" and got[(1, 1)] == got[(2, 1)]
    assert set(got[(1, 1)]) == set(small_masters["eo"].columns) and set(got[(1, 2)]) == set(small_masters["mp"].columns)
    assert got[(1, 3)] is None


def test_nested_values_are_sanitised(spark):
    nan, inf = float("nan"), float("inf")
    schema = "a struct<x:double,l:array<struct<y:float,z:string>>,m:map<string,array<double>>>, b map<double,string>, c array<array<double>>, d double, e string"
    rows = [((nan, [(inf, "t"), None], {"k": [nan, 1.5, None]}), {1.0: "v"}, [[inf], None, []], -inf, "nan"), (None, None, None, None, None)]
    got = retrieval.sanitize_values(spark.createDataFrame(rows, schema)).collect()
    assert got[0].a.x == 0.0 and got[0].a.l[0].y == 0.0 and got[0].a.l[1] is None and got[0].a.m == {"k": [0.0, 1.5, None]}
    assert got[0].c == [[0.0], None, []] and got[0].d == 0.0 and got[0].e == "nan" and got[0].b == {1.0: "v"}
    assert all(v is None for v in got[1])
    assert not math.isnan(got[0].a.x) and got[0].__fields__ == ["a", "b", "c", "d", "e"]
    assert retrieval.sanitize_values(spark.createDataFrame(rows, schema)).schema.simpleString() == spark.createDataFrame(rows, schema).schema.simpleString()


def test_raw_map_has_every_column(spark):
    df = spark.createDataFrame([(1, 2.5, "x", None)], "a int, b double, c string, d double")
    assert df.select(retrieval.raw_map(df).alias("m")).first().m == {"a": "1", "b": "2.5", "c": "x", "d": None}
    assert df.select("a", "c").select(F.size(retrieval.raw_map(df.select("a", "c")))).first()[0] == 2
