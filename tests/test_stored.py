"""Stored masters, documents, vectors and reports read back as they were; the vectoriser hook and the mended edges."""

import pytest
from pyspark.sql import functions as F

from storeline.operators import enrich, masters, profile, responses, retrieval
from storeline.sources import stored


def test_round_trips(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([("a:1", "a", "1", "café x", "{}"), ("a:2", "a", "2", None, None)], stored.DOCUMENT_SCHEMA)
    stored.write_documents(docs, folder)
    assert sorted(stored.read_documents(spark, folder).collect()) == sorted(docs.collect())
    made = retrieval.embed_text(docs.na.fill(""), "text")
    stored.write_vectors(made, folder)
    assert {r.id for r in stored.read_vectors(spark, folder).collect()} == {"a:1", "a:2"}
    stored.write_masters({"outlet": docs}, folder)
    assert stored.read_masters(spark, folder, ["outlet"])["outlet"].count() == 2
    stored.write_report(profile.report_lines(profile.profile_table(docs, "docs")), folder)
    assert [r.value.split("|")[1].strip() for r in stored.read_report(spark, folder).collect()] == docs.columns


def test_words_beyond_ascii_have_vectors(spark):
    rows = spark.createDataFrame([("caf\u00e9",), ("caf",), ("\u65e5\u672c",)], "t string")
    a, b, c = (r.embedding for r in retrieval.embed_text(rows, "t").collect())
    assert a != b and any(c)


def test_vectoriser_hook(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    out = retrieval.embed_text(rows, "t", "v", vectoriser=lambda df, text, new: df.withColumn(new, F.array(F.lit(1.0))))
    assert out.first().v == [1.0]


def test_group_totals_keep_the_column_order(spark):
    df = spark.createDataFrame([("1", "x", 2.0)], "id string, city string, rev double")
    assert enrich.group_totals(df, "city", {"total": "rev"}).columns == ["id", "city", "rev", "total"]


def test_all_white_space_is_stripped(spark):
    df = spark.createDataFrame([("\t Pune\n",)], "city string")
    assert enrich.standardize_strings(df, ("city",)).first().city == "pune"
    blank = spark.createDataFrame([("\t\n",), ("x",), (None,)], "a string")
    assert [r.f for r in blank.select(masters.availability_flag(blank, "a").alias("f")).collect()] == [False, True, False]


@pytest.mark.parametrize("text, want", [
    ('{"text":"a"} trailing prose', None), ("{'text':'single'}", None), ('{"a":1},{"b":2}', None),
    ('{"text":" a "}', "a"), ('{"choices":[{"message":{"content":"hi"}}]}', "hi")])
def test_answers_are_parsed_strictly(spark, text, want):
    got = spark.createDataFrame([(text,)], "r string").select(responses.extract_answer(F.col("r"))).first()[0]
    assert got == (text if want is None else want)
