"""The question pipeline as a stream: question files in, one answers folder per micro-batch out."""

import glob

from pyspark.sql import functions as F

from storeline.plans import answers
from storeline.sources.fixtures import model_tables
from storeline.sources.questions import conversation_questions
from storeline.sources.testdata import Tables
from storeline.streaming.questions import answer_stream

from conftest import SF_SMALL


def test_answer_stream(spark, tmp_path):
    qdir, out = str(tmp_path / "questions"), str(tmp_path / "answers")
    qs = conversation_questions(Tables(spark, SF_SMALL))
    n = qs.count()
    qs.write.parquet(qdir)
    m = answers.build_masters(model_tables(spark, SF_SMALL))
    query = answer_stream(spark, qdir, m, out, name=f"test-{tmp_path.name}")
    query.awaitTermination(600)
    assert query.exception() is None
    got = spark.read.parquet(*glob.glob(f"{out}/epoch=*"))
    assert got.count() == n
    assert got.where(F.col("context").isNull()).count() == 0
