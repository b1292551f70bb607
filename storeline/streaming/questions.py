"""The question pipeline over a stream of arriving question files.

The reference answers questions one at a time as they arrive; here arriving
files of questions are a Structured Streaming source and each micro-batch
runs the batch pipeline (``plans.answers``) against masters that were built
and stored once. Output is written per epoch with overwrite, so a retried
micro-batch replaces its own output (idempotent sink); the stream's progress
lives in the shared checkpoint folder named by the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from storeline.plans import answers
from storeline.session import ensure_checkpoint_dir

QUESTION_SCHEMA = "q_id BIGINT, question STRING"


def answer_stream(spark: SparkSession, question_dir: str, masters: dict[str, DataFrame], out_dir: str,
                  name: str = "answers", available_now: bool = True) -> StreamingQuery:
    """Start the stream: parquet question files in ``question_dir`` -> answers under ``out_dir/epoch=N``."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    stream = spark.readStream.schema(QUESTION_SCHEMA).parquet(question_dir)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        out = answers.answers(batch, masters)
        out.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}")

    writer = (stream.writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", f"{base}/streams/{name}"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
