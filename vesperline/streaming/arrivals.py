"""Extraction of notes as they arrive. Line windows need whole notes, so each micro-batch is a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperline.operators.extract import tasks
from vesperline.sources.notes import MARKERS, without_bom


def extract_arrivals(spark: SparkSession, notes_dir: str, out_dir: str, state_dir: str):
    """Start a query that reads Parquet files of ``(root, file, text)`` as they land in a folder and appends their
    tasks to ``out_dir``. A batch that is run again writes its own folder again."""

    def batch(df: DataFrame, number: int) -> None:
        text = without_bom(F.col("text"))
        tasks(df.withColumn("text", text).where(text.rlike(MARKERS))).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    stream = spark.readStream.schema("root string, file string, text string").parquet(notes_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
