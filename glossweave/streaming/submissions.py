"""Submissions as a stream: flattened as they come, merged by key when read, and the consensus of the articles that a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from glossweave.operators.consensus import build_consensus, drop_sentinel
from glossweave.operators.nested import TAGGED, annotation_spans, flat_table, tag_submissions
from glossweave.session import cut

SUBMISSIONS = "submission_key string, received_at timestamp, payload string"
#: Folders over which the articles of a table are spread, so that a batch reads those of its own articles only.
BUCKETS = 64


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submissions from Parquet files as they arrive, however late; keys sent again are merged when tables are read."""
    return spark.readStream.schema(SUBMISSIONS).parquet(path)


def _bucket(article: str = "article_id"):
    return F.pmod(F.xxhash64(article), F.lit(BUCKETS)).cast("int")


def _write(df: DataFrame, out: str, number: int) -> None:
    tag_submissions(df).withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("tag", "bucket").parquet(f"{out}/batch={number}")


def flatten_stream(rows: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the tagged flat tables, a folder for each batch, so that a batch run again replaces its own rows."""
    return rows.writeStream.foreachBatch(lambda df, number: _write(df, out, number)).option("checkpointLocation", checkpoint)


def merged_table(spark: SparkSession, out: str, table: str, buckets: list[int] | None = None) -> DataFrame:
    """A flat table of all batches, of a key that came in several batches only the rows of the one received first.

    Ties go to the earlier batch. Rejected rows all stay. Whatever the order of arrival, no submission is lost and
    none counts twice. `buckets` limits the folders read.
    """
    everything = spark.read.schema(f"{TAGGED}, bucket int, batch bigint").option("basePath", out).parquet(f"{out}/batch=*")
    rows = everything.where(F.col("tag") == table)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if table != "rejects":
        place = F.struct(F.col("received_at").isNull().alias("late"), "received_at", "batch")
        first = everything.where("tag = 'submissions'").groupBy("submission_key").agg(F.min(place).alias("p")).select("submission_key", F.col("p.batch").alias("batch"))
        rows = rows.join(first, ["submission_key", "batch"], "left_semi")
    return flat_table(rows, table)


def consensus_stream(rows: DataFrame, tables: str, out: str, checkpoint: str) -> DataStreamWriter:
    """As flatten_stream; then the consensus of the articles with new spans is rebuilt into a folder for each batch.

    The newest batch folder of an article holds its consensus.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        _write(df, tables, number)
        new = spark.read.schema(f"{TAGGED}, bucket int").parquet(f"{tables}/batch={number}").where("tag = 'annotations'")
        touched = cut(new.select("article_id", "bucket").where("article_id IS NOT NULL").distinct())
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
        spans = merged_table(spark, tables, "annotations", buckets).join(touched.select("article_id"), "article_id", "left_semi")
        build_consensus(drop_sentinel(annotation_spans(spans))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
