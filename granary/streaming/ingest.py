"""Continuous ingest: new documents are chunked as they arrive, and event-time counts of what came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from granary.operators.chunker import chunk_documents

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in "filename filepath relative_path file_type content source_identity source_fingerprint".split()])


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(docs: DataFrame, out: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Append the chunks of arriving documents to ``out``, each source version once.

    A batch writes a folder of its own (``batch=<id>``) and replaces it when it is repeated, so a
    restart neither loses nor doubles chunks. Sources already present with the same fingerprint are skipped.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["source_identity", "source_fingerprint"])
        try:
            known = spark.read.parquet(out).where(F.col("batch") != epoch)
            seen = known.select(F.col("doc_id").alias("source_identity"), F.get_json_object("metadata", "$.source_fingerprint").alias("source_fingerprint")).distinct()
            fresh = fresh.join(seen, ["source_identity", "source_fingerprint"], "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        chunk_documents(fresh, size, overlap).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need instants: times without a zone are read in the session's."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, time_col: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(start, <by>, n)`` per tumbling window of event time; rows later than ``late`` behind the newest are not waited for."""
    grouped = _timed(events, time_col).withWatermark(time_col, late).groupBy(F.window(time_col, width), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time_col: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``(start, end, <by>, n)``: runs of events no further apart than ``gap``."""
    grouped = _timed(events, time_col).withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
