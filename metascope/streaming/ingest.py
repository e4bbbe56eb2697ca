"""Incremental ingest as a stream: new files of an export become methods in a table, each file's rows replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metascope.runtime import cut
from metascope.sources import exports, modules
from metascope.sources.sinks import TableStore

FILES = "file_id bigint, config_id string, file_path string, rel_path string, mtime timestamp_ntz, length bigint, content binary, scanned_at timestamp_ntz"


def ingest_methods(spark: SparkSession, folder: str, store: TableStore, checkpoint: str, table: str = "methods") -> StreamingQuery:
    """Reads parquet files of scanned versions as they come and replaces each file's methods. The newest version of a file
    (scanned_at, ties: file_id) wins, in whatever order and batches versions come; a newest version without methods leaves
    none. The versions taken are in <table>_files. A batch that is repeated after a failure gives the same table."""

    def batch(df: DataFrame, _: int) -> None:
        path = exports.slashes(F.col("rel_path"))
        v = df.groupBy("config_id", path.alias("file_path")).agg(F.max(F.struct("scanned_at", "file_id")).alias("v")).select("config_id", "file_path", "v.scanned_at", "v.file_id")
        new = cut(store.newer_files(table, v))
        if not new.isEmpty():
            rows = df.join(new.select("file_id"), "file_id", "left_semi").dropDuplicates(["file_id"])
            store.replace_versions(table, modules.methods(rows).withColumn("file_path", path), new)

    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", 64).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(spark: SparkSession, folder: str, window: str = "1 day") -> DataFrame:
    """Scanned versions per configuration and window of scanned_at, for the output modes update and complete. Versions come
    in no order of time, so no watermark closes a window: a late version corrects its window's row. The state is one
    row for each configuration and window, whatever the number of versions."""
    s = spark.readStream.schema(FILES).parquet(folder).withColumn("at", F.col("scanned_at").cast("timestamp"))
    return s.groupBy(F.window("at", window), "config_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("length").alias("bytes"))
