"""The import of search results as a stream: micro-batches go through the batch operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolegraph.operators.imports import first_of_url, merged, normalized_records

#: Folders that a batch's rows are dealt to by their URL.
BUCKETS = 64


def start_import(records: DataFrame, results_folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append new results of a stream of records (imports.RECORD) to a Parquet folder, once for each query and URL.

    Each batch is written under its own id, so a batch that is repeated after a failure replaces itself; inside it rows
    lie in folders by bucket of their URL. A batch reads of what is stored the columns of the key, and only the buckets
    that its own URLs fall in.
    """
    bucket = F.pmod(F.xxhash64("normalized_url"), F.lit(BUCKETS)).cast("int")

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = first_of_url(normalized_records(df)[0]).withColumns({"batch": F.lit(epoch), "bucket": bucket})
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        try:
            stored = spark.read.parquet(results_folder).filter((F.col("batch") < epoch) & F.col("bucket").isin(touched))
        except AnalysisException:  # the first batch finds no folder
            stored = new.limit(0)
        merged(new, stored).drop("batch").write.mode("overwrite").partitionBy("bucket").parquet(f"{results_folder}/batch={epoch}")

    w = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
