"""Incremental sketching of a folder that records keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import SketchParams
from ..operators.sketch import build
from ..sources.shared import scratch

RECORDS = "sketch_id bigint, rec_id bigint, seq string"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of cleaned records from Parquet files."""
    return spark.readStream.schema(RECORDS).parquet(folder)


def sketch_stream(records: DataFrame, target: str, checkpoint: str, p: SketchParams, once: bool = True) -> StreamingQuery:
    """Append the sketch of each micro-batch's records to a folder, one subfolder a batch.

    A batch that is run again after a failure overwrites its own subfolder.  A
    sketch whose records arrive in several batches has rows in several
    subfolders; :func:`read_sketch` adds them up.
    """

    def append(batch: DataFrame, number: int) -> None:
        build(batch, p.counting).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_sketch(spark: SparkSession, target: str, p: SketchParams) -> DataFrame:
    """The sketch of all batches: sketch_id, minimizer, kmer, cnt and pos_min.

    Counts of a k-mer are added up before the least abundance is asked for, so
    ``sketch_stream`` keeps every count.
    """
    parts = spark.read.parquet(target).drop("batch")
    found = parts.groupBy("sketch_id", "minimizer", "kmer").agg(F.sum("cnt").alias("cnt"), F.min("pos_min").alias("pos_min"))
    return found.where(F.col("cnt") >= p.abundance) if p.abundance > 1 else found


def sketch_once(records: DataFrame, p: SketchParams) -> DataFrame:
    """Run a stream of records to its end in a scratch folder and return the sketch it made."""
    folder = scratch(records.sparkSession)
    sketch_stream(records, f"{folder}/sketch", f"{folder}/state", p).awaitTermination()
    return read_sketch(records.sparkSession, f"{folder}/sketch", p)
