"""Gene calling over a folder that FASTA files keep arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orfweave.params import DEFAULT, Params
from orfweave.plans.annotate import Annotation
from orfweave.sources.readers import records_to_contigs


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files' texts: file, value. A file is one row, so a contig never falls in two batches."""
    files = spark.readStream.schema("value string").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def annotate(spark: SparkSession, folder: str, target: str, checkpoint: str, params: Params = DEFAULT, **trigger) -> StreamingQuery:
    """Appends the calls of each new file's contigs to Parquet files in target, one folder a batch: a batch that is run
    again after a failure replaces its folder. Contigs of different files are kept apart by the file's name."""

    def each(batch: DataFrame, number: int) -> None:
        records = batch.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("value")), "\n>")).alias("place", "value")).where("place > 0")
        own = records_to_contigs(records.withColumn("place", F.col("place").cast("long")), "file")
        named = own.select(F.concat_ws("#", "file", "contig_id").alias("contig_id"), "seq", "length")
        run = Annotation(named, params=params)
        run.calls.write.mode("overwrite").parquet(f"{target}/batch={number}")
        run.release()

    return contigs(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
