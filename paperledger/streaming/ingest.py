"""Incremental ingestion: files that arrive are read once, whatever happens to a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperledger.schema import EXTRACTION, FILE
from paperledger.sources.extract import Extraction, chosen_content, extract, plain_text
from paperledger.sources.files import unique_files
from paperledger.tables import exists


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files below a folder."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(folder)


def ingest(spark: SparkSession, folder: str, cache: str, checkpoint: str, extractor: Callable[[bytes, str], Extraction] = plain_text) -> StreamingQuery:
    """Extracts the texts of all files that weren't seen yet and ends. Contents known from the cache or seen
    twice in a batch are skipped.

    The batch number is part of the path and a batch overwrites its own folder, so a batch that runs again
    after a failure leaves its rows once.
    """

    def batch(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        first = unique_files(files)
        if exists(session, cache):  # one read of the hashes of all batches but this one, which may run again
            known = session.read.schema(f"{EXTRACTION.toDDL()}, batch bigint").parquet(cache).where(F.col("batch") != number)
            first = first.join(known.select("sha256"), "sha256", "left_anti")
        extract(chosen_content(first, files), extractor).write.mode("overwrite").parquet(f"{cache}/batch={number}")

    return new_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
