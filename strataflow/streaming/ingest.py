"""Incremental ingest: a file stream whose batches are parsed, chunked and merged by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import text as T
from strataflow.operators import blocks as B
from strataflow.operators import chunking as C
from strataflow.sources import files, office


def process(listing: DataFrame, pdf=None, presentation: bool = False) -> DataFrame:
    """Chunks of listed files: parse, drop noise, assign sections, chunk."""
    return chunked(office.parse_files(listing, pdf).where("status = 'ok'"), presentation)


def chunked(parsed: DataFrame, presentation: bool = False) -> DataFrame:
    """Chunks of parsed blocks: drop noise, assign sections, chunk."""
    return C.chunk_documents(B.assign_sections(B.drop_noise(parsed.drop("status", "error"))), presentation)


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str, pdf=None):
    """Start a query that ingests new files below ``root`` once and ends (availableNow).

    Every batch replaces its documents, so a batch that runs twice after a failure
    leaves the same table.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,pptx,potx,pdf}").load(root)

    def merge(batch: DataFrame, _: int) -> None:
        named = batch.where(F.col("length") <= files.MAX_BYTES).select(T.content_id(F.col("content")).alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content", F.col("modificationTime").alias("processed_at"))
        files.write_by_document(process(files.one_per_content(named), pdf), out)

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
