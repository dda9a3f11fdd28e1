"""File listing, the manifest of processed files, JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow import schemas as S
from strataflow.functions import text as T
from strataflow.sources.tables import exists, materialize

SUFFIXES = ("pdf", "docx", "pptx", "potx")
MAX_BYTES, MAX_PAGES = 200 * 1024 * 1024, 500


def list_files(spark: SparkSession, root: str, suffixes=SUFFIXES, content: bool = True) -> DataFrame:
    """(source_key, file_name, length, modified, etag, status[, content]) of the files below ``root``.

    Works on any file system that Spark reads.  Files over the size limit keep their
    row, with status skipped_too_large and without content.
    """
    glob = "*.{" + ",".join([*suffixes, *(s.upper() for s in suffixes)]) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    big = F.col("length") > MAX_BYTES
    out = raw.select(
        F.col("path").alias("source_key"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", F.col("modificationTime").alias("modified"),
        F.when(~big, F.sha2("content", 256)).alias("etag"), F.when(big, "skipped_too_large").otherwise("pending").alias("status"), F.when(~big, F.col("content")).alias("content"),
    )
    return out if content else out.drop("content")


def latest(manifest: DataFrame) -> DataFrame:
    """The newest manifest entry of every source key."""
    order = Window.partitionBy("source_key").orderBy(F.col("processed_at").desc_nulls_last())
    return manifest.withColumn("sf_n", F.row_number().over(order)).where("sf_n = 1").drop("sf_n")


def not_done(listing: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files that are new, changed or failed: anti-join on key, etag and a finished status."""
    if force:
        return listing
    done = manifest.where(F.col("status").isin(*S.DONE_STATUS)).select("source_key", "etag")
    return listing.join(done, ["source_key", "etag"], "left_anti")


def one_per_content(rows: DataFrame, key: str = "doc_id", by: str = "processed_at") -> DataFrame:
    """The last processed row of every content id."""
    order = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last())
    return rows.withColumn("sf_n", F.row_number().over(order)).where("sf_n = 1").drop("sf_n")


def with_path_metadata(listing: DataFrame) -> DataFrame:
    """``listing`` with category, venue, year, doc_type, author_hint and doc_id."""
    out = listing.withColumn("sf_m", T.source_meta(F.col("source_key")))
    out = out.select("*", "sf_m.category", "sf_m.venue", "sf_m.year", "sf_m.doc_type").drop("sf_m")
    return out.withColumn("author_hint", T.author_hint(F.col("file_name"))).withColumn("doc_id", F.concat(F.lit("doc_"), F.substring("etag", 1, 12)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Parsed chunks (JSON lines); own files, so a bad line is an error."""
    return spark.read.schema(S.CHUNK).option("mode", "FAILFAST").json(path)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records (JSON lines) by the tolerant view; files that start with an underscore are skipped by Spark."""
    from strataflow.operators.extraction import read_records

    return read_records(spark.read.schema(S.EXTRACTION).json(path))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DOCUMENT_META).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(path)


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary file {"terms": [...]}: trimmed, lower-cased, distinct; lists for humans, so small."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("terms").alias("t")).select(F.lower(F.trim("t")).alias("t")).distinct()
    return sorted(r["t"] for r in rows.collect())


#: Parts of a table that is merged by document: a batch rewrites the parts of its documents.
BUCKETS = 256


def write_by_document(df: DataFrame, path: str, ids: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Replace the documents of ``df`` (and those of ``ids``, which may have no rows left) in the Parquet table at ``path``.

    Rows are dealt to ``buckets`` by a hash of the document id (the column ``bucket``),
    so a table has as many directories at any size; the parts that a batch touches are
    written anew (dynamic partition overwrite), and a batch that runs twice leaves the
    same table.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = materialize(df.select("*", bucket), "new-rows")
    gone = new.select("doc_id", "bucket")
    gone = (gone if ids is None else gone.unionByName(ids.select("doc_id", bucket))).distinct()
    if exists(spark, path):
        old = spark.read.parquet(path)
        touched = old.join(F.broadcast(gone.select("bucket").distinct()), "bucket", "left_semi")  # a row a bucket at most
        new = new.unionByName(touched.join(gone.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
