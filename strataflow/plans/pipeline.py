"""Batch build as a command: files to chunks to extraction records to graph tables, and a plan of merges.

Files and chunks that are done are not done again; ``apply`` carries the plan out.

    spark-submit -m strataflow.plans.pipeline all --root s3a://corpus/raw --out s3a://corpus/tables
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataflow.operators import entity_resolution as R
from strataflow.operators import extraction as X
from strataflow.operators import graph_build as K
from strataflow.plans import providers as P
from strataflow.sources import files, office, tables
from strataflow.streaming import ingest as I


def step_ingest(spark: SparkSession, root: str, out: str, force: bool = False) -> None:
    """Parse the files that are new, changed or failed before; the manifest says which are done."""
    listing = files.with_path_metadata(files.list_files(spark, root)).withColumn("processed_at", F.col("modified"))
    # winners are chosen without the bytes, then the bytes follow
    todo = listing.drop("content").where("etag is not null")
    if tables.exists(spark, f"{out}/manifest"):
        todo = files.not_done(todo, files.latest(spark.read.parquet(f"{out}/manifest")), force)
    todo = tables.materialize(files.one_per_content(todo), "to-do")
    parsed = tables.materialize(office.parse_files(listing.join(todo.select("source_key"), "source_key", "left_semi")), "parsed")
    files.write_by_document(I.chunked(parsed.where("status = 'ok'")), f"{out}/chunks", todo)
    failed = parsed.where("status <> 'ok'").select("doc_id", F.col("status").alias("said")).distinct()
    done = todo.join(failed, "doc_id", "left").withColumn("status", F.coalesce("said", F.lit("ok"))).drop("said")
    skipped = listing.drop("content").where("etag is null")
    done.unionByName(skipped).withColumn("processed_at", F.current_timestamp()).write.mode("append").parquet(f"{out}/manifest")


def step_extract(spark: SparkSession, out: str, extractor=None, limit: int | None = None) -> None:
    """Ask for the chunks whose text has no answer yet; answers are kept, so a provider is asked once."""
    chunks = spark.read.parquet(f"{out}/chunks").withColumn("asked", F.sha2("text", 256))
    todo = chunks
    if tables.exists(spark, f"{out}/answers"):
        todo = chunks.join(spark.read.parquet(f"{out}/answers").select("chunk_id", "asked"), ["chunk_id", "asked"], "left_anti")
    todo = tables.materialize(todo if limit is None else todo.orderBy("chunk_id").limit(limit), "to-ask")
    P.extract(todo.drop("asked"), extractor or P.RuleExtractor()).join(todo.select("chunk_id", "asked"), "chunk_id").write.mode("append").parquet(f"{out}/answers")
    current = spark.read.parquet(f"{out}/answers").join(chunks.select("chunk_id", "asked"), ["chunk_id", "asked"], "left_semi")
    records = X.postvalidate(X.parse_answers(current).where("not rejected"))
    records.select("chunk_id", "doc_id", F.col("doc_id").alias("source_doc"), F.col("chunk_id").alias("source_chunk"), "result").write.mode("overwrite").parquet(f"{out}/extractions")


def step_load(spark: SparkSession, out: str) -> None:
    records = spark.read.parquet(f"{out}/extractions")
    kept = K.admitted(X.mentions(records))
    K.aggregate_entities(kept).write.mode("overwrite").parquet(f"{out}/entities")
    facts = K.resolve_relations(X.relation_mentions(records), kept)
    facts = facts.withColumn("src", K.node_id(F.col("source_label"), F.col("source_key"))).withColumn("dst", K.node_id(F.col("target_label"), F.col("target_key")))
    facts.write.mode("overwrite").parquet(f"{out}/facts")
    K.first_edges(K.edge_properties(spark.read.parquet(f"{out}/facts")).select("src", "type", "dst", "doc_id", "chunk_id", "ord", "confidence", "props"), ["doc_id", "chunk_id", "ord"]).write.mode("overwrite").parquet(f"{out}/edges")
    K.described_in(kept).write.mode("overwrite").parquet(f"{out}/described_in")
    K.load_statistics(X.mentions(records), kept, X.relation_mentions(records), facts).write.mode("overwrite").parquet(f"{out}/load_statistics")


def step_embed(spark: SparkSession, out: str, embedder=None) -> None:
    """Vectors of the chunks there are; those whose text and model are unchanged are taken from the last run."""
    chunks, cache = spark.read.parquet(f"{out}/chunks"), None
    if tables.exists(spark, f"{out}/vectors"):
        cache = spark.read.parquet(f"{out}/vectors")
    new = tables.materialize(P.embed(chunks, embedder or P.HashingEmbedder(), cache), "vectors")
    new.write.mode("overwrite").parquet(f"{out}/vectors")


def step_report(spark: SparkSession, out: str) -> None:
    """(item, n) into ``report``: sizes of the tables, files by status, chunk ids that repeat, edges without a publication."""
    chunks, manifest = spark.read.parquet(f"{out}/chunks"), files.latest(spark.read.parquet(f"{out}/manifest"))
    status = manifest.groupBy(F.concat(F.lit("status:"), "status").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    twice = K.unique_violations(chunks, "chunk_id").agg(F.lit("repeated_chunk_ids").alias("item"), F.count(F.lit(1)).alias("n"))
    lost = K.orphans(spark.read.parquet(f"{out}/edges").withColumnRenamed("doc_id", "source_doc"), chunks.select("doc_id").distinct())
    rows = status.unionByName(twice).unionByName(lost.agg(F.lit("edges_without_document").alias("item"), F.count(F.lit(1)).alias("n")))
    for name in ("chunks", "vectors", "entities", "facts", "edges"):
        if tables.exists(spark, f"{out}/{name}"):
            rows = rows.unionByName(spark.read.parquet(f"{out}/{name}").agg(F.lit(f"rows:{name}").alias("item"), F.count(F.lit(1)).alias("n")))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/report")


def step_dedup(spark: SparkSession, out: str) -> None:
    """Plan merges of entities alike in name: decisions, clusters, the map of duplicates and counts; nothing is merged yet."""
    nodes = _nodes(spark, out)
    pairs = R.fuzzy_pairs(nodes.select("label", "id", "name_norm")).withColumn("cosine_score", F.lit(None).cast("double"))
    R.safe_only(R.decide(pairs)).write.mode("overwrite").parquet(f"{out}/dedup/decisions")
    decisions = spark.read.parquet(f"{out}/dedup/decisions")
    groups, mapping = R.clusters(nodes, decisions)
    groups.write.mode("overwrite").parquet(f"{out}/dedup/clusters")
    mapping.write.mode("overwrite").parquet(f"{out}/dedup/mapping")
    R.plan_summary(decisions).write.mode("overwrite").parquet(f"{out}/dedup/summary")


def step_apply(spark: SparkSession, out: str) -> int:
    """Carry out the plan of :func:`step_dedup` into ``merged/entities`` and ``merged/edges`` and log it; the number of merged nodes.

    ValueError if the plan names a node that is there no longer: plan again.
    """
    nodes, mapping = _nodes(spark, out), spark.read.parquet(f"{out}/dedup/mapping")
    asked = mapping.select(F.explode(F.array("id", "canon_id")).alias("id")).distinct()
    if lost := asked.join(nodes, "id", "left_anti").count():
        raise ValueError(f"{lost} nodes of the plan are missing")
    edges = spark.read.parquet(f"{out}/edges")
    kept, moved = R.rewire(nodes, edges.withColumn("props", F.to_json("props")), mapping)
    kept.write.mode("overwrite").parquet(f"{out}/merged/entities")
    moved.withColumn("props", F.from_json("props", edges.schema["props"].dataType)).write.mode("overwrite").parquet(f"{out}/merged/edges")
    files.append_log(mapping, f"{out}/merged/log")
    return mapping.count()


def _nodes(spark: SparkSession, out: str):
    """Entities with id and degree."""
    edges = spark.read.parquet(f"{out}/edges")
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = spark.read.parquet(f"{out}/entities").withColumn("id", K.node_id(F.col("label"), F.col("name_norm")))
    return nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("step", choices=["ingest", "extract", "load", "embed", "dedup", "report", "apply", "all"])
    ap.add_argument("--root")
    ap.add_argument("--out", required=True)
    ap.add_argument("--force", action="store_true", help="parse files again that are done")
    ap.add_argument("--limit", type=int, help="ask for so many chunks at most")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("strataflow").getOrCreate()
    if a.step in ("ingest", "all"):
        step_ingest(spark, a.root, a.out, a.force)
    if a.step in ("extract", "all"):
        step_extract(spark, a.out, limit=a.limit)
    if a.step in ("load", "all"):
        step_load(spark, a.out)
    if a.step in ("embed", "all"):
        step_embed(spark, a.out)
    if a.step in ("dedup", "all"):
        step_dedup(spark, a.out)
    if a.step in ("report", "all"):
        step_report(spark, a.out)
    if a.step == "apply":
        step_apply(spark, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
