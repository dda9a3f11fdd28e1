"""Mentions and relation mentions to nodes, edges, facts and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow import schemas as S
from strataflow.functions import text as T

UNFILTERED = ("Expert", "Organization")


def admitted(mentions: DataFrame, stop=T.STOP_TERMS, least: float = 0.5) -> DataFrame:
    """Mentions that may become nodes: no stop term; confident, or of a label that need not be."""
    stopped = F.lower(T.strip(F.col("name_norm"))).isin(*stop)
    return mentions.where(~stopped & ((F.col("confidence") >= least) | F.col("label").isin(*UNFILTERED)))


def admission_counts(mentions: DataFrame, stop=T.STOP_TERMS, least: float = 0.5) -> DataFrame:
    """(stopped, unsure): rejections among the first mentions of each (label, name)."""
    first = mentions.groupBy("label", "name_norm").agg(F.min_by("confidence", F.struct("doc_id", "chunk_id", "ord")).alias("confidence"))
    stopped = F.lower(T.strip(F.col("name_norm"))).isin(*stop)
    unsure = ~stopped & (F.col("confidence") < least) & ~F.col("label").isin(*UNFILTERED)
    return first.agg(F.sum(stopped.cast("long")).alias("stopped"), F.sum(unsure.cast("long")).alias("unsure"))


def node_id(label, name_norm):
    return F.sha2(F.concat_ws("\x1f", label, name_norm), 256)


def aggregate_entities(mentions: DataFrame) -> DataFrame:
    """One node for (label, name_norm): the first mention names it, aliases unite, confidence is the highest.

    Everything is a partial aggregate, so a name that a third of all mentions share
    costs one row a task.
    """
    order = F.struct("doc_id", "chunk_id", "ord")
    first = F.min_by(F.struct("name", "geography", "source_doc", "source_chunk"), order).alias("f")
    alias = mentions.select("label", "name_norm", F.explode_outer("aliases").alias("alias")).where("alias is not null").distinct()
    alias = alias.groupBy("label", "name_norm").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    out = mentions.groupBy("label", "name_norm").agg(first, F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("mentions"))
    out = out.join(alias, ["label", "name_norm"], "left")
    none = F.array().cast("array<string>")
    return out.select(node_id(F.col("label"), F.col("name_norm")).alias("id"), "label", "name_norm", "f.name", "f.geography", "f.source_doc", "f.source_chunk", F.coalesce("aliases", none).alias("aliases"), "confidence", "mentions")


def upsert_entities(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Entities of a run merged into those there are, by (label, name_norm).

    Aliases unite, the highest confidence stays and mentions add up; all else is as the
    existing row has it.  Either side has one row a key, so a key gathers two rows.
    """
    first = [c for c in existing.columns if c not in ("label", "name_norm", "aliases", "confidence", "mentions")]
    both = existing.withColumn("sf_new", F.lit(0)).unionByName(new.withColumn("sf_new", F.lit(1)))
    aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")
    out = both.groupBy("label", "name_norm").agg(F.min_by(F.struct(*first), "sf_new").alias("f"), aliases, F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"))
    return out.select(*[F.col(f"f.{c}").alias(c) if c in first else F.col(c) for c in existing.columns])


def load_statistics(mentions: DataFrame, kept: DataFrame, relations: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, mentions, admitted, relations, resolved): what the load of each document took in and what it kept."""
    parts = [("mentions", mentions), ("admitted", kept), ("relations", relations), ("resolved", facts)]
    counted = [df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name)) for name, df in parts]
    both = reduce(lambda a, b: a.unionByName(b), counted)
    return both.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(name) for name, _ in parts])


def resolve_relations(relations: DataFrame, mentions: DataFrame, least: float = 0.5, by_document: bool = False) -> DataFrame:
    """Facts: relation mentions with both ends resolved to (label, key).

    Temporary ids are unique inside a chunk, so they are looked up there;
    ``by_document`` looks them up in the whole document, the last one winning.
    'DOC' is the publication; relations between two of them, with unknown ends, or
    unsure 'relates_to' ones are dropped.
    """
    scope = ["doc_id"] if by_document else ["doc_id", "chunk_id"]
    place = F.struct("chunk_id", "ord")
    ids = mentions.groupBy(*scope, "tmp_id").agg(F.max_by(F.struct("label", "name_norm"), place).alias("k"))

    def end(df, col):
        known = ids.select(*scope, F.col("tmp_id").alias(col), F.col("k").alias(f"{col}_k"))
        out = df.join(known, [*scope, col], "left")
        is_doc = F.col(col) == "DOC"
        out = out.withColumn(f"{col}_label", F.when(is_doc, "Publication").otherwise(F.col(f"{col}_k.label")))
        return out.withColumn(f"{col}_key", F.when(is_doc, F.col("doc_id")).otherwise(F.col(f"{col}_k.name_norm"))).drop(f"{col}_k")

    out = end(end(relations, "source"), "target").where("source_key is not null and target_key is not null")
    out = out.where(~((F.col("source_label") == "Publication") & (F.col("target_label") == "Publication")))
    return out.where((F.col("type") != "relates_to") | (F.col("confidence") >= least))


def edge_properties(facts: DataFrame) -> DataFrame:
    """``facts`` with ``props``: provenance and numbers as text, the attributes last so that they win.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` only in spirit: keys of attributes are removed from the base first.
    """
    numeric = F.col("type").isin(*S.NUMERIC_RELATIONS) & F.col("numeric").isNotNull()
    pairs = [("source_doc", F.col("doc_id")), ("source_chunk", F.col("source_chunk")), ("confidence", F.col("confidence").cast("string"))]
    pairs += [(k, F.when(numeric, F.col(f"numeric.{k}").cast("string"))) for k in ("parameter", "operator", "value", "value_min", "value_max", "unit")]
    base = F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    own = F.map_filter(base, lambda k, v: ~F.map_contains_key(attrs, k))
    return facts.withColumn("props", F.map_concat(own, attrs)).withColumn("type", F.upper("type"))


def first_edges(facts: DataFrame, order: list[str], key=("src", "type", "dst")) -> DataFrame:
    """One edge for (src, type, dst): the first fact; ``facts`` keeps the others.

    A minimum by the order, not a window, so that a frequent edge is summed before it is shuffled.
    """
    rest = [c for c in facts.columns if c not in key]
    out = facts.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("facts"))
    return out.select(*key, *[F.col(f"f.{c}").alias(c) for c in rest], "facts")


def described_in(mentions: DataFrame) -> DataFrame:
    """Provenance: (label, name_norm, doc_id) with the first chunk."""
    return mentions.groupBy("label", "name_norm", "doc_id").agg(F.min_by("chunk_id", F.struct("chunk_id", "ord")).alias("source_chunk"))


def orphans(edges: DataFrame, publications: DataFrame) -> DataFrame:
    """Edges whose document is no publication."""
    return edges.join(publications.select(F.col("doc_id").alias("source_doc")), "source_doc", "left_anti")


def publications(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Publications: title (metadata, else the file's stem) and the language of most chunks, ties to the first seen."""
    lang = chunks.groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    lang = lang.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "lang")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    out = meta.join(lang, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.nullif(T.strip(F.col("file_metadata_title")), F.lit("")), stem).alias("title"), F.coalesce("lang", F.lit("ru")).alias("lang"), "year", "venue", "doc_type", "author_hint", F.col("source_key").alias("source_path"))


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once: the check that takes the place of a uniqueness constraint."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
