"""From chunks to extraction records: selection, parsing, validation, resume, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow import schemas as S
from strataflow.functions import text as T


def admissible_documents(meta: DataFrame, doc_types=None, drop_low_yield: bool = False) -> DataFrame:
    """Documents with usable status; rows without a type pass the type filter."""
    out = meta.where(F.col("status").isin("ok", "scan_low_value"))
    if drop_low_yield:
        out = out.where(~F.coalesce(F.col("low_yield"), F.lit(False)))
    return out.where(F.col("doc_type").isNull() | F.col("doc_type").isin(*doc_types)) if doc_types else out


def table_first(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``rank`` within its document: tables, then front matter, then the rest, ties by chunk id."""
    kind = F.when(F.col("kind") == "table", 0).when(F.col("section") == "frontmatter", 1).otherwise(2)
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(kind, "chunk_id")))


def core_documents(meta: DataFrame, chunks: DataFrame, terms: list[str], head: int = 20, size: int = 500) -> DataFrame:
    """Documents whose name, venue or chunk heads hold a core term; all if there are no terms."""
    if not terms:
        return meta.select("doc_id")
    hit = T.any_contained(F.lower(F.substring("text", 1, size)), [t.lower() for t in terms])
    by_text = table_first(chunks).where((F.col("rank") <= head) & hit).select("doc_id")
    by_name = meta.where(T.any_contained(F.lower(F.concat_ws(" ", "file_name", "venue")), [t.lower() for t in terms])).select("doc_id")
    return by_text.unionByName(by_name).distinct()


def pending(chunks: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks that were not extracted yet."""
    out = chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return out if limit is None else out.orderBy("chunk_id").limit(limit)


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The newest row of every key; a new row wins over an existing one."""
    both = existing.withColumn("sf_new", F.lit(0)).unionByName(new.withColumn("sf_new", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.desc("sf_new"))
    return both.withColumn("sf_n", F.row_number().over(latest)).where("sf_n = 1").drop("sf_n", "sf_new")


def parse_answers(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """``raw`` with ``result`` (entities, relations) and ``rejected``: provider answers are never trusted.

    Numbers may be strings with a decimal comma; they are read as text and cast.
    """
    loose = "struct<entities:array<{e}>,relations:array<{r}>>".format(e=S.ENTITY, r=S.RELATION.replace("value:double,value_min:double,value_max:double", "value:string,value_min:string,value_max:string"))
    out = raw.withColumn("sf_p", F.from_json(T.strip_json_fence(F.col(text_col)), loose))

    def number(n):
        v, lo, hi = (T.lenient_double(n[c]) for c in ("value", "value_min", "value_max"))
        ranged = (n["operator"] == "range") & lo.isNull() & hi.isNotNull()
        return F.when(n.isNotNull(), F.struct(n["parameter"].alias("parameter"), n["operator"].alias("operator"), F.when(~F.coalesce(ranged, F.lit(False)), v).alias("value"), F.when(F.coalesce(ranged, F.lit(False)), v).otherwise(lo).alias("value_min"), hi.alias("value_max"), n["unit"].alias("unit")))

    relations = F.transform("sf_p.relations", lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("type"), number(r["numeric"]).alias("numeric"), r["attrs"].alias("attrs"), r["confidence"].alias("confidence")))
    good_entity = F.forall("sf_p.entities", lambda e: e["type"].isin(*S.NODE_LABELS) & e["confidence"].between(0, 1))
    good_relation = F.forall("sf_p.relations", lambda r: r["type"].isin(*S.RELATION_TYPES) & r["confidence"].between(0, 1))
    valid = F.coalesce(good_entity & good_relation, F.lit(False))
    result = F.when(valid, F.struct(F.col("sf_p.entities").alias("entities"), relations.alias("relations")))
    return out.withColumn("result", result).withColumn("rejected", F.col("result").isNull()).drop("sf_p")


def postvalidate(records: DataFrame) -> DataFrame:
    """Referential integrity inside one result: names of two characters, known ends, numbers only where they belong."""
    entities = F.filter("result.entities", lambda e: F.length(T.strip(e["name_norm"])) >= 2)
    ids = F.concat(F.transform(entities, lambda e: e["tmp_id"]), F.array(F.lit("DOC")))
    known = F.filter("result.relations", lambda r: F.array_contains(ids, r["source"]) & F.array_contains(ids, r["target"]))
    tidy = F.transform(known, lambda r: r.withField("numeric", F.when(r["type"].isin(*S.NUMERIC_RELATIONS), r["numeric"])))
    return records.withColumn("result", F.struct(entities.alias("entities"), tidy.alias("relations")))


def calibration_sample(chunks: DataFrame, ids: list[str], key: str = "chunk_id") -> DataFrame:
    """The chunks of a fixed list, for a trial run; ValueError if one of them is missing."""
    found = chunks.where(F.col(key).isin(*ids))
    seen = {r[key] for r in found.select(key).distinct().collect()}  # as many as the list has
    if lost := sorted(set(ids) - seen, key=str):
        raise ValueError(f"chunks of the sample are missing: {lost}")
    return found


def retry_penalty(confidence, retries, by: float = 0.2):
    """Confidence of a result that needed retries, lowered and clamped."""
    return F.when(retries > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence - by))).otherwise(confidence)


def read_records(raw: DataFrame) -> DataFrame:
    """Tolerant view of extraction records: defaults filled, token counts hoisted, empty results dropped."""
    return raw.where(F.col("result").isNotNull()).select(
        "chunk_id", "doc_id", F.coalesce("source_doc", "doc_id").alias("source_doc"), F.coalesce("source_chunk", "chunk_id").alias("source_chunk"), "year", "result",
        F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("retries", F.lit(0)).alias("retries"),
        F.coalesce("prompt_tokens", "usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", "usage.completion_tokens", F.lit(0)).alias("completion_tokens"),
    )


def run_statistics(records: DataFrame, prompt_price: float = 0.15e-6, completion_price: float = 0.6e-6) -> DataFrame:
    """Counts, tokens and cost of every document; only models named 'mini' have a price."""
    n_e, n_r = F.size("result.entities"), F.size("result.relations")
    cost = F.when(F.contains(F.lower("model"), F.lit("mini")), F.col("prompt_tokens") * prompt_price + F.col("completion_tokens") * completion_price)
    return records.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("processed"), F.sum(n_e).alias("entities"), F.sum(n_r).alias("relations"), F.sum(((n_e == 0) & (n_r == 0)).cast("int")).alias("empty"),
        F.sum(F.col("result").isNull().cast("int")).alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(cost).alias("cost_usd"),
    )


def mentions(records: DataFrame) -> DataFrame:
    """One row for every entity of every record, with its place."""
    e = records.select("doc_id", "chunk_id", "source_doc", "source_chunk", F.posexplode("result.entities").alias("ord", "e"))
    return e.select("doc_id", "chunk_id", "source_doc", "source_chunk", "ord", "e.tmp_id", F.col("e.type").alias("label"), "e.name", "e.name_norm", "e.aliases", "e.geography", "e.confidence")


def relation_mentions(records: DataFrame) -> DataFrame:
    r = records.select("doc_id", "chunk_id", "source_doc", "source_chunk", F.posexplode("result.relations").alias("ord", "r"))
    return r.select("doc_id", "chunk_id", "source_doc", "source_chunk", "ord", "r.source", "r.target", "r.type", "r.numeric", "r.attrs", "r.confidence")
