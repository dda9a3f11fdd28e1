"""From retrieved rows to an answer: facts, contradictions, context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import text as T

BUDGET, RESERVE, MAX_CHUNKS, CHUNK_CHARS, SNIPPET, TOP = 12_000, 200, 8, 800, 400, 5
UNTITLED = "Без названия"


def distinct_facts(rows: DataFrame) -> DataFrame:
    """The first fact of every (name, parameter, value, minimum, maximum) by ``seq``."""
    key = ["name", "parameter", "value", "value_min", "value_max"]
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("f")).select(*key, *[F.col(f"f.{c}").alias(c) for c in rest])


def format_fact() -> Column:
    """A fact as a line of context."""
    unit = F.coalesce("unit", F.lit(""))
    span = F.concat(F.coalesce(F.col("value_min").cast("string"), F.lit("")), F.lit("–"), F.coalesce(F.col("value_max").cast("string"), F.lit("")), unit)
    value = F.when(F.col("value").isNotNull(), F.concat(F.col("value").cast("string"), unit)).when(F.coalesce("value_min", "value_max").isNotNull(), span).otherwise(F.concat(F.lit("?"), unit))
    return F.concat(F.lit("«"), F.coalesce("name", F.lit("?")), F.lit("» — "), F.coalesce("parameter", F.lit("?")), F.lit(" "), F.coalesce("operator", F.lit("=")), F.lit(" "), value, F.lit(" (confidence "), F.col("confidence").cast("string"), F.lit(", источники: doc:"), F.coalesce("doc_id", F.lit("unknown")), F.lit(")"))


def contradictions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_a, source_b, description) of edges that contradict; names from the nodes."""
    found = edges.where(F.lower("type") == "contradicts")
    for end, name in (("src", "source_a"), ("dst", "source_b")):
        known = nodes.select(F.col("id").alias(end), F.col("name").alias(name))
        found = found.join(known, end, "left").withColumn(name, F.coalesce(name, end))
    text = F.coalesce("note", "description", F.lit("contradiction"))
    return found.select("source_a", "source_b", text.alias("description"))


def format_chunk() -> Column:
    year = F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("0")), F.lit("?"))
    return F.concat(F.lit("[doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)), F.lit(" ("), year, F.lit("): "), T.trim_at_sentence(F.coalesce("text", F.lit("")), CHUNK_CHARS))


def within_budget(chunks: DataFrame, used: int, budget: int = BUDGET, most: int = MAX_CHUNKS) -> DataFrame:
    """The leading chunks (rank, ...) whose lines fit the budget: a running sum, cut at the first that does not."""
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = chunks.where(F.col("rank") <= most).withColumn("line", format_chunk())
    total = F.sum(F.length("line") + 1).over(so_far) - 1
    fits = lines.withColumn("sf_fits", (total + used + RESERVE <= budget).cast("int"))
    return fits.withColumn("sf_all", F.min("sf_fits").over(so_far)).where("sf_all = 1").drop("sf_fits", "sf_all")


def context(query: str, facts: DataFrame, found: DataFrame, chunks: DataFrame, budget: int = BUDGET) -> str:
    """The text a language model would get; facts and contradictions always, chunks while they fit."""
    fact_lines = [r["line"] for r in facts.orderBy("seq").select(format_fact().alias("line")).collect()]
    said = [f"- {r['source_a']} vs {r['source_b']}: {r['description']}" for r in found.collect()]
    head = "[ФАКТЫ ГРАФА]\n" + ("\n".join(fact_lines) or "(нет)")
    against = "[ЗАФИКСИРОВАННЫЕ ПРОТИВОРЕЧИЯ]\n" + "\n".join(said) if said else ""
    lines = [r["line"] for r in within_budget(chunks, len(head) + len(against) + len(query), budget).orderBy("rank").collect()]
    return "\n\n".join(p for p in (f"Вопрос: {query}", head, against, "[ФРАГМЕНТЫ ДОКУМЕНТОВ]\n" + ("\n".join(lines) or "(нет)")) if p)


def extractive_answer(chunks: DataFrame, top: int = TOP) -> DataFrame:
    """(answer): the leading chunks with title, year, venue or type and a snippet; a fixed text if there are none."""
    title = F.coalesce("title", F.lit(UNTITLED))
    year = F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("0")), F.lit("год не указан"))
    where = F.coalesce(F.nullif("venue", F.lit("")), F.nullif("doc_type", F.lit("")), F.lit("тип не указан"))
    block = F.concat(F.lit("**"), title, F.lit("** ("), year, F.lit(", "), where, F.lit(") [doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")), F.lit("]\n"), T.snippet(F.coalesce("text", F.lit("")), SNIPPET))
    rows = chunks.where(F.col("rank") <= top).select("rank", block.alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda r: r["block"])
    none = F.lit("## Ничего не найдено\n\nПопробуйте переформулировать запрос или расширить фильтры.")
    return rows.agg(F.when(F.count(F.lit(1)) == 0, none).otherwise(F.concat(F.lit("## Найдено по запросу\n\n"), F.array_join(blocks, "\n\n"))).alias("answer"))


def citations(chunks: DataFrame) -> DataFrame:
    """One citation a chunk, the first by rank: defaults filled, the score clamped as confidence."""
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("doc_id", "title", "text", "score", "page", "year", "geography"), "rank").alias("c"), F.min("rank").alias("rank"))
    return first.select(
        F.coalesce(F.col("c.doc_id").cast("string"), F.lit("unknown")).alias("doc_id"), "chunk_id", F.coalesce("c.title", F.lit(UNTITLED)).alias("title"), F.substring("c.text", 1, SNIPPET).alias("snippet"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c.score", F.lit(0.0)))).alias("confidence"), "c.page", "c.score", "c.year", F.coalesce("c.geography", F.lit("UNKNOWN")).alias("geography"), "rank",
    )


def strip_unknown_citations(answers: DataFrame, known: DataFrame, id_col: str, text_col: str = "answer") -> DataFrame:
    """``answers`` (id_col, text_col) without the [doc:id] marks of documents that ``known`` (doc_id) lacks.

    Cited ids meet the known ones in a semi-join, so neither list is gathered.
    """
    cited = answers.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"\[doc:([^\]]+)\]"), F.lit(1)))).alias("cited"))
    valid = cited.join(known.select(F.col("doc_id").cast("string").alias("cited")), "cited", "left_semi").groupBy(F.col(id_col).alias("of")).agg(F.collect_set("cited").alias("valid"))
    out = answers.join(valid, answers[id_col] == valid["of"], "left")
    return out.select(id_col, T.strip_citations(F.col(text_col), F.coalesce("valid", F.array().cast("array<string>"))).alias(text_col))


def answer_mode(retrieval: str | None, synthesised: bool, has_nodes: bool) -> str:
    if synthesised:
        return "full"
    return "vector+graph" if retrieval in ("vector+graph", "graph") and has_nodes else "vector"


def consensus(answer: Column) -> Column:
    """How many different documents an answer cites."""
    return F.size(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[doc:([^\]]+)\]"), F.lit(1))))
