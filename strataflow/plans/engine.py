"""The engine: a catalogue of tables, and the questions that clients ask."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import text as T
from strataflow.operators import answer as A
from strataflow.operators import graph_analytics as G
from strataflow.operators import retrieval as Q
from strataflow.plans import providers as P

DOC_ID = re.compile(r"doc_[0-9a-f]{12}")


@dataclass
class Tables:
    """What the engine answers from; facts and edges may be absent."""

    chunks: DataFrame
    vectors: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    facts: DataFrame | None = None


@dataclass
class QueryResult:
    answer: str
    citations: DataFrame
    mode: str
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    facts: DataFrame | None = None
    contradictions: DataFrame | None = None
    gaps: DataFrame | None = None
    took_ms: dict = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, tables: Tables, embedder: P.Embedder | None = None, synthesise=None):
        self.spark, self.tables, self.embedder, self.synthesise = spark, tables, embedder or P.HashingEmbedder(), synthesise

    def query(self, question: str, filters: Q.Filters | None = None, top_k: int = 12, use_graph: bool = True) -> QueryResult:
        """Hybrid answer: vector and fact legs fused by rank, an extractive answer unless a synthesiser is given.

        Nothing found is an empty result, never an error.
        """
        t, filters, began = self.tables, filters or Q.Filters(), time.monotonic()
        vec = self.embedder([question])[0].tolist()
        ranked = Q.vector_top_k(t.vectors, t.chunks, vec, 20 if use_graph else 10, filters).persist()
        graph = use_graph and t.facts is not None and bool(filters.numeric)
        facts = Q.find_facts(t.facts, filters).where(Q.is_numeric_row()) if graph else None
        top = ranked
        if graph:
            docs = facts.groupBy("doc_id").agg(F.min("seq").alias("row")).withColumn("sources", F.array().cast("array<struct<doc_id:string>>"))
            by_fact = Q.documents_of_rows(docs)
            fused = Q.reciprocal_rank_fusion([ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "rank"), by_fact.select(F.col("doc_id").cast("string").alias("doc_id"), "rank")])
            best = fused.where(F.col("rank") <= top_k).select(F.col("id").alias("fused_id"), F.col("rank").alias("fused_rank"))
            top = ranked.drop("rank").withColumn("key", F.col("doc_id").cast("string")).join(best, F.col("key") == F.col("fused_id")).withColumn("rank", F.col("fused_rank")).drop("key", "fused_id", "fused_rank")
        nodes = edges = contradictions = gaps = None
        if use_graph and t.nodes is not None:
            terms = self.spark.createDataFrame([(question,)], "q string").select(F.posexplode(T.query_terms(F.col("q"))).alias("ord", "term"))
            anchors = G.resolve_anchors(t.nodes, t.edges, terms)
            nodes = G.expand(anchors, t.nodes, t.edges)
            edges = G.induced(nodes, t.edges)
            if "note" in t.edges.columns:
                contradictions = A.contradictions(edges, t.nodes)
            gaps = G.gaps(t.edges.join(t.nodes.where("label = 'Experiment'").select(F.col("id").alias("src")), "src", "left_semi"), anchors).limit(3)
        extra = [c for c in ("page", "geography") if c not in top.columns]
        cited = A.citations(top.select("*", *[F.lit(None).cast("int" if c == "page" else "string").alias(c) for c in extra]))
        text, done = None, False
        if self.synthesise is not None:
            try:
                valid = self.spark.createDataFrame([(self.synthesise(question, top),)], "a string").crossJoin(top.agg(F.collect_set(F.col("doc_id").cast("string")).alias("v")))
                text, done = valid.select(T.strip_citations(F.col("a"), F.col("v"))).first()[0], True
            except Exception:  # a provider that fails leaves the extractive answer
                text = None
        text = text if text is not None else A.extractive_answer(top).first()["answer"]
        mode = A.answer_mode("vector+graph" if graph else "vector", done, nodes is not None)
        return QueryResult(text, cited, mode, nodes, edges, facts, contradictions, gaps, {"took_ms": round(1000 * (time.monotonic() - began))})

    def graph_stats(self) -> DataFrame:
        return G.statistics(self.tables.nodes)

    def subgraph(self, node_ids: list[str] | None = None, limit: int = 150) -> tuple[DataFrame, DataFrame]:
        """The preview, or the part of it that ``node_ids`` names."""
        nodes, edges = G.preview(self.tables.nodes, self.tables.edges, limit)
        if node_ids:
            nodes = nodes.where(F.col("id").isin(*node_ids))
            edges = G.induced(nodes, edges)
        return nodes, edges

    def document_link(self, doc_id: str, publications: DataFrame) -> str | None:
        """Where a document's file lies; ValueError for an id of another form, None for an unknown one."""
        if not DOC_ID.fullmatch(doc_id):
            raise ValueError("not a document id")
        row = publications.where(F.col("doc_id") == doc_id).select("source_path").first()
        return row["source_path"] if row else None

    def health(self) -> dict[str, str]:
        try:
            self.spark.range(1).count()
            return {"spark": "ok"}
        except Exception:
            return {"spark": "down"}
