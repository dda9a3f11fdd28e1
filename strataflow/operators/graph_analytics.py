"""Queries over nodes (id, label, name, ...) and edges (src, type, dst, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow import schemas as S

CAP = 60


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other, type): every edge from both ends."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return edges.select(ends.alias("e"), "type").select("e.id", "e.other", "type")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node; ends are exploded, so one scan and one partial sum do."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def statistics(nodes: DataFrame) -> DataFrame:
    label = F.col("label")
    return nodes.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("entities", label.isin(*S.ENTITY_LABELS)), ("chunks", label == "Chunk"), ("publications", label == "Publication"))])


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def top_by_label(nodes: DataFrame, edges: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` nodes of highest degree of each label (a report)."""
    order = Window.partitionBy("label").orderBy(F.desc("degree"), "id")
    return with_degree(nodes, edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, cap: int = CAP, allowed=(*S.ENTITY_LABELS, "Publication")) -> DataFrame:
    """Seeds (id) and their neighbours with allowed labels, ``cap`` nodes at most: seeds first, then by id."""
    seeds = seeds.select("id").distinct()
    near = undirected(edges).join(seeds, "id", "left_semi").select(F.col("other").alias("id")).distinct()
    hop = seeds.withColumn("hop", F.lit(0)).unionByName(near.withColumn("hop", F.lit(1))).groupBy("id").agg(F.min("hop").alias("hop"))
    out = nodes.where(F.col("label").isin(*allowed)).join(hop, "id")
    return out.orderBy("hop", "id").limit(cap)


def match_seeds(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Entities named so, by name or normalised name."""
    low = [n.lower() for n in names]
    return nodes.where(F.col("label").isin(*S.ENTITY_LABELS) & (F.col("name").isin(*names) | F.col("name_norm").isin(*low)))


def preview(nodes: DataFrame, edges: DataFrame, limit: int = 150) -> tuple[DataFrame, DataFrame]:
    """The entities of highest degree and their neighbours, ``limit`` nodes (1 to 300), with the edges among them."""
    limit = max(1, min(300, limit))
    top = with_degree(nodes.where(F.col("label").isin(*S.ENTITY_LABELS)), edges).orderBy(F.desc("degree"), "id").limit(limit)
    kept = expand(top, nodes, edges, limit)
    return kept, induced(kept, edges)


def fallback_preview(publications: DataFrame, authored: DataFrame, experts: DataFrame, limit: int = 150) -> DataFrame:
    """The latest publications with their experts."""
    latest = publications.orderBy(F.coalesce("year", F.lit(0)).desc(), "title", "doc_id").limit(limit)
    return latest.join(authored, "doc_id", "left").join(experts, "expert_id", "left")


def expand_chunks(chunk_docs: DataFrame, described: DataFrame, entities: DataFrame, edges: DataFrame, least: float = 0.5, top: int = 45, cap: int = CAP) -> DataFrame:
    """Entities described in the chunks' publications, the most confident first, with their neighbours."""
    found = described.join(chunk_docs.select("doc_id").distinct(), "doc_id", "left_semi").select("id").distinct()
    best = entities.join(found, "id").where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "id").limit(top)
    return expand(best, entities, edges.where(~F.upper("type").isin("DESCRIBED_IN", "PART_OF")), cap)


def union_subsets(*subsets: DataFrame, cap: int = CAP) -> DataFrame:
    """Nodes of several subsets, the first of an id winning, cut to ``cap`` in that order."""
    tagged = [s.withColumn("sf_i", F.lit(i)) for i, s in enumerate(subsets)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = Window.partitionBy("id").orderBy("sf_i")
    return both.withColumn("sf_n", F.row_number().over(first)).where("sf_n = 1").orderBy("sf_i", "id").limit(cap).drop("sf_n", "sf_i")


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, least: float = 0.0) -> DataFrame:
    """(id, hops): nodes within ``depth`` edges of confidence ``least``, breadth first."""
    live = undirected(edges.where(F.col("confidence") >= least)).select("id", "other").distinct()
    seen = front = start.select("id").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        reached = front.join(live, "id").select(F.col("other").alias("id")).distinct()
        front = reached.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, source: str, target: str, longest: int = 4) -> DataFrame:
    """(path array, hops): simple undirected paths from ``source`` to ``target`` of at most ``longest`` edges.

    Two sides meet in the middle: walks of half the length from both ends.
    """
    live = undirected(edges).select("id", "other").distinct()

    def walks(start, steps):
        front = edges.sparkSession.createDataFrame([([start],)], "path array<string>")
        out = [front]
        for _ in range(steps):
            last = F.element_at("path", -1)
            front = front.withColumn("id", last).join(live, "id").where(~F.array_contains("path", F.col("other"))).select(F.concat("path", F.array("other")).alias("path"))
            out.append(front)
        return out

    left, right = walks(source, (longest + 1) // 2), walks(target, longest // 2)
    found = []
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if i - j in (0, 1) and i + j >= 1:
                x = a.select(F.col("path").alias("p"), F.element_at("path", -1).alias("mid"))
                y = b.select(F.col("path").alias("q"), F.element_at("path", -1).alias("mid"))
                tail = F.slice(F.reverse("q"), F.lit(2), F.greatest(F.size("q") - 1, F.lit(0)))
                met = x.join(y, "mid").where(F.size(F.array_intersect("p", "q")) == 1)
                found.append(met.select(F.concat("p", tail).alias("path")))
    out = reduce(lambda a, b: a.unionByName(b), found).distinct()
    return out.withColumn("hops", F.size("path") - 1)


def coverage(publications: DataFrame, described: DataFrame) -> DataFrame:
    """(publications, covered, share): publications with at least one described entity."""
    per = publications.select("doc_id").join(described.groupBy("doc_id").agg(F.countDistinct("id").alias("n")), "doc_id", "left")
    hit = F.sum((F.coalesce("n", F.lit(0)) > 0).cast("long"))
    return per.agg(F.count(F.lit(1)).alias("publications"), hit.alias("covered"), F.round(hit / F.count(F.lit(1)), 6).alias("share"))


def without_incoming(nodes: DataFrame, edges: DataFrame, types=S.NUMERIC_RELATIONS) -> DataFrame:
    """Nodes that no edge of ``types`` points to."""
    hit = edges.where(F.lower("type").isin(*types)).select(F.col("dst").alias("id"))
    return nodes.join(hit, "id", "left_anti")


def edge_sample(edges: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """A random report of valued edges with a unit, repeatable by ``seed``."""
    valued = edges.where(F.coalesce("value", "value_min", "value_max").isNotNull() & (F.trim("unit") != ""))
    return valued.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "src", "type", "dst").cast("binary")), "src", "type", "dst").limit(n)


def stop_list_leak(nodes: DataFrame, terms) -> DataFrame:
    """Entities whose name is a stop term."""
    return nodes.where(F.col("label").isin(*S.ENTITY_LABELS) & F.lower(F.trim("name_norm")).isin(*terms))


def linked_to_chunks(edges: DataFrame) -> DataFrame:
    """Edges without the structural types."""
    return edges.where(~F.upper("type").isin("DESCRIBED_IN", "PART_OF"))


def gaps(experiment_edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs (a, b) of anchors (id), a < b, that no experiment links: (a, b)."""
    x = experiment_edges.join(anchors.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    linked = x.select("src", F.col("dst").alias("a")).join(x.select("src", F.col("dst").alias("b")), "src").where("a < b").select("a", "b").distinct()
    ids = F.broadcast(anchors.select("id").distinct())  # anchors: a handful, chosen for a question
    pairs = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(linked, ["a", "b"], "left_anti")


def redundant(a: Column, b: Column, prefix: int = 12) -> Column:
    """Variants of one term: one holds the other, or they start alike."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.contains(x, y) | F.contains(y, x) | (F.substring(x, 1, prefix) == F.substring(y, 1, prefix))


def resolve_anchors(nodes: DataFrame, edges: DataFrame, terms: DataFrame, labels=("Process", "Material"), least: int = 3, per_term: int = 3, most: int = 5) -> DataFrame:
    """Anchor nodes of the query terms (ord, term): matched by name or alias, well linked, valid, in order of term."""
    known = with_degree(nodes.where(F.col("label").isin(*labels)), edges).where(F.col("degree") >= least)
    hit = F.contains(F.lower("name_norm"), F.col("term")) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.col("term")))
    found = known.join(F.broadcast(terms), hit)  # the terms of one question
    order = Window.partitionBy("ord").orderBy(F.desc("degree"), "id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_term)
    name = F.lower(F.trim("name_norm"))
    valid = (F.length(name) >= 5) & ~name.rlike(r"[\d%=°]") & (F.contains(name, F.col("term")) | F.contains(F.col("term"), name))
    found = found.where(valid).groupBy("id", "label", "name", "name_norm").agg(F.min(F.struct("ord", "n")).alias("place"))
    return found.orderBy("place", "id").limit(most).select("id", "label", "name", "name_norm")


def rank_experts(authored: DataFrame, documents: DataFrame, top: int = 5) -> DataFrame:
    """Experts of the documents by number of works, with up to three titles; ties by name.

    ``authored`` has (doc_id, title, expert, affiliation).
    """
    found = authored.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    out = found.groupBy("expert").agg(F.max("affiliation").alias("affiliation"), F.count(F.lit(1)).alias("works"), F.slice(F.array_sort(F.collect_set("title")), 1, 3).alias("top_publications"))
    return out.orderBy(F.desc("works"), "expert").limit(top)


def display_selection(nodes: DataFrame, edges: DataFrame, cap: int = 45) -> DataFrame:
    """What a viewer shows: no chunks; above ``cap`` nodes those of highest confidence times degree."""
    seen = nodes.where(F.col("label") != "Chunk")
    scored = with_degree(seen, induced(seen, edges)).withColumn("score", F.coalesce("confidence", F.lit(0.0)) * F.col("degree"))
    return scored.orderBy(F.desc("score"), "id").limit(cap)


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def publication_star(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A query hub and one edge to each distinct document (doc_id, rank), in order of rank."""
    docs = ranked.groupBy("doc_id").agg(F.min("rank").alias("rank"))
    edges = docs.select(F.lit("query").alias("src"), F.lit("described_in").alias("type"), F.col("doc_id").alias("dst"), "rank")
    hub = ranked.sparkSession.createDataFrame([("query", "Query")], "id string, label string")
    return hub.unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("Publication").alias("label"))), edges


def display_node(nodes: DataFrame) -> DataFrame:
    """(id, label, name): identity and name by precedence; the embedding is left out."""
    ident = F.coalesce("doc_id", "chunk_id", "id", "name_norm", "name")
    name = F.when(F.col("label") == "Chunk", F.substring("text", 1, 80)).otherwise(F.coalesce("name", "title", "name_norm", "doc_id"))
    return nodes.where(F.col("label").isin(*S.NODE_LABELS)).select(ident.alias("id"), "label", name.alias("name"))


def term_diagnostics(nodes: DataFrame, edges: DataFrame, terms: list[str], types: list[str]) -> DataFrame:
    """(kind, item, n): why a query came back empty; one pass over nodes and one over edges."""
    name = F.lower("name_norm")
    counts = [F.coalesce(F.sum(F.contains(name, F.lit(t.lower())).cast("long")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(terms)]
    out = []
    if terms:
        row = nodes.agg(*counts)
        out.append(row.select(F.explode(F.array(*[F.struct(F.lit("term").alias("kind"), F.lit(t).alias("item"), F.col(f"t{i}").alias("n")) for i, t in enumerate(terms)])).alias("x")).select("x.*"))
    if types:
        wanted = edges.sparkSession.createDataFrame([(t,) for t in types], "item string")
        found = edges.where(F.col("type").isin(*types)).groupBy(F.col("type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
        out.append(wanted.join(found, "item", "left").select(F.lit("type").alias("kind"), "item", F.coalesce("n", F.lit(0)).alias("n")))
    return reduce(lambda a, b: a.unionByName(b), out)
