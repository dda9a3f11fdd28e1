"""Entity resolution: candidates, decisions, components, canonical nodes, rewiring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import similarity, vectors
from strataflow.sources.tables import discard, materialize

FUZZY, COSINE, AUTO_FUZZY, AUTO_COSINE = 88.0, 0.92, 96.0, 0.97
#: Vectors in a block of a matrix product; labels with more than one block that are sent to every executor.
BLOCK, BROADCAST_LABELS = 4096, 100_000
#: Rows of a key in a block of pairs_within, and the pairs of one of its tasks.
KEY_BLOCK, PAIRS_A_TASK = 1024, 2_000_000
#: Nodes of a forest that a task holds; more of them make another forest, as the later rounds join forests anyhow.
FOREST_NODES = 200_000


def fuzzy_pairs(nodes: DataFrame, least: float = FUZZY, strict: bool = False) -> DataFrame:
    """(label, a, b, fuzzy_score): pairs of one label whose token-sorted names are alike.

    Names meet by the pairs of neighbouring characters (grams) they share: an inserted
    or deleted character touches two grams, and a score of s = least / 100 allows
    (1 - s) * (la + lb) <= la * 2 * (1 - s) / s of them, so partners share one of the
    4 * (1 - s) / s * la + 1 rarest grams of either (prefix filter).  Lengths bound the
    rest, and the exact score decides.
    """
    key = F.array_join(F.array_sort(F.split(F.lower(F.trim("name_norm")), r"\s+")), " ")
    rows = nodes.select("label", "id", key.alias("key")).withColumn("size", F.length("key")).where("size > 0")
    padded = F.concat(F.lit("\x02"), "key", F.lit("\x03"))
    # grams with their number, so that repeated grams count as different ones
    grams = rows.select("label", "id", "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("pos", "gram"))
    nth = Window.partitionBy("label", "id", "gram").orderBy("pos")
    grams = grams.withColumn("gram", F.concat("gram", F.row_number().over(nth).cast("string")))
    often = grams.groupBy("label", "gram").agg(F.count(F.lit(1)).alias("often"))
    grams = grams.join(often, ["label", "gram"])
    lost = F.floor(F.col("size") * 4.0 * (100.0 - least) / least + 1e-9) + 1
    rank = Window.partitionBy("label", "id").orderBy("often", "gram")
    prefix = grams.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= lost).select("label", "gram", "id", "size")
    p = prefix.select("label", "gram", F.col("id").alias("a"), F.col("size").alias("sa"))
    q = prefix.select("label", "gram", F.col("id").alias("b"), F.col("size").alias("sb"))
    near = (F.col("a") < F.col("b")) & (200.0 * F.least("sa", "sb") >= least * (F.col("sa") + F.col("sb")))
    pairs = p.join(q, ["label", "gram"]).where(near).select("label", "a", "b").distinct()
    name = nodes.select("label", "id", "name_norm")
    pairs = pairs.join(name.select("label", F.col("id").alias("a"), F.col("name_norm").alias("name_a")), ["label", "a"])
    pairs = pairs.join(name.select("label", F.col("id").alias("b"), F.col("name_norm").alias("name_b")), ["label", "b"])
    score = similarity.udfs()["token_sort_ratio"]("name_a", "name_b")
    out = pairs.withColumn("fuzzy_score", score)
    return out.where((F.col("fuzzy_score") > least) if strict else (F.col("fuzzy_score") >= least)).select("label", "a", "b", "name_a", "name_b", "fuzzy_score")


def cosine_pairs(nodes: DataFrame, least: float = COSINE, most: int = BLOCK) -> DataFrame:
    """(label, a, b, cosine_score): pairs of one label with alike vectors.

    The nodes (id, label, vec) of a label are dealt into as many blocks as leave about
    ``most`` in each; every pair of blocks is one matrix product in a task of its own, so
    a task holds two blocks however large the label, and a row is copied once a block.
    """
    import numpy as np
    import pyarrow as pa

    large = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = materialize(large.select("label", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "large-labels")
    if large.count() <= BROADCAST_LABELS:
        large = F.broadcast(large)
    rows = nodes.join(large, "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.select("label", F.col("id").cast("string").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), part.alias("part"), "blocks")
    # a row of part p goes to the block pairs (i, j), i <= j, that hold p, once with each role
    pairs = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.array(F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j"))))), lambda x: x["i"] <= x["j"])
    dealt = rows.select("label", "id", "vec", "part", F.explode(pairs).alias("ij")).select("label", "id", "vec", "part", "ij.i", "ij.j")

    def product(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, part = t["id"].to_pylist(), t["part"].to_numpy()
        x = np.array(t["vec"].to_pylist(), float)
        n = np.sqrt((x * x).sum(1))
        x = np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)
        i, j, label = t["i"][0].as_py(), t["j"][0].as_py(), t["label"][0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        p, q = np.nonzero(x[left] @ x[right].T >= least - 1e-12)
        found = [(ids[a], ids[b], float((x[a] * x[b]).sum())) for a, b in zip(left[p].tolist(), right[q].tolist(), strict=True) if a != b and (i != j or ids[a] < ids[b])]
        found = [(min(a, b), max(a, b), s) for a, b, s in found if s >= least]
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"label": pa.array([label] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "cosine_score": pa.array(s, pa.float64())})

    return dealt.groupBy("label", "i", "j").applyInArrow(product, "label string, a string, b string, cosine_score double")


def candidates(fuzzy: DataFrame, cosine: DataFrame, on: tuple[str, ...] = ("label", "a", "b")) -> DataFrame:
    """All pairs of either kind, with null for the score that a pair lacks.

    ``on`` may start with the ``cell`` of :func:`pairs_within`: the pairs of both sides
    then meet where they were made and none is shuffled.
    """
    return fuzzy.select(*on, "fuzzy_score").join(cosine.select(*on, "cosine_score"), list(on), "full_outer")


def pairs_within(rows: DataFrame, keys: list[str], order: str, most: int = KEY_BLOCK, task: int = PAIRS_A_TASK) -> DataFrame:
    """(cell, p, q): all pairs of rows (structs) that agree in ``keys``, ``p`` before ``q`` by ``order``.

    Pairs grow with the square of a key's rows, so tasks are cut by pairs, not by rows:
    the rows of a key are dealt into blocks of about ``most``, each two blocks meet in a
    cell, and cells are hashed to as many partitions as leave about ``task`` pairs in each,
    or to the session's number of shuffle partitions if that is more.
    """
    rows = rows.where(" and ".join(f"{k} is not null" for k in keys))
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum(F.col("n") * (F.col("n") + 1.0))).first()[0] or 0
    cells = max(int(total / 2 / task) + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    if large.count() <= BROADCAST_LABELS:
        large = F.broadcast(large)
    dealt = rows.select(*keys, order, F.struct(*rows.columns).alias("row")).join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(order), F.col("blocks")).cast("int"))
    both = F.sequence(F.lit(0), F.col("blocks") - 1)

    def side(name, i, j):
        out = dealt.select(*keys, F.col(order).alias(f"{name}_order"), F.col("row").alias(name), F.col("part"), F.explode(both).alias("other"))
        out = out.select(*keys, f"{name}_order", name, F.col(i).alias("i"), F.col(j).alias("j"))
        return out.withColumn("cell", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(cells)).cast("int")).repartitionById(cells, "cell")

    # p lies in block i and q in block j, so every ordered pair of blocks is a cell and a pair has one
    p, q = side("p", "part", "other"), side("q", "other", "part")
    return p.join(q.hint("shuffle_hash"), ["cell", *keys, "i", "j"]).where("p_order < q_order").select("cell", "p", "q")


def expert_name(c):
    """struct(surname, initials array) of 'Surname I.O.'."""
    name = F.trim(c)
    rest = F.regexp_replace(name, r"^\S+\s*", "")
    return F.struct(F.lower(F.regexp_extract(name, r"^(\S+)", 1)).alias("surname"), F.regexp_extract_all(F.upper(rest), F.lit(r"(\p{Lu})\.?"), F.lit(1)).alias("initials"))


def experts_match(a, b):
    """The same surname, and the shorter list of initials, if any, starts the longer."""
    x, y = expert_name(a), expert_name(b)
    i, j = x["initials"], y["initials"]
    n = F.least(F.size(i), F.size(j))
    return (x["surname"] == y["surname"]) & (n > 0) & (F.slice(i, F.lit(1), n) == F.slice(j, F.lit(1), n))


def decide(pairs: DataFrame, auto_fuzzy: float = AUTO_FUZZY, auto_cosine: float = AUTO_COSINE, judged: DataFrame | None = None) -> DataFrame:
    """``pairs`` (label, a, b, name_a, name_b, scores) with ``method`` and ``merge``.

    Experts go by surname and initials; others merge by score, else as a judge
    (label, a, b, same) says; without an answer they do not merge.
    """
    if judged is None:
        pairs = pairs.withColumn("same", F.lit(None).cast("boolean"))
    else:
        pairs = pairs.join(judged, ["label", "a", "b"], "left")
    expert = F.col("label") == "Expert"
    by_cosine, by_fuzzy = F.coalesce(F.col("cosine_score") >= auto_cosine, F.lit(False)), F.coalesce(F.col("fuzzy_score") >= auto_fuzzy, F.lit(False))
    method = F.when(expert, "expert").when(by_cosine, "auto_cosine").when(by_fuzzy, "auto_fuzzy").otherwise("llm")
    merge = F.when(expert, experts_match(F.col("name_a"), F.col("name_b"))).when(by_cosine | by_fuzzy, True).otherwise(F.coalesce("same", F.lit(False)))
    return pairs.withColumn("method", method).withColumn("merge", merge).drop("same")


def _forests(batches):
    """Union-find forests of the links (a, b) of a partition: (node, root) for each node that is no root; the smaller id is the root."""
    import pyarrow as pa

    parent: dict[str, str] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def out():
        nodes = list(parent)
        return pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.string()), "root": pa.array(map(find, nodes), pa.string())})

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= FOREST_NODES:
            yield out()
            parent.clear()
    if parent:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b strings): the smallest id reachable.

    Every partition makes forests of its links.  Then, round by round, a node with several
    roots links them to the smallest and every root is replaced by its own: roots
    themselves are joined, so no label has to walk along a chain, and rounds grow with the
    logarithm of the component.  Every round is written and read back, so lineage stays
    short and a lost executor loses nothing.
    """
    edges = materialize(edges.select("a", "b"), "links")
    links = edges.where("a is not null and b is not null")
    forest = materialize(links.mapInArrow(_forests, "node string, root string").distinct(), "forest")
    while True:
        least = materialize(forest.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("most")), "roots")
        up = least.select(F.col("node").alias("above"), F.col("root").alias("over"))
        if not (least.where("root <> most").limit(1).count() or least.join(up, F.col("root") == F.col("above"), "left_semi").limit(1).count()):
            break
        # the other roots of a node under its smallest, then every root replaced by its own
        merged = forest.join(least.select("node", F.col("root").alias("low")), "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        merged = least.select("node", "root").unionByName(merged)
        jumped = merged.join(up, F.col("root") == F.col("above"), "left").select("node", F.coalesce("over", "root").alias("root"))
        last, forest = forest, materialize(jumped.mapInArrow(_forests, "node string, root string").distinct(), "forest")
        discard(last, least)
    discard(forest)
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    return ids.join(least.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def canonical(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, canon_id, members, duplicates): the node of highest degree, ties by name, then id."""
    rows = groups.join(nodes.select("id", "degree", "name_norm"), "id")
    best = F.min_by("id", F.struct(-F.col("degree"), "name_norm", "id"))
    return rows.groupBy("root").agg(best.alias("canon_id"), F.count(F.lit(1)).alias("members"))


def clusters(nodes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, canon_id, members, methods) and the map (id, canon_id) of duplicates."""
    merged = decisions.where("merge")
    groups = components(merged)
    canon = canonical(nodes, groups)
    methods = merged.join(groups.select(F.col("id").alias("a"), "root"), "a").groupBy("root").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    mapping = groups.join(canon.select("root", "canon_id"), "root").where("id <> canon_id").select("id", "canon_id")
    return canon.join(methods, "root"), mapping


def rewire(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without duplicates, aliases united, and edges between canonical nodes, one of each (src, type, dst)."""
    to = mapping.select(F.col("id").alias("sf_id"), F.col("canon_id").alias("sf_to"))

    def move(df, col):
        out = df.join(to, F.col(col) == F.col("sf_id"), "left")
        return out.withColumn(col, F.coalesce("sf_to", col)).drop("sf_id", "sf_to")

    rest = [c for c in edges.columns if c not in ("src", "type", "dst")]
    moved = move(move(edges, "src"), "dst").where("src <> dst")
    new_edges = moved.groupBy("src", "type", "dst").agg(F.min(F.struct(*rest)).alias("f")).select("src", "type", "dst", *[F.col(f"f.{c}").alias(c) for c in rest])
    said = nodes.join(mapping, "id").select(F.col("canon_id").alias("id"), F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("alias"))
    said = said.groupBy("id").agg(F.collect_set("alias").alias("more"))
    kept = nodes.join(mapping.select("id"), "id", "left_anti").join(said, "id", "left")
    union = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.filter(F.coalesce("more", F.array().cast("array<string>")), lambda x: x != F.col("name")))))
    return kept.withColumn("aliases", union).drop("more"), new_edges


def safe_only(decisions: DataFrame) -> DataFrame:
    """Automatic merges survive only between names that differ in case alone."""
    safe = F.col("method").isin("llm", "expert") | (F.startswith("method", F.lit("auto_")) & (F.lower("name_a") == F.lower("name_b")))
    return decisions.withColumn("merge", F.col("merge") & safe)


def plan_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("method").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("merge").cast("long")).alias("to_merge"))


def duplicate_scan(nodes: DataFrame, threshold: float = 90.0, top: int = 30) -> DataFrame:
    """The most alike names of each label above ``threshold`` (a report of ``top`` pairs)."""
    names = nodes.select("label", F.col("name_norm").alias("id"), "name_norm").distinct()
    return fuzzy_pairs(names, threshold, strict=True).orderBy(F.desc("fuzzy_score"), "label", "a", "b").limit(top)
