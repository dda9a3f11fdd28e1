import itertools
import random

import pytest
from pyspark.sql import functions as F

from strataflow.functions.similarity import token_sort_ratio
from strataflow.operators import answer as A
from strataflow.operators import entity_resolution as R
from strataflow.operators import extraction as X
from strataflow.operators import graph_analytics as G
from strataflow.operators import graph_build as K
from strataflow.operators import retrieval as Q

MENTION = "doc_id string, chunk_id string, ord int, tmp_id string, label string, name string, name_norm string, aliases array<string>, geography string, confidence double, source_doc string, source_chunk string"


def mention(doc, chunk, n, label, name, conf=0.9, aliases=(), tmp="e1"):
    return (doc, chunk, n, tmp, label, name, name.lower(), list(aliases), "RU", conf, doc, chunk)


def test_entities_unite_in_order_of_sight(spark):
    rows = [mention("d1", "c1", 0, "Material", "Matte", 0.6, ["m1"]), mention("d1", "c2", 0, "Material", "MATTE", 0.9, ["m2", "m1"]), mention("d1", "c1", 1, "Material", "data"), mention("d1", "c1", 2, "Material", "weak", 0.1), mention("d1", "c1", 3, "Expert", "Weak W.", 0.1)]
    m = spark.createDataFrame(rows, MENTION)
    out = {r["name_norm"]: r for r in K.aggregate_entities(K.admitted(m)).collect()}
    assert set(out) == {"matte", "weak w."}
    assert (out["matte"]["name"], out["matte"]["aliases"], out["matte"]["confidence"], out["matte"]["source_chunk"]) == ("Matte", ["m1", "m2"], 0.9, "c1")
    assert tuple(K.admission_counts(m).first()) == (1, 1)


def test_relations_resolve_inside_their_chunk(spark):
    m = spark.createDataFrame([mention("d", "c1", 0, "Material", "first"), mention("d", "c2", 0, "Material", "second"), mention("d", "c1", 1, "Property", "yield", tmp="e2")], MENTION)
    schema = "doc_id string, chunk_id string, source_chunk string, ord int, source string, target string, type string, confidence double"
    r = spark.createDataFrame([("d", "c1", "c1", 0, "e1", "e2", "has_property", 0.9), ("d", "c1", "c1", 1, "e1", "DOC", "described_in", 0.9), ("d", "c1", "c1", 2, "DOC", "DOC", "relates_to", 0.9), ("d", "c1", "c1", 3, "e1", "e9", "owns", 0.9), ("d", "c1", "c1", 4, "e1", "e2", "relates_to", 0.2)], schema)
    got = {(x["source_key"], x["target_key"]) for x in K.resolve_relations(r, m).collect()}
    assert got == {("first", "yield"), ("first", "d")}
    assert {x["source_key"] for x in K.resolve_relations(r, m, by_document=True).collect()} == {"second"}


def test_edge_properties_let_attributes_win(spark):
    numeric = "struct<parameter:string,operator:string,value:double,value_min:double,value_max:double,unit:string>"
    f = spark.createDataFrame([("d", "c", 0.5, "has_property", ("p", "=", 1.0, None, None, "%"), {"confidence": "x", "k": "v"}), ("d", "c", 0.5, "owns", ("p", "=", 1.0, None, None, "%"), None)], f"doc_id string, source_chunk string, confidence double, type string, numeric {numeric}, attrs map<string,string>")
    a, b = K.edge_properties(f).collect()
    assert a["props"]["confidence"] == "x" and a["props"]["value"] == "1.0" and a["type"] == "HAS_PROPERTY"
    assert "value" not in b["props"]


def test_first_edges_are_idempotent(spark):
    f = spark.createDataFrame([("a", "t", "b", 1, 5.0), ("a", "t", "b", 0, 7.0), ("a", "t", "c", 2, 1.0)], "src string, type string, dst string, ord int, value double")
    once = K.first_edges(f, ["ord"])
    assert sorted((r["dst"], r["value"]) for r in once.collect()) == [("b", 7.0), ("c", 1.0)]
    assert K.unique_violations(once, "src", "type", "dst").count() == 0


NODES = [("a", "Process", "Leaching", "leaching"), ("b", "Material", "Nickel", "nickel"), ("c", "Material", "Copper", "copper"), ("e", "Experiment", "E", "e"), ("p", "Publication", "P", None), ("k", "Chunk", None, None)]


def graph(spark):
    n = spark.createDataFrame(NODES, "id string, label string, name string, name_norm string").withColumn("aliases", F.array(F.lit("alias"))).withColumn("confidence", F.lit(0.9))
    e = spark.createDataFrame([("e", "uses", "a", 0.9), ("e", "uses", "b", 0.9), ("b", "described_in", "p", 0.4), ("k", "PART_OF", "p", 1.0)], "src string, type string, dst string, confidence double")
    return n, e


def test_graph_questions(spark):
    n, e = graph(spark)
    assert tuple(G.statistics(n).first()) == (4, 1, 1)
    assert {r["id"]: r["degree"] for r in G.with_degree(n, e).collect()} == {"a": 1, "b": 2, "c": 0, "e": 2, "p": 2, "k": 1}
    nodes, edges = G.preview(n, e, 2)
    assert [r["id"] for r in nodes.orderBy("hop", "id").collect()] == ["b", "e"] and edges.count() == 1
    assert {r["id"]: r["hops"] for r in G.neighbours(e, spark.createDataFrame([("a",)], "id string"), 2, 0.5).collect()} == {"a": 0, "e": 1, "b": 2}
    assert [r["path"] for r in G.paths(e, "a", "p", 4).collect()] == [["a", "e", "b", "p"]]
    assert G.paths(e, "a", "p", 2).count() == 0
    assert [tuple(r) for r in G.gaps(e.where("src = 'e'"), n.where("id in ('a','b','c')")).orderBy("a", "b").collect()] == [("a", "c"), ("b", "c")]
    terms = spark.createDataFrame([(0, "nickel"), (1, "alias")], "ord int, term string")
    assert [r["id"] for r in G.resolve_anchors(n, e, terms, least=1).collect()] == ["b"]
    assert [r["id"] for r in G.union_subsets(n.where("id='a'"), n.where("id in ('a','b')")).collect()] == ["a", "b"]
    hub, star = G.publication_star(spark.createDataFrame([("p", 2), ("p", 1), ("q", 3)], "doc_id string, rank int"))
    assert hub.count() == 3 and sorted((r["dst"], r["rank"]) for r in star.collect()) == [("p", 1), ("q", 3)]
    assert G.without_incoming(n.where("label = 'Material'"), e.withColumn("type", F.lit("HAS_PROPERTY"))).first()["id"] == "c"


def test_redundant_pairs(spark):
    df = spark.createDataFrame([("heap leaching", "leaching"), ("abcdefghijkl one", "ABCDEFGHIJKL two"), ("nickel", "copper")], "a string, b string")
    assert [r[0] for r in df.select(G.redundant(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_fuzzy_join_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["nickel", "matte", "copper", "slag", "leaching", "heap", "flotation", "sulfide", "ore"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) + rng.choice(["", "s", " x", "1"]) for _ in range(120)})
    nodes = spark.createDataFrame([("Material", f"n{i:03d}", x) for i, x in enumerate(names)], "label string, id string, name_norm string")
    for least in (88.0, 75.0):
        got = {(r["a"], r["b"]) for r in R.fuzzy_pairs(nodes, least).collect()}
        want = {(f"n{i:03d}", f"n{j:03d}") for i, j in itertools.combinations(range(len(names)), 2) if token_sort_ratio(names[i], names[j]) >= least}
        assert got == want and want


def test_cosine_join_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    nodes = spark.createDataFrame([("L", f"v{i:02d}", v.tolist()) for i, v in enumerate(x)], "label string, id string, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"v{i:02d}", f"v{j:02d}") for i, j in itertools.combinations(range(60), 2) if u[i] @ u[j] >= 0.7}
    assert {(r["a"], r["b"]) for r in R.cosine_pairs(nodes, 0.7).collect()} == want and want
    # many blocks of one label, one of another
    both = nodes.unionByName(nodes.where("id < 'v05'").withColumn("label", F.lit("M")))
    out = R.cosine_pairs(both, 0.7, most=7).collect()
    assert sorted((r["a"], r["b"]) for r in out if r["label"] == "L") == sorted(want)
    assert {(r["a"], r["b"]) for r in out if r["label"] == "M"} == {p for p in want if max(p) < "v05"}


def test_experts(spark):
    rows = [("Иванов И.И.", "Иванов И.", True), ("Иванов И.И.", "Иванов П.", False), ("Иванов", "Иванов И.", False), ("Петров И.", "Иванов И.", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(R.experts_match(F.col("a"), F.col("b")), "want").collect())


def test_components_and_clusters(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y")]
    out = {r["id"]: r["root"] for r in R.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(out.values()) == {"n000", "x"} and len(out) == 43
    nodes = spark.createDataFrame([("a", "M", "A", "a", 1, ["z"]), ("b", "M", "B", "b", 5, []), ("c", "M", "C", "c", 0, [])], "id string, label string, name string, name_norm string, degree int, aliases array<string>")
    d = spark.createDataFrame([("M", "a", "b", "A", "B", "auto_fuzzy", True), ("M", "b", "c", "B", "C", "llm", False)], "label string, a string, b string, name_a string, name_b string, method string, merge boolean")
    found, mapping = R.clusters(nodes, d)
    assert [tuple(r) for r in mapping.collect()] == [("a", "b")] and found.first()["methods"] == ["auto_fuzzy"]
    edges = spark.createDataFrame([("a", "t", "c", 1), ("b", "t", "c", 2), ("a", "t", "b", 3)], "src string, type string, dst string, ord int")
    new, moved = R.rewire(nodes, edges, mapping)
    assert {r["id"]: r["aliases"] for r in new.collect()} == {"b": ["A", "z"], "c": []}
    assert [tuple(r) for r in moved.collect()] == [("b", "t", "c", 1)]
    assert R.safe_only(d).where("merge").count() == 0


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    written = []

    def counted(df, name, write=R.materialize):
        written.append(name)
        assert len(written) <= 30
        return write(df, name)

    monkeypatch.setattr(R, "materialize", counted)
    monkeypatch.setattr(R, "FOREST_NODES", 50, raising=False)
    # ids rise along the chain and the smallest is at its far end: its label has to go back against all others
    links = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(3000)] + [("n03000", "a")]
    random.Random(2).shuffle(links)
    edges = spark.createDataFrame([*links, ("x", "x"), ("y", None), ("b2", "b10"), ("b3", "b10"), ("b3", "b2")], "a string, b string").repartition(6)
    out = {r["id"]: r["root"] for r in R.components(edges).collect()}
    assert len(out) == 3002 + 5 and out["x"] == "x" and out["y"] == "y" and {out[x] for x in ("b2", "b3", "b10")} == {"b10"}
    assert {v for k, v in out.items() if k[0] in "an"} == {"a"}


def test_intervals(spark):
    f = spark.createDataFrame([("t", 5.0, None, None, "C"), ("t", None, 1.0, 3.0, "C"), ("t", None, 9.0, 12.0, "C"), ("t", 5.0, None, None, "K"), (None, None, None, None, None)], "parameter string, value double, value_min double, value_max double, unit string")
    def count(low, high):
        return Q.find_facts(f, Q.Filters(numeric=(Q.NumericFilter("T", low, high, ("C",)),))).count()
    assert [count(2, 6), count(None, 2), count(10, None), count(4, 4.5)] == [2, 1, 1, 0]
    assert f.where(Q.is_numeric_row()).count() == 4


def test_filters_are_sanitised():
    f = Q.Filters.sanitised({"year_range": {"lo": 2010, "hi": None}, "geo": "RU", "numeric_filters": [{"parameter": "t", "operator": "range", "value_min": 1, "value_max": float("nan")}, {"parameter": "t", "operator": "<=", "value": 5, "unit": "C"}]})
    assert f.year_min is None and f.geography == "RU" and f.numeric == (Q.NumericFilter("t", None, 5.0, ("C",)),)


def test_fusion_adds_repeats_and_keeps_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "doc_id string, rank int")
    b = spark.createDataFrame([("z", 1), ("y", 2)], "doc_id string, rank int")
    out = Q.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["x", "y", "z"]
    assert out[0]["score"] == pytest.approx(1 / 61 + 1 / 63)


def test_context_and_answer(spark):
    rows = [(i, "d", "T", 2000, "v", "r", "word " * 200) for i in range(1, 6)]
    chunks = spark.createDataFrame(rows, "rank int, doc_id string, title string, year int, venue string, doc_type string, text string")
    assert A.within_budget(chunks, 0, 2000).count() == 2
    facts = spark.createDataFrame([("N", "p", "=", 1.5, None, None, "%", 0.9, "d", 1)], "name string, parameter string, operator string, value double, value_min double, value_max double, unit string, confidence double, doc_id string, seq int")
    none = spark.createDataFrame([], "source_a string, source_b string, description string")
    text = A.context("q", facts, none, chunks, 2000)
    assert "«N» — p = 1.5% (confidence 0.9, источники: doc:d)" in text and text.count("[doc:d] T (2000)") >= 1
    assert A.extractive_answer(chunks.limit(0)).first()["answer"].startswith("## Ничего")
    assert [A.answer_mode(m, s, n) for m, s, n in (("vector", True, False), ("graph", False, True), ("graph", False, False))] == ["full", "vector+graph", "vector"]


def test_vector_search_modes(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10.0]) for i in range(10)], "chunk_id int, vec array<double>")
    c = spark.createDataFrame([(i, i // 2, f"text {i // 2}", "en" if i > 4 else "de", 2000 + i) for i in range(10)], "chunk_id int, doc_id int, text string, lang string, year int")
    pre = Q.vector_top_k(v, c, [1.0, 0.0], 2, Q.Filters(lang="en"), prefix=None)
    assert [r["chunk_id"] for r in pre.orderBy("rank").collect()] == [5, 6]
    post = Q.vector_top_k(v, c, [1.0, 0.0], 1, Q.Filters(lang="en"), post_filter=True)
    assert post.count() == 0
    assert [r["chunk_id"] for r in Q.vector_top_k(v, c, [1.0, 0.0], 2).orderBy("rank").collect()] == [0, 2]


def test_expand_finds_neighbours_of_all_seeds(spark):
    n = 10_050
    seeds = spark.range(n).select(F.format_string("s%05d", "id").alias("id"))
    edges = spark.range(n).select(F.format_string("s%05d", "id").alias("src"), F.format_string("t%05d", "id").alias("dst"), F.lit("x").alias("type"))
    nodes = seeds.unionByName(edges.select(F.col("dst").alias("id"))).withColumn("label", F.lit("Publication"))
    assert G.expand(seeds, nodes, edges, cap=3 * n).count() == 2 * n


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(11)
    inf, nan = float("inf"), float("nan")

    def intervals(n):
        rows = [(lo := rng.choice((0.0, -50.0, 1e6)) + rng.uniform(-100, 100), lo + rng.choice((0.0, 0.5, 3.0, 10.0, 900.0, 1e7))) for _ in range(n)]
        return rows + [(5.0, inf), (-inf, 2.0), (-inf, inf), (9.0, 4.0), (8.0, 8.0), (10.0, 20.0), (20.0, 30.0)]

    left, right = intervals(80), intervals(40)
    facts = spark.createDataFrame([(i, "pq"[i % 2], lo, hi) for i, (lo, hi) in enumerate(left)] + [(998, "p", None, 4.0), (999, "p", nan, 4.0)], "id int, parameter string, lo double, hi double")
    wanted = spark.createDataFrame([(i, "pq"[i % 3 % 2], lo, hi) for i, (lo, hi) in enumerate(right)] + [(999, None, 0.0, 4.0)], "want int, parameter string, want_lo double, want_hi double")
    want = sorted((i, j) for i, (a, b) in enumerate(left) for j, (c, e) in enumerate(right) if "pq"[i % 2] == "pq"[j % 3 % 2] and a <= e and b >= c)
    for width in (0.25, 10.0, 1e5):
        assert sorted((r["id"], r["want"]) for r in Q.overlap_join(facts, wanted, width).collect()) == want
    assert Q.overlap_join(facts.limit(0), wanted, 1.0).count() == 0


def test_search_in_blocks_equals_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(70, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id int, vec array<double>")
    asked = vectors.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in Q.search_many(vectors, asked, 4, block=6).collect()}
    assert got == {(q, n + 1): int(c) for q in range(0, 70, 3) for n, c in enumerate(np.argsort(-(u @ u[q]), kind="stable")[:4])}
    assert Q.search_many(vectors, asked.limit(0), 4).count() == 0


def test_search_holds_products_with_few_rows_and_breaks_ties_by_id(spark):
    import tracemalloc

    import numpy as np

    x = np.random.default_rng(4).normal(size=(3000, 4))
    x[1000:1100] = x[0]  # copies: the smallest ids win
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in reversed(list(enumerate(x)))], "chunk_id int, vec array<double>").coalesce(1)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in Q.search_many(vectors, vectors.where("chunk_id in (0, 7)").withColumnRenamed("chunk_id", "query_id"), 4).collect()}
    assert [got[0, n] for n in (1, 2, 3, 4)] == [0, 1000, 1001, 1002] and got[7, 1] == 7

    class Plan:  # what the tasks run, without Spark
        schema = vectors.schema

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    import pyarrow as pa

    asked = [{"query_id": i, "vec": v.tolist()} for i, v in enumerate(x[:1500])]
    run = Q._search_block(Plan(), asked, vectors.schema["chunk_id"].dataType, 4)
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(3000), pa.int32()), "vec": pa.array(x.tolist(), pa.list_(pa.float64()))})
    tracemalloc.start()
    rows = sum(b.num_rows for b in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 * 4 and peak < 1500 * 3000 * 8 / 1.5


def test_pairs_within_keys_are_cut_by_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("xxxxyz"), rng.choice((1, 1, 1, 2)), f"n{i}") for i in range(300)] + [(900, None, 1, "no"), (901, "x", None, "no")]
    df = spark.createDataFrame(rows, "id int, kind string, size int, name string")
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows[:300], 2) if a[1:3] == b[1:3])
    for most, task in ((1000, 10**6), (10, 100)):
        out = R.pairs_within(df, ["kind", "size"], "id", most, task)
        assert sorted((r["p"]["id"], r["q"]["id"]) for r in out.collect()) == want
    # a hot key is spread over the tasks
    sizes = [n for n in out.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert len(sizes) > len(want) / 100 / 2 and max(sizes) < len(want) / 10
    assert R.pairs_within(df.limit(0), ["kind", "size"], "id").count() == 0
    # candidates of one cell meet without another shuffle of the pairs
    pairs = out.select("cell", F.lit("M").alias("label"), F.col("p.name").alias("a"), F.col("q.name").alias("b"), (F.col("p.id") % 3).cast("double").alias("fuzzy_score"), (F.col("q.id") % 2).cast("double").alias("cosine_score"))
    by_cell = R.candidates(pairs.where("fuzzy_score > 0"), pairs.where("cosine_score > 0"), ("cell", "label", "a", "b"))
    plain = R.candidates(pairs.where("fuzzy_score > 0"), pairs.where("cosine_score > 0"))
    assert by_cell._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0
    assert sorted(map(str, by_cell.drop("cell").collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", ["plan_filter", "dedup_decisions", "plan_summary", "candidate_union"])
def test_decisions_are_made_in_tasks_bounded_by_pairs(spark, tmp_path, monkeypatch, name):
    from strataflow.plans import queries

    # one key of 60 rows: 1770 pairs, which a join on the key alone makes in one task
    part = spark.createDataFrame([(i, f"n{i % 2}", "b", "t", 1) for i in range(60)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(R.pairs_within, "__defaults__", (10, 100))
    seen = []
    monkeypatch.setattr(queries.R, "decide", lambda pairs, decide=R.decide: seen.append(pairs) or decide(pairs))
    out = queries.QUERIES[name](spark, str(tmp_path))
    rows = out.collect()
    tasks = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1770 and max(tasks) < 1770 / 3
    if name == "plan_summary":
        assert sum(r["pairs"] for r in rows) == 1770
    elif name == "candidate_union":
        assert len(rows) == sum(p % 20 + 80 >= 88 or (p % 3 == 0 and q % 10 + 90 >= 92) for p, q in itertools.combinations(range(60), 2))
    else:
        assert len({(r["a"], r["b"]) for r in rows}) == len(rows) == 1770


def test_calibration_sample_is_complete_or_refused(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_id string, n int")
    assert {r["n"] for r in X.calibration_sample(chunks, ["a", "c"]).collect()} == {1, 3}
    with pytest.raises(ValueError, match="zz"):
        X.calibration_sample(chunks, ["a", "zz"])


def test_entities_of_a_run_are_merged_into_the_table(spark):
    schema = "id string, label string, name_norm string, name string, geography string, source_doc string, source_chunk string, aliases array<string>, confidence double, mentions long"
    old = spark.createDataFrame([("1", "M", "x", "X", "RU", "d1", "c1", ["b"], 0.4, 2), ("2", "M", "y", "Y", None, "d1", "c1", [], 0.9, 1)], schema)
    new = spark.createDataFrame([("1", "M", "x", "Xx", "WORLD", "d2", "c2", ["a", "b"], 0.7, 3), ("3", "P", "x", "X", None, "d2", "c2", ["q"], 0.5, 1)], schema)
    out = {r["id"]: r for r in K.upsert_entities(old, new).collect()}
    assert len(out) == 3 and tuple(out["1"]) == ("1", "M", "x", "X", "RU", "d1", "c1", ["a", "b"], 0.7, 5)
    assert out["2"]["aliases"] == [] and out["3"]["mentions"] == 1
