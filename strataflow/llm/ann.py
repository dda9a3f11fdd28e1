"""Approximate nearest neighbours (operator 9): shifted space-filling curves.

Unit vectors are projected ``CURVES`` times onto ``DIMS`` random orthogonal
directions, shifted, quantised and ordered along a Hilbert curve; Spark deals each
ordering out by ranges, which gives every vector a rank in each.  Candidates of a
query are the vectors within a window of ranks around its own; windows of all
curves merge, and the original vectors are reranked by cosine in double precision.
A window is cut into blocks of rows, and a query goes to the blocks that its
window meets, so the work of a task is bounded for any data.

The window is not guessed: a sample of at most ``SAMPLE`` queries is answered
exactly (one pass over all rows), and the window is the rank distance that covers
the share ``TARGET`` of their true neighbours.  Where data have no structure, as
random directions in 64 dimensions, that is a large share of all rows; where they
have, it is small.  All rows are indexed.

Equal vectors are one entry of the index that carries its smallest ids, so any
number of copies costs what one vector does, and ties between copies are exact.
Entries are scaled by a power of two to a largest component near one: their cosines
stay what they are, and no square overflows or vanishes.

Defined results: vectors that are null, zero, hold null or non-finite components or
have another length than most take no part, as query or candidate; rows with a null
id neither; a query with fewer than ``k`` candidates gets them all; ties go to the
smaller id; rows that repeat an id count once if their vectors are equal, else each is
a candidate and, if a query, answered on its own (only its own row is left out); an
empty table gives an empty result; extra columns are not read; ids that are not
numbers end in a cast error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import lean, materialize, shuffle_partitions

CURVES, DIMS, BITS = 8, 8, 6
#: Queries at most that the window is measured on, and the share of neighbours that it covers.
SAMPLE, TARGET = 256, 0.95
#: Rows of a block at most.
BLOCK = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, d), uint64; d * bits <= 64."""
    axes = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for a in range(len(axes)):
            upper = (axes[a] >> np.uint64(b)) & one == one
            swap = np.where(upper, np.uint64(0), (axes[0] ^ axes[a]) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            if a:
                axes[a] = axes[a] ^ swap
    for a in range(1, len(axes)):
        axes[a] = axes[a] ^ axes[a - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ flip) >> np.uint64(b)) & one)
    return key


def _curve(number: int, width: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shift of a curve, the same on every worker."""
    rng = np.random.default_rng((number, width))
    return np.linalg.qr(rng.normal(size=(width, dims)))[0], rng.random(dims)


def curve_keys(unit: np.ndarray, number: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    dims = min(dims, unit.shape[1])
    directions, shift = _curve(number, unit.shape[1], dims)
    spread = np.clip(unit @ directions * np.sqrt(unit.shape[1]) / 8 + 0.5, 0, 1)
    return hilbert_keys(np.minimum((spread + shift) / 2 * (1 << bits), (1 << bits) - 1).astype(np.uint64), bits)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision; the order of summation depends on their length alone."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


#: More than the rounding of a cosine by matrix product.
MARGIN = 1e-9


def _scaled(x: np.ndarray) -> np.ndarray:
    """``x`` times a power of two, its largest component between 0.5 and 1."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _best(q: np.ndarray, d: np.ndarray, allowed: np.ndarray | None, ids: np.ndarray, own: np.ndarray, k: int, reps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, cosine) of the ``k`` best rows for each query; ties go by ``ids``, ``own`` names the row of ``reps`` (else ``ids``) left out."""
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit(q) @ unit(d).T
    bad = own[:, None] == (ids if reps is None else reps)[None, :]
    if allowed is not None:
        bad |= ~allowed
    near[bad] = -np.inf
    # all rows that may tie with the k-th: exact scores and ids decide among them
    least = -np.partition(-near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    row, at = np.nonzero((near >= least[:, None] - MARGIN) & np.isfinite(near))
    score = cosine(q[row], d[at])
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k], score[place < k]


def _valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>, a, b): rows that take part, with a hash of the vector."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    huge = F.lit(1.7976931348623157e308)
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > huge))).where(F.exists("vec", lambda x: x != 0))
    return rows.select("id", "vec", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"))


def _classes(valid: DataFrame, k: int, every: int) -> DataFrame:
    """(rep, ids: the k + 1 smallest, asks boolean, v binary, a, b): one row for equal vectors; ``rep`` is a number of its own."""
    first = Window.partitionBy("a", "b").orderBy("id")
    small = valid.select("id", "a", "b").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    small = small.groupBy("a", "b").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = valid.groupBy("a", "b").agg(F.max(F.col("id") % every == 0).alias("asks"))
    both = small.join(asks, ["a", "b"]).withColumn("first", F.col("ids")[0])
    vectors = valid.select(F.col("id").alias("first"), "a", "b", "vec").dropDuplicates(["first", "a", "b"])

    def pack(batches):
        for batch in batches:
            raw = [_scaled(np.array(v.as_py(), np.float64)).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary()), batch.column(3), batch.column(4)], names=["ids", "asks", "v", "a", "b"])

    out = vectors.join(both, ["first", "a", "b"]).select("ids", "asks", "vec", "a", "b").mapInArrow(lean(pack), "ids array<long>, asks boolean, v binary, a long, b long")
    return out.select(F.monotonically_increasing_id().alias("rep"), "*")  # written before use, so it stays what it is


def _ranks(classes: DataFrame, curves: int) -> DataFrame:
    """(curve, rep, rank): the rank of every entry along every curve."""
    spark = classes.sparkSession

    def keys(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            for c in range(curves if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curve_keys(unit, c).astype(np.int64)), batch.column(0), batch.column(2)], names=["curve", "key", "rep", "a"])

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))], names=["curve", "rep", "part", "place"])
            at += batch.num_rows

    keyed = materialize(classes.select("rep", "v", "a").mapInArrow(lean(keys), "curve int, key long, rep long, a long"), "curve-keys")
    dealt = keyed.repartitionByRange(max(2, shuffle_partitions(spark)), "curve", "key", "a", "rep").sortWithinPartitions("curve", "key", "a", "rep")
    placed = materialize(dealt.select("curve", "rep").mapInArrow(lean(number), "curve int, rep long, part int, place long"), "places")
    starts, before = [], 0
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(starts, "part int, before long")
    n = before // curves
    return placed.join(F.broadcast(starts), "part").select("curve", "rep", (F.col("place") + F.col("before") - F.col("curve") * F.lit(n)).alias("rank"))


def _window(classes: DataFrame, ranks: DataFrame, k: int, sample: int, target: float) -> int:
    """The rank distance that covers ``target`` of the true neighbours of sampled queries."""
    picked = classes.where("asks").select("rep", "v", "a", "b").orderBy("a", "b").limit(sample).collect()
    if not picked:
        return 1
    own = np.array([r["rep"] for r in picked])
    q = np.frombuffer(b"".join(r["v"] for r in picked), np.float64).reshape(len(own), -1)

    def exact(batches):
        row, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                d, reps = _matrix(some.column(1)), some.column(0).to_numpy()
                r, c, s = _best(q, d, None, reps, own, k)
                row, ids, score = np.concatenate([row, r]), np.concatenate([ids, reps[c]]), np.concatenate([score, s])
                order = np.lexsort((ids, -score, row))
                row, ids, score = row[order], ids[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, ids, score = row[keep], ids[keep], score[keep]
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids), pa.array(score)], names=["q", "c", "score"])

    found = sorted(map(tuple, classes.select("rep", "v").mapInArrow(lean(exact), "q long, c long, score double").collect()), key=lambda r: (r[0], -r[2], r[1]))
    pairs, seen = [], {}
    for a, b, _ in found:
        seen[a] = seen.get(a, 0) + 1
        if seen[a] <= k:
            pairs.append((a, b))
    if not pairs:
        return 1
    wanted = classes.sparkSession.createDataFrame([(x,) for x in sorted({int(x) for p in pairs for x in p})], "rep long")
    where = {(r["curve"], r["rep"]): r["rank"] for r in ranks.join(F.broadcast(wanted), "rep").collect()}
    curves = 1 + max(c for c, _ in where)
    apart = sorted(min(abs(where[c, a] - where[c, b]) for c in range(curves)) for a, b in pairs)
    return max(1, apart[min(len(apart) - 1, int(np.ceil(target * len(apart))) - 1)])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, target: float = TARGET, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the nearest of each row whose id ``every`` divides."""
    valid = _valid(vectors, id_col, vec_col)
    width = [r["n"] for r in valid.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()]
    valid = valid.where(F.size("vec") == (width[0] if width else 0))
    classes = materialize(_classes(valid, k, every), "classes")
    ranks = materialize(_ranks(classes, curves), "ranks")
    w = _window(classes, ranks, k, sample, target)
    size = min(max(w, 64), block)

    placed = ranks.join(classes.select("rep", "asks", "v", F.col("ids")[0].alias("first")), "rep")
    group = F.floor(F.col("rank") / size).cast("long")
    data = placed.select("curve", group.alias("block"), F.lit(False).alias("query"), "rank", "rep", "first", "v")
    met = F.sequence(F.floor(F.greatest(F.col("rank") - w, F.lit(0)) / size).cast("long"), F.floor((F.col("rank") + w) / size).cast("long"))
    asked = placed.where("asks").select("curve", F.explode(met).alias("block"), F.lit(True).alias("query"), "rank", "rep", "first", "v")

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_query = t["query"].to_numpy()
        rank, rep, first = (t[c].to_numpy() for c in ("rank", "rep", "first"))
        x = _matrix(t["v"])
        here, ask = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        out = []
        for at in range(0, len(ask) if len(here) else 0, 256):
            some = ask[at : at + 256]
            allowed = np.abs(rank[some][:, None] - rank[here][None, :]) <= w
            r, c, s = _best(x[some], x[here], allowed, first[here], rep[some], k, rep[here])
            out.append((rep[some][r], rep[here][c], first[here][c], s))
        none = np.zeros(0, np.int64)
        q, c, f, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (none, none, none, np.zeros(0))
        return pa.table({"q": q, "c": c, "first": f, "score": s})

    hits = data.unionByName(asked).groupBy("curve", "block").applyInArrow(search, "q long, c long, first long, score double")
    hits = hits.groupBy("q", "c").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first", "c")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "c", "score")
    others = hits.join(classes.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", "ids", F.lit(False).alias("own"))

    def same(v: pa.Array) -> pa.Array:
        x = _matrix(v)
        return pa.array(cosine(x, x))

    own = classes.where("asks").select(F.col("rep").alias("q"), F.arrow_udf(same, "double")("v").alias("score"), "ids", F.lit(True).alias("own"))
    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id"), F.col("own").alias("own")))
    lists = others.unionByName(own).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, k + 1).alias("found"))
    lists = materialize(lists.join(classes.select(F.col("rep").alias("q"), "a", "b"), "q").select("a", "b", "found"), "found")
    queries = materialize(valid.where(F.col("id") % every == 0).select("id", "a", "b").distinct(), "queries")
    out = queries.join(lists, ["a", "b"])
    found = F.slice(F.filter("found", lambda x: ~x["own"] | (x["id"] != F.col("id"))), 1, k)
    out = out.select("id", F.posexplode(found).alias("pos", "hit"))
    return out.select(F.col("id").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
