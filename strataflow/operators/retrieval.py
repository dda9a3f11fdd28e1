"""Vector search, fact filters and rank fusion."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import text as T
from strataflow.functions import vectors as V
from strataflow.sources.tables import materialize, numbered

RRF_K = 60
#: Queries that a pass over the vectors answers at once.
BLOCK = 4096
#: Vectors whose products with a block of queries a task holds at once.
ROWS = 512
#: Ends of intervals that lie further out are taken as this far.
_FAR = 1e300


@dataclass(frozen=True)
class NumericFilter:
    """A user's numeric condition: a parameter and an interval, either end open."""

    parameter: str
    low: float | None = None
    high: float | None = None
    units: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filters:
    """What a question is restricted to; None disables a filter."""

    year_min: int | None = None
    year_max: int | None = None
    lang: str | None = None
    doc_type: str | None = None
    geography: str | None = None
    min_confidence: float | None = None
    numeric: tuple[NumericFilter, ...] = field(default=())

    @classmethod
    def sanitised(cls, raw: dict) -> Filters:
        """From a request: a year range needs both ends, a numeric filter a finite bound (a range two)."""
        import math

        def number(x):
            return float(x) if isinstance(x, int | float) and math.isfinite(x) else None

        years = raw.get("year_range") or {}
        lo, hi = number(years.get("lo")), number(years.get("hi"))
        numeric = []
        for f in raw.get("numeric_filters") or ():
            op, v, a, b = f.get("operator"), number(f.get("value")), number(f.get("value_min")), number(f.get("value_max"))
            a = v if a is None else a
            low, high = {"<=": (None, v), ">=": (v, None), "=": (v, v), "range": (a, b)}.get(op, (None, None))
            if (op == "range" and None not in (a, b)) or (op != "range" and (low is not None or high is not None)):
                numeric.append(NumericFilter(f["parameter"], low, high, (f["unit"],) if f.get("unit") else ()))
        both = lo is not None and hi is not None
        return cls(int(lo) if both else None, int(hi) if both else None, raw.get("lang"), raw.get("doc_type"), raw.get("geo"), raw.get("min_confidence"), tuple(numeric))


def metadata_condition(f: Filters) -> Column | None:
    """Year, language, type and geography as a predicate; a null year fails an active year filter."""
    parts = []
    if f.year_min is not None:
        parts.append(F.col("year") >= f.year_min)
    if f.year_max is not None:
        parts.append(F.col("year") <= f.year_max)
    if f.lang is not None:
        parts.append(F.col("lang") == f.lang)
    if f.doc_type is not None:
        parts.append(F.col("doc_type") == f.doc_type)
    if f.geography is not None:
        parts.append(F.contains("geography", F.lit(f.geography)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def scored(vectors: DataFrame, query) -> DataFrame:
    """(chunk_id, score): the cosine of every vector with ``query``."""
    unit = [float(x) for x in query]
    length = sum(x * x for x in unit) ** 0.5 or 1.0
    score = F.round(V.dot_literal(F.col("vec"), [x / length for x in unit]) / V.norm(F.col("vec")), 9)
    return vectors.select("chunk_id", score.alias("score"))


def collapse_near_duplicates(rows: DataFrame, prefix: int = 120, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The best scored of the chunks that agree in ``by`` and in their first ``prefix`` characters; a partial minimum, no sort."""
    first = F.min_by(F.struct(*rows.columns), F.struct(-F.col("score"), "chunk_id")).alias("row")
    return rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in by], F.substring("text", 1, prefix).alias("start")).agg(first).select("row.*")


def vector_top_k(vectors: DataFrame, chunks: DataFrame, query, k: int = 20, filters: Filters | None = None, post_filter: bool = False, over: int = 4, prefix: int | None = 120) -> DataFrame:
    """The ``k`` nearest chunks by cosine: (all columns of ``chunks``, score, rank).

    Filters apply before the cut, so they cannot leave fewer than there are;
    ``post_filter`` cuts to ``over * k`` first, as an index would.  Chunks of one
    document that start with the same ``prefix`` characters count once.
    """
    filters = filters or Filters()
    near = scored(vectors, query)
    keep = metadata_condition(filters)
    if post_filter:
        near = near.orderBy(F.desc("score"), "chunk_id").limit(over * k)
    rows = near.join(chunks, "chunk_id")
    if "is_reference" in chunks.columns:
        rows = rows.where(~F.coalesce("is_reference", F.lit(False)))
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.orderBy(F.desc("score"), "chunk_id").limit(over * k)
    if prefix:
        rows = collapse_near_duplicates(rows, prefix)
    rows = rows.orderBy(F.desc("score"), "chunk_id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, chunk_id, score): exact nearest chunks of many queries (query_id, vec), in blocks.

    Queries are dealt by hash into blocks of about ``block``; a block travels to the tasks
    for one pass over the vectors, every task keeps its ``k`` best, and only those are
    ranked.  A task holds one block and its products with ``ROWS`` vectors; the plan in
    the driver holds the vectors of all queries, but none of the others.
    """
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block))))
    asked = materialize(queries.select("query_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"), part.alias("part")), "asked")
    rows = vectors.select("chunk_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    parts = sorted(r["part"] for r in asked.select("part").distinct().collect())  # a number a block
    found = [_search_block(rows, asked.where(F.col("part") == p).orderBy("query_id").collect(), queries.schema["query_id"].dataType, k) for p in parts or [0]]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return reduce(lambda a, b: a.unionByName(b), found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(vectors: DataFrame, asked: list, id_type, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the ``k`` best of every task for the queries of a block."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    ids = [r["query_id"] for r in asked]
    q = np.array([r["vec"] for r in asked], float) if ids else np.zeros((0, 1))
    q = q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)
    name_type = vectors.schema["chunk_id"].dataType
    types = (to_arrow_type(id_type), to_arrow_type(name_type))

    def matrix(column):
        if not len(column):
            return np.zeros((0, q.shape[1]))
        if column.null_count or len(column.flatten()) != len(column) * q.shape[1]:
            return np.array(column.to_pylist(), float)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches):
        # the best so far of query `of` by rounded score, then name; the last of k of them is the bound for others
        of, score, name = np.zeros(0, int), np.zeros(0), None
        bound = np.full(len(ids), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows if ids else 0, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(1))
                near = q @ (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)).T
                least, open_ = bound.copy(), np.flatnonzero(bound == -np.inf)
                if len(open_) and k <= near.shape[1]:  # what is not among the k best of these rows is not among all; equal scores stay
                    least[open_] = np.partition(near[open_], near.shape[1] - k, axis=1)[:, -k]
                i, j = np.nonzero(near >= (least - 2e-9)[:, None])
                names = part.column(0).to_numpy(zero_copy_only=False) if not part.column(0).null_count else np.array(part.column(0).to_pylist(), object)
                name = names[:0] if name is None else name
                new = np.zeros(len(ids), bool)
                new[i] = True
                old = new[of]
                o, s, c = np.concatenate([of[old], i]), np.concatenate([score[old], np.round(near[i, j], 9)]), np.concatenate([name[old], names[j]])
                order = np.lexsort((c if c.dtype != object else np.unique(c, return_inverse=True)[1], -s, o))
                o, s, c = o[order], s[order], c[order]
                rank = np.arange(len(o)) - np.searchsorted(o, o)
                bound[o[rank == k - 1]] = s[rank == k - 1]
                best = rank < k
                of, score, name = np.concatenate([of[~old], o[best]]), np.concatenate([score[~old], s[best]]), np.concatenate([name[~old], c[best]])
        name = [] if name is None else name.tolist()
        yield pa.RecordBatch.from_pydict({"query_id": pa.array([ids[i] for i in of.tolist()], types[0]), "chunk_id": pa.array(name, types[1]), "score": pa.array(score, pa.float64())})

    return vectors.mapInArrow(run, f"query_id {id_type.simpleString()}, chunk_id {name_type.simpleString()}, score double")


def interval_condition(f: NumericFilter) -> Column:
    """Facts whose point lies in the interval, or whose range meets it; units are a list of equals, never converted."""
    point, lo, hi = F.col("value"), F.col("value_min"), F.col("value_max")
    inside = F.lit(True)
    meets = F.lit(True)
    if f.low is not None:
        inside, meets = inside & (point >= f.low), meets & (hi >= f.low)
    if f.high is not None:
        inside, meets = inside & (point <= f.high), meets & (lo <= f.high)
    ranged = point.isNull() & (lo.isNotNull() | hi.isNotNull())
    out = F.contains(F.lower("parameter"), F.lit(f.parameter.lower())) & ((point.isNotNull() & inside) | (ranged & meets))
    return out & F.col("unit").isin(*f.units) if f.units else out


def find_facts(facts: DataFrame, filters: Filters) -> DataFrame:
    """Facts that meet any of the numeric conditions, the confidence and the metadata filters."""
    out = facts
    if filters.numeric:
        out = out.where(reduce(lambda a, b: a | b, [interval_condition(f) for f in filters.numeric]))
    if filters.min_confidence is not None:
        out = out.where(F.col("confidence") >= filters.min_confidence)
    keep = metadata_condition(filters)
    return out if keep is None else out.where(keep)


def overlap_join(facts: DataFrame, wanted: DataFrame, width: float) -> DataFrame:
    """Facts [lo, hi] and wanted intervals [want_lo, want_hi] of one parameter that overlap.

    Cells of ``width`` double from level to level.  An interval lies at the level whose
    cells are as long as it is, in two or three of them however wide it is; it meets
    longer ones in the cells of their level, so it has a few rows for each level that the
    other side holds.  An overlap is reported in the cell that holds its start: no pair
    comes twice and no join compares all with all.  Ends may be infinite; an interval
    with a null or NaN end overlaps nothing.
    """

    def ends(lo, hi):
        return F.greatest(F.col(lo), F.lit(-_FAR)), F.least(F.col(hi), F.lit(_FAR))

    def placed(df, lo, hi):
        a, b = ends(lo, hi)
        level = F.greatest(F.coalesce(F.ceil(F.log2(F.abs(b - a) / width)), F.lit(0)), F.lit(0)).cast("int")
        return df.where(~F.isnan(lo) & ~F.isnan(hi)).withColumn("level", level)

    def cell(x):
        return F.floor(x / (width * F.pow(F.lit(2.0), F.col("level"))))

    def cut(df, lo, hi):
        a, b = ends(lo, hi)
        return df.withColumn("cell", F.explode(F.sequence(cell(a), cell(b))))

    def lifted(df, other, strictly):
        # one row a level of doubles: some 2,000 at most
        levels = F.broadcast(other.select(F.col("level").alias("at")).distinct())
        return df.join(levels, F.col("at") > F.col("level") if strictly else F.col("at") >= F.col("level")).drop("level").withColumnRenamed("at", "level")

    def met(x, y):
        out = x.join(y, ["parameter", "level", "cell"]).where((F.col("lo") <= F.col("want_hi")) & (F.col("hi") >= F.col("want_lo")))
        return out.where(F.col("cell") == cell(F.greatest("lo", "want_lo", F.lit(-_FAR)))).drop("level", "cell")

    # written once, as each side is read for its own cells, its lifted ones and its levels
    left, right = materialize(placed(facts, "lo", "hi"), "intervals"), materialize(placed(wanted, "want_lo", "want_hi"), "intervals")
    longer = met(cut(left, "lo", "hi"), cut(lifted(right, left, False), "want_lo", "want_hi"))
    return longer.unionByName(met(cut(lifted(left, right, True), "lo", "hi"), cut(right, "want_lo", "want_hi")))


def is_numeric_row() -> Column:
    return (F.coalesce(F.length("parameter"), F.lit(0)) > 0) & F.coalesce("value", "value_min", "value_max").isNotNull()


def collect_sources(facts: DataFrame, publications: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the distinct publications of their facts, sorted."""
    rows = facts.join(publications.select(F.col("doc_id").alias("source_doc"), "title", "year"), "source_doc")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("source_doc").alias("doc_id"), "title", "year"))).alias("sources"))


def reciprocal_rank_fusion(ranked: list[DataFrame], id_col: str = "doc_id", k: int = RRF_K, most: int | None = None) -> DataFrame:
    """(id, score, first, rank): the sum of 1 / (k + rank) over lists (id, rank); an id repeated in a list adds up.

    ``first`` is the place of first appearance, list by list: the tie-break.  Only the
    ``most`` leading ids are ranked if a number is given, else all, range by range.
    """
    rows = [r.select(F.col(id_col).alias("id"), "rank", F.lit(i).alias("list")) for i, r in enumerate(ranked)]
    both = reduce(lambda a, b: a.unionByName(b), rows)
    out = both.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    order = [F.desc("score"), F.col("first"), F.col("id")]
    if most is None:
        return numbered(out, order, "rank")
    return out.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def documents_of_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, rank): document ids of fact rows in order of first sight, nested sources before the row's own."""
    listed = rows.select("row", F.posexplode_outer(F.transform("sources", lambda s: s["doc_id"])).alias("pos", "doc_id")).where("doc_id is not null")
    own = rows.where("doc_id is not null").select("row", F.lit(1 << 30).alias("pos"), "doc_id")
    first = listed.unionByName(own).groupBy("doc_id").agg(F.min(F.struct("row", "pos")).alias("at"))
    return numbered(first, ["at", "doc_id"], "rank").select("doc_id", "rank")


def best_chunk_per_document(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk of each fused document (id, rank); documents without one get an empty text and score 0."""
    best = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct("chunk_id", "text", "score"), F.struct(-F.col("score"), "chunk_id")).alias("c"))
    out = fused.join(best, "id", "left")
    return out.select(F.col("id").alias("doc_id"), "rank", F.coalesce("c.chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.score", F.lit(0.0)).alias("score"))


def seed_names(rows: DataFrame, most: int = 20) -> DataFrame:
    """Distinct lower-cased names in order of first sight."""
    return rows.where(F.length("name") > 0).groupBy(F.lower("name").alias("name")).agg(F.min("row").alias("row")).orderBy("row", "name").limit(most)


def match_entities(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Entities whose name or an alias holds one of the terms."""
    low = [t.lower() for t in terms]
    return nodes.where(T.any_contained(F.lower("name_norm"), low) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: T.any_contained(F.lower(a), low)))


def verdict(graph_rows: Column, top_score: Column) -> Column:
    return F.when((graph_rows > 0) | (top_score >= 0.3), "OK").otherwise("FAIL")


def retrieval_mode(vector_rows: int | None, graph_rows: int | None) -> str | None:
    """'vector', 'graph' or 'vector+graph' by the legs that found something; None if none did."""
    legs = [n for n, rows in (("vector", vector_rows), ("graph", graph_rows)) if rows]
    return "+".join(legs) or None
