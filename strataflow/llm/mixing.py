"""Mixing sources to target weights (operator 5): hash-threshold histograms.

A document's size is its number of words.  Sources share a budget by weight; a
source whose target exceeds ``max_repeats`` times its size stops there and the
excess is shared anew by weight until none is above.  A source takes all its
documents as many whole times as the target holds its size, and once more those
documents whose hash lies below a threshold.  The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the
running sum crosses the rest of the target is the only one opened, and it is
opened by the next bits of the hash until it is a single hash value.  Thresholds
are nested: a larger target takes a superset.

Sources may be many (domains): their table stays in the cluster, is numbered by
ranges, and the driver sees two sums a round of sharing.  A source has at most
``2 ** BITS`` buckets a level.  The table of sources is sent to every executor up to
``BROADCAST_SOURCES`` rows and joined by a shuffle beyond.

Defined results: the extra copies take the longest prefix, by hash, whose sum
does not exceed the rest, so a source falls short of its target by less than one
document (rows of one hash value, that is of one id, go together); where the rest is
0 there are none.  Null or empty text has size 0 and takes 0; a null source is a
source, the last; null ids hash as the empty string; an empty table gives an empty
result; a source of size 0 gets a target of 0.  Extra columns are not read and, in
:func:`apply_mix`, kept whatever their names.  A text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize
from strataflow.sources.tables import numbered

#: Hash bits that one level of the histogram opens, and bits of the hash.
BITS, HASH_BITS = 12, 60
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2.0


#: Sources up to this many are sent to every executor.
BROADCAST_SOURCES = 100_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target double) of (source, source_size); weights repeat over the sources by code point, null last."""
    order = sizes.select("source", "source_size", F.col("source").isNull().alias("last"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights)).cast("int"))
    rows = materialize(numbered(order, ["last", "source"], "number").select("source", "source_size", weight.alias("w")), "source-weights")
    most = F.lit(float(max_repeats)) * F.col("source_size")
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    # a source that is above stays above: what is capped leaves less than its share behind
    level, capped, held, weight_left = None, F.lit(False), 0.0, None
    while True:
        sums = rows.agg(F.sum(F.when(capped, most)).alias("held"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count(F.when(capped, 1)).alias("n")).first()
        held, weight_left = sums["held"] or 0.0, sums["w"] or 0.0
        if level == sums["n"] or not weight_left:
            break
        level = sums["n"]
        capped = capped | (F.lit(float(budget - held)) * F.col("w") / F.lit(float(weight_left)) > most)
    goal = F.lit(float(budget - held)) * F.col("w") / F.lit(float(weight_left)) if weight_left else most
    return rows.select("source", "source_size", F.when(capped, most).otherwise(goal).alias("target"))


def _hash(id_col):
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, hash): what the mix decides on."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        _hash(F.col(id_col)).alias("hash"),
    )


def quotas(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, whole long, below long) of every source; ``rows`` are those of :func:`sized`, written."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    goal = targets(sizes, weights, share, max_repeats).withColumn("whole", whole)
    goal = materialize(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    # all below ``low`` is taken once more and holds ``base`` words
    state = goal.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("base"))
    part, width, done = rows, HASH_BITS, None
    while width:
        high, width = width, width - min(BITS, width)
        bounds = _small(state.select(F.col("source").alias("of"), "rest", "low", "base"))
        inside = part["source"].eqNullSafe(bounds["of"]) & part["hash"].between(bounds["low"], bounds["low"] + ((1 << high) - 1))
        inside = part.join(bounds, inside).select("source", "size", "hash", "rest", "low", "base")
        if high == HASH_BITS - BITS:  # a few thousandths of the rows: later levels read no others
            inside = materialize(inside, "open-buckets")
            part = inside.select("source", "size", "hash")
        bucket = F.shiftrightunsigned(F.col("hash"), width)
        found = inside.groupBy("source", "rest", "low", "base", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        found = found.withColumn("upto", upto).groupBy("source", "rest", "low", "base").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("base")))).alias("at"))
        found = materialize(found, "boundaries")
        # a source whose bucket the rest does not cross takes it whole
        past = found.where("at is null").select("source", (F.col("low") + (1 << high)).alias("below"))
        done = past if done is None else done.unionByName(past)
        state = found.where("at is not null").select("source", "rest", F.shiftleft(F.col("at.bucket"), width).alias("low"), F.col("at.base").alias("base"))
    done = done.unionByName(state.select("source", F.col("low").alias("below"))).select(F.col("source").alias("of"), "below")
    out = goal.join(done, goal["source"].eqNullSafe(done["of"]), "left")
    return materialize(out.select("source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), "quotas")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(id_col, source, size long, source_size long, target double, repeats int, taken long) of every row."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    decided = _small(quotas(rows, weights, share, max_repeats).withColumnRenamed("source", "of"))
    out = rows.join(decided, rows["source"].eqNullSafe(decided["of"]))
    repeats = (F.col("whole") + (F.col("hash") < F.col("below")).cast("int")).cast("int").alias("repeats")
    out = out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", repeats)
    return out.withColumn("taken", F.col("size") * F.col("repeats"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; the columns stay.

    The decision is a function of source and id hash, so the rows are filtered and
    repeated where they lie, without a join on ids.
    """
    decided = _small(quotas(materialize(sized(docs, id_col, text_col, source_col), "sizes"), weights, share, max_repeats))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].cast("string").alias("of"), _hash(docs[id_col]).alias("hash"))
    out = rows.join(decided, rows["of"].eqNullSafe(decided["source"]))
    n = (F.col("whole") + (F.col("hash") < F.col("below")).cast("int")).cast("int")
    out = out.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return out.select(*[out["row"][c].alias(c) for c in docs.columns])
