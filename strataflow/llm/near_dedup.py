"""MinHash near-dedup (operator 6): SuperMinHash, banding, verification, union-find.

A document's set holds its distinct shingles (word sequences) as 64-bit hashes.
SuperMinHash gives every element a random permutation of the registers and
ranks that rise along it, so the registers of one element differ and the
estimate varies less than with independent minima.  The walk along the
permutations is done level by level for all elements of many documents at once
and ends for a document when each register has a value: a later level could not
lower any of them.

Documents with equal sets are one node from the start.  Bands of registers put
nodes into buckets; pairs are confirmed on full sets.  No bucket is expanded into
all its pairs: first each node meets one hub of its buckets (the member with the
most company), then the hubs of those that another component holds, and only
pairs of a bucket whose components still differ after that are tested one by one,
if an exact bound on what different components can share (see ``_open_pairs``),
their sizes, and a signature estimate ``SLACK`` standard deviations under the
threshold leave a link possible.  Pairs inside one component need no test as they
cannot change the result.

The bands are chosen so that a pair at the threshold is missed with a probability
of at most ``MISS``; the same bound governs the estimate filter.

Defined results: null or empty text, or text without words, gives an empty set,
linked with nothing; fewer words than a shingle give one shingle of all words;
rows of one id are one node; null ids are linked with nothing, their component
is null and they are kept; an empty table gives an empty result; extra columns
are not read; ids that are not numbers end in a cast error.  A text of any length is
one set, in memory in proportion to it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import discard, lean, materialize, mix64, small_batches
from strataflow.llm.components import contract

SHINGLE, PERCENT = 5, 80
#: Chance that a pair at the threshold shares no bucket.
MISS = 2e-6
#: Standard deviations that an estimate may lie under the threshold.
SLACK = 4.5
#: Distinct ids up to this many are sent to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: 64-bit words of the bitmap that bounds what two documents share.
MAP_WORDS = 32
#: Words a worker remembers the hash of; elements and documents that it walks at once.
WORD_CACHE, CHUNK, CHUNK_DOCS = 150_000, 60_000, 4096

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_EMPTY = np.uint64(_MASK)


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most 256 registers meet ``miss``."""
    for rows in range(12, 0, -1):
        p = (percent / 100) ** rows
        bands = math.ceil(math.log(miss) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= 256:
            return bands, rows
    return 256, 1


class Shingler:
    """Sets of shingle hashes of raw UTF-8 texts."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = raw.lower().split() if raw else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORD_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = mix64(out * np.uint64(_GOLDEN) + h[i : i + n])
        return np.unique(out)


def superminhash(x: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers, uint64 (n_docs, m), of the elements ``x`` of documents ``doc`` (indexes)."""
    h = np.full(n_docs * m, _EMPTY)
    perm: np.ndarray | None = None
    for level in range(m):
        z = mix64(x + np.uint64((level + 1) * _GOLDEN & _MASK))
        jump = (mix64(z ^ np.uint64(_GOLDEN)) >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32)
        to = level + jump.astype(np.int64)
        if level == 0 and perm is None:
            target = to
        else:
            rows = np.arange(len(x))
            target = perm[rows, to].astype(np.int64)
            perm[rows, to] = perm[:, level]
        np.minimum.at(h, doc * m + target, np.uint64(level << 48) | (z >> np.uint64(16)))
        going = (h.reshape(n_docs, m) == _EMPTY).any(axis=1)[doc]
        if not going.any():
            break
        if level == 0:
            x, doc, to = x[going], doc[going], to[going]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            perm[np.arange(len(x)), to] = 0
        elif going.mean() < 0.8:
            x, doc, perm = x[going], doc[going], perm[going]
    return h.reshape(n_docs, m)


def signatures(docs: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, n long, same binary, bands array<long>, sketch binary) of every row.

    ``same`` is a 128-bit digest of the set (null: empty set), ``bands`` holds the
    bucket keys and ``sketch`` a byte of every register.
    """
    bands, rows = banding(percent)
    m = bands * rows

    def flush(ids, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        keys, sketch = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), m), np.uint8)
        at = 0
        while at < len(sets):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + CHUNK_DOCS]), CHUNK, "right")))
            x = np.concatenate(sets[at:to])
            if len(x):
                h = superminhash(x, np.repeat(np.arange(to - at), sizes[at:to]), to - at, m)
                mixed = mix64(h)
                sketch[at:to] = mixed & np.uint64(255)
                key = np.tile(np.arange(bands, dtype=np.uint64), (to - at, 1))
                for r in range(rows):
                    key = mix64(key * np.uint64(_GOLDEN) + mixed[:, r::rows])
                keys[at:to] = key
            at = to
        some = sizes > 0
        same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].astype(np.int64).ravel()))
        sketches = pa.array([s.tobytes() if k else None for s, k in zip(sketch, some, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), same, lists, sketches], names=["id", "n", "same", "bands", "sketch"])

    def run(batches):
        shingles = Shingler(shingle)
        for batch in batches:
            start, held, sets = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                sets.append(shingles(value.as_py()))
                held += len(sets[-1])
                if held > 4 * CHUNK or len(sets) >= CHUNK_DOCS or i + 1 == batch.num_rows:
                    yield flush(batch.column(0).slice(start, len(sets)), sets)
                    start, held, sets = i + 1, 0, []

    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return raw.mapInArrow(lean(run), "id long, n long, same binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, items binary): the full sets of the documents in ``ids``."""

    def run(batches):
        shingles = Shingler(shingle)
        for batch in batches:
            raw = [shingles(v.as_py()).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "items"])

    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return raw.join(ids, "id", "left_semi").mapInArrow(lean(run), "id long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            hit = []
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                both = len(p) + len(q)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    shared = int((q[at] == p).sum())
                    if 100 * shared >= percent * (both - shared):
                        hit.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(hit, pa.int64())) for k in (0, 1)], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("p")), "a").select("a", "b", "p")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("items").alias("q")), "b").select("a", "b", "p", "q")
    return joined.mapInArrow(lean(run), "a long, b long")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, p, q: sketches) whose estimated likeness does not rule a link out."""
    bands, rows = banding(percent)
    t = percent / 100
    least = t - SLACK * math.sqrt(t * (1 - t) / (bands * rows))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                hit = pa.array(np.flatnonzero((p == q).mean(axis=1) >= least))
                yield pa.RecordBatch.from_arrays([batch.column(k).take(hit) for k in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(lean(run), "a long, b long")


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket, of different components, that may still link.

    ``members`` has (key, id, n, id_root).  Documents of different components can
    share only shingles that stand in both, so a shingle that one component alone
    holds counts against every such pair: with c of its n shingles held by several
    components, a document links with none unless c / n reaches the threshold.  A
    bitmap of those c shingles bounds a pair: each bit that one of two documents
    has alone stands for a shingle at least that the other lacks, so they share
    min(c - alone, c' - alone') at most.  The bounds are exact and spare the members
    of a group of loose copies the tests of one against all.
    """

    def mixed(rows):
        keys = rows.groupBy("key").agg(F.min("id_root").alias("lo"), F.max("id_root").alias("hi")).where("lo != hi").select("key")
        return materialize(rows.join(materialize(keys, "mixed-keys"), "key"), "mixed")

    def items(batches):
        for batch in batches:
            for root, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), root))], names=["item", "root"])

    def spread(batches):
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), at))], names=["item", "id"])

    rows = mixed(members)
    held = sets.join(rows.select("id", "id_root").distinct(), "id")
    common = held.select("id_root", "items").mapInArrow(lean(items), "item long, root long").groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    common = materialize(common.where("lo != hi").select("item"), "common-items")
    shared = held.select("id", "items").mapInArrow(lean(spread), "item long, id long").join(common, "item")
    bit = F.pmod("item", F.lit(64 * MAP_WORDS))
    bits = [F.bit_or(F.when(F.floor(bit / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(MAP_WORDS)]
    shared = shared.groupBy("id").agg(F.count(F.lit(1)).alias("c"), *bits)
    shared = materialize(shared, "shared-items")
    discard(common)
    rows = mixed(rows.join(shared, "id").where(100 * F.col("c") >= percent * F.col("n")))

    # the members of a bucket's largest component meet only those outside it
    groups = rows.groupBy("key", "id_root").agg(F.count(F.lit(1)).alias("size"))
    main = materialize(groups.groupBy("key").agg(F.max_by("id_root", F.struct("size", "id_root")).alias("main")), "main-components")
    mine = materialize(rows.join(main, "key").where(F.col("id_root") != F.col("main")), "outsiders")
    words = range(MAP_WORDS)
    match = rows.select("key", F.col("id_root").alias("root_b"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"), *[F.col(f"m{k}").alias(f"b{k}") for k in words])

    def alone(x, y):
        return reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in words])

    most = F.least(F.col("c") - alone("m", "b"), F.col("c_b") - alone("b", "m"))
    sizes = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    apart = (F.col("root_b") == F.col("main")) | (F.col("id_root") < F.col("root_b"))
    pairs = mine.join(match, "key").where(apart & sizes & (100 * most >= percent * (F.col("n") + F.col("n_b") - most)))
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles long, component_id long, kept boolean) of every row."""
    with small_batches(docs.sparkSession):  # all that runs in Python is written before this returns
        return _near_duplicates(docs, shingle, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    signed = materialize(signatures(docs, shingle, percent, id_col, text_col), "signatures")
    classes = materialize(signed.where("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("node")), "classes")
    nodes = signed.join(classes.select(F.col("node").alias("id"), F.col("same").alias("of")), "id").where(F.col("same") == F.col("of"))
    keyed = nodes.select("id", "n", F.explode("bands").alias("key"))
    counts = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi")
    buckets = materialize(counts.select("key", "size"), "buckets")
    found = materialize(keyed.join(buckets, "key"), "bucketed")
    # the hub of a bucket is the member with the most company, as that is likest to most
    company = materialize(found.groupBy("id").agg(F.sum("size").alias("company")), "company")
    known = materialize(found.select("key", "id", "n").join(company, "id"), "company-by-bucket")
    discard(buckets, found)
    hubs = known.groupBy("key").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"))).alias("hub"))
    hubs = materialize(hubs.select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.company").alias("most")), "hubs")
    members = materialize(known.join(hubs, "key"), "members")
    discard(known, hubs)
    sets = materialize(_sets(docs, materialize(company.select("id"), "candidates"), shingle, id_col, text_col), "sets")

    def labelled(df, name, labels):
        """``df`` with the component of its column ``name`` as ``name_root``."""
        roots = labels.select(F.col("node").alias(name), F.col("root").alias("sf_root"))
        return df.join(roots, name, "left").withColumn(f"{name}_root", F.coalesce("sf_root", name)).drop("sf_root")

    first = members.where(F.col("id") != F.col("hub")).groupBy("id").agg(F.max(F.struct("most", (-F.col("hub")).alias("minus"))).alias("hub"))
    labels = contract(None, materialize(_confirmed(first.select(F.col("id").alias("a"), (-F.col("hub.minus")).alias("b")), sets, percent), "links"))
    rest = members.where(F.col("id") != F.col("hub")).select("id", "hub").distinct()
    rest = labelled(labelled(rest, "id", labels), "hub", labels).where("id_root != hub_root").select("id", "hub")
    labels = contract(labels, materialize(_confirmed(rest.toDF("a", "b"), sets, percent), "links"))

    pairs = _open_pairs(labelled(members.select("key", "id", "n"), "id", labels), sets, percent)
    sketches = materialize(nodes.select("id", "sketch").join(company.select("id"), "id", "left_semi"), "sketches")
    pairs = pairs.join(sketches.toDF("a", "p"), "a").join(sketches.toDF("b", "q"), "b").select("a", "b", "p", "q")
    labels = contract(labels, materialize(_confirmed(materialize(_alike(pairs, percent), "last-pairs"), sets, percent), "links"))

    roots = materialize(labelled(classes, "node", labels).select("same", "node_root"), "class-roots")
    out = signed.select("id", "n", "same").join(roots, "same", "left")
    component = F.coalesce("node_root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group; the columns stay."""
    found = near_duplicates(docs, shingle, percent, id_col, text_col)
    gone = materialize(found.where(~F.col("kept")).select(F.col(id_col).alias("sf_gone")).distinct(), "dropped")
    return docs.join(gone, docs[id_col].cast("long") == gone["sf_gone"], "left_anti")
