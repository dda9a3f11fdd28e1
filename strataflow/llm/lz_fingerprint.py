"""Lempel-Ziv phrase fingerprints (operator 7).

A text is parsed into dictionary phrases as LZ78 does: from each position the
longest phrase known so far plus one more character becomes the next phrase.  The
fingerprint is a bottom-less minimum-hash signature of the phrase set: phrase
hashes are dealt into ``SLOTS`` slots and each slot keeps its minimum (one
permutation hashing, empty slots stay empty).  The likeness of two fingerprints is
the share of equal minima among the slots that either fills, an estimate of
the Jaccard index of the phrase sets: texts that compress well together share
phrases.

Phrases are hashed by position in the text (prefix sums of a polynomial over its
code points), so a parse keeps only the ends of its phrases.

Defined results: null is empty; the empty text has an empty set, a fingerprint of
empty slots, and a likeness of 1 to another empty set and 0 to others; equal
texts have equal fingerprints; a last phrase that the text cuts short counts as
the phrase it is; rows that repeat an id follow one another in an unspecified but,
as the rows are alike, immaterial order unless their texts differ, when the smaller
SHA-256 comes first; null ids come last in descending order; a table of one row is
its own next; extra columns are not read; ids that are not numbers end in a cast error.
A text of any length is parsed whole, in memory in proportion to it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import lean, materialize, mix64, shuffle_partitions

SLOTS = 256
_NONE = np.uint64((1 << 64) - 1)
#: Odd multiplier of the rolling polynomial modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def parse(text: str, known: set[str] | None = None, start: int = 0, stop: int | None = None) -> list[int]:
    """Ends of the phrases from ``start`` on; ``known`` gains them.

    With ``stop`` the parse ends before the first phrase that reaches beyond it.
    """
    known = set() if known is None else known
    add, ends = known.add, []
    n = len(text)
    stop = n if stop is None else stop
    a = start
    while a < n:
        # known phrases are closed under prefixes, so the search may start anywhere
        z = a + 4 if a + 4 <= n else n
        if text[a:z] in known:
            z += 1
            while z <= n and text[a:z] in known:
                z += 1
        else:
            while z - 1 > a and text[a : z - 1] not in known:
                z -= 1
        if z > stop:
            break
        add(text[a:z])
        ends.append(z)
        a = z
    if stop == n and a < n:
        ends.append(n)
    return ends


def phrase_hashes(text: str, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every phrase; equal phrases have equal hashes wherever they stand."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(points)
    up = _powers(n, _BASE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points) * up[:n], out=sums[1:])
    starts = np.concatenate([[0], ends[:-1]])
    size = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts] ^ size * np.uint64(_BASE))


_power_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64."""
    have = _power_tables.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + n // 4, 1 << 16) + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _power_tables[base] = have
    return have


def signature(text: str, ends: list[int], slots: int = SLOTS) -> np.ndarray:
    """Minima of the phrase hashes by slot, uint64."""
    out = np.full(slots, _NONE)
    if ends:
        h = phrase_hashes(text, np.array(ends))
        np.minimum.at(out, (h % np.uint64(slots)).astype(np.int64), h // np.uint64(slots))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima among the slots that either fills; 1 if both are empty."""
    used = (a != _NONE) | (b != _NONE)
    return float((a == b)[used].mean()) if used.any() else 1.0


def fingerprint(text: str, slots: int = SLOTS) -> np.ndarray:
    return signature(text, parse(text), slots)


def both(text: str, tail: str, cut: int, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of ``text[:cut] + tail``; what they share is parsed once."""
    known: set[str] = set()
    shared = parse(text, known, 0, cut) if cut < len(text) else []
    at = shared[-1] if shared else 0
    edited = text[:cut] + tail
    other = set(known)
    first = shared + parse(text, known, at)
    second = shared + parse(edited, other, at)
    return signature(text, first, slots), signature(edited, second, slots)


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id_col, fingerprint string) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [_hex(fingerprint((v.as_py() or b"").decode("utf-8", "replace"), slots)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return out.mapInArrow(lean(run), f"id {id_type}, fingerprint string").toDF(id_col, "fingerprint")


def edited_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness.

    The edited text has its last third replaced by as many first code points of
    the next document in descending id order (the first after the last).

    The rows are dealt out by ranges of the id and sorted there, so the next text
    is the next row.  The last row of a range needs the first of the next one: the
    first row of every range is found on the ids alone and dealt to both ranges.
    So the texts are shuffled once, and the driver sees one id a range.
    """
    parts = shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = materialize(docs.select(key.alias("k")), "ids")
    bounds = np.array(sorted(ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else [], np.float64)

    def part_of(k: pa.Array) -> np.ndarray:
        # descending: the largest ids are in part 0
        return len(bounds) - np.searchsorted(bounds, k.to_numpy(zero_copy_only=False).astype(np.float64), "left")

    part = F.arrow_udf(lambda k: pa.array(part_of(k), pa.int32()), "int")
    tops = sorted((r["part"], r["top"]) for r in ids.groupBy(part("k").alias("part")).agg(F.max("k").alias("top")).collect())
    # an id that opens a range -> the range in front of it; the first range follows the last
    opens = {tops[i][1]: tops[i - 1][0] for i in range(len(tops))}

    def places(k: pa.Array) -> pa.Array:
        """The part of each id, and for one that opens it also ~(the part in front)."""
        own = part_of(k).tolist()
        return pa.array([[p, ~opens[i]] if i in opens else [p] for i, p in zip(k.to_pylist(), own, strict=True)], pa.list_(pa.int32()))

    rows = docs.select(key.alias("k"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("place", F.explode(F.arrow_udf(places, "array<int>")("k")))
    ahead = F.col("place") < 0
    rows = rows.select("k", "none", "text", ahead.alias("ahead"), F.when(ahead, F.bitwise_not("place")).otherwise(F.col("place")).alias("to"))
    rows = rows.repartitionById(parts, F.col("to")).sortWithinPartitions("ahead", F.col("k").desc(), F.sha2("text", 256))

    def run(batches):
        def result(held, after):
            text, other = held[2], after[2]
            cut = len(text) - len(text) // 3
            tail = other[: len(text) - cut]
            a, b = both(text, tail, cut, slots)
            return held[0], held[1], len(text), hashlib.sha256((text[:cut] + tail).encode()).hexdigest(), a, b

        def rows_of(batches):
            for batch in batches:
                for k, none, raw, ahead in zip(*(batch.column(i) for i in range(4)), strict=True):
                    yield k.as_py(), none.as_py(), raw.as_py().decode("utf-8", "replace"), ahead.as_py()

        out, waiting, held = [], None, None

        def close(done, following):
            k, none, n, sha, a, b = done
            return (None if none else k, n, sha, _hex(a), _hex(b), likeness(a, b), likeness(a, following))

        def batch_of(out):
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for row in rows_of(batches):
            if held is not None:
                if held[3]:
                    continue  # only the first of the rows ahead is the next one
                done = result(held, row)
                if waiting is not None:
                    out.append(close(waiting, done[4]))
                waiting = done
            held = row
            if len(out) >= 500:
                yield batch_of(out)
                out = []
        if waiting is not None:
            out.append(close(waiting, fingerprint(held[2], slots)))
        if out:
            yield batch_of(out)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("k", "none", "text", "ahead").mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
