"""Substring dedup (operator 3): hashing of lines or paragraphs, and of word windows.

A text is cut into units (lines, or paragraphs parted by empty lines).  A unit
is normalised (ASCII white space stripped at the ends and runs of it made one
space, A-Z lower-cased) and, if it has at least ``min_words`` words, digested.
Of all units of the corpus with one digest the earliest by rank (document id,
then offset) stays; the others are removed.  Original offsets, in code points
with the end exclusive, are kept for every removed unit.

Plan: unit rows are written once; minima by digest are partial sums, digests that
stand once go no further, and the rest meet their units in a join that adaptive
execution may split; no group of copies is gathered.

:func:`passages` is the same for units that need no line ends: every window of
``min_words`` words is a unit.  Passages of a corpus begin and end inside lines, so
lines alone miss them.  Windows are not rows: those with one anchor (a hash that
follows from their words alone) are one stretch, some 13 words to the next.
Stretches whose anchor stands once are unique and go no further.  Equal stretches
are one class by their digest, and all but the earliest of a class are repeated
whole; only the earliest stretches of classes that share an anchor (where texts
begin to differ) are opened into windows and digested one by one.  Anchors and
digests are 64-bit polynomial hashes of mixed word hashes, compared together.
Each removed window stands earlier in the corpus, though parts of that earlier copy
may themselves be removed for one earlier still.

Defined results: null and empty texts have no units and come back unchanged;
units repeated inside one document are removed after the first; rows that repeat
a document id are ranked as they are, each losing its own spans only, and where id
and offset tie one of the tied units (the same text) stays in each row; null ids
rank last; an empty table gives an empty result; extra columns are not read and,
where texts are returned, kept, but for those named as an output.  A worker needs
memory in proportion to its longest text (some 100 bytes a byte).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import discard, lean, materialize, mix64

#: A unit of this many words or more counts as a passage.
MIN_WORDS = 50
#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """(key, id, start, end, n_words, digest binary): the units of at least ``min_words`` words.

    A worker walks each text once, so the cost is linear in the longest text too.
    """
    sep = "\n\n" if paragraphs else "\n"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, starts, ends, words, digests = [], [], [], [], []
            for i, value in enumerate(batch.column(2)):
                raw = value.as_py() or b""
                at = 0
                for unit in raw.decode("utf-8", "replace").split(sep):
                    end = at + len(unit)
                    if end - at >= 2 * min_words - 1:
                        key = unit.encode().lower().split()
                        if len(key) >= min_words:
                            row.append(i)
                            starts.append(at)
                            ends.append(end)
                            words.append(len(key))
                            digests.append(hashlib.md5(b" ".join(key)).digest())
                    at = end + len(sep)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(words, pa.int64()), pa.array(digests, pa.binary())], names=["key", "id", "start", "end", "n_words", "digest"])

    return _keyed(docs, id_col, text_col).mapInArrow(lean(run), f"key long, id {id_type}, start long, end long, n_words long, digest binary")


def _key(docs: DataFrame, id_col: str, text_col: str):
    """Rows equal in id and text share a key and count as one document."""
    return F.xxhash64(docs[id_col], docs[text_col].cast("binary"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text binary) of the rows that have a text."""
    text = docs[text_col].cast("binary")
    return docs.where(F.octet_length(text) > 0).select(_key(docs, id_col, text_col).alias("key"), docs[id_col].alias("id"), text.alias("text"))


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int, paragraphs: bool) -> DataFrame:
    found = materialize(units(docs, id_col, text_col, min_words, paragraphs), "units")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "start")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = materialize(first.select("digest", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")), "first-units")
    return found.join(first, "digest").where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("start") == F.col("first_start"))))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """Every removed unit and the earliest one like it.

    (doc_id, start, end, n_words, digest hex, first_doc_id, first_start)
    """
    out = _repeats(docs, id_col, text_col, min_words, paragraphs)
    return out.select(F.col("id").alias(id_col), "start", "end", "n_words", F.lower(F.hex("digest")).alias("digest"), F.col("first_id").alias(f"first_{id_col}"), "first_start")


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, sep: str) -> DataFrame:
    """``docs`` with ``sf_kept`` (the text without the spans ``gone`` of its row's key) and ``sf_removed`` (the spans).

    A span goes with the separator after it or, at the end of the text, before it.
    """
    gone = gone.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(_key(docs, id_col, text_col).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = rows.join(gone, "key", "left")
    text = out["row"][text_col]
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda r: r["end"] + len(sep)))
    starts = F.concat(F.transform("spans", lambda r: r["start"]), F.array(F.char_length(text).cast("long") + len(sep)))
    kept = F.array_join(F.zip_with(ends, starts, lambda e, s: F.substring(F.concat(text, F.lit(sep)), (e + 1).cast("int"), (s - e).cast("int"))), "")
    kept = F.substring(kept, F.lit(1), F.char_length(kept) - len(sep))
    kept = F.when(F.col("spans").isNull() | text.isNull(), text).otherwise(kept)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = out.select("row", F.struct(kept.alias("sf_kept"), F.coalesce("spans", none).alias("sf_removed")).alias("new"))
    return out.select(*[out["row"][c].alias(c) for c in docs.columns if c not in ("sf_kept", "sf_removed")], out["new"]["sf_kept"].alias("sf_kept"), out["new"]["sf_removed"].alias("sf_removed"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """``docs`` with two more columns: ``sf_kept`` (the text without repeated units) and ``sf_removed`` (their spans)."""
    return _without(docs, _repeats(docs, id_col, text_col, min_words, paragraphs), id_col, text_col, "\n\n" if paragraphs else "\n")


# -- passages at word level


def _chunks(texts: list[bytes], most: int = 1 << 20):
    """(first row, texts): consecutive texts of ``most`` bytes or so at once."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words, parted by ASCII white space."""
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n`` of the multiplier and of its inverse."""
    base, back = (np.full(n + 1, b, np.uint64) for b in (_BASE, _BACK))
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


class _Sums:
    """Polynomial hashes (modulo 2**64) of slices of ``x``: equal slices have equal hashes."""

    def __init__(self, x: np.ndarray):
        base, self.back = _powers(1 << max(21, len(x).bit_length()))
        self.total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * base[: len(x)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.back[starts])


class _Chunk:
    """The words of some texts: hashes, rows, numbers in their text and offsets in code points."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        starts, ends = _words(raw)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.sums = _Sums(_Sums(raw.astype(np.uint64))(starts, ends))
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        before = chars[begins[self.doc]]
        self.start, self.end = chars[starts] - before, chars[ends] - before

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the window that each word begins: whether one text holds it whole, and its anchor.

        The anchor is the least hash of the runs of half a window's length in it, so
        it follows from the window's words alone.
        """
        if len(self.doc) < min_words:
            return np.zeros(0, bool), np.zeros(0, np.uint64)
        k = (min_words + 1) // 2
        at = np.arange(len(self.doc) - k + 1)
        least, wide, want = self.sums(at, at + k), 1, min_words - k + 1
        while wide < want:
            step = min(wide, want - wide)
            least, wide = np.minimum(least[:-step], least[step:]), wide + step
        return self.doc[: len(least)] == self.doc[min_words - 1 :], least


def _stretches(keyed: DataFrame, min_words: int) -> DataFrame:
    """(key, id, anchor, digest, wide, from, to, start, end) of every stretch.

    A stretch is a run of windows with one anchor; ``from`` and ``to`` number them by
    their first words, ``digest`` is that of all its words, ``start`` and ``end`` are
    its offsets; one that is ``wide`` holds its anchor more than once.
    """
    id_type = keyed.schema["id"].dataType.simpleString()
    choice = min_words - (min_words + 1) // 2 + 1

    def run(batches):
        for batch in batches:
            texts = [v.as_py() for v in batch.column(2)]
            for at, some in _chunks(texts):
                c = _Chunk(some)
                whole, least = c.windows(min_words)
                doc = c.doc[: len(least)]
                new = whole & ~np.concatenate([[False], whole[:-1] & (doc[1:] == doc[:-1]) & (least[1:] == least[:-1])])[: len(whole)]
                begin = np.flatnonzero(new)
                end = begin + np.bincount(np.cumsum(new)[whole] - 1, minlength=len(begin))
                last = end - 1 + min_words
                row, first = pa.array(doc[begin] + at), c.first[doc[begin]]
                numbers = [pa.array(x.astype(np.int32)) for x in (begin - first, end - first, c.start[begin], c.end[last - 1])]
                hashes = [pa.array(x.view(np.int64)) for x in (least[begin], c.sums(begin, last))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *hashes, pa.array(end - begin > choice), *numbers], names=["key", "id", "anchor", "digest", "wide", "from", "to", "start", "end"])

    return keyed.mapInArrow(lean(run), f"key long, id {id_type}, anchor long, digest long, wide boolean, from int, to int, start int, end int")


def _windows(opened: DataFrame, min_words: int) -> DataFrame:
    """(key, id, anchor, digest, at, start, end): each window of the stretches ``parts`` of ``opened``."""
    id_type = opened.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [v.as_py() for v in batch.column(2)]
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            parts = batch.column(3).flatten()
            row = np.repeat(np.arange(len(texts)), sizes)
            begin, end = (parts.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for at, some in _chunks(texts):
                c = _Chunk(some)
                _, least = c.windows(min_words)
                mine = (row >= at) & (row < at + len(some))
                r, b, e = row[mine] - at, begin[mine], end[mine]
                n = e - b
                word = np.repeat(c.first[r] + b - np.concatenate([[0], np.cumsum(n)[:-1]])[: len(n)], n) + np.arange(n.sum())
                of = c.doc[word]
                ids = pa.array(of + at)
                numbers = [pa.array(x.astype(np.int32)) for x in (word - c.first[of], c.start[word], c.end[word + min_words - 1])]
                hashes = [pa.array(x.view(np.int64)) for x in (least[word], c.sums(word, word + min_words))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), *hashes, *numbers], names=["key", "id", "anchor", "digest", "at", "start", "end"])

    return opened.select("key", "id", "text", "parts").mapInArrow(lean(run), f"key long, id {id_type}, anchor long, digest long, at int, start int, end int")


def _spans(parts: DataFrame, min_words: int) -> DataFrame:
    """Unions of the windows [from, to) in ``parts`` (key, id, parts) that overlap or touch, with what the first tells of its origin."""
    id_type = parts.schema["id"].dataType.simpleString()
    names = ["from", "to", "start", "end", "first_id", "first_start", "anchor", "first_key", "first_from"]

    def run(batches):
        for batch in batches:
            column, sizes = batch.column(2), batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            p = dict(zip(names, column.flatten().flatten(), strict=True))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            begin, end, start, stop = (p[k].to_numpy(zero_copy_only=False) for k in names[:4])
            order = np.lexsort((end, begin, row))
            row, begin, end, start, stop = (x[order] for x in (row, begin, end, start, stop))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (begin[1:] - end[:-1] + 1 > min_words)
            lead = np.flatnonzero(new)
            tail = np.concatenate([lead[1:], [len(row)]])[: len(lead)] - 1
            take = pa.array(order[lead])
            numbers = [pa.array(x.astype(np.int64)) for x in (start[lead], stop[tail], end[tail] - begin[lead] + min_words - 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row[lead])) for k in (0, 1)], *numbers, *[p[k].take(take) for k in names[4:]]], names=["key", "id", "start", "end", "n_words", *names[4:]])

    return parts.select("key", "id", "parts").mapInArrow(lean(run), f"key long, id {id_type}, start long, end long, n_words long, first_id {id_type}, first_start int, anchor long, first_key long, first_from int")


def _passages(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(key, id, start, end, n_words, first_id, first_start) of every repeated span."""
    keyed = _keyed(docs, id_col, text_col)
    found = materialize(_stretches(keyed, min_words), "stretches")
    often = found.groupBy("anchor").agg(F.sum(F.lit(1) + F.col("wide").cast("int")).alias("n")).where("n > 1")
    often = materialize(often.select("anchor"), "anchors")
    held = materialize(found.join(often, "anchor"), "repeated-stretches")
    discard(found, often)

    # equal stretches are one class; only where classes share an anchor may single windows repeat
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "start", "key", "from")
    classes = materialize(held.groupBy("anchor", "digest").agg(F.min(rank).alias("f"), F.max("wide").alias("open")), "classes")
    mixed = materialize(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(True).alias("mixed")), "mixed-anchors")
    first = classes.join(mixed, "anchor", "left").select("anchor", "digest", F.col("f.id").alias("first_id"), F.col("f.start").alias("first_start"), F.col("f.key").alias("first_key"), F.col("f.from").alias("first_from"), (F.col("open") | F.coalesce("mixed", F.lit(False))).alias("open"))
    first = materialize(first, "first-stretches")
    own = F.col("key") == F.col("first_key")
    over = own & (F.col("from") < F.col("first_from") + min_words)  # the first of its class itself, or one that overlaps it
    marks = materialize(held.join(first, ["anchor", "digest"]).withColumn("over", over).where("not over or open").drop("digest", "wide"), "marked-stretches")
    discard(held, classes, mixed, first)

    opened = marks.where("over").groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("parts"))
    windows = materialize(_windows(keyed.join(opened, "key"), min_words), "windows")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "start", "key", "at")
    first = windows.groupBy("anchor", "digest").agg(F.min(rank).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("anchor", "digest", F.col("f.id").alias("first_id"), F.col("f.start").alias("first_start"), F.col("f.key").alias("first_key"), F.col("f.at").alias("first_at"))
    known = materialize(windows.join(materialize(first, "first-windows"), ["anchor", "digest"]), "known-windows")
    discard(windows)

    again = known.where((F.col("key") != F.col("first_key")) | (F.col("at") >= F.col("first_at") + min_words))
    none = F.lit(None)
    again = again.select("key", "id", F.struct(F.col("at").alias("from"), (F.col("at") + 1).alias("to"), "start", "end", "first_id", "first_start", none.cast("long").alias("anchor"), none.cast("long").alias("first_key"), none.cast("int").alias("first_from")).alias("part"))
    whole = marks.where("not over").select("key", "id", F.struct("from", "to", "start", "end", "first_id", "first_start", F.when(F.col("open"), F.col("anchor")).alias("anchor"), "first_key", "first_from").alias("part"))
    parts = again.unionByName(whole).groupBy("key").agg(F.first("id").alias("id"), F.collect_set("part").alias("parts"))
    spans = materialize(_spans(parts, min_words), "spans")

    # the first window of an opened class may stand earlier, in a stretch of another class
    leads = known.groupBy("anchor", F.col("key").alias("first_key"), F.col("at").alias("first_from")).agg(F.first(F.struct("first_id", "first_start")).alias("lead"))
    asked = spans.where("anchor is not null").select("anchor", "first_key", "first_from").distinct()
    leads = materialize(leads.join(asked, ["anchor", "first_key", "first_from"], "left_semi"), "leads")
    discard(known, marks)
    out = spans.join(leads, ["anchor", "first_key", "first_from"], "left")
    origin = F.coalesce("lead", F.struct("first_id", "first_start"))
    return out.select("key", "id", "start", "end", "n_words", origin["first_id"].alias("first_id"), origin["first_start"].cast("long").alias("first_start"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every span of ``min_words`` words or more that stood earlier in the corpus, wherever lines end.

    (doc_id, start, end, n_words, first_doc_id, first_start)

    A window of ``min_words`` words is repeated if an equal one (in lower case, any
    white space) starts earlier by document id, then offset, and does not overlap it
    in the same document.  Spans are unions of repeated windows that overlap or
    touch; the last two columns tell where the span's first window stood first.
    """
    out = _passages(docs, id_col, text_col, min_words)
    return out.select(F.col("id").alias(id_col), "start", "end", "n_words", F.col("first_id").alias(f"first_{id_col}"), "first_start")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with two more columns: ``sf_kept`` (the text without repeated passages) and ``sf_removed`` (their spans)."""
    return _without(docs, _passages(docs, id_col, text_col, min_words), id_col, text_col, "")
