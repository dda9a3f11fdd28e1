"""Line dedup (operator 10), native: DataFrame functions only.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased.  Keys of at least ``min_chars`` code points that stand in at least
``min_docs`` documents lose all their lines everywhere; the other lines stay in
place.

Plan: one pass hashes every row's distinct keys; hashes are counted by row first
(map-side sums), and only those that reach ``min_docs`` rows go on to the exact
count of distinct documents.  The frequent hashes meet the documents again as
one list for each document, so the text is shuffled once and no line is ever
grouped with its copies: a line that a third of all documents share costs one
partial sum a task and a join that adaptive execution may split.  Counting uses
two independent 64-bit hashes; the first of them finds a document's own lines.

Defined results: null or empty text is one empty line (its key has 0 code
points and stays while ``min_chars`` is at least 1); rows that repeat a document
id count as one document and each row is returned; rows with a null id count
together as one document; no result depends on an order, so ties do not arise;
an empty table gives an empty result; extra columns are never read and, in
:func:`drop_lines`, are kept.  A row's lines are arrays in memory, so a text may be as
long as a row may be; each of its lines is looked up in its list of frequent hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import ascii_lower, ascii_strip, materialize

MIN_DOCS = 10
MIN_CHARS = 1


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key):
    return F.xxhash64(key)


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The hashes of frequent keys that each document holds: (id, drop array<long>)."""
    keys = F.transform(_lines(ascii_lower(F.col(text_col))), ascii_strip)
    keyed = docs.select(F.col(id_col).alias("id"), F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars)).alias("keys"))
    hashed = keyed.select("id", F.explode("keys").alias("k")).select("id", _hash(F.col("k")).alias("a"), F.xxhash64(F.lit(1), "k").alias("b"))
    hashed = materialize(hashed, "line-hashes")
    by_rows = materialize(hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b"), "lines-by-rows")
    held = hashed.join(by_rows, ["a", "b"]).distinct()
    by_docs = materialize(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b"), "lines-by-documents")
    return hashed.join(by_docs, ["a", "b"]).groupBy("id").agg(F.collect_set("a").alias("drop"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` and three more.

    ``sf_kept`` is the text without its frequent lines, ``sf_n_lines`` and
    ``sf_n_dropped`` count lines before and those lost.  Columns of ``docs`` that have
    one of these names are replaced.
    """
    drop = frequent_lines(docs, id_col, text_col, min_docs, min_chars).select(F.col("id").alias("of"), "drop")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"))
    joined = rows.join(drop, rows["id"].eqNullSafe(drop["of"]), "left")
    text = F.coalesce(joined["row"][text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    stays = F.filter(lines, lambda x: ~F.array_contains("drop", _hash(ascii_strip(ascii_lower(x)))) | (F.char_length(ascii_strip(x)) < min_chars))
    out = joined.select("row", text.alias("whole"), F.when(F.col("drop").isNotNull(), stays).alias("stays"), F.size(lines).cast("long").alias("n"))
    new = {
        "sf_kept": F.coalesce(F.array_join(out["stays"], "\n"), out["whole"]),
        "sf_n_lines": out["n"],
        "sf_n_dropped": F.coalesce(out["n"] - F.size(out["stays"]), F.lit(0)).cast("long"),
    }
    return out.select(*[out["row"][c].alias(c) for c in docs.columns if c not in new], *[c.alias(name) for name, c in new.items()])
