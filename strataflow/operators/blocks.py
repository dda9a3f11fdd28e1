"""Blocks of parsed documents: order, headings, sections, slides, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import text as T
from strataflow.functions.similarity import sequence_ratio


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, page, x0, y0, page_width, ...) with ``rank``: two columns if there is a gap wide enough.

    A page of four blocks or more is split at the widest gap between sorted left
    edges when it is at least 15 % of the page width; ties go to the leftmost gap.
    """
    page = Window.partitionBy("doc_id", "page")
    edge = F.row_number().over(page.orderBy("x0", "y0"))
    gaps = blocks.withColumn("sf_gap", F.lead("x0").over(page.orderBy("x0", "y0")) - F.col("x0")).withColumn("sf_edge", edge)
    best = F.max_by(F.struct("sf_gap", (F.col("x0") + F.col("sf_gap") / 2).alias("mid")), F.struct("sf_gap", -F.col("sf_edge")))
    split = gaps.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("sf_n"), best.alias("sf_best"))
    out = blocks.join(split, ["doc_id", "page"])
    columns = (F.col("sf_n") >= 4) & (F.col("sf_best.sf_gap") >= 0.15 * F.col("page_width"))
    side = F.when(columns & (F.col("x0") >= F.col("sf_best.mid")), 1).otherwise(0)
    order = page.orderBy(side, "y0", F.when(~columns, F.col("x0")), "x0")
    return out.withColumn("rank", F.row_number().over(order)).drop("sf_n", "sf_best")


def infer_headings(blocks: DataFrame, max_chars: int = 80, factor: float = 1.25, per_page: int = 3) -> DataFrame:
    """``blocks`` (doc_id, page, text, font_size, ...) with ``is_heading``.

    The upper median of a document's font sizes is the reference; a page with more
    than ``per_page`` candidates has none.
    """
    sizes = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list("font_size")).alias("sf_s"))
    median = sizes.select("doc_id", F.coalesce(F.get("sf_s", (F.size("sf_s") / 2).cast("int")), F.lit(12.0)).alias("sf_median"))
    body = T.strip(F.col("text"))
    maybe = (F.length(body) < max_chars) & (F.col("font_size") > factor * F.col("sf_median")) & ~body.rlike(r"[.,]\z")
    out = blocks.join(median, "doc_id").withColumn("sf_maybe", maybe)
    count = F.sum(F.col("sf_maybe").cast("int")).over(Window.partitionBy("doc_id", "page"))
    return out.withColumn("is_heading", F.col("sf_maybe") & (count <= per_page)).drop("sf_maybe", "sf_median")


def assign_sections(blocks: DataFrame, titles=T.REFERENCE_TITLES, alike: float = 0.85) -> DataFrame:
    """``blocks`` with ``section``: the last heading before, 'frontmatter' before any, 'references' under a bibliography.

    Only headings are compared with the titles, so the Python function sees few rows.
    """

    @F.udf("boolean")
    def near(title):
        return any(sequence_ratio(title.casefold(), t) >= alike for t in titles)

    heads = blocks.where(F.col("type") == "heading").select("doc_id", "ord", T.strip(F.col("text")).alias("sf_t"))
    name = F.when(near("sf_t"), "references").when(F.col("sf_t") == "", "untitled").otherwise(F.col("sf_t"))
    heads = heads.select(F.col("doc_id").alias("sf_doc"), F.col("ord").alias("sf_ord"), name.alias("sf_name"))
    out = blocks.drop("section").join(heads, (F.col("doc_id") == F.col("sf_doc")) & (F.col("ord") == F.col("sf_ord")), "left")
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("section", F.coalesce(F.last("sf_name", ignorenulls=True).over(so_far), F.lit("frontmatter"))).drop("sf_doc", "sf_ord", "sf_name")


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.3) -> DataFrame:
    """Text blocks that no table box of their page covers by more than ``share`` of their own area."""
    t = tables.select(*[F.col(c).alias(f"t_{c}") for c in ("doc_id", "page", "x0", "y0", "x1", "y1")])
    wide = F.least("x1", "t_x1") - F.greatest("x0", "t_x0")
    high = F.least("y1", "t_y1") - F.greatest("y0", "t_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cover = (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page") == F.col("t_page")) & (wide > 0) & (high > 0) & (area > 0) & (wide * high > share * area)
    return blocks.join(t, cover, "left_anti")


def slide_pages(blocks: DataFrame, below: float = 120) -> DataFrame:
    """(doc_id, page) whose text blocks are short on average."""
    texts = blocks.where(F.col("type").isin("paragraph", "heading") & F.col("page").isNotNull())
    return texts.groupBy("doc_id", "page").agg(F.avg(F.length("text")).alias("mean")).where(F.col("mean") < below).select("doc_id", "page")


def merge_slides(blocks: DataFrame) -> DataFrame:
    """One paragraph for every page: its non-blank blocks in order, titled by the first line."""
    texts = blocks.where(F.col("type").isin("paragraph", "heading") & (T.strip(F.col("text")) != ""))
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    out = texts.groupBy("doc_id", "page").agg(F.min("ord").alias("ord"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    first = F.get(F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != ""), F.lit(0))
    return out.select("doc_id", "page", "ord", "text", first.alias("section"))


def drop_noise(blocks: DataFrame, markers=T.PUBLICATION_MARKERS) -> DataFrame:
    """Blocks that are no noise; tables are exempt."""
    return blocks.where((F.col("type") == "table") | ~T.is_noise(F.col("text"), markers=markers))


def table_context(blocks: DataFrame) -> DataFrame:
    """Table blocks as chunks, each led by the paragraph since the table before."""
    doc = Window.partitionBy("doc_id").orderBy("ord")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumn("sf_run", F.coalesce(F.sum((F.col("type") == "table").cast("int")).over(before), F.lit(0)))
    run = Window.partitionBy("doc_id", "sf_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("sf_context", F.last(F.when(F.col("type") == "paragraph", F.col("text")), ignorenulls=True).over(run))
    return marked.where(F.col("type") == "table").select("doc_id", "ord", F.concat_ws("\n\n", "sf_context", "text").alias("text"))


def document_stats(chunks: DataFrame, pages: DataFrame | None = None, low: float = 150) -> DataFrame:
    """Counts, text size, means and the low-yield flag of every document."""
    text = F.when(F.col("kind") == "text", F.length("text"))
    out = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum((F.col("kind") == "table").cast("int")).alias("tables"), F.sum(F.length("text")).alias("text_chars"), F.round(F.avg(text), 6).alias("avg_chunk_chars"))
    if pages is None:
        return out
    out = out.join(pages.select("doc_id", "pages"), "doc_id", "left")
    return out.withColumn("low_yield", F.coalesce(F.col("text_chars") / F.col("pages") < low, F.lit(False)))


def quality_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, n): counts by status, low yield, density and size warnings, chunk ids that repeat.

    ``documents`` has (doc_id, status, pages, chunks, avg_chunk_chars, low_yield).
    """
    by_status = documents.groupBy(F.concat(F.lit("status:"), "status").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    flags = {"low_yield": F.col("low_yield"), "dense": F.col("chunks") / F.col("pages") > 6, "odd_size": ~F.col("avg_chunk_chars").between(600, 2500)}
    found = documents.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, c in flags.items()])
    warned = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("n")) for k in flags])).alias("x")).select("x.*")
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.lit("repeated_chunk_ids").alias("item"), F.count(F.lit(1)).alias("n"))
    return by_status.unionByName(warned).unionByName(twice)
