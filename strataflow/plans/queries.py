"""Named queries over the test tables and their SQL; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.functions import text as T
from strataflow.operators import answer as A
from strataflow.operators import blocks as B
from strataflow.operators import chunking as C
from strataflow.operators import entity_resolution as R
from strataflow.operators import extraction as X
from strataflow.operators import graph_analytics as G
from strataflow.operators import graph_build as K
from strataflow.operators import retrieval as Q
from strataflow.plans import standin as S
from strataflow.sources import files
from strataflow.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINE = _STRIP.format("line")

# ---- text quality and documents


@query("noise_lines", rf"""
with {S.LINES_SQL}, t as (select doc_id, ord, {_LINE} as s from lines)
select doc_id, ord, case when s = '' then true when length(s) < 15 then true when len(regexp_extract_all(s, '[а-яА-Яa-zA-Z0-9]'))::double / length(s) < 0.55 then true
  else len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: length(w) >= 3))::double / len(regexp_split_to_array(s, '\s+')) < 0.4 end as noise from t""")
def noise_lines(spark, d):
    return S.lines(spark, d).select("doc_id", "ord", T.is_noise(F.col("line")).alias("noise"))


@query("repeated_lines_removed", rf"""
with {S.LINES_SQL}, t as (select *, {_LINE} as k from lines), r as (select *, row_number() over (partition by doc_id, k order by ord) as n from t)
select doc_id, sha256(string_agg(line, chr(10) order by ord)) as text_sha256 from r where length(k) <= 20 or n = 1 group by doc_id""")
def repeated_lines_removed(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(T.drop_repeated_lines(F.col("text")).cast("binary"), 256).alias("text_sha256"))


@query("reference_mark", r"""
with t as (select doc_id, upper(substr(text, 1, 200)) as h, substr(text, 1, 800) as b from documents)
select coalesce(case when contains(h, 'LICENSED UNDER') then 'LICENSED UNDER' when contains(h, 'GNU GENERAL PUBLIC') then 'GNU GENERAL PUBLIC' when len(regexp_extract_all(b, '\b\d{1,2}\.\s+[А-ЯA-Z][а-яa-z]+\s+[А-ЯA-Z]\.')) >= 4 then 'numbered-refs-heuristic' end, 'none') as reason, count(*) as n from t group by 1""")
def reference_mark(spark, d):
    reason = T.reference_reason(F.col("text"), ("LICENSED UNDER", "GNU GENERAL PUBLIC"))
    return read(spark, d, "documents").groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("section_fill", rf"""
with {S.LINES_SQL}, h as (select doc_id, ord, {_LINE} as s, length({_LINE}) between 1 and 40 as head from lines)
select doc_id, ord, coalesce(last_value(case when head then s end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row), 'frontmatter') as section from h""")
def section_fill(spark, d):
    s = T.strip(F.col("line"))
    rows = S.lines(spark, d).select("doc_id", "ord", F.col("line").alias("text"), F.when(F.length(s).between(1, 40), "heading").otherwise("paragraph").alias("type"))
    return B.assign_sections(rows, titles=()).select("doc_id", "ord", "section")


@query("doc_stats", rf"""
with {S.LINES_SQL} select doc_id, count(*) as chunks, sum(case when line like '%|%' then 1 else 0 end)::bigint as tables, sum(length(line))::bigint as text_chars, round(avg(case when line not like '%|%' then length(line) end), 6) as avg_chunk_chars from lines group by doc_id""")
def doc_stats(spark, d):
    rows = S.lines(spark, d).select("doc_id", F.col("line").alias("text"), F.when(F.contains("line", F.lit("|")), "table").otherwise("text").alias("kind"))
    return B.document_stats(rows)


@query("low_yield_report", f"""
with {S.CHUNKS_SQL} select venue, count(*) as documents, sum(case when n_chars < 600 then 1 else 0 end)::bigint as low_yield, round(avg(n_chars), 6) as mean_chars from chunks group by venue""")
def low_yield_report(spark, d):
    rows = S.chunks(spark, d).select("doc_id", "text", F.lit("text").alias("kind"), "venue", F.lit(4).alias("pages"))
    stats = B.document_stats(rows, rows.select("doc_id", "pages")).join(rows.select("doc_id", "venue"), "doc_id")
    return stats.groupBy("venue").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("low_yield").cast("long")).alias("low_yield"), F.round(F.avg("text_chars"), 6).alias("mean_chars"))


@query("doc_majority_lang", """
with n as (select source, lang, count(*) as n, min(doc_id) as first from documents group by source, lang)
select source as doc_id, arg_min(lang, (-n, first)) as lang from n group by source""")
def doc_majority_lang(spark, d):
    rows = read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.format_string("%012d", "doc_id").alias("chunk_id"), "lang")
    meta = rows.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("file_metadata_title"), F.col("doc_id").alias("file_name"), *[F.lit(None).cast("string").alias(c) for c in ("year", "venue", "doc_type", "author_hint", "source_key")])
    return K.publications(rows, meta).select("doc_id", "lang")


@query("chunk_ids", r"select doc_id, 'doc_' || doc_id || '_' || lpad((unnest(range(len(string_split(text, chr(10))))))::varchar, 5, '0') as chunk_id from documents")
def chunk_ids(spark, d):
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return S.lines(spark, d).select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.lpad(number.cast("string"), 5, "0")).alias("chunk_id"))


@query("content_id_dupes", "select 'doc_' || substr(sha256(text), 1, 12) as content_id, count(*) as copies, min(doc_id) as first_doc, max(doc_id) as last_doc from documents group by 1 having count(*) > 1")
def content_id_dupes(spark, d):
    out = read(spark, d, "documents").groupBy(T.content_id(F.col("text").cast("binary")).alias("content_id")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return out.where("copies > 1")


@query("slide_pages", rf"with {S.LINES_SQL} select doc_id, ord // 4 as page from lines where line <> '' group by doc_id, ord // 4 having avg(length(line)) < 120")
def slide_pages(spark, d):
    rows = S.lines(spark, d).where("line <> ''").select("doc_id", F.floor(F.col("ord") / 4).alias("page"), F.lit("paragraph").alias("type"), F.col("line").alias("text"))
    return B.slide_pages(rows)


@query("slide_merge", rf"with {S.LINES_SQL} select doc_id, ord // 4 as page, string_agg(line, chr(10) order by ord) as text from lines where {_LINE} <> '' group by doc_id, ord // 4")
def slide_merge(spark, d):
    rows = S.lines(spark, d).select("doc_id", F.floor(F.col("ord") / 4).alias("page"), "ord", F.lit("paragraph").alias("type"), F.col("line").alias("text"))
    return B.merge_slides(rows).select("doc_id", "page", "text")


@query("table_context", rf"""
with {S.LINES_SQL}, t as (select *, line like '%|%' as tab, coalesce(sum(case when line like '%|%' then 1 else 0 end) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as run from lines),
c as (select *, last_value(case when not tab then line end ignore nulls) over (partition by doc_id, run order by ord rows between unbounded preceding and 1 preceding) as ctx from t)
select doc_id, ord, concat_ws(chr(10) || chr(10), ctx, line) as text from c where tab""")
def table_context(spark, d):
    rows = S.lines(spark, d).select("doc_id", "ord", F.when(F.contains("line", F.lit("|")), "table").otherwise("paragraph").alias("type"), F.col("line").alias("text"))
    return B.table_context(rows)


@query("markdown_tables", r"""
with t as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: contains(l, '|')) as ls from documents),
r as (select doc_id, list_transform(ls, lambda l: list_transform(string_split(l, '|'), lambda c: trim(c))) as rows from t where len(ls) > 0),
w as (select *, list_max(list_transform(rows, lambda r: len(r))) as n from r),
p as (select doc_id, n, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(n - len(r)), lambda i: '')), ' | ') || ' |') as body from w)
select doc_id, array_to_string(list_concat(body[1:1], ['| ' || array_to_string(list_transform(range(n), lambda i: '---'), ' | ') || ' |'], body[2:]), chr(10)) as markdown from p""")
def markdown_tables(spark, d):
    rows = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.contains(x, F.lit("|"))), lambda x: F.split(x, r"\|", -1))
    return read(spark, d, "documents").select("doc_id", rows.alias("rows")).where(F.size("rows") > 0).select("doc_id", T.rows_to_markdown(F.col("rows")).alias("markdown"))


@query("chunk_documents")
def chunk_documents(spark, d):
    rows = S.lines(spark, d).select(F.format_string("doc_%012d", "doc_id").alias("doc_id"), "ord", F.when(F.contains("line", F.lit("|")), "table").otherwise("paragraph").alias("type"), F.col("line").alias("text"), F.floor(F.col("ord") / 12).cast("int").alias("page"), F.lit("body").alias("section"))
    return C.chunk_documents(rows)


@query("chunk_presentations")
def chunk_presentations(spark, d):
    rows = read(spark, d, "conversations").select(F.format_string("doc_%012d", "conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.lit("paragraph").alias("type"), "text", F.floor(F.col("turn") / 2).cast("int").alias("page"), F.col("role").alias("section"))
    return C.chunk_documents(rows, presentation=True)


# ---- extraction


@query("json_coercion", "select event_id, try_cast(replace(replace(trim(k), ' ', ''), ',', '.') as double) as number from (select event_id, json_extract_string(props, '$.k') as k from events)")
def json_coercion(spark, d):
    return read(spark, d, "events").select("event_id", T.lenient_double(F.get_json_object("props", "$.k")).alias("number"))


@query("postvalidate_refs", f"""
with {S.MENTIONS_SQL}, e as (select chunk_id, label, name_norm from mentions where length(trim(name_norm)) >= 2)
select label, count(*) as kept, count(distinct chunk_id) as chunks from e group by label""")
def postvalidate_refs(spark, d):
    m = S.mentions(spark, d)
    entity = F.struct(F.lit("e1").alias("tmp_id"), F.col("label").alias("type"), "name", "name_norm", "aliases", "geography", "confidence")
    relation = F.struct(F.lit("e1").alias("source"), F.lit("DOC").alias("target"), F.lit("described_in").alias("type"), F.lit(None).cast("struct<parameter:string,operator:string,value:double,value_min:double,value_max:double,unit:string>").alias("numeric"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(0.5).alias("confidence"))
    records = m.select("chunk_id", "doc_id", "source_doc", "source_chunk", F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations")).alias("result"))
    return X.mentions(X.postvalidate(records)).groupBy("label").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("chunk_id").alias("chunks"))


@query("pending_anti_join", "select doc_id as chunk_id from documents where doc_id not in (select doc_id from labels)")
def pending_anti_join(spark, d):
    return X.pending(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")), read(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")))


@query("upsert_latest", """
select event_id as chunk_id, 'new' as version, value from events where event_type = 'purchase'
union all select event_id, 'old', value from events where event_type <> 'purchase'""")
def upsert_latest(spark, d):
    e = read(spark, d, "events")
    old = e.select(F.col("event_id").alias("chunk_id"), F.lit("old").alias("version"), "value")
    new = e.where("event_type = 'purchase'").select(F.col("event_id").alias("chunk_id"), F.lit("new").alias("version"), "value")
    return X.upsert(old, new)


@query("manifest_skip", "select url as source_key, md5(html) as etag, 'pending' as status from pages where page_id not in (select doc_id from labels where quality = 1)")
def manifest_skip(spark, d):
    from strataflow.sources.files import not_done

    listing = read(spark, d, "pages").select("page_id", F.col("url").alias("source_key"), F.md5(F.col("html").cast("binary")).alias("etag"))
    done = listing.join(read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").withColumn("status", F.lit("ok"))
    return not_done(listing, done).select("source_key", "etag", F.lit("pending").alias("status"))


@query("core_documents", """
select doc_id from documents where contains(lower(substr(text, 1, 500)), 'with') or contains(lower(substr(text, 1, 500)), 'der ') or contains(lower(source), 'src7')""")
def core_documents(spark, d):
    docs = read(spark, d, "documents")
    meta = docs.select("doc_id", F.lit(None).cast("string").alias("file_name"), F.col("source").alias("venue"))
    rows = docs.select("doc_id", F.col("doc_id").alias("chunk_id"), "text", F.lit("text").alias("kind"), F.lit("body").alias("section"))
    return X.core_documents(meta, rows, ["with", "der ", "src7"])


@query("run_statistics", """
select user_id as doc_id, count(*) as processed, sum(case when event_type = 'error' then 0 else 1 end)::bigint as entities, sum(case when event_type = 'error' then 1 else 0 end)::bigint as empty, round(sum(case when event_type = 'view' then event_id % 1000 * 1.5e-7 else null end), 9) as cost_usd from events group by user_id""")
def run_statistics(spark, d):
    entity = F.struct(F.lit("e").alias("tmp_id"))
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.struct(F.when(F.col("event_type") == "error", F.array().cast("array<struct<tmp_id:string>>")).otherwise(F.array(entity)).alias("entities"), F.array().cast("array<struct<source:string>>").alias("relations")).alias("result"), F.when(F.col("event_type") == "view", "a-mini").otherwise("b").alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))
    return X.run_statistics(e).select("doc_id", "processed", "entities", "empty", F.round("cost_usd", 9).alias("cost_usd"))


# ---- graph build


_STOP = ("lion", "ink", "building")
_ADMIT = "(lower(trim(name_norm)) not in ('building', 'machinery') and (confidence >= 0.5 or label in ('Expert', 'Organization')))"


@query("entity_admission", f"with {S.MENTIONS_SQL} select label, count(*) as mentions, count(distinct name_norm) as names from mentions where {_ADMIT} group by label")
def entity_admission(spark, d):
    out = K.admitted(S.mentions(spark, d), ("building", "machinery"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("name_norm").alias("names"))


@query("admission_counts", f"""
with {S.MENTIONS_SQL}, f as (select label, name_norm, arg_min(confidence, (doc_id, chunk_id, ord)) as confidence from mentions group by label, name_norm)
select sum(case when name_norm in ('building', 'machinery') then 1 else 0 end)::bigint as stopped, sum(case when name_norm not in ('building', 'machinery') and confidence < 0.5 and label not in ('Expert', 'Organization') then 1 else 0 end)::bigint as unsure from f""")
def admission_counts(spark, d):
    return K.admission_counts(S.mentions(spark, d), ("building", "machinery"))


@query("entity_aggregate", f"""
with {S.MENTIONS_SQL}, g as (select label, name_norm, arg_min(name, (doc_id, chunk_id, ord)) as name, arg_min(geography, (doc_id, chunk_id, ord)) as geography, arg_min(chunk_id, (doc_id, chunk_id, ord)) as source_chunk, max(confidence) as confidence, count(*) as mentions from mentions group by label, name_norm),
a as (select label, name_norm, array_to_string(list_sort(list(distinct x)), '|') as aliases from (select label, name_norm, unnest(aliases) as x from mentions) group by label, name_norm)
select sha256(g.label || chr(31) || g.name_norm) as id, g.label, g.name_norm, g.name, geography, source_chunk, aliases, confidence, mentions from g join a on g.label = a.label and g.name_norm = a.name_norm""")
def entity_aggregate(spark, d):
    out = K.aggregate_entities(S.mentions(spark, d))
    return out.select("id", "label", "name_norm", "name", "geography", "source_chunk", F.array_join("aliases", "|").alias("aliases"), "confidence", "mentions")


@query("edge_first_wins", f"with {S.FACTS_SQL} select src, type, dst, arg_min(value, ord) as value, arg_min(source_doc, ord) as source_doc, arg_min(confidence, ord) as confidence, count(*) as facts from facts group by src, type, dst")
def edge_first_wins(spark, d):
    return K.first_edges(S.facts(spark, d), ["ord"]).select("src", "type", "dst", "value", "source_doc", "confidence", "facts")


@query("provenance_first_chunk", f"with {S.MENTIONS_SQL} select label, name_norm, doc_id, arg_min(chunk_id, (chunk_id, ord)) as source_chunk from mentions group by label, name_norm, doc_id")
def provenance_first_chunk(spark, d):
    return K.described_in(S.mentions(spark, d))


@query("orphan_documents", "select count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)")
def orphan_documents(spark, d):
    pubs = read(spark, d, "orders").select(F.concat(F.lit("d:"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    return K.orphans(S.facts(spark, d), pubs).agg(F.count(F.lit(1)).alias("n"))


@query("unique_violations", "select text, count(*) as n from documents group by text having count(*) > 1")
def unique_violations(spark, d):
    return K.unique_violations(read(spark, d, "documents"), "text")


@query("row_count_reconciliation", "select source, sum(n_chars)::bigint as expected, sum(length(text))::bigint as found, sum(n_chars) = sum(length(text)) as same from documents group by source")
def row_count_reconciliation(spark, d):
    out = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("expected"), F.sum(F.length("text").cast("long")).alias("found"))
    return out.withColumn("same", F.col("expected") == F.col("found"))


# ---- graph analytics

_ENT = "('Material', 'Process', 'Equipment', 'Property', 'Experiment', 'Expert', 'Organization', 'Facility')"


@query("graph_stats", f"with {S.NODES_SQL} select sum(case when label in {_ENT} then 1 else 0 end)::bigint as entities, sum(case when label = 'Chunk' then 1 else 0 end)::bigint as chunks, sum(case when label = 'Publication' then 1 else 0 end)::bigint as publications from nodes")
def graph_stats(spark, d):
    return G.statistics(S.nodes(spark, d))


@query("label_counts", f"with {S.NODES_SQL} select label, count(*) as n from nodes group by label")
def label_counts(spark, d):
    return G.label_counts(S.nodes(spark, d))


@query("edge_type_counts", f"with {S.EDGES_SQL} select type, count(*) as n from edges group by type")
def edge_type_counts(spark, d):
    return G.type_counts(S.edges(spark, d))


@query("degree_top_per_label", f"""
with {S.NODES_SQL}, {S.EDGES_SQL}, {S.DEGREES_SQL}, r as (select label, n.id, coalesce(degree, 0) as degree, row_number() over (partition by label order by coalesce(degree, 0) desc, n.id) as rank from nodes n left join degrees d on n.id = d.id)
select label, id, degree, rank::int as rank from r where rank <= 30""")
def degree_top_per_label(spark, d):
    return G.top_by_label(S.nodes(spark, d), S.edges(spark, d)).select("label", "id", "degree", "rank")


_TOP = f"""{S.NODES_SQL}, {S.EDGES_SQL}, {S.DEGREES_SQL}, top as (select n.id from nodes n left join degrees d on n.id = d.id where label in {_ENT} order by coalesce(degree, 0) desc, n.id limit 150),
hops as (select id, min(hop) as hop from (select id, 0 as hop from top union all select dst, 1 from edges where src in (select id from top) union all select src, 1 from edges where dst in (select id from top)) group by id),
kept as (select n.id, n.label, hop from nodes n join hops h on n.id = h.id order by hop, n.id limit 150)"""


@query("preview_subgraph", f"with {_TOP} select id, label, hop from kept")
def preview_subgraph(spark, d):
    return G.preview(S.nodes(spark, d), S.edges(spark, d))[0].select("id", "label", "hop")


@query("preview_edges", f"with {_TOP} select src, type, dst from edges where src in (select id from kept) and dst in (select id from kept)")
def preview_edges(spark, d):
    return G.preview(S.nodes(spark, d), S.edges(spark, d))[1].select("src", "type", "dst")


@query("one_hop_induced", f"""
with {S.NODES_SQL}, {S.EDGES_SQL}, seeds as (select id from nodes where label in {_ENT} and (name in ('FRANCE', 'GERMANY') or name_norm in ('france', 'germany', 'nation_3', 'nation_5'))),
hops as (select id, min(hop) as hop from (select id, 0 as hop from seeds union all select dst, 1 from edges where src in (select id from seeds) union all select src, 1 from edges where dst in (select id from seeds)) group by id)
select n.id, label, hop from nodes n join hops h on n.id = h.id order by hop, n.id limit 60""")
def one_hop_induced(spark, d):
    nodes = S.nodes(spark, d)
    seeds = G.match_seeds(nodes, ["FRANCE", "GERMANY", "NATION_3", "nation_5"])
    return G.expand(seeds, nodes, S.edges(spark, d)).select("id", "label", "hop")


@query("k_hop_neighbours", f"""
with recursive {S.EDGES_SQL}, u as (select src as a, dst as b from edges where type = 'affiliated_with' union select dst, src from edges where type = 'affiliated_with'),
w as (select 'o:1' as id, 0 as hops union select u.b, w.hops + 1 from w join u on w.id = u.a where w.hops < 2)
select id, min(hops)::int as hops from w group by id""")
def k_hop_neighbours(spark, d):
    e = S.edges(spark, d).where("type = 'affiliated_with'").withColumn("confidence", F.lit(1.0))
    return G.neighbours(e, spark.createDataFrame([("o:1",)], "id string"), 2)


@query("publication_coverage", f"with {S.FACTS_SQL} select count(*) as publications, count(f.source_doc) as covered, round(count(f.source_doc)::double / count(*), 6) as share from orders o left join (select distinct source_doc from facts) f on f.source_doc = 'd:' || o.o_orderkey")
def publication_coverage(spark, d):
    pubs = read(spark, d, "orders").select(F.concat(F.lit("d:"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    return G.coverage(pubs, S.facts(spark, d).select(F.col("source_doc").alias("doc_id"), F.col("dst").alias("id")))


@query("orphan_anti_join", f"with {S.NODES_SQL}, {S.FACTS_SQL} select id, label from nodes where label in ('Material', 'Organization') and id not in (select dst from facts)")
def orphan_anti_join(spark, d):
    nodes = S.nodes(spark, d).where(F.col("label").isin("Material", "Organization"))
    return G.without_incoming(nodes, S.facts(spark, d)).select("id", "label")


@query("suspicious_names", rf"with {S.NODES_SQL} select id from nodes where label <> 'Publication' and (length(trim(name_norm)) < 4 or regexp_matches(lower(trim(name_norm)), '^[0-9]+$') or regexp_matches(lower(trim(name_norm)), '^[a-z0-9]{{1,6}}$'))")
def suspicious_names(spark, d):
    return S.nodes(spark, d).where((F.col("label") != "Publication") & T.is_suspicious_name(F.col("name_norm"))).select("id")


@query("gap_pairs", """
with x as (select distinct l_orderkey as src, p_brand || ' ' || (p_size // 8) as dst from lineitem join part on l_partkey = p_partkey),
a as (select distinct p_brand || ' ' || (p_size // 8) as id from part), l as (select distinct x.dst as a, y.dst as b from x join x y on x.src = y.src and x.dst < y.dst)
select p.id as a, q.id as b from a p join a q on p.id < q.id where not exists (select 1 from l where l.a = p.id and l.b = q.id)""")
def gap_pairs(spark, d):
    part = read(spark, d, "part").withColumn("kind", F.concat("p_brand", F.lit(" "), F.floor(F.col("p_size") / 8).cast("string")))
    rows = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return G.gaps(rows.select(F.col("l_orderkey").alias("src"), F.col("kind").alias("dst")), part.select(F.col("kind").alias("id")).distinct())


@query("expert_rank", """
select c_name as expert, count(*) as works, array_to_string(list_sort(list(distinct 'Order ' || o_orderkey))[1:3], '|') as top_publications from orders join customer on o_custkey = c_custkey group by c_name order by works desc, expert limit 5""")
def expert_rank(spark, d):
    o = read(spark, d, "orders").withColumn("title", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
    authored = o.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), "title", F.col("c_name").alias("expert"), F.lit(None).cast("string").alias("affiliation"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"))
    return G.rank_experts(authored, docs).select("expert", "works", F.array_join("top_publications", "|").alias("top_publications"))


@query("contradiction_edges", """
with f as (select p_name, l_suppkey, min(l_quantity) as lo, max(l_quantity) as hi from lineitem join part on l_partkey = p_partkey group by p_name, l_suppkey)
select s_name as source_a, 'm:' || lower(p_name) as source_b, 'quantity ' || lo::int || ' to ' || hi::int as description from f join supplier on s_suppkey = l_suppkey where hi - lo > 45""")
def contradiction_edges(spark, d):
    f = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name", "l_suppkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")).where("hi - lo > 45")
    note = F.concat(F.lit("quantity "), F.col("lo").cast("int").cast("string"), F.lit(" to "), F.col("hi").cast("int").cast("string"))
    e = f.select(F.concat(F.lit("o:"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("CONTRADICTS").alias("type"), F.concat(F.lit("m:"), F.lower("p_name")).alias("dst"), note.alias("note"), F.lit(None).cast("string").alias("description"))
    return A.contradictions(e, S.nodes(spark, d).where("label = 'Organization'").select("id", "name"))


@query("display_topk", f"""
with {S.NODES_SQL}, {S.EDGES_SQL}, {S.DEGREES_SQL} select n.id, round(coalesce(confidence, 0) * coalesce(degree, 0), 6) as score from nodes n left join degrees d on n.id = d.id order by coalesce(confidence, 0) * coalesce(degree, 0) desc, n.id limit 45""")
def display_topk(spark, d):
    return G.display_selection(S.nodes(spark, d), S.edges(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("confidence_bucket", f"with {S.FACTS_SQL} select case when confidence >= 0.8 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as bucket, count(*) as n from facts group by 1")
def confidence_bucket(spark, d):
    return S.facts(spark, d).groupBy(G.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("term_diagnostics", f"""
with {S.NODES_SQL}, {S.EDGES_SQL} select 'term' as kind, 'supplier' as item, count(*) as n from nodes where contains(lower(name_norm), 'supplier') union all select 'term', 'nothing', count(*) from nodes where contains(lower(name_norm), 'nothing')
union all select 'type', 'authored_by', count(*) from edges where type = 'authored_by' union all select 'type', 'owns', count(*) from edges where type = 'owns'""")
def term_diagnostics(spark, d):
    return G.term_diagnostics(S.nodes(spark, d), S.edges(spark, d), ["Supplier", "nothing"], ["authored_by", "owns"]).withColumn("item", F.lower("item"))


@query("query_terms", r"""
select item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) >= 4 and t not in ('with', 'from', 'that', 'this', 'which', 'after', 'before', 'year', 'years', 'find', 'show')), ' ') as terms from benchmark""")
def query_terms(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("anchor_resolution", f"""
with {S.NODES_SQL}, {S.EDGES_SQL}, {S.DEGREES_SQL}, t(ord, term) as (values (0, 'part'), (1, 'item'), (2, 'brand#11'), (3, 'green'), (4, 'steel')),
k as (select n.*, degree from nodes n join degrees d on n.id = d.id where label in ('Process', 'Material') and degree >= 3),
f as (select k.*, ord, term, row_number() over (partition by ord order by degree desc, k.id) as n from k join t on contains(lower(name_norm), term) or len(list_filter(aliases, lambda a: contains(lower(a), term))) > 0),
v as (select * from f where n <= 3 and length(trim(name_norm)) >= 5 and not regexp_matches(trim(name_norm), '[0-9%=°]') and (contains(name_norm, term) or contains(term, name_norm)))
select id, label, name_norm from v group by id, label, name_norm order by min((ord, n)), id limit 5""")
def anchor_resolution(spark, d):
    terms = spark.createDataFrame(list(enumerate(["part", "item", "brand#11", "green", "steel"])), "ord int, term string")
    return G.resolve_anchors(S.nodes(spark, d), S.edges(spark, d), terms).select("id", "label", "name_norm")


# ---- entity resolution


@query("dedup_cosine_pairs", """
select label::varchar as label, a.vec_id::varchar as a, b.vec_id::varchar as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine_score
from embeddings a join embeddings b using (label) where a.vec_id::varchar < b.vec_id::varchar and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3""")
def dedup_cosine_pairs(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))
    return R.cosine_pairs(rows, 0.3).withColumn("cosine_score", F.round("cosine_score", 6))


def _materials(spark, d):
    return S.nodes(spark, d).where("label = 'Material'").select("label", "id", "name_norm")


@query("dedup_fuzzy_pairs")
def dedup_fuzzy_pairs(spark, d):
    return R.fuzzy_pairs(_materials(spark, d)).select("label", "a", "b", F.round("fuzzy_score", 6).alias("fuzzy_score"))


@query("duplicate_scan")
def duplicate_scan(spark, d):
    return R.duplicate_scan(_materials(spark, d))


_MEMBERS = "n as (select 'c' || c_custkey as id, c_nationkey as nation, c_custkey * 2 as ord from customer union all select 's' || s_suppkey, s_nationkey, s_suppkey * 2 + 1 from supplier)"
_PAIRS = f"{_MEMBERS}, p as (select * from (select id as a, lead(id) over (partition by nation order by ord) as b, nation from n) where b is not null), roots as (select nation, min(id) as root, count(*) as members from n group by nation having count(*) > 1)"


def _links(spark, d):
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 2).alias("ord"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") * 2 + 1).alias("ord"))
    return c.unionByName(s).withColumn("b", F.lead("a").over(Window.partitionBy("nation").orderBy("ord"))).where("b is not null").select("a", "b")


@query("dedup_components", f"with {_PAIRS} select id, root from n join roots using (nation)")
def dedup_components(spark, d):
    return R.components(_links(spark, d))


@query("dedup_canon", f"""
with {_PAIRS}, g as (select id, count(*) as degree from (select a as id from p union all select b from p) group by id)
select root, arg_min(g.id, (-degree, g.id)) as canon_id, count(*) as members from g join n using (id) join roots using (nation) group by root""")
def dedup_canon(spark, d):
    links = _links(spark, d)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return R.canonical(degree.withColumn("name_norm", F.col("id")), R.components(links))


@query("dedup_rewire", f"""
with {S.FACTS_SQL}, m as (select 'o:' || s_suppkey as id, 'o:' || min(s_suppkey) over (partition by s_nationkey) as canon from supplier), e as (select distinct src, type, dst from facts)
select distinct coalesce(m.canon, e.src) as src, type, dst from e left join m on m.id = e.src""")
def dedup_rewire(spark, d):
    s = read(spark, d, "supplier").withColumn("first", F.min("s_suppkey").over(Window.partitionBy("s_nationkey")))
    mapping = s.where("s_suppkey <> first").select(F.concat(F.lit("o:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("o:"), F.col("first").cast("string")).alias("canon_id"))
    nodes = S.nodes(spark, d).where("label = 'Organization'")
    return R.rewire(nodes, S.facts(spark, d).select("src", "type", "dst", "ord"), mapping)[1].select("src", "type", "dst")


_DECIDE = """pairs as (select 'Material' as label, p.p_name as name_a, q.p_name as name_b, p.p_partkey::varchar as a, q.p_partkey::varchar as b, (p.p_partkey % 20 + 80)::double as fuzzy_score, case when p.p_partkey % 3 = 0 then (q.p_partkey % 10 + 90) / 100.0::double end as cosine_score from part p join part q on p.p_size = q.p_size and p.p_brand = q.p_brand and p.p_type = q.p_type and p.p_partkey < q.p_partkey),
d as (select *, case when coalesce(cosine_score >= 0.97, false) then 'auto_cosine' when fuzzy_score >= 96 then 'auto_fuzzy' else 'llm' end as method from pairs)"""


def _decisions(spark, d):
    keys = ["p_size", "p_brand", "p_type"]
    rows = R.pairs_within(read(spark, d, "part").select("p_partkey", "p_name", *keys), keys, "p_partkey")
    cos = F.when(F.col("p.p_partkey") % 3 == 0, (F.col("q.p_partkey") % 10 + 90) / 100.0)
    return R.decide(rows.select("cell", F.lit("Material").alias("label"), F.col("p.p_partkey").cast("string").alias("a"), F.col("q.p_partkey").cast("string").alias("b"), F.col("p.p_name").alias("name_a"), F.col("q.p_name").alias("name_b"), (F.col("p.p_partkey") % 20 + 80).cast("double").alias("fuzzy_score"), cos.alias("cosine_score")))


@query("dedup_decisions", f"with {_DECIDE} select a, b, method, method <> 'llm' as merge from d")
def dedup_decisions(spark, d):
    return _decisions(spark, d).select("a", "b", "method", "merge")


@query("plan_filter", f"with {_DECIDE} select a, b, method, method <> 'llm' and lower(name_a) = lower(name_b) as merge from d")
def plan_filter(spark, d):
    return R.safe_only(_decisions(spark, d)).select("a", "b", "method", "merge")


@query("plan_summary", f"with {_DECIDE} select method, count(*) as pairs, sum(case when method <> 'llm' then 1 else 0 end)::bigint as to_merge from d group by method")
def plan_summary(spark, d):
    return R.plan_summary(_decisions(spark, d))


@query("candidate_union", f"""
with {_DECIDE} select coalesce(f.a, c.a) as a, coalesce(f.b, c.b) as b, fuzzy, cosine from (select a, b, fuzzy_score as fuzzy from pairs where fuzzy_score >= 88) f full join (select a, b, cosine_score as cosine from pairs where cosine_score >= 0.92) c on f.a = c.a and f.b = c.b""")
def candidate_union(spark, d):
    rows = _decisions(spark, d)
    out = R.candidates(rows.where("fuzzy_score >= 88"), rows.where("cosine_score >= 0.92"), ("cell", "label", "a", "b"))
    return out.select("a", "b", F.col("fuzzy_score").alias("fuzzy"), F.col("cosine_score").alias("cosine"))


# ---- retrieval


_FOUND = f"with {S.CHUNKS_SQL}, {S.SCORES_SQL}, j as (select c.*, score from scores s join chunks c on c.chunk_id = s.chunk_id)"


@query("vec_topk", f"{_FOUND}, t as (select * from j where lang = 'en' and year >= 2005 order by score desc, chunk_id limit 40), u as (select *, row_number() over (partition by doc_id, substr(text, 1, 120) order by score desc, chunk_id) as n from t), v as (select * from u where n = 1 order by score desc, chunk_id limit 10) select chunk_id, doc_id, title, year, venue, doc_type, lang, score, (row_number() over (order by score desc, chunk_id))::int as rank from v")
def vec_topk(spark, d):
    out = Q.vector_top_k(S.vectors(spark, d), S.chunks(spark, d), S.QUERY, 10, Q.Filters(year_min=2005, lang="en"))
    return out.select("chunk_id", "doc_id", "title", "year", "venue", "doc_type", "lang", "score", "rank")


@query("vec_topk_postfilter", f"{_FOUND}, t as (select chunk_id from scores order by score desc, chunk_id limit 40) select j.chunk_id, score from j join t on t.chunk_id = j.chunk_id where lang = 'en' and year >= 2005 order by score desc, j.chunk_id limit 10")
def vec_topk_postfilter(spark, d):
    return Q.vector_top_k(S.vectors(spark, d), S.chunks(spark, d), S.QUERY, 10, Q.Filters(year_min=2005, lang="en"), post_filter=True, prefix=None).select("chunk_id", "score")


@query("vec_neardup_collapse", f"{_FOUND}, u as (select *, row_number() over (partition by substr(text, 1, 120) order by score desc, chunk_id) as n from j) select chunk_id, score from u where n = 1")
def vec_neardup_collapse(spark, d):
    rows = Q.scored(S.vectors(spark, d), S.QUERY).join(S.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return Q.collapse_near_duplicates(rows, by=()).select("chunk_id", "score")


@query("vec_search_many", """
with q as (select vec_id as query_id, embedding::double[] as e from embeddings where label = 3), s as (select query_id, v.vec_id as chunk_id, round(round(list_cosine_similarity(q.e, v.embedding::double[]), 9), 6) as score, list_cosine_similarity(q.e, v.embedding::double[]) as x from q, embeddings v),
r as (select *, row_number() over (partition by query_id order by round(x, 9) desc, chunk_id) as rank from s) select query_id, chunk_id, score, rank::int as rank from r where rank <= 5""")
def vec_search_many(spark, d):
    v = S.vectors(spark, d)
    asked = v.where("label = 3").select(F.col("chunk_id").alias("query_id"), "vec")
    return Q.search_many(v, asked, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _ranked(spark, d):
    order = Window.orderBy(F.desc("n"), "doc_id")
    e = read(spark, d, "events")
    one = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    two = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return [x.withColumn("rank", F.row_number().over(order)) for x in (one, two)]


_RANKED = "a as (select user_id as doc_id, row_number() over (order by count(*) desc, user_id) as rank from events where event_type = 'view' group by user_id), b as (select user_id as doc_id, row_number() over (order by count(*) desc, user_id) as rank from events where event_type = 'click' group by user_id), fused as (select doc_id as id, round(sum(1.0::double / (60 + rank)), 12) as score, min((l, rank)) as first from (select 0 as l, * from a union all select 1, * from b) group by doc_id)"


@query("rrf_fusion", f"with {_RANKED} select id, round(score, 9) as score, (row_number() over (order by score desc, first, id))::int as rank from fused")
def rrf_fusion(spark, d):
    return Q.reciprocal_rank_fusion(_ranked(spark, d)).select("id", F.round("score", 9).alias("score"), "rank")


@query("best_chunk_per_doc", f"""
with {_RANKED}, r as (select id, row_number() over (order by score desc, first, id) as rank from fused), c as (select user_id as id, arg_min(event_id, (-value, event_id)) as chunk_id, max(value) as score from events where event_type = 'purchase' group by user_id)
select r.id as doc_id, rank::int as rank, coalesce(c.chunk_id::varchar, '') as chunk_id, coalesce(c.score, 0) as score from r left join c on r.id = c.id""")
def best_chunk_per_doc(spark, d):
    fused = Q.reciprocal_rank_fusion(_ranked(spark, d)).select("id", "rank")
    e = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("chunk_id"), F.lit("").alias("text"), F.col("value").alias("score"))
    best = Q.best_chunk_per_document(fused, e.withColumn("key", F.col("chunk_id")).withColumn("chunk_id", F.col("chunk_id")))
    return best.select("doc_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "score")


@query("fact_range_overlap", f"with {S.RANGES_SQL} select name, supp, lo, hi from ranges where lo <= 5000 and hi >= 2000")
def fact_range_overlap(spark, d):
    rows = S.ranges(spark, d).select("*", F.lit(None).cast("double").alias("value"), F.col("lo").alias("value_min"), F.col("hi").alias("value_max"), F.lit("usd").alias("unit"))
    return Q.find_facts(rows, Q.Filters(numeric=(Q.NumericFilter("price", 2000, 5000, ("usd",)),))).select("name", "supp", "lo", "hi")


@query("fact_upper_bound", f"with {S.FACTS_SQL} select src, dst, value, count(*) as n from facts where value <= 3 and confidence >= 0.95 group by src, dst, value")
def fact_upper_bound(spark, d):
    out = Q.find_facts(S.facts(spark, d), Q.Filters(min_confidence=0.95, numeric=(Q.NumericFilter("quantity", None, 3),)))
    return out.groupBy("src", "dst", "value").agg(F.count(F.lit(1)).alias("n"))


@query("fact_overlap_join", f"""
with {S.RANGES_SQL}, w(want, want_lo, want_hi) as (values (1, 900.0::double, 1500.0::double), (2, 20000.0, 30000.0), (3, 90000.0, 91000.0))
select want, name, count(*) as n from ranges join w on lo <= want_hi and hi >= want_lo group by want, name""")
def fact_overlap_join(spark, d):
    wanted = spark.createDataFrame([(1, "price", 900.0, 1500.0), (2, "price", 20000.0, 30000.0), (3, "price", 90000.0, 91000.0)], "want int, parameter string, want_lo double, want_hi double")
    return Q.overlap_join(S.ranges(spark, d), wanted, 10_000.0).groupBy("want", "name").agg(F.count(F.lit(1)).alias("n"))


@query("source_collection", f"""
with {S.FACTS_SQL} select src, count(distinct source_doc) as sources, min(source_doc) as first_source from facts join orders on source_doc = 'd:' || o_orderkey group by src""")
def source_collection(spark, d):
    pubs = read(spark, d, "orders").select(F.concat(F.lit("d:"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.col("o_orderstatus").alias("title"), F.year("o_orderdate").alias("year"))
    out = Q.collect_sources(S.facts(spark, d), pubs, ["src"])
    return out.select("src", F.size("sources").cast("long").alias("sources"), F.get("sources", F.lit(0))["doc_id"].alias("first_source"))


@query("substring_entity_match", f"with {S.NODES_SQL} select id, label from nodes where contains(lower(name_norm), 'an') or len(list_filter(aliases, lambda a: contains(lower(a), '#5') or contains(lower(a), 'an'))) > 0")
def substring_entity_match(spark, d):
    return Q.match_entities(S.nodes(spark, d), ["AN", "#5"]).select("id", "label")


@query("seed_names", "select lower(n_name) as name from nation group by 1 order by min(n_nationkey), 1 limit 20")
def seed_names(spark, d):
    return Q.seed_names(read(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("name"))).select("name")


# ---- answer

_TOPTEN = f"{_FOUND}, v as (select *, row_number() over (order by score desc, chunk_id) as rank from j qualify rank <= 10)"


def _ten(spark, d):
    return Q.vector_top_k(S.vectors(spark, d), S.chunks(spark, d), S.QUERY, 10, prefix=None)


_COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("extractive_answer", f"""{_TOPTEN}, b as (select rank, '**' || title || '** (' || coalesce(year::varchar, 'год не указан') || ', ' || venue || ') [doc:' || doc_id || ']' || chr(10) || case when length({_COLLAPSED}) <= 400 then {_COLLAPSED} else rtrim(substr({_COLLAPSED}, 1, 400)) || '…' end as block from v where rank <= 5)
select '## Найдено по запросу' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by rank) as answer from b""")
def extractive_answer(spark, d):
    return A.extractive_answer(_ten(spark, d))


@query("citation_table", f"{_TOPTEN} select doc_id::varchar as doc_id, chunk_id, title, substr(text, 1, 400) as snippet, greatest(0.0, least(1.0, score)) as confidence, score, year, 'UNKNOWN' as geography, rank::int as rank from v")
def citation_table(spark, d):
    rows = _ten(spark, d).withColumn("page", F.lit(None).cast("int")).withColumn("geography", F.lit(None).cast("string"))
    return A.citations(rows).drop("page")


_HEAD = f"substr({_COLLAPSED}, 1, 800)"
_LAST = "case when contains(head, '{0}') then length(head) - instr(reverse(head), reverse('{0}')) - 1 end"
_ENDS = ", ".join(f"case when {_LAST.format(x)} > 400 then rtrim(substr(head, 1, {_LAST.format(x)} + 1)) end" for x in (". ", "! ", "? "))


@query("context_budget", f"""{_TOPTEN}, h as (select *, {_COLLAPSED} as whole, {_HEAD} as head from v where rank <= 8),
l as (select chunk_id, rank, length('[doc:' || doc_id || '] ' || title || ' (' || coalesce(year::varchar, '?') || '): ' || case when length(whole) <= 800 then whole else coalesce({_ENDS}, rtrim(head) || '…') end) as n from h),
t as (select *, sum(n + 1) over (order by rank) - 1 + {A.RESERVE} <= 2500 as fits from l)
select chunk_id, n::int as n_chars, rank::int as rank from t where rank < coalesce((select min(rank) from t where not fits), 99)""")
def context_budget(spark, d):
    return A.within_budget(_ten(spark, d), 0, budget=2500).select("chunk_id", F.length("line").alias("n_chars"), "rank")


@query("citation_strip", """
select item_id, regexp_replace(text, 'a', '', 'g') || case when item_id in (select doc_id from labels) then '[doc:' || item_id || ']' else '' end as answer from benchmark""")
def citation_strip(spark, d):
    text = F.concat(F.replace("text", F.lit("a"), F.lit("")), F.lit("[doc:"), F.col("item_id").cast("string"), F.lit("]"))
    return A.strip_unknown_citations(read(spark, d, "benchmark").select("item_id", text.alias("answer")), read(spark, d, "labels"), "item_id")


@query("distinct_facts", f"with {S.FACTS_SQL} select src as name, parameter, value, arg_min(source_doc, ord) as doc_id from facts group by src, parameter, value")
def distinct_facts(spark, d):
    rows = S.facts(spark, d).select(F.col("src").alias("name"), "parameter", "value", "value_min", "value_max", F.col("ord").alias("seq"), F.col("source_doc").alias("doc_id"))
    return A.distinct_facts(rows).select("name", "parameter", "value", "doc_id")


@query("consensus_count", r"select conv_id, turn, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) as cited from conversations")
def consensus_count(spark, d):
    marked = F.regexp_replace("text", r"([0-9]+)", "[doc:$1]")
    return read(spark, d, "conversations").select("conv_id", "turn", A.consensus(marked).cast("long").alias("cited"))


# ---- events: the incremental side


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    from strataflow.streaming.events import tumbling

    return tumbling(read(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("event_sessions", """
with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '30 minutes' then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from e)
select user_id, min(ts) as start, count(*) as n from s group by user_id, session""")
def event_sessions(spark, d):
    from strataflow.streaming.events import sessions

    return sessions(read(spark, d, "events"), "30 minutes").select("user_id", "start", "n")


# ---- layout, reports and graph views


def _boxes(spark, d):
    n = F.col("ord")
    return S.lines(spark, d).where("line <> ''").select("doc_id", F.floor(n / 8).cast("int").alias("page"), "ord", F.col("line").alias("text"), ((n % 2) * 300 + 20).cast("double").alias("x0"), ((n * 37) % 700).cast("double").alias("y0"), F.lit(600.0).alias("page_width"), F.when(n % 5 == 0, 14.0).otherwise(10.0).alias("font_size"))


_BOXES = f"{S.LINES_SQL}, b as (select doc_id, (ord // 8)::int as page, ord, line as text, ((ord % 2) * 300 + 20)::double as x0, ((ord * 37) % 700)::double as y0, case when ord % 5 = 0 then 14.0 else 10.0 end as font from lines where line <> '')"


@query("reading_order", f"""
with {_BOXES}, g as (select *, lead(x0) over (partition by doc_id, page order by x0, y0) - x0 as gap, count(*) over (partition by doc_id, page) as n from b),
m as (select doc_id, page, max(gap) as gap, max(n) as n, max_by(x0 + gap / 2, gap) filter (where gap is not null) as mid from g group by doc_id, page)
select b.doc_id, b.page, b.ord, (row_number() over (partition by b.doc_id, b.page order by case when n >= 4 and gap >= 90 and x0 >= mid then 1 else 0 end, y0, x0))::int as rank from b join m on b.doc_id = m.doc_id and b.page = m.page""")
def reading_order(spark, d):
    return B.reading_order(_boxes(spark, d)).select("doc_id", "page", "ord", "rank")


@query("heading_inference", rf"""
with {_BOXES}, z as (select doc_id, list_sort(list(font))[count(*) // 2 + 1] as median from b group by doc_id), t as (select b.*, {_STRIP.format('text')} as s, median from b join z on b.doc_id = z.doc_id),
c as (select *, length(s) < 80 and font > 1.25 * median and not regexp_matches(s, '[.,]$') as maybe from t)
select doc_id, ord, maybe and sum(maybe::int) over (partition by doc_id, page) <= 3 as is_heading from c""")
def heading_inference(spark, d):
    return B.infer_headings(_boxes(spark, d)).select("doc_id", "ord", "is_heading")


@query("table_overlap", f"""
with {_BOXES} select doc_id, ord from b where not (x0 < 100 and least(y0 + 20, 350) - greatest(y0, 0) > 0 and (least(y0 + 20, 350) - greatest(y0, 0)) * (least(x0 + 100, 200) - x0) > 0.3 * 2000)""")
def table_overlap(spark, d):
    rows = _boxes(spark, d).withColumn("x1", F.col("x0") + 100).withColumn("y1", F.col("y0") + 20)
    tables = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(350.0).alias("y1"))
    return B.outside_tables(rows, tables).select("doc_id", "ord")


@query("quality_report", """
with t as (select doc_id, lang as status, 4 as pages, len(string_split(text, chr(10))) as chunks, n_chars::double / len(string_split(text, chr(10))) as size, n_chars / 4.0 < 150 as low from documents)
select 'status:' || status as item, count(*) as n from t group by 1 union all select 'low_yield', sum(low::int)::bigint from t union all select 'dense', sum((chunks / 4.0 > 6)::int)::bigint from t union all select 'odd_size', sum((size < 600 or size > 2500)::int)::bigint from t
union all select 'repeated_chunk_ids', count(*) from (select md5(text) from documents group by 1 having count(*) > 1)""")
def quality_report(spark, d):
    n = F.size(F.split("text", "\n", -1))
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("status"), F.lit(4).alias("pages"), n.alias("chunks"), (F.col("n_chars") / n).alias("avg_chunk_chars"), (F.col("n_chars") / 4 < 150).alias("low_yield"))
    return B.quality_report(docs, read(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("chunk_id")))


@query("table_first_order", """
select conv_id as doc_id, turn as chunk_id, (row_number() over (partition by conv_id order by case when text like '%|%' then 0 when role = 'user' then 1 else 2 end, turn))::int as rank from conversations""")
def table_first_order(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), F.when(F.contains("text", F.lit("|")), "table").otherwise("text").alias("kind"), F.when(F.col("role") == "user", "frontmatter").otherwise("x").alias("section"))
    return X.table_first(rows).select("doc_id", "chunk_id", "rank")


@query("admissible_documents", "select doc_id from labels where (quality = 1 or toxic = 0) and not (quality = 0 and toxic = 1)")
def admissible_documents(spark, d):
    meta = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("scan_low_value").alias("status"), ((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("low_yield"), F.lit(None).cast("string").alias("doc_type"))
    return X.admissible_documents(meta, ["report"], drop_low_yield=True).select("doc_id")


@query("retry_penalty", "select event_id, round(case when event_type = 'error' then greatest(0.0, least(1.0, event_id % 100 / 100.0::double - 0.2)) else event_id % 100 / 100.0::double end, 6) as confidence from events")
def retry_penalty(spark, d):
    c = F.col("event_id") % 100 / 100.0
    return read(spark, d, "events").select("event_id", F.round(X.retry_penalty(c, (F.col("event_type") == "error").cast("int")), 6).alias("confidence"))


@query("documents_of_rows", """
with r as (select l_orderkey * 8 + l_linenumber as n, l_suppkey as s, l_partkey as p from lineitem), f as (select doc_id, min((n, pos)) as place from (select s as doc_id, n, 0 as pos from r union all select p, n, 1073741824 from r) group by doc_id)
select doc_id, (row_number() over (order by place, doc_id))::int as rank from f""")
def documents_of_rows(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.array(F.struct(F.col("l_suppkey").alias("doc_id"))).alias("sources"), F.col("l_partkey").alias("doc_id"))
    return Q.documents_of_rows(rows)


@query("reference_verdict", f"with {S.CHUNKS_SQL}, {S.SCORES_SQL} select label, count(*) as chunks, max(score) as top_score, case when max(score) >= 0.3 then 'OK' else 'FAIL' end as verdict from scores join embeddings on vec_id = chunk_id group by label")
def reference_verdict(spark, d):
    v = S.vectors(spark, d)
    scored = Q.vector_top_k(v, v.select("chunk_id", "label"), S.QUERY, 1 << 30, over=1, prefix=None)
    out = scored.groupBy("label").agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("top_score"))
    return out.withColumn("verdict", Q.verdict(F.lit(0), F.col("top_score")))


@query("fallback_preview", f"""
with {S.CHUNKS_SQL}, l as (select doc_id, title, year, venue from chunks order by coalesce(year, 0) desc, title, doc_id limit 150) select l.doc_id, l.title, s.s_name as expert from l left join supplier s on s.s_suppkey = l.doc_id""")
def fallback_preview(spark, d):
    sup = read(spark, d, "supplier").select(F.col("s_suppkey").alias("expert_id"), F.col("s_name").alias("expert"))
    return G.fallback_preview(S.chunks(spark, d), sup.select(F.col("expert_id").alias("doc_id"), "expert_id"), sup).select("doc_id", "title", "expert")


@query("chunk_entity_expansion", f"""
with {S.NODES_SQL}, {S.EDGES_SQL}, docs as (select 'd:' || o_orderkey as doc_id from orders where o_totalprice > (select max(o_totalprice) * 0.98 from orders)), found as (select distinct dst as id from facts where source_doc in (select doc_id from docs)),
best as (select n.id from nodes n join found f on n.id = f.id where confidence >= 0.5 order by confidence desc, n.id limit 45), e as (select * from edges where type not in ('described_in', 'part_of')),
hops as (select id, min(hop) as hop from (select id, 0 as hop from best union all select dst, 1 from e where src in (select id from best) union all select src, 1 from e where dst in (select id from best)) group by id)
select n.id, label, hop from nodes n join hops h on n.id = h.id order by hop, n.id limit 60""")
def chunk_entity_expansion(spark, d):
    o = read(spark, d, "orders")
    top = o.agg((F.max("o_totalprice") * 0.98).alias("least"))
    docs = o.join(F.broadcast(top), F.col("o_totalprice") > F.col("least")).select(F.concat(F.lit("d:"), F.col("o_orderkey").cast("string")).alias("doc_id"))
    described = S.facts(spark, d).select(F.col("source_doc").alias("doc_id"), F.col("dst").alias("id"))
    return G.expand_chunks(docs, described, S.nodes(spark, d), S.edges(spark, d)).select("id", "label", "hop")


@query("induced_by_ids", f"with {S.EDGES_SQL} select src, type, dst from edges where type = 'affiliated_with' and src like 'o:%'")
def induced_by_ids(spark, d):
    ids = S.nodes(spark, d).where(F.col("label").isin("Organization", "Facility")).select("id")
    return G.induced(ids, S.edges(spark, d)).select("src", "type", "dst")


@query("display_nodes", f"with {S.NODES_SQL} select id, label, coalesce(name, name_norm) as name from nodes")
def display_nodes(spark, d):
    n = S.nodes(spark, d)
    for c in ("doc_id", "chunk_id", "text", "title"):
        n = n.withColumn(c, F.lit(None).cast("string"))
    return G.display_node(n)


@query("publication_star", f"{_FOUND}, v as (select doc_id, row_number() over (order by score desc, chunk_id) as rank from j qualify rank <= 50) select 'query' as src, 'described_in' as type, doc_id::varchar as dst, min(rank)::int as rank from v group by doc_id")
def publication_star(spark, d):
    rows = Q.vector_top_k(S.vectors(spark, d), S.chunks(spark, d), S.QUERY, 50, prefix=None)
    return G.publication_star(rows.select(F.col("doc_id").cast("string").alias("doc_id"), "rank"))[1]


@query("subgraph_union", f"""
with {S.NODES_SQL}, u as (select id, label, min(i) as i from (select id, label, 0 as i from nodes where label = 'Facility' union all select id, label, 1 from nodes where label in ('Facility', 'Organization')) group by id, label) select id, label from u order by i, id limit 60""")
def subgraph_union(spark, d):
    n = S.nodes(spark, d)
    return G.union_subsets(n.where("label = 'Facility'"), n.where(F.col("label").isin("Facility", "Organization"))).select("id", "label")


@query("stop_list_leak", f"with {S.NODES_SQL} select id from nodes where label in {_ENT} and name_norm in ('france', 'nation_1', 'blue anvil', 'data')")
def stop_list_leak(spark, d):
    return G.stop_list_leak(S.nodes(spark, d), ("france", "nation_1", "blue anvil", "data")).select("id")


@query("edge_sample", f"with {S.FACTS_SQL}, e as (select src, type, dst, arg_min(value, ord) as value from facts group by src, type, dst) select src, type, dst, value from e order by md5(concat_ws('|', '42', src, type, dst)), src, type, dst limit 10")
def edge_sample(spark, d):
    return G.edge_sample(K.first_edges(S.facts(spark, d), ["ord"])).select("src", "type", "dst", "value")


@query("simple_paths", f"""
with {S.FACTS_SQL}, u as (select distinct src as a, dst as b from facts) select 'o:1|' || x.b || '|o:2' as path, 2 as hops from u x join u y on x.b = y.b where x.a = 'o:1' and y.a = 'o:2'""")
def simple_paths(spark, d):
    return G.paths(S.facts(spark, d).select("src", "type", "dst").distinct(), "o:1", "o:2", 2).select(F.array_join("path", "|").alias("path"), "hops")


@query("normalised_terms", "select p_partkey, case p_partkey % 4 when 0 then 'кучное выщелачивание' when 1 then 'флотация' when 2 then 'обратный осмос' else trim(p_name) end as name_norm from part")
def normalised_terms(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, " Heap  LEACHING").when(k == 1, "Flotation ").when(k == 2, "reverse\tosmosis").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", T.canonical_name(name).alias("name_norm"))


@query("path_metadata", r"""
select page_id, case when len(p) > 0 then p[1] end as category, case when len(p) >= 3 and p[1] = 'Журналы' then p[2] end as venue, case when len(p) >= 3 and p[1] = 'Журналы' and regexp_full_match(p[3], '[0-9]{4}') then p[3]::int end as year, case when p[1] = 'Журналы' and len(p) >= 3 then 'journal_issue' when p[1] = 'Доклады' then 'presentation' else 'report' end as doc_type
from (select page_id, list_filter(string_split(case page_id % 3 when 0 then 'Журналы/J' || page_id || '/' || (1990 + page_id % 30) || '/n.pdf' when 1 then 'Доклады/x.pptx' else 'Прочее/y.pdf' end, '/'), lambda x: x <> '') as p from pages)""")
def path_metadata(spark, d):
    i = F.col("page_id")
    tail = F.when(i % 3 == 0, F.concat(F.lit("Журналы/J"), i.cast("string"), F.lit("/"), (1990 + i % 30).cast("string"), F.lit("/n.pdf"))).when(i % 3 == 1, F.lit("Доклады/x.pptx")).otherwise(F.lit("Прочее/y.pdf"))
    return read(spark, d, "pages").select("page_id", T.source_meta(F.concat(F.lit("raw/Источники информации/"), tail)).alias("m")).select("page_id", "m.*")


_AUTHORS = ("Петров П.П.", "Сидорова Анна", "Journal of Ores", "Кузнецов и др.")


@query("metadata_repair", f"select doc_id, case when doc_id % 5 < 4 then ({list(_AUTHORS)})[doc_id % 5 + 1] else source end as author from documents")
def metadata_repair(spark, d):
    broken = F.get(F.array(*[F.lit(a.encode(e).decode("latin-1")) for a, e in zip(_AUTHORS, ("cp1251", "cp1251", "ascii", "cp1251"), strict=True)]), (F.col("doc_id") % 5).cast("int"))
    return read(spark, d, "documents").select("doc_id", T.repair_metadata(F.when(F.col("doc_id") % 5 < 4, broken).otherwise(F.col("source"))).alias("author"))


@query("one_per_content", "select doc_id, source from (select *, row_number() over (partition by text order by doc_id desc) as n from documents where text is not null) where n = 1")
def one_per_content(spark, d):
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", "source", T.content_id(F.col("text").cast("binary")).alias("content_id"))
    return files.one_per_content(rows, "content_id", "doc_id").select("doc_id", "source")


@query("json_fence", r"""
select p_partkey, '{"name":"' || p_name || '"}' as inside from part""")
def json_fence(spark, d):
    inside = F.concat(F.lit('{"name":"'), "p_name", F.lit('"}'))
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), inside, F.lit("\n```"))).when(k == 1, F.concat(F.lit(" \n```\n"), inside, F.lit("\n``` "))).otherwise(F.concat(inside, F.lit("\n")))
    return read(spark, d, "part").select("p_partkey", T.strip_json_fence(raw).alias("inside"))


@query("author_hint", """
select c_custkey, case c_custkey % 5 when 0 then 'Иванов А.Б.' when 1 then 'Петрова В.Г.' when 2 then 'Сидоров Д.Е.' when 3 then 'Smith John' end as author from customer""")
def author_hint(spark, d):
    i = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.lit("Доклад_Иванов А. Б.pptx")).when(k == 1, F.concat(F.lit("Петрова_В_Г_"), i, F.lit(".pdf"))).when(k == 2, F.concat(i, F.lit(" Сидоров Д.Е. обзор.docx"))).when(k == 3, F.concat(F.lit("Smith_John_"), i, F.lit(".pdf"))).otherwise(F.concat(F.lit("report "), i, F.lit(".pdf")))
    return read(spark, d, "customer").select("c_custkey", T.author_hint(name).alias("author"))


@query("office_tables", """
select n_regionkey, '| nation | rest |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || (100 + n_nationkey % 3) || ' |', chr(10) order by n_nationkey) as markdown from nation group by n_regionkey""")
def office_tables(spark, d):
    # the first cell is merged over two columns, or the second over three; the first row is the header
    key, rest = F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), (100 + F.col("n_nationkey") % 3).cast("string"))
    row = F.struct("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.array(key, key, rest)).otherwise(F.array(key, rest, rest, rest)).alias("cells"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])
    return read(spark, d, "nation").groupBy("n_regionkey").agg(T.office_table(F.concat(F.array(F.array(F.lit("nation"), F.lit("rest"))), rows)).alias("markdown"))


@query("script_language", "select doc_id, case when len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[а-яА-ЯёЁ]')) then 'en' else 'ru' end as lang from documents")
def script_language(spark, d):
    return read(spark, d, "documents").select("doc_id", T.script_language(F.col("text")).alias("lang"))


@query("distinct_streamed_events", "select event_type, count(distinct event_id) as n from events group by event_type")
def distinct_streamed_events(spark, d):
    e = read(spark, d, "events")
    return e.unionByName(e).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- extraction records, loads, merges

_ENDS = """ends as (select r.doc_id, r.chunk_id, r.ord, r.type, r.confidence, r.price, r.has_unit,
    case when source = 'DOC' then 'Publication' else s.label end as source_label, case when source = 'DOC' then r.doc_id else s.k end as source_key,
    case when target = 'DOC' then 'Publication' else t.label end as target_label, case when target = 'DOC' then r.doc_id else t.k end as target_key
  from rels r left join ids s on s.scope = r.{scope} and s.tmp_id = source left join ids t on t.scope = r.{scope} and t.tmp_id = target),
resolved as (select * from ends where source_key is not null and target_key is not null and not (source_label = 'Publication' and target_label = 'Publication') and (type <> 'relates_to' or confidence >= 0.5))"""
_BY_CHUNK = f"{S.ENTITIES_SQL}, {S.RELATIONS_SQL}, ids as (select chunk_id as scope, tmp_id, label, k from ents), {_ENDS.format(scope='chunk_id')}"
_BY_DOCUMENT = f"{S.ENTITIES_SQL}, {S.RELATIONS_SQL}, ids as (select doc_id as scope, tmp_id, arg_max(label, chunk_id) as label, arg_max(k, chunk_id) as k from ents group by doc_id, tmp_id), {_ENDS.format(scope='doc_id')}"
_RESOLVED = ("doc_id", "chunk_id", "ord", "source_label", "source_key", "target_label", "target_key")


def _resolved(spark, d, by_document=False):
    records = S.records(spark, d)
    return K.resolve_relations(X.relation_mentions(records), X.mentions(records), by_document=by_document)


@query("relation_routing", f"with {_BY_CHUNK} select {', '.join(_RESOLVED)} from resolved")
def relation_routing(spark, d):
    return _resolved(spark, d).select(*_RESOLVED)


@query("relation_routing_by_document", f"with {_BY_DOCUMENT} select {', '.join(_RESOLVED)} from resolved")
def relation_routing_by_document(spark, d):
    return _resolved(spark, d, by_document=True).select(*_RESOLVED)


@query("edge_properties", f"""
with {_BY_CHUNK} select chunk_id, ord, upper(type) as type, 3 + case when type = 'has_property' then 4 else 0 end as properties, case when type = 'has_property' then case when has_unit then 'eur' else 'usd' end end as unit, case when type = 'has_property' then price end as value from resolved""")
def edge_properties(spark, d):
    out = K.edge_properties(_resolved(spark, d))
    return out.select("chunk_id", "ord", "type", F.size("props").alias("properties"), F.col("props")["unit"].alias("unit"), F.col("props")["value"].cast("double").alias("value"))


@query("load_statistics", f"""
with {S.ENTITIES_SQL}, {S.RELATIONS_SQL}, ids as (select chunk_id as scope, tmp_id, label, k from ents where confidence >= 0.5), {_ENDS.format(scope='chunk_id')}
select doc_id, mentions, admitted, relations, coalesce(resolved, 0) as resolved
from (select doc_id, count(*) as mentions, count(*) filter (where confidence >= 0.5) as admitted from ents group by doc_id) join (select doc_id, count(*) as relations from rels group by doc_id) using (doc_id) left join (select doc_id, count(*) as resolved from resolved group by doc_id) using (doc_id)""")
def load_statistics(spark, d):
    records = S.records(spark, d)
    mentions, relations = X.mentions(records), X.relation_mentions(records)
    kept = K.admitted(mentions)
    return K.load_statistics(mentions, kept, relations, K.resolve_relations(relations, kept))


@query("entity_upsert", f"""
with {S.ENTITIES_SQL}, old as (select label, k, list(distinct alias) as aliases, max(confidence) as c, count(*) as n, min(doc_id) as doc from ents where doc_id < 'd:5' group by label, k),
new as (select label, k, list(distinct alias) as aliases, max(confidence) as c, count(*) as n, min(doc_id) as doc from ents where doc_id >= 'd:5' group by label, k)
select coalesce(old.label, new.label) as label, coalesce(old.k, new.k) as name_norm, array_to_string(list_sort(list_distinct(list_concat(coalesce(old.aliases, []), coalesce(new.aliases, [])))), '|') as aliases, greatest(coalesce(old.c, 0), coalesce(new.c, 0)) as confidence, coalesce(old.n, 0) + coalesce(new.n, 0) as mentions, coalesce(old.doc, new.doc) as source_doc
from old full join new on old.label = new.label and old.k = new.k""")
def entity_upsert(spark, d):
    mentions = X.mentions(S.records(spark, d))
    out = K.upsert_entities(*[K.aggregate_entities(mentions.where(part)) for part in ("doc_id < 'd:5'", "doc_id >= 'd:5'")])
    return out.select("label", "name_norm", F.array_join("aliases", "|").alias("aliases"), "confidence", "mentions", "source_doc")


_ANSWERS = """answers as (select event_id, event_id % 25 / 20.0::double as confidence, case event_type when 'error' then 'Gadget' when 'view' then 'Material' else 'Process' end as label, event_id % 2 = 0 as ranged, floor(value) as v, event_id % 3 > 0 as bounded from events)"""


@query("answer_validation", f"""
with {_ANSWERS}, a as (select *, label = 'Gadget' or confidence > 1 as rejected from answers)
select event_id, rejected, case when not rejected and not (ranged and bounded) then v + 0.5 end as value, case when not rejected and ranged and bounded then v + 0.5 end as value_min, case when not rejected and bounded then 1000000.0::double end as value_max from a""")
def answer_validation(spark, d):
    kind = F.when(F.col("event_type") == "error", "Gadget").when(F.col("event_type") == "view", "Material").otherwise("Process")
    number = F.struct(F.lit("k").alias("parameter"), F.when(F.col("event_id") % 2 == 0, "range").otherwise("=").alias("operator"), F.concat(F.floor("value").cast("string"), F.lit(",5")).alias("value"), F.when(F.col("event_id") % 3 > 0, 1000000).alias("value_max"))
    conf = (F.col("event_id") % 25) / 20.0
    entity = F.struct(F.lit("e1").alias("tmp_id"), kind.alias("type"), F.lit("thing").alias("name"), F.lit("thing").alias("name_norm"), conf.alias("confidence"))
    relation = F.struct(F.lit("e1").alias("source"), F.lit("DOC").alias("target"), F.lit("has_property").alias("type"), number.alias("numeric"), F.lit(0.5).alias("confidence"))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations"))), F.lit("\n```"))
    n = F.col("result.relations")[0]["numeric"]
    return X.parse_answers(read(spark, d, "events").select("event_id", raw.alias("raw"))).select("event_id", "rejected", *[n[c].alias(c) for c in ("value", "value_min", "value_max")])


_SAMPLE = list(range(3, 183, 15))


@query("calibration_sample", f"select doc_id as chunk_id, sha256(text) as text_sha256 from documents where doc_id in ({', '.join(map(str, _SAMPLE))})")
def calibration_sample(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return X.calibration_sample(docs, _SAMPLE)


@query("numeric_rows", """
select l_returnflag, l_linenumber, count(*) as n from lineitem where l_linenumber > 2 and (l_linenumber % 2 = 1 or l_returnflag = 'R') group by all""")
def numeric_rows(spark, d):
    number, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = read(spark, d, "lineitem").select(
        "l_returnflag", "l_linenumber", F.when(number == 2, "").when(number > 2, "quantity").alias("parameter"),
        F.when(number % 2 == 1, F.col("l_quantity")).alias("value"), F.lit(None).cast("double").alias("value_min"), F.when(flag == "R", F.col("l_tax")).alias("value_max"),
    )
    return rows.where(Q.is_numeric_row()).groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("redundant_pairs", """
select a.o_orderkey as a, b.o_orderkey as b, contains(x, y) or contains(y, x) or substr(x, 1, 12) = substr(y, 1, 12) as redundant
from (select *, lower(trim(o_orderpriority || ' order ' || o_orderkey % 20)) as x from orders) a join (select *, lower(trim(o_orderpriority || ' order ' || o_orderkey % 20)) as y from orders) b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey""")
def redundant_pairs(spark, d):
    text = F.concat_ws(" order ", "o_orderpriority", (F.col("o_orderkey") % 20).cast("string"))
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", text.alias("text"))
    a, b = (rows.select("o_custkey", F.col("o_orderkey").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
    return a.join(b, "o_custkey").where("a < b").select("a", "b", G.redundant(F.col("text_a"), F.col("text_b")).alias("redundant"))


@query("dedup_clusters", f"""
with {_PAIRS}, g as (select id, count(*) as degree from (select a as id from p union all select b from p) group by id),
kinds as (select nation, array_to_string(list_sort(list(distinct case when length(a) % 2 = 0 then 'auto_fuzzy' else 'auto_cosine' end)), '|') as methods from p group by nation)
select root, arg_min(g.id, (-degree, g.id)) as canon_id, count(*) as members, any_value(methods) as methods from g join n using (id) join roots using (nation) join kinds using (nation) group by root""")
def dedup_clusters(spark, d):
    links = _links(spark, d)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")).withColumn("name_norm", F.col("id"))
    merged = links.select("a", "b", F.when(F.length("a") % 2 == 0, "auto_fuzzy").otherwise("auto_cosine").alias("method"), F.lit(True).alias("merge"))
    refused = read(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("b"), F.lit("llm").alias("method"), F.lit(False).alias("merge"))
    canon = R.clusters(degree, merged.unionByName(refused))[0]
    return canon.select("root", "canon_id", "members", F.array_join("methods", "|").alias("methods"))
