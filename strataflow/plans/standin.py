"""Corpus and graph tables derived from the plain test tables, with the same derivation in SQL.

Documents stand for publications and their chunks, embeddings for chunk vectors,
parts, suppliers, nations, customers and orders for a graph of materials,
organizations, facilities, experts and publications, line items for numeric facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.schemas import NUMERIC
from strataflow.sources.tables import read

CHUNKS_SQL = """chunks as (select doc_id, doc_id as chunk_id, 'Document ' || doc_id as title, text, lang, source as venue, n_chars,
  case when doc_id % 11 = 0 then null else (2000 + doc_id % 25)::int end as year, case doc_id % 3 when 0 then 'report' when 1 then 'article' else 'presentation' end as doc_type from documents)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    return read(spark, d, "documents").select(
        "doc_id", doc.alias("chunk_id"), F.concat(F.lit("Document "), doc.cast("string")).alias("title"), "text", "lang", F.col("source").alias("venue"), "n_chars",
        F.when(doc % 11 != 0, (2000 + doc % 25).cast("int")).alias("year"), F.when(doc % 3 == 0, "report").when(doc % 3 == 1, "article").otherwise("presentation").alias("doc_type"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


#: A fixed query vector: one direction that no row favours.
QUERY = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::double" for x in QUERY) + "]"
SCORES_SQL = f"scores as (select vec_id as chunk_id, round(list_dot_product(embedding::double[], {_Q}) / sqrt(list_dot_product({_Q}, {_Q})) / sqrt(list_dot_product(embedding::double[], embedding::double[])), 9) as score from embeddings)"

LINES_SQL = "lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls)))::int as ord from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))


MENTIONS_SQL = """mentions as (select 'doc_' || p_size as doc_id, 'c_' || p_partkey as chunk_id, p_partkey as ord, 'Material' as label, p_name as name, lower(p_name) as name_norm, [p_brand, p_type] as aliases, p_brand as geography, (p_partkey % 100) / 100.0::double as confidence from part
  union all select 'doc_' || s_nationkey, 'c_' || s_suppkey, s_suppkey, 'Organization', s_name, lower(s_name), [s_name], 'WORLD', (s_suppkey % 100) / 100.0::double from supplier
  union all select 'doc_' || c_nationkey, 'c_' || c_custkey, c_custkey, 'Process', c_mktsegment, lower(c_mktsegment), [c_name], 'RU', (c_custkey % 100) / 100.0::double from customer)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    def rows(table, doc, key, label, name, aliases, geo):
        return read(spark, d, table).select(
            F.concat(F.lit("doc_"), F.col(doc).cast("string")).alias("doc_id"), F.concat(F.lit("c_"), F.col(key).cast("string")).alias("chunk_id"), F.col(key).alias("ord"), F.lit(label).alias("label"), F.col(name).alias("name"),
            F.lower(name).alias("name_norm"), F.array(*aliases).alias("aliases"), geo.alias("geography"), ((F.col(key) % 100) / 100.0).alias("confidence"),
        )

    a = rows("part", "p_size", "p_partkey", "Material", "p_name", ["p_brand", "p_type"], F.col("p_brand"))
    b = rows("supplier", "s_nationkey", "s_suppkey", "Organization", "s_name", ["s_name"], F.lit("WORLD"))
    c = rows("customer", "c_nationkey", "c_custkey", "Process", "c_mktsegment", ["c_name"], F.lit("RU"))
    return a.unionByName(b).unionByName(c).withColumn("source_doc", F.col("doc_id")).withColumn("source_chunk", F.col("chunk_id"))


NODES_SQL = """nodes as (select 'm:' || lower(p_name) as id, 'Material' as label, min(p_name) as name, lower(p_name) as name_norm, list_sort(list(distinct p_brand)) as aliases, max(p_size) / 50.0::double as confidence from part group by lower(p_name)
  union all select 'o:' || s_suppkey, 'Organization', s_name, lower(s_name), [], 0.9::double from supplier
  union all select 'f:' || n_nationkey, 'Facility', n_name, lower(n_name), [], 0.7::double from nation
  union all select 'x:' || c_custkey, 'Expert', c_name, lower(c_name), [], 0.5::double from customer
  union all select 'd:' || o_orderkey, 'Publication', 'Order ' || o_orderkey, null, [], null from orders)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")

    def of(table, prefix, key, label, name, conf, norm=True):
        n = name if not isinstance(name, str) else F.col(name)
        return read(spark, d, table).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), n.alias("name"), (F.lower(n) if norm else F.lit(None).cast("string")).alias("name_norm"), none.alias("aliases"), F.lit(conf).cast("double").alias("confidence"))

    low = F.lower("p_name")
    material = read(spark, d, "part").groupBy(low.alias("name_norm")).agg(F.min("p_name").alias("name"), F.array_sort(F.collect_set("p_brand")).alias("aliases"), (F.max("p_size") / 50.0).alias("confidence"))
    material = material.select(F.concat(F.lit("m:"), "name_norm").alias("id"), F.lit("Material").alias("label"), "name", "name_norm", "aliases", "confidence")
    out = material
    for part in (of("supplier", "o:", "s_suppkey", "Organization", "s_name", 0.9), of("nation", "f:", "n_nationkey", "Facility", "n_name", 0.7), of("customer", "x:", "c_custkey", "Expert", "c_name", 0.5), of("orders", "d:", "o_orderkey", "Publication", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), None, False)):
        out = out.unionByName(part)
    return out


FACTS_SQL = """facts as (select 'o:' || l_suppkey as src, 'has_property' as type, 'm:' || lower(p_name) as dst, 'd:' || l_orderkey as source_doc, l_orderkey * 8 + l_linenumber as ord, 'quantity' as parameter, '=' as operator, l_quantity as value, 'pcs' as unit, round(1 - l_discount, 6) as confidence
  from lineitem join part on l_partkey = p_partkey)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return rows.select(
        text("o:", "l_suppkey").alias("src"), F.lit("has_property").alias("type"), F.concat(F.lit("m:"), F.lower("p_name")).alias("dst"), text("d:", "l_orderkey").alias("source_doc"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.lit("quantity").alias("parameter"), F.lit("=").alias("operator"), F.col("l_quantity").alias("value"), F.lit(None).cast("double").alias("value_min"), F.lit(None).cast("double").alias("value_max"), F.lit("pcs").alias("unit"), F.round(1 - F.col("l_discount"), 6).alias("confidence"),
    )


RANGES_SQL = """ranges as (select p_brand as name, l_suppkey as supp, 'price' as parameter, 'range' as operator, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem join part on l_partkey = p_partkey group by p_brand, l_suppkey)"""


def ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("name"), F.col("l_suppkey").alias("supp")).agg(F.lit("price").alias("parameter"), F.lit("range").alias("operator"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


EDGES_SQL = f"""{FACTS_SQL}, edges as (select distinct src, type, dst from facts
  union all select distinct dst, 'described_in', source_doc from facts
  union all select 'd:' || o_orderkey, 'authored_by', 'x:' || o_custkey from orders
  union all select 'o:' || s_suppkey, 'affiliated_with', 'f:' || s_nationkey from supplier
  union all select 'x:' || c_custkey, 'affiliated_with', 'f:' || c_nationkey from customer)"""
DEGREES_SQL = "degrees as (select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by id)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        f.select("src", "type", "dst").distinct(),
        f.select(F.col("dst").alias("src"), F.lit("described_in").alias("type"), F.col("source_doc").alias("dst")).distinct(),
        read(spark, d, "orders").select(text("d:", "o_orderkey").alias("src"), F.lit("authored_by").alias("type"), text("x:", "o_custkey").alias("dst")),
        read(spark, d, "supplier").select(text("o:", "s_suppkey").alias("src"), F.lit("affiliated_with").alias("type"), text("f:", "s_nationkey").alias("dst")),
        read(spark, d, "customer").select(text("x:", "c_custkey").alias("src"), F.lit("affiliated_with").alias("type"), text("f:", "c_nationkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ENTITIES_SQL = """ents as (select 'd:' || o_custkey as doc_id, 'c:' || o_orderkey as chunk_id, t.ord, t.tmp_id, t.label, t.k, t.confidence, t.alias from orders,
  lateral (values (0, 'e1', 'Material', lower(o_orderpriority) || ' ' || o_orderkey % 7, (o_orderkey % 10) / 10.0::double, o_orderpriority), (1, 'e2', 'Process', lower(o_orderstatus) || ' process', (o_custkey % 10) / 10.0::double, o_orderstatus)) t(ord, tmp_id, label, k, confidence, alias))"""
RELATIONS_SQL = """rels as (select 'd:' || o_custkey as doc_id, 'c:' || o_orderkey as chunk_id, t.ord, t.source, t.target, t.type, (o_orderkey % 10) / 10.0::double as confidence, o_totalprice as price, o_orderkey % 2 = 0 as has_unit from orders,
  lateral (values (0, 'e1', 'e2', 'relates_to'), (1, 'DOC', 'e1', 'described_in'), (2, 'e2', case when o_orderkey % 3 = 0 then 'e9' else 'DOC' end, 'has_property'), (3, 'DOC', 'DOC', 'part_of')) t(ord, source, target, type))"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Extraction records, one an order: two entities, and relations between them, the document and an unknown id."""
    none_n, none_a = F.lit(None).cast(NUMERIC), F.lit(None).cast("map<string,string>")
    order, conf = F.col("o_orderkey"), (F.col("o_orderkey") % 10) / 10.0

    def entity(tmp, label, norm, alias, confidence):
        return F.struct(F.lit(tmp).alias("tmp_id"), F.lit(label).alias("type"), norm.alias("name"), norm.alias("name_norm"), F.array(alias).alias("aliases"), F.lit("WORLD").alias("geography"), confidence.alias("confidence"))

    def relation(source, target, type_, numeric=none_n, attrs=none_a):
        return F.struct(F.lit(source).alias("source"), target.alias("target"), F.lit(type_).alias("type"), numeric.alias("numeric"), attrs.alias("attrs"), conf.alias("confidence"))

    price = F.struct(F.lit("price").alias("parameter"), F.lit("=").alias("operator"), F.col("o_totalprice").alias("value"), F.lit(None).cast("double").alias("value_min"), F.lit(None).cast("double").alias("value_max"), F.lit("usd").alias("unit"))
    unit = F.when(order % 2 == 0, F.create_map(F.lit("unit"), F.lit("eur")))
    entities = F.array(
        entity("e1", "Material", F.concat_ws(" ", F.lower("o_orderpriority"), (order % 7).cast("string")), F.col("o_orderpriority"), conf),
        entity("e2", "Process", F.concat(F.lower("o_orderstatus"), F.lit(" process")), F.col("o_orderstatus"), (F.col("o_custkey") % 10) / 10.0),
    )
    relations = F.array(
        relation("e1", F.lit("e2"), "relates_to"), relation("DOC", F.lit("e1"), "described_in"),
        relation("e2", F.when(order % 3 == 0, "e9").otherwise("DOC"), "has_property", price, unit), relation("DOC", F.lit("DOC"), "part_of"),
    )
    doc, chunk = F.concat(F.lit("d:"), F.col("o_custkey").cast("string")), F.concat(F.lit("c:"), order.cast("string"))
    return read(spark, d, "orders").select(doc.alias("doc_id"), chunk.alias("chunk_id"), doc.alias("source_doc"), chunk.alias("source_chunk"), F.struct(entities.alias("entities"), relations.alias("relations")).alias("result"))
