import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from strataflow.plans import guard, pipeline
from strataflow.plans import providers as P
from strataflow.plans.engine import Engine, Tables
from strataflow.operators import retrieval as Q
from strataflow.sources import files, office
from strataflow.streaming import events, ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def docx(*paragraphs, table=()):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table) + "</w:tbl>"
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx(*slides):
    def shape(y, text, kind=""):
        ph = f'<p:nvPr><p:ph type="{kind}"/></p:nvPr>' if kind else "<p:nvPr/>"
        return f'<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    return archive({f"ppt/slides/slide{i}.xml": f"<p:sld {A}><p:cSld><p:spTree>{''.join(shape(*s) for s in shapes)}</p:spTree></p:cSld></p:sld>" for i, shapes in enumerate(slides, 1)})


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_docx_and_pptx_blocks():
    got = office.docx_blocks(docx(("Heading1", "Title"), ("", "Body"), table=[["a", "b"], ["1", "2"]]))
    assert [(b["type"], b.get("level")) for b in got] == [("heading", 1), ("paragraph", None), ("table", None)]
    blocks, bare = office.pptx_blocks(pptx([(200, "second"), (100, "Top", "title")], []))
    assert [(b["type"], b["text"], b["page"]) for b in blocks] == [("heading", "Top", 1), ("paragraph", "second", 1)] and bare == 1


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "raw"
    (root / "sub").mkdir(parents=True)
    (root / "a.docx").write_bytes(docx(("Heading1", "Methods"), ("", "Nickel yield = 31,2 % was reached in the long experiment with matte. " * 8), table=[["metal", "share"], ["Ni", "1"]]))
    (root / "sub" / "b.pptx").write_bytes(pptx([(0, "Slide title", "title"), (10, "Some body text of the slide that is long enough to stay")]))
    (root / "broken.docx").write_bytes(b"no archive")
    (root / "note.txt").write_text("ignored")
    return root


def test_listing_parsing_and_manifest(spark, corpus):
    listing = files.with_path_metadata(files.list_files(spark, str(corpus)))
    assert {r["file_name"] for r in listing.select("file_name").collect()} == {"a.docx", "b.pptx", "broken.docx"}
    parsed = office.parse_files(listing)
    assert parsed.where("status = 'error'").count() == 1
    assert parsed.where("type = 'table'").first()["text"] == "| metal | share |\n| --- | --- |\n| Ni | 1 |"
    done = listing.limit(1).select("source_key", "etag").withColumn("status", F.lit("ok"))
    assert files.not_done(listing, done).count() == 2 and files.not_done(listing, done, force=True).count() == 3


def test_stream_ingest_is_incremental(spark, corpus, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    assert ingest.ingest_stream(spark, str(corpus), out, mark).awaitTermination(120)
    first = spark.read.parquet(out)
    assert first.select("doc_id").distinct().count() == 2
    (corpus / "c.docx").write_bytes(docx(("", "Another document with enough words to be a chunk of its own. " * 6)))
    assert ingest.ingest_stream(spark, str(corpus), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).select("doc_id").distinct().count() == 3


def test_event_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").select("start", "event_type", "n").collect())) == sorted(map(tuple, events.tumbling(rows, "1 hour").select("start", "event_type", "n").collect()))


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("g")
    assert guard.run(spark, "select id from g where id > 1 limit 2").count() == 2
    for bad in ("drop table g", "insert into g select 1", "create table x as select 1", "select from where", "set a=b", "call x()", "select id from missing"):
        assert guard.violation(spark, bad), bad
    call = "reflect('java.lang.System', 'getProperty', 'user.home')"
    hidden = ("select {}", "select id from g where id in (select {})", "select (select {}) from g", "select id from g order by {}", "select sum(id) over (order by {}) from g", "select * from g lateral view explode(array({})) t as x", "with a as (select {} as x) select * from a", "values ({})", "select transform(array(1), x -> {})", "select * from g join lateral (select {})")
    for sql in (*(h.format(call) for h in hidden), "select builtin.java_method('a', 'b')", "select * from parquet.`/tmp/x`", "select * from json.`x`", "select * from python_worker_logs()", "select input_file_name() from g"):
        assert "not allowed" in guard.violation(spark, sql), sql
    for good in ("select case when id between 1 and 2 then 'a' end, count(*) over (), lower('A') from g where id in (select id from g) limit 3", "with a as (select id from g) select count(*) from a", "select a.id from g a join g b on a.id = b.id order by 1", "select id from g union all select id from g"):
        assert guard.violation(spark, good) is None, good
    assert [guard.limit_of(x) for x in ("select 1", "select 1 limit 7", "select 1 limit 700", "select 1 limit 5 offset 3;")] == [50, 7, 50, 5]
    assert guard.within(spark, 30, lambda: spark.range(3).count()) == 3


def test_embedding_cache(spark):
    calls = []

    class Counting(P.HashingEmbedder):
        pass

    e = Counting(16)
    a = spark.createDataFrame([("c1", "nickel matte"), ("c2", "copper")], "chunk_id string, text string")
    first = P.embed(a, e).collect()
    cache = spark.createDataFrame([(r["chunk_id"], r["text_hash"], r["model"], r["vec"]) for r in first], "chunk_id string, text_hash string, model string, vec array<double>")
    b = spark.createDataFrame([("c1", "nickel matte"), ("c2", "changed")], "chunk_id string, text string")
    second = {r["chunk_id"]: r["vec"] for r in P.embed(b, e, cache.withColumn("vec", F.transform("vec", lambda x: x * 2))).collect()}
    assert second["c1"] == pytest.approx([x * 2 for x in first[0]["vec"]]) and sum(x * x for x in second["c2"]) == pytest.approx(1)
    assert not calls


def test_judge_and_backoff():
    assert P.judge_pairs([("a", "b")] * 35, lambda part: [True] * (len(part) - 1)) == [True] * 29 + [False] + [True] * 4 + [False]
    with pytest.raises(RuntimeError):
        P.judge_pairs([("a", "b")], lambda part: [])
    tries, pauses = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert P.with_backoff(call, (TimeoutError,), sleep=pauses.append) == "ok" and len(pauses) == 2 and pauses[1] > pauses[0]


def test_pipeline_from_files_to_graph(spark, corpus, tmp_path):
    out = str(tmp_path / "tables")
    assert pipeline.main(["all", "--root", str(corpus), "--out", out]) == 0
    entities = {r["name_norm"] for r in spark.read.parquet(f"{out}/entities").collect()}
    assert {"nickel", "yield"} <= entities
    edge = spark.read.parquet(f"{out}/edges").first()
    assert edge["type"] == "HAS_PROPERTY" and edge["props"]["value"] == "31.2"

    def counts():
        return {t: spark.read.parquet(f"{out}/{t}").count() for t in ("manifest", "chunks", "answers", "entities", "edges")}

    # what is done is not done again, but for the file that failed; a changed file replaces its chunks
    before = counts()
    assert before["manifest"] == 3
    assert pipeline.main(["all", "--root", str(corpus), "--out", out]) == 0
    assert counts() == before | {"manifest": 4}
    (corpus / "c.docx").write_bytes(docx(("", "Nickels yield = 12 % was reached in another long experiment with matte of copper. " * 5)))
    assert pipeline.main(["all", "--root", str(corpus), "--out", out, "--limit", "5"]) == 0
    after = counts()
    assert after["manifest"] == 6 and after["chunks"] == after["answers"] == before["chunks"] + 1

    # vectors of unchanged chunks are kept, the report counts what is there
    vectors = spark.read.parquet(f"{out}/vectors")
    assert vectors.count() == after["chunks"] == vectors.select("chunk_id").distinct().count()
    report = {r["item"]: r["n"] for r in spark.read.parquet(f"{out}/report").collect()}
    assert report["rows:chunks"] == report["rows:vectors"] == after["chunks"] and report["rows:edges"] == after["edges"]
    assert report["repeated_chunk_ids"] == report["edges_without_document"] == 0 and report["status:ok"] >= 2
    loaded = spark.read.parquet(f"{out}/load_statistics").agg(F.sum("mentions"), F.sum("admitted"), F.sum("resolved")).first()
    assert loaded[0] >= loaded[1] > 0 and loaded[2] == spark.read.parquet(f"{out}/facts").count()

    # the plan is written, applied and logged; a plan that names a lost node is refused
    merged = pipeline.step_apply(spark, out)
    plan = spark.read.parquet(f"{out}/dedup/mapping")
    assert merged == plan.count() and spark.read.parquet(f"{out}/merged/entities").count() == after["entities"] - merged
    spark.createDataFrame([("gone", "lost")], "id string, canon_id string").write.mode("overwrite").parquet(f"{out}/dedup/mapping")
    with pytest.raises(ValueError):
        pipeline.step_apply(spark, out)


def test_engine_answers(spark):
    rows = [(f"c{i}", f"doc_{i:012x}", f"Document {i}", t, "en", 2000 + i, "v", "report") for i, t in enumerate(["nickel matte smelting", "copper flotation", "heap leaching of nickel ore"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, title string, text string, lang string, year int, venue string, doc_type string")
    emb = P.HashingEmbedder(64)
    vectors = P.embed(chunks, emb).select("chunk_id", "vec")
    facts = spark.createDataFrame([("nickel", "yield", "=", 31.0, None, None, "%", 0.9, rows[2][1], 1)], "name string, parameter string, operator string, value double, value_min double, value_max double, unit string, confidence double, doc_id string, seq int")
    engine = Engine(spark, Tables(chunks, vectors, facts=facts), emb)
    r = engine.query("nickel matte", top_k=2, use_graph=False)
    assert r.mode == "vector" and "Document 0" in r.answer and r.citations.count() == 3
    r = engine.query("nickel", Q.Filters(numeric=(Q.NumericFilter("yield", 30, 40),)))
    assert r.facts.count() == 1 and r.answer.index("Document 2") < r.answer.index("Document 1")
    r = engine.query("nothing", Q.Filters(lang="xx"), use_graph=False)
    assert r.answer.startswith("## Ничего")
    with pytest.raises(ValueError):
        engine.document_link("x", chunks)
    assert engine.health() == {"spark": "ok"}


def test_extraction_is_asked_again_only_on_failure(spark):
    chunks = spark.createDataFrame([("c", "d", "Nickel yield = 31,2 %")], "chunk_id string, doc_id string, text string")
    r = P.extract(chunks, P.RuleExtractor()).first()
    assert r["retries"] == 0 and json.loads(r["raw"])["relations"][0]["numeric"]["value"] == "31,2"
