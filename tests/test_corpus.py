import random

from pyspark.sql import functions as F

from strataflow.operators import blocks as B
from strataflow.operators import chunking as C
from strataflow.operators import extraction as X
from tests import slow_chunking as slow


def block(text, kind="paragraph", page=1, section="s"):
    return {"type": kind, "text": text, "page": page, "section": section}


def test_sections_fill_forward_and_end_references(spark):
    rows = [("d", 0, "paragraph", "title"), ("d", 1, "heading", "Methods"), ("d", 2, "paragraph", "x"), ("d", 3, "heading", "Referencess"), ("d", 4, "paragraph", "[1]"), ("d", 5, "heading", "  "), ("d", 6, "paragraph", "y")]
    out = B.assign_sections(spark.createDataFrame(rows, "doc_id string, ord int, type string, text string"))
    assert [r["section"] for r in out.orderBy("ord").collect()] == ["frontmatter", "Methods", "Methods", "references", "references", "untitled", "untitled"]


def test_reading_order_splits_columns(spark):
    rows = [("d", 1, x, y, 600.0, f"{n}") for n, (x, y) in enumerate([(50.0, 10.0), (350.0, 10.0), (50.0, 200.0), (350.0, 100.0)])]
    out = B.reading_order(spark.createDataFrame(rows, "doc_id string, page int, x0 double, y0 double, page_width double, text string"))
    assert [r["text"] for r in out.orderBy("rank").collect()] == ["0", "2", "1", "3"]
    few = B.reading_order(spark.createDataFrame(rows[:3], "doc_id string, page int, x0 double, y0 double, page_width double, text string"))
    assert [r["text"] for r in few.orderBy("rank").collect()] == ["0", "1", "2"]


def test_headings_by_font(spark):
    rows = [("d", 1, "Body text of a page", 10.0), ("d", 1, "Heading", 14.0), ("d", 1, "Ends with dot.", 14.0)] + [("d", 2, f"Big {i}", 14.0) for i in range(4)] + [("d", 3, "more body", 10.0)] * 6
    out = B.infer_headings(spark.createDataFrame(rows, "doc_id string, page int, text string, font_size double"))
    assert [r["text"] for r in out.where("is_heading").collect()] == ["Heading"]


def test_text_under_tables_goes(spark):
    schema = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
    text = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 100.0, 0.0, 110.0, 10.0), ("d", 2, 0.0, 0.0, 10.0, 10.0), ("d", 1, 5.0, 5.0, 5.0, 5.0)], schema)
    table = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 6.0)], schema)
    assert B.outside_tables(text, table).count() == 3


def test_chunks_cover_every_line_once_or_as_overlap():
    rng = random.Random(2)
    for _ in range(50):
        blocks = [block(" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 60))), page=None, section=f"s{rng.randint(0, 2)}") for _ in range(rng.randint(1, 25))]
        chunks = C.chunk_blocks(blocks)
        text = "\n".join(c["text"] for c in chunks)
        assert all(b["text"] in text for b in blocks)
        assert [c["n"] for c in chunks] == list(range(len(chunks)))
        assert all(len(c["text"]) >= C.SMALL_CHUNK for c in chunks) or len(chunks) == 1


def some_blocks(rng):
    out = []
    for _ in range(rng.randint(1, 25)):
        lines = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice((1, 3, 8, 40, 90)))) for _ in range(rng.choice((1, 1, 2, 4)))]
        lines = ["x" * 1300 if rng.random() < 0.03 else "the same line that is long" if rng.random() < 0.1 else x for x in lines]
        out.append((rng.choice(("paragraph",) * 6 + ("heading", "table")), rng.choice((None, 1, 1, 2)), rng.choice("ab" if rng.random() < 0.9 else ["references"]), "\n".join(lines) if rng.random() < 0.97 else " "))
    return sorted(out, key=lambda b: b[1] or 0) if rng.random() < 0.7 else out


def test_chunks_equal_the_slow_version(spark):
    rng = random.Random(11)
    docs = [some_blocks(rng) for _ in range(400)]
    rows = [(f"d{n:03d}", i, k, t, p, s) for n, blocks in enumerate(docs) for i, (k, p, s, t) in enumerate(blocks)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, page int, section string").repartition(5)
    for presentation in (False, True):
        got = {f"d{n:03d}": [] for n in range(len(docs))}
        for r in C.chunk_documents(df, presentation).orderBy("chunk_id").collect():
            got[r["doc_id"]].append((r["kind"], r["page"], r["section"], r["text"]))
        for n, blocks in enumerate(docs):
            assert got[f"d{n:03d}"] == (slow.presentation if presentation else slow.chunks)(blocks), (n, presentation)


def test_small_chunks_join_by_an_empty_line():
    out = C.merge_small([{"text": t, "kind": k} for t, k in (("a", "text"), ("b" * 300, "text"), ("| t |", "table"), ("c" * 400, "text"), ("d", "text"))])
    assert [c["text"] for c in out] == ["a\n\n" + "b" * 300, "| t |", "c" * 400 + "\n\nd"]


def test_window_overlap_and_long_lines():
    lines = [block("x" * 500, page=3), block("y" * 500), block("z" * 500), block("q" * 1300)]
    out = C.window_lines(lines)
    assert out[0]["text"] == "x" * 500 + "\n" + "y" * 500 and out[0]["page"] == 3
    assert out[1]["text"] == "y" * 500 + "\n" + "z" * 500
    assert out[-1]["text"] == "q" * 1300


def test_tables_are_atomic_with_context():
    chunks = C.chunk_blocks([block("p" * 400), block("| a |", "table"), block("r" * 400)])
    assert [c["kind"] for c in chunks] == ["text", "table", "text"]
    assert chunks[1]["text"] == "p" * 400 + "\n\n| a |"


def test_references_are_left_out():
    assert C.chunk_blocks([block("x" * 400), block("[1] someone", section="references")])[0]["text"] == "x" * 400


def test_presentations_split_long_slides():
    short = [block("a" * 300, page=1), block("b" * 300, page=1), block("c" * 300, page=2)]
    assert [len(c["text"]) for c in C.chunk_blocks(short, presentation=True)] == [601, 300]
    long = [block("a" * 1500, page=1), block("b" * 900, page=1)]
    assert len(C.chunk_blocks(long, presentation=True)) == 2


def test_chunk_documents_runs_by_document(spark):
    rows = [(d, i, "paragraph", f"text {d} {i} " * 40, 1, "s") for d in ("a", "b") for i in range(5)]
    out = C.chunk_documents(spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, page int, section string")).orderBy("chunk_id").collect()
    assert out[0]["chunk_id"] == "a_00000" and {r["doc_id"] for r in out} == {"a", "b"}


def test_answers_are_parsed_and_checked(spark):
    good = '```json\n{"entities":[{"tmp_id":"e1","type":"Material","name":"Штейн","name_norm":"штейн","aliases":[],"confidence":0.9},{"tmp_id":"e2","type":"Property","name":"x","name_norm":" x ","aliases":[],"confidence":0.9}],"relations":[{"source":"e1","target":"DOC","type":"described_in","confidence":0.7,"numeric":{"parameter":"p","operator":"=","value":"1,5","unit":"%"}},{"source":"e1","target":"e2","type":"has_property","confidence":0.7}]}\n```'
    bad = ['{"entities":[{"tmp_id":"e1","type":"Alien","name":"a","name_norm":"aa","confidence":0.5}],"relations":[]}', "not json", None]
    raw = spark.createDataFrame([(f"c{i}", "d", x) for i, x in enumerate([good, *bad])], "chunk_id string, doc_id string, raw string")
    out = X.parse_answers(raw)
    assert [r["rejected"] for r in out.orderBy("chunk_id").collect()] == [False, True, True, True]
    checked = X.postvalidate(out.where("not rejected")).first()["result"]
    assert [e["tmp_id"] for e in checked["entities"]] == ["e1"]
    assert [(r["target"], r["numeric"]) for r in checked["relations"]] == [("DOC", None)]


def test_ranges_are_normalised(spark):
    raw = '{"entities":[],"relations":[{"source":"DOC","target":"DOC","type":"has_property","confidence":0.7,"numeric":{"parameter":"p","operator":"range","value":"1","value_max":"2","unit":"%"}}]}'
    n = X.parse_answers(spark.createDataFrame([(raw,)], "raw string")).first()["result"]["relations"][0]["numeric"]
    assert (n["value"], n["value_min"], n["value_max"]) == (None, 1.0, 2.0)


def test_tolerant_records(spark):
    from strataflow import schemas as S

    rows = ['{"chunk_id":"c","doc_id":"d","result":{"entities":[],"relations":[]},"usage":{"prompt_tokens":5,"completion_tokens":2}}', '{"chunk_id":"x","doc_id":"d","result":null}']
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", S.EXTRACTION).alias("r")).select("r.*")
    out = X.read_records(df).collect()
    assert len(out) == 1 and (out[0]["source_doc"], out[0]["model"], out[0]["prompt_tokens"]) == ("d", "unknown", 5)


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    assert sorted(map(tuple, X.upsert(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert [r[0] for r in X.pending(new, old).collect()] == ["c"]
