"""The pipeline against a brute-force version of its stages."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def test_stages_have_the_documented_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_pipeline_matches_brute_force(spark):
    import tiktoken
    from strataflow.llm import bpe

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    source = {i: s for i, _, s in docs}
    text = {i: t for i, t, _, _ in brute.line_dedup([(i, t) for i, t, _ in docs])}
    group = brute.components(list(text.items()), 5, 80)
    text = {i: t for i, t in text.items() if group[i][1] == i}
    taken = brute.mix([(i, t, source[i]) for i, t in text.items()])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load(path, public_tokenizers.PATTERN).ranks
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in text.items():
        ids = tok.encode_ordinary(t)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)
        expected += [row] * taken[i]
    got = [(r[0], r[1], r[2], r[3], list(r[4])) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(got) == sorted(expected)
    assert len(got) > 100


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_survive_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, hash long"
    rows = [(1, None, None, None, None, "a", 1, 1), (None, "the word", "en", "s", 8, None, None, None), (2, "", "en", None, 0, "", 0, 0), (2, "", "en", None, 0, "", 0, 0), (3, "x " * 50_000, "de", "t", 1, "b", 2, 3)]
    docs = spark.createDataFrame(rows, schema)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, "")
    assert stage == 4 or out.columns == docs.columns
    assert out.collect() is not None
    assert run(spark, docs.limit(0), "").collect() == []
