"""The queries of the training-data operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import ann, bpe, language_id, line_dedup, lz_fingerprint, mixing, near_dedup, pii, substring_dedup, token_codec
from strataflow.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_next(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codec.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("sf_n_lines").alias("n_lines"), F.col("sf_n_dropped").alias("n_dropped"), F.sha2(F.col("sf_kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_minhash": op6_minhash,
    "op7_lz_fingerprint": op7_lz_fingerprint,
    "op8_token_output": op8_token_output,
    "op9_nearest": op9_nearest,
    "op10_line_dedup": op10_line_dedup,
}

_SPACE = r"E' \t\n\x0b\x0c\r'"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
with pieces as (select doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]') ps from documents where text is not null),
cut as (select doc_id, unnest(ps) p, unnest(range(len(ps))) pos from pieces),
placed as (select doc_id, p, coalesce(sum(length(p) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint st from cut),
words as (select doc_id, p, st, st + length(p) as en, row_number() over (partition by doc_id order by st) as n from placed where p <> ''),
windows as (select doc_id, n, st, lead(en, 49) over o as en, md5(string_agg(p, ' ') over (partition by doc_id order by n rows between current row and 49 following)) as digest from words window o as (partition by doc_id order by n)),
ranked as (select *, first_value(doc_id) over w as first_doc_id, first_value(st) over w as first_start, first_value(n) over w as first_n from windows where en is not null window w as (partition by digest order by doc_id, st)),
again as (select *, (n - lag(n) over (partition by doc_id order by n) > 50)::int as gap from ranked where doc_id <> first_doc_id or n >= first_n + 50),
runs as (select *, sum(coalesce(gap, 0)) over (partition by doc_id order by n) as run from again)
select doc_id, min(st)::bigint as start, max(en)::bigint as "end", (max(n) - min(n) + 50)::bigint as n_words, arg_min(first_doc_id, n) as first_doc_id, arg_min(first_start, n)::bigint as first_start from runs group by doc_id, run""",
    "op5_mixing": r"""
with recursive sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
src as (select source, sum(size)::bigint source_size, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w from sized group by source),
rounds(k, source, source_size, w, capped) as (
  select 0, source, source_size, w, false from src
  union all
  select k + 1, source, source_size, w, capped or (1.5 * sum(source_size) over () - coalesce(sum(case when capped then 2.0 * source_size end) over (), 0)) * w / sum(case when capped then 0 else w end) over () > 2.0 * source_size
  from rounds where k < 40),
goal as (select source, source_size, case when capped then 2.0 * source_size else (1.5 * sum(source_size) over () - coalesce(sum(case when capped then 2.0 * source_size end) over (), 0)) * w / sum(case when capped then 0 else w end) over () end::double target from rounds where k = 40),
cum as (select s.doc_id, s.size, g.source_size, g.target, floor(g.target / nullif(g.source_size, 0)) whole, sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) c from sized s join goal g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * (coalesce(whole, 0) + case when c <= target - coalesce(whole, 0) * source_size then 1 else 0 end))::bigint taken from cum""",
    "op10_line_dedup": rf"""
with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
lines as (select doc_id, unnest(ls) line, unnest(range(len(ls))) pos from cut),
keyed as (select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACE}) k from lines),
freq as (select k from keyed group by k having count(distinct doc_id) >= 10 and length(k) >= 1)
select doc_id, count(*)::bigint n_lines, count(f.k)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) kept_sha256
from keyed left join freq f on keyed.k = f.k group by doc_id""",
}
