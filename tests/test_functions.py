import random

import pytest
from pyspark.sql import functions as F

from strataflow.functions import similarity as M
from strataflow.functions import text as T
from strataflow.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "noisy"), [("", True), ("  \n ", True), ("ISSN 12 Printing House of a journal and more", True), ("short", True), ("медный концентрат и никелевый штейн", False), ("----- ***** ===== +++++ a b", True), ("a b c d e f g h i j k l m n", True)])
def test_noise(spark, text, noisy):
    assert one(spark, T.is_noise(F.col("t")), t=text) is noisy


def test_noise_spares_short_table_cells(spark):
    assert one(spark, T.is_noise(F.col("t"), is_table_cell=True), t="nickel 31.2") is False


def test_repeated_lines_keep_short_and_first(spark):
    long = "a line that is longer than twenty characters"
    assert one(spark, T.drop_repeated_lines(F.col("t")), t=f"{long}\nno\n {long} \nno\nlast") == f"{long}\nno\nno\nlast"


def test_reference_reasons(spark):
    assert one(spark, T.reference_reason(F.col("t")), t="Список литературы\n1. ...") == "СПИСОК ЛИТЕРАТУРЫ"
    refs = " ".join(f"{i}. Иванов И. Название." for i in range(1, 6))
    assert one(spark, T.reference_reason(F.col("t")), t=refs) == "numbered-refs-heuristic"
    assert one(spark, T.reference_reason(F.col("t")), t="plain text") is None


def test_names_and_languages(spark):
    assert one(spark, T.canonical_name(F.col("t")), t="  Heap   Leaching ") == "кучное выщелачивание"
    assert one(spark, T.canonical_name(F.col("t")), t=" Own Name ") == "Own Name"
    assert one(spark, T.script_language(F.col("t")), t="nickel matte") == "en"
    assert one(spark, T.script_language(F.col("t")), t="никель") == "ru"
    assert [one(spark, T.is_suspicious_name(F.col("t")), t=x) for x in ("abc", "12345", "ab12", "никелевый", "long enough")] == [True, True, True, False, False]


@pytest.mark.parametrize(("name", "hint"), [("Доклад_Петров И.И..pptx", "Петров И.И."), ("Отчет Сидоров_А_Б 2020.pdf", "Сидоров А.Б."), ("x Иванов П. С. plan.docx", "Иванов П.С."), ("Smith_John_paper.pdf", "Smith John"), ("notes.pdf", None)])
def test_author_hints(spark, name, hint):
    assert one(spark, T.author_hint(F.col("t")), t=name) == hint


def test_source_meta(spark):
    meta = one(spark, T.source_meta(F.col("t")), t="raw/Источники информации/Журналы/Цветные металлы/2019/n1.pdf")
    assert tuple(meta) == ("Журналы", "Цветные металлы", 2019, "journal_issue")
    assert tuple(one(spark, T.source_meta(F.col("t")), t="raw/Источники информации/Доклады/a.pptx")) == ("Доклады", None, None, "presentation")
    assert tuple(one(spark, T.source_meta(F.col("t")), t="elsewhere/a.pdf")) == (None, None, None, "report")


def test_json_fences_and_numbers(spark):
    assert one(spark, T.strip_json_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.strip_json_fence(F.col("t")), t=' {"a": 1} ') == '{"a": 1}'
    assert [one(spark, T.lenient_double(F.col("t")), t=x) for x in ("1 234,5", " 7 ", "x", None)] == [1234.5, 7.0, None, None]


def test_terms_sentences_and_citations(spark):
    assert one(spark, T.query_terms(F.col("t")), t="Какие методы обессоливания with Reverse osmosis?") == ["методы", "обессоливания", "reverse", "osmosis"]
    assert one(spark, T.trim_at_sentence(F.col("t"), 20), t="One two three. Four five six seven") == "One two three."
    assert one(spark, T.trim_at_sentence(F.col("t"), 10), t="abcdefghijklmnop") == "abcdefghij…"
    assert one(spark, T.strip_citations(F.col("t"), F.col("v")), t="a [doc:1] b [doc:2]", v=["1"]) == "a [doc:1] b "


def test_tables(spark):
    rows = F.lit([["a", "b"], ["1", "2", "3"]]) if False else F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit(None), F.lit("3")))
    assert one(spark, T.rows_to_markdown(rows), t="") == "| a | b |  |\n| --- | --- | --- |\n| 1 |  | 3 |"
    merged = F.array(*[F.array(*[F.lit(c) for c in r]) for r in (["Metal", "Metal", "Yield"], ["name", "grade", "share"], ["Ni", "1", "2"])])
    assert one(spark, T.office_table(merged), t="").split("\n")[0] == "| Metal / name | Yield / grade | share |"
    bare = F.array(*[F.array(*[F.lit(c) for c in r]) for r in (["1", "2"], ["3", "4"])])
    assert one(spark, T.office_table(bare), t="").split("\n")[0] == "| col1 | col2 |"


def test_similarities():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert M.lcs_length(a, b) == slow(a, b)
    assert M.token_sort_ratio("nickel matte", "matte nickel") == 100
    assert M.token_set_ratio("matte", "nickel matte") == 100
    assert M.indel_ratio("", "") == 100 and M.token_set_ratio("", "a") == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    row = df.select(V.cosine(F.col("a"), F.col("b")), V.dot_literal(F.col("a"), [1, 2]), V.unit(F.col("a"))).first()
    assert row[0] == pytest.approx(0.96) and row[1] == 11 and row[2] == [0.6, 0.8]


def test_metadata_repair(spark):
    broken = "Петров Иван".encode("cp1251").decode("latin-1")
    assert one(spark, T.repair_metadata(F.col("t")), t=broken) == "Петров Иван"
    assert one(spark, T.repair_metadata(F.col("t")), t=" Plain Name ") == "Plain Name"
    assert one(spark, T.repair_metadata(F.col("t")), t="\x01\x02===") is None
    assert one(spark, T.repair_metadata(F.col("t")), t="  ") is None
