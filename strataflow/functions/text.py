"""Text predicates and transforms as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, markers and limits that results depend on.
PUBLICATION_MARKERS = ("ISSN", "e-mail :", "Phone :", "Subscription :", "Printing House", "Publication Frequency", "Adress :")
NOISE_MIN_CHARS, NOISE_MIN_ALNUM, NOISE_MIN_LONG_WORDS = 15, 0.55, 0.4
REFERENCE_MARKERS = ("БИБЛИОГРАФИЧЕСКИЙ СПИСОК", "СПИСОК ЛИТЕРАТУРЫ", "СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ", "REFERENCES", "ЛИТЕРАТУРА:")
NUMBERED_REFERENCE = r"\b\d{1,2}\.\s+[А-ЯA-Z][а-яa-z]+\s+[А-ЯA-Z]\."
REFERENCE_TITLES = ("список использованных источников", "список литературы", "библиографический список", "references", "библиография", "литература")
STOP_TERMS = (
    "технология", "процесс", "данные", "результат", "исследование", "работа", "метод", "система", "анализ", "показатель", "значение", "часть", "вид", "случай",
    "technology", "process", "data", "result", "research", "work", "method", "system", "analysis", "indicator", "value", "part", "type", "case",
)
QUERY_STOPWORDS = (
    "какие", "какой", "какая", "какое", "найди", "найти", "где", "кто", "что", "как", "при", "для", "или", "это", "они", "все", "всех",
    "the", "and", "for", "with", "from", "that", "this", "which", "after", "before", "year", "years", "find", "show",
)
SYNONYMS = {
    "обессоливание": "обессоливание", "desalination": "обессоливание", "деминерализация": "обессоливание",
    "выщелачивание": "выщелачивание", "leaching": "выщелачивание",
    "heap leaching": "кучное выщелачивание", "кучное выщелачивание": "кучное выщелачивание",
    "флотация": "флотация", "flotation": "флотация",
    "обратный осмос": "обратный осмос", "reverse osmosis": "обратный осмос",
    "ионный обмен": "ионный обмен", "ion exchange": "ионный обмен",
}
#: Python's white space for str.strip and \s, as a Java class.
WS = r"[\s\x1c-\x1f\u0085   -     　]"


#: The same characters one by one.
WS_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it (a plan copies expressions, not variables)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; a trim, as a pattern would look at every inner space too."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, the ends none."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def words(c: Column) -> Column:
    """Runs of anything but white space, as an array."""
    return F.filter(F.split(c, rf"{WS}+"), lambda w: w != "")


def any_contained(c: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms), F.lit(False))


def is_noise(text: Column, is_table_cell: Column | bool = False, markers=PUBLICATION_MARKERS) -> Column:
    """Boilerplate, near-empty or mostly non-alphanumeric text."""
    cell = F.lit(is_table_cell) if isinstance(is_table_cell, bool) else is_table_cell
    space = WS[1:-1]

    def judged(body):
        hits = reduce(lambda a, b: a + b, (F.contains(body, F.lit(m)).cast("int") for m in markers))
        alnum = F.length(F.array_join(F.regexp_extract_all(body, F.lit("[a-zA-Z0-9а-яА-Я]+"), F.lit(0)), "")) / F.length(body)
        # plain ASCII is tried first, as it is the quickest to tell from space
        few_long = let(F.regexp_extract_all(body, F.lit(f"[!-~[^{space}]]+"), F.lit(0)), lambda ws: F.size(F.filter(ws, lambda w: F.length(w) >= 3)) / F.size(ws) < NOISE_MIN_LONG_WORDS)
        return (
            F.when(body == "", True)
            .when(hits >= 2, True)
            .when((F.length(body) < NOISE_MIN_CHARS) & ~cell, True)
            .when(alnum < NOISE_MIN_ALNUM, True)
            .otherwise(few_long)
        )

    return let(strip(F.coalesce(text, F.lit(""))), judged)


def drop_repeated_lines(text: Column, longer_than: int = 20) -> Column:
    """Later copies of any line whose stripped form is longer than ``longer_than`` go; order stays.

    Lines sorted by their stripped form and place bring copies together, the first
    ahead; what stays is sorted by place again, so the cost is n log n in the lines.
    """
    by_key = F.sort_array(F.transform(F.split(text, "\n", -1), lambda line, at: F.struct(strip(line).alias("key"), at.alias("at"), line.alias("line"))))

    def firsts(rows):
        kept = F.filter(rows, lambda r, i: (F.length(r["key"]) <= longer_than) | (i == 0) | (F.get(rows, i - 1)["key"] != r["key"]))
        return F.array_join(F.transform(F.sort_array(F.transform(kept, lambda r: F.struct(r["at"], r["line"]))), lambda r: r["line"]), "\n")

    return let(by_key, firsts)


def reference_reason(text: Column, markers=REFERENCE_MARKERS, head: int = 200, heuristic_head: int = 800, least: int = 4) -> Column:
    """The marker that makes a chunk bibliography, 'numbered-refs-heuristic', or null."""
    upper = F.upper(F.substring(text, 1, head))
    hits = [F.when(F.contains(upper, F.lit(m)), F.lit(m)) for m in markers]
    numbered = F.regexp_count(F.substring(text, 1, heuristic_head), F.lit(f"(?U){NUMBERED_REFERENCE}")) >= least
    return F.coalesce(*hits, F.when(numbered, F.lit("numbered-refs-heuristic")))


def script_language(text: Column) -> Column:
    """'en' if Latin letters outnumber Cyrillic ones, else 'ru' (also for text without letters)."""
    return F.when(F.regexp_count(text, F.lit("[A-Za-z]")) > F.regexp_count(text, F.lit("[а-яА-ЯёЁ]")), "en").otherwise("ru")


def is_suspicious_name(c: Column) -> Column:
    """Too short, digits only, or a short code without Cyrillic."""
    s = F.lower(strip(c))
    return (F.length(s) < 4) | s.rlike(r"^[0-9]+\z") | s.rlike(r"^[a-z0-9]{1,6}\z")


def canonical_name(c: Column) -> Column:
    """Synonyms map to one name; others keep their own, trimmed."""
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.coalesce(table[collapse(F.lower(c))], strip(c))


def author_hint(file_name: Column) -> Column:
    """'Surname I.O.' from a file name, by patterns in order of priority; null if none fits."""
    name = F.lit("")

    def grab(pattern, group):
        return F.nullif(F.regexp_extract(file_name, pattern, group), name)

    def initials(pattern):
        return F.when(file_name.rlike(pattern), F.concat(grab(pattern, 1), F.lit(" "), grab(pattern, 2), F.lit("."), grab(pattern, 3), F.lit(".")))

    def tidy(c):
        full = r"^([А-ЯЁ][а-яё]+)\s+([А-ЯЁ])\.?\s*([А-ЯЁ])\.?$"
        return F.when(c.rlike(full), F.concat(F.regexp_extract(c, full, 1), F.lit(" "), F.regexp_extract(c, full, 2), F.lit("."), F.regexp_extract(c, full, 3), F.lit("."))).otherwise(c)

    return F.coalesce(
        tidy(strip(grab(r"(?i)Доклад_(.+)\.(pdf|docx|pptx|potx)$", 1))),
        initials(r"([А-ЯЁ][а-яё]{2,})_([А-ЯЁ])_?([А-ЯЁ])"),
        initials(r"([А-ЯЁ][а-яё]{2,}) ([А-ЯЁ])\.\s?([А-ЯЁ])\.?"),
        tidy(strip(grab(r"^([А-ЯЁ][а-яё]+ [А-ЯЁ]\.? ?[А-ЯЁ]\.?)[ _]", 1))),
        F.replace(grab(r"^([A-Z][a-z]+_[A-Z][a-z]+)_", 1), F.lit("_"), F.lit(" ")),
    )


DOC_TYPES = {"Доклады": "presentation", "Статьи": "article", "Справочники": "reference", "Нормативы": "reference", "Отчёты": "report", "Отчеты": "report"}
SOURCES_MARKER, JOURNALS = "Источники информации/", "Журналы"


def source_meta(key: Column) -> Column:
    """struct(category, venue, year, doc_type) from the path behind the corpus marker."""
    parts = F.filter(F.split(F.regexp_extract(key, rf"(?s){SOURCES_MARKER}(.*)", 1), "/"), lambda p: p != "")
    category = F.get(parts, F.lit(0))
    journal = (category == JOURNALS) & (F.size(parts) >= 3)
    year = F.get(parts, F.lit(2))
    types = F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])
    return F.struct(
        category.alias("category"),
        F.when(journal, F.get(parts, F.lit(1))).alias("venue"),
        F.when(journal & year.rlike(r"^\d{4}\z"), year.try_cast("int")).alias("year"),
        F.when(journal, "journal_issue").otherwise(F.coalesce(types[category], F.lit("report"))).alias("doc_type"),
    )


def content_id(content: Column) -> Column:
    """'doc_' and 12 hex digits of the SHA-256."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 12))


def strip_json_fence(c: Column) -> Column:
    """Text inside a leading triple-backtick fence (tagged json or not)."""
    s = strip(c)
    return F.when(F.startswith(s, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(s, r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", ""))).otherwise(s)


def lenient_double(c: Column) -> Column:
    """A decimal comma and spaces inside numbers are accepted; null if it is no number."""
    return F.replace(F.replace(strip(c), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def query_terms(c: Column) -> Column:
    """Lower-cased word tokens of four characters or more, without stop words, in order."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\wЀ-ӿ]+)"), F.lit(1))
    return F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(*QUERY_STOPWORDS))


def trim_at_sentence(c: Column, size: int) -> Column:
    """Collapsed text cut to ``size``, at the last sentence end behind the middle if there is one."""
    s = collapse(c)
    head = F.substring(s, 1, size)

    def last(sep):
        return F.when(F.contains(head, F.lit(sep)), F.length(head) - F.locate(sep[::-1], F.reverse(head)) - 1)

    ends = [F.when(last(sep) > size // 2, F.rtrim(F.substring(head, F.lit(1), last(sep) + 1))) for sep in (". ", "! ", "? ")]
    return F.when(F.length(s) <= size, s).otherwise(F.coalesce(*ends, F.concat(F.rtrim(head), F.lit("…"))))


def snippet(c: Column, size: int = 400) -> Column:
    s = collapse(c)
    return F.when(F.length(s) <= size, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, size)), F.lit("…")))


def strip_citations(answer: Column, valid: Column) -> Column:
    """Without [doc:id] marks whose id is not in the array ``valid``."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[doc:([^\]]+)\]"), F.lit(1)))
    return F.aggregate(F.array_except(cited, valid), answer, lambda t, i: F.replace(t, F.concat(F.lit("[doc:"), i, F.lit("]")), F.lit("")))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def rows_to_markdown(rows: Column) -> Column:
    """A table (array of arrays of cells) as markdown: the first row is the header, rows are padded to the widest."""
    width = F.array_max(F.transform(rows, F.size))
    clean = F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), F.array_repeat(F.lit(""), width - F.size(r))))
    rule = F.array(markdown_row(F.array_repeat(F.lit("---"), width)))
    body = F.transform(clean, markdown_row)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), rule, F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")).otherwise("")


def drop_repeated_cells(cells: Column) -> Column:
    """Runs of equal cells (merged cells of office tables) become one."""
    return F.filter(cells, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(cells, i - 1)))


def is_header_row(cells: Column) -> Column:
    """At least half of the non-empty cells hold a letter."""
    full = F.filter(cells, lambda c: F.trim(c) != "")
    return (F.size(full) > 0) & (F.size(F.filter(full, lambda c: c.rlike(r"\p{L}"))) * 2 >= F.size(full))


def office_table(rows: Column) -> Column:
    """Markdown of an office table: merged cells collapse, two header rows join, none gives col1 to colN."""
    none = F.lit("")

    def merged(a, b):
        return F.when(a == b, a).otherwise(F.array_join(F.filter(F.array(a, b), lambda x: x != ""), " / "))

    def fitted(rows, header, skip):
        body = F.slice(rows, skip + 1, F.greatest(F.size(rows) - skip, F.lit(0)))
        return F.transform(body, lambda r: F.slice(F.concat(r, F.array_repeat(none, F.greatest(F.size(header) - F.size(r), F.lit(0)))), F.lit(1), F.size(header)))

    def table(rows):
        first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
        two = is_header_row(first) & F.coalesce(is_header_row(second), F.lit(False)) & (F.size(rows) > 2)
        joined = F.zip_with(first, second, lambda a, b: merged(F.coalesce(a, none), F.coalesce(b, none)))
        named = F.transform(F.sequence(F.lit(1), F.array_max(F.transform(rows, F.size))), lambda i: F.concat(F.lit("col"), i.cast("string")))
        head = F.when(two, F.struct(joined.alias("cells"), F.lit(2).alias("skip"))).when(is_header_row(first), F.struct(first.alias("cells"), F.lit(1).alias("skip"))).otherwise(F.struct(named.alias("cells"), F.lit(0).alias("skip")))
        whole = let(head, lambda h: let(F.concat(F.array(h["cells"]), fitted(rows, h["cells"], h["skip"])), rows_to_markdown))
        return F.when(F.size(rows) > 0, whole).otherwise("")

    clean = F.transform(rows, lambda r: let(F.transform(r, lambda c: F.trim(F.coalesce(c, none))), drop_repeated_cells))
    return let(F.filter(clean, lambda r: F.exists(r, lambda c: c != "")), table)


# What readable metadata is made of, and the encodings tried in turn.
NORMAL_CHARS = r"[A-Za-z0-9\s .,;:!?'\"()\[\]{}«»/\\@#&%+–—а-яёА-ЯЁ-]"
GARBLED_MARKS = "˜ˆ€‚ƒ„…†‡‰Š‹ŒŽ•"
DECODINGS = ("cp1251", "cp866", "koi8-r", "utf-8")


def looks_garbled(c: Column) -> Column:
    """Control characters, many odd ones, typical marks, or runs of digits and signs."""
    odd = F.length(F.regexp_replace(c, NORMAL_CHARS, "")) / F.greatest(F.length(c), F.lit(1))
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | (odd > 0.15) | c.rlike(f"[{GARBLED_MARKS}]") | c.rlike(r"[=>0-9]{3,}")


def repair_metadata(c: Column) -> Column:
    """Text whose bytes were read in the wrong encoding, read in the first that gives words; null if none does.

    Only garbled values reach the Python function.
    """
    import re

    control = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")

    @F.udf("string")
    def again(raw):
        for encoding in DECODINGS if raw is not None else ():
            try:
                text = raw.encode("latin-1").decode(encoding)
            except (UnicodeError, LookupError):
                continue
            if text and not control.search(text) and sum(ch.isalpha() for ch in text) / len(text) >= 0.5:
                return text.strip() or None
        return None

    body = strip(c)
    return F.when(c.isNull() | (body == ""), F.lit(None)).when(~looks_garbled(body), body).otherwise(again(F.when(looks_garbled(body), body)))
