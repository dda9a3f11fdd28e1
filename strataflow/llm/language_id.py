"""Language ID (operator 1): families first, then one-versus-one SVMs within one.

A text becomes the square roots of the shares of its hashed byte n-grams (1 to 4
bytes of its lower-cased words).  Linear support vector machines, one for each pair
of families, vote for a family; one for each pair of languages of that family, then
votes for a language.  They are trained by dual coordinate descent on labelled rows,
at most ``PER_LANGUAGE`` of a language and ``SAMPLE`` in all, chosen by a hash of the
id; whole texts are used, and pieces of them so that short texts are met as well.

Languages that ``FAMILIES`` does not list are each a family of their own.

Defined results: ``und`` with score 0 if the text is null or has no letter or
nothing could be learned; with one language only, that language with score 1; ties
of votes go to the larger sum of margins, then the first by name; rows that repeat
an id are predicted alike if their texts are; null ids are not held out and not
learned from; a text of any length counts whole, in memory in proportion to it; extra
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import free_others, lean

#: Language families by ISO code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Bounds of the sample that the machines are fitted to.
PER_LANGUAGE, SAMPLE = 400, 8_000
DIM_BITS, EPOCHS, COST = 15, 8, 4.0
#: Margin to score: the score is 1 / (1 + exp(-STEEP * margin)).
STEEP = 4.0
UND = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of text that one pass of array operations handles.
_SLAB = 1 << 18


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed byte n-grams, or None if there is no letter."""
    words = _WORD.findall(text.lower())
    if not words:
        return None
    raw = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
    total = np.zeros(1 << DIM_BITS, np.int64)
    shift = np.uint32(32 - DIM_BITS)
    for at in range(0, len(raw), _SLAB):
        b = raw[at : at + _SLAB + 3].astype(np.uint32)  # three bytes more, for the n-grams that cross
        code, n = b + np.uint32(1), min(len(b), _SLAB)
        for k in range(1, 5):
            if k > 1:
                code = code[:-1] * np.uint32(257) + b[k - 1 :] + np.uint32(1)
            total += np.bincount((code[:n] * np.uint32(2654435761) + np.uint32(k * 97) * np.uint32(40503)) >> shift, minlength=1 << DIM_BITS)
            if not len(code):
                break
    return total


def vector(text: str) -> np.ndarray | None:
    c = counts(text)
    return None if c is None else np.sqrt(c / c.sum()).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM on sparse unit rows (indexes, values); y is +1 or -1."""
    w = np.zeros((1 << DIM_BITS) + 1)
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = y[i] * (w[at] @ x + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost * share[int(y[i])])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    #: (scope, first, second) of each column of ``weights``; scope is "" for families
    machines: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def _vote(self, scope: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The winner of the machines of ``scope`` and its smallest margin (infinite if alone)."""
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for (s, a, b), m in zip(self.machines, margins.tolist(), strict=True):
            if s == scope:
                votes[a if m > 0 else b] += 1
                for name, v in ((a, m), (b, -m)):
                    sums[name] += v
                    least[name] = min(least[name], v)
        best = min(names, key=lambda n: (-votes[n], -sums[n], n))
        return best, least[best]

    def predict(self, text: str) -> tuple[str, float]:
        x = vector(text) if self.languages else None
        if x is None:
            return UND, 0.0
        margins = x @ self.weights + self.bias if self.machines else np.zeros(0)
        family, sure = self._vote("", self.families, margins)
        language, within = self._vote(family, self.members[family], margins)
        margin = min(sure, within)
        return language, 1.0 if np.isinf(margin) else float(1 / (1 + np.exp(-STEEP * margin)))


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]]:
    """(language, sparse rows of the text and of pieces of it), a bounded number, in a fixed order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    most = max(1, min(PER_LANGUAGE, SAMPLE // len(sizes)))  # of more than SAMPLE languages, one text each
    spread = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)).alias("spread")
    # a hash threshold a language, half as wide again as the wanted number, then the lowest hashes
    limits = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, (1.5 * most + 30) / n) * (1 << 30))])
    rows = rows.withColumn("spread", spread).where(F.col("spread") <= limits[F.col("lang")])

    def run(batches):
        for batch in batches:
            out = []
            for lang, spread, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = value.as_py().decode("utf-8", "replace")
                size, at = len(text), spread.as_py()
                for k, width in enumerate((size, 120, 40, 15)):
                    start = (at * (k + 1) * 7919) % max(1, size - width + 1)
                    x = vector(text[start : start + width]) if k == 0 or size > width else None
                    if x is not None:
                        idx = np.flatnonzero(x).astype(np.int32)
                        out.append((lang.as_py(), at, k, idx.tobytes(), x[idx].tobytes()))
            types = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "spread", "k", "i", "x"])

    got = sorted(map(tuple, rows.select("lang", "spread", "text").mapInArrow(lean(run), "lang string, spread long, k int, i binary, x binary").collect()))
    out, last, used = [], None, {}
    for lang, at, _, i, x in got:
        if last != (lang, at):
            last = (lang, at)
            used[lang] = used.get(lang, 0) + 1
            if used[lang] <= most:
                out.append((lang, []))
        if used[lang] <= most:
            out[-1][1].append((np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the machines to rows that are not held out."""
    sample = _sample(docs, id_col, text_col, lang_col)
    by_language: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, rows in sample:
        by_language.setdefault(lang, []).extend(rows)
    model = Model(sorted(by_language))
    for lang in model.languages:
        model.members.setdefault(FAMILY.get(lang.lower().split("-")[0], lang), []).append(lang)
    model.families = sorted(model.members)
    scopes = [("", {f: [r for m in model.members[f] for r in by_language[m]] for f in model.families})]
    scopes += [(f, {m: by_language[m] for m in model.members[f]}) for f in model.families]
    columns = []
    for scope, groups in scopes:
        for a, b in combinations(sorted(groups), 2):
            y = np.array([1] * len(groups[a]) + [-1] * len(groups[b]))
            columns.append(fit_svm(groups[a] + groups[b], y))
            model.machines.append((scope, a, b))
    if columns:
        w = np.stack(columns, axis=1)
        model.weights, model.bias = w[:-1].astype(np.float32), w[-1].astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out boolean, lang_pred string, score double) of every row, from the text alone."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [model.predict((v.as_py() or b"").decode("utf-8", "replace")) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["id", "held_out", "lang", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(lean(run), f"id {id_type}, held_out boolean, lang string, score double")
    return out.toDF(id_col, "held_out", "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in some learned language with at least ``min_score``; the columns stay.

    With ``min_score`` 0, as in the pipeline, every text with a letter is in some
    learned language: only texts without a letter go, and the classifier has no effect.
    The decision is made beside the text (an Arrow function of it), so no join on ids is needed.
    """
    model = train(docs, id_col, text_col, lang_col)

    def keeps(texts: pa.Array) -> pa.Array:
        free_others()
        out = []
        for v in texts:
            language, score = model.predict((v.as_py() or b"").decode("utf-8", "replace"))
            out.append(language != UND and score >= min_score)
        return pa.array(out, pa.bool_())

    return docs.where(F.arrow_udf(keeps, "boolean")(F.col(text_col).cast("binary")))
