"""Personal data (operator 4): candidate generators and gradient-boosted trees.

Base spans follow fixed formats and are always reported.  High-recall generators
propose further, overlapping spans (numbers without a country code, addresses
spelt out, card and address forms with unusual separators, addresses in colons);
boosted trees score them by format and context, and a threshold for each kind selects
those that are reported too.  It is calibrated to ``PRECISION`` on examples in layouts
(records, tables, logs) that the trees were not fitted to, which know prose only.  A
selected span never overlaps a base span or a better selected one.

The trees are trained here, on examples made by a seeded generator (invented
identifiers and look-alikes such as version numbers, sums, dates and order codes in
invented contexts), never on the corpus; training takes a second or so and the
model is a few kilobytes.

Defined results: null is empty; a text without spans has empty lists and the digest
of the empty string; rows that repeat are treated alike; ties in score go to the
earlier, then the longer span, then the kind listed first; very long texts are
scanned in linear time (each generator runs over runs of its own characters once);
extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
#: Share of true spans among those selected that the calibration asks for.
PRECISION = 0.995
EXAMPLES, SEED = 16_000, 20

#: Characters of an address before the @, and the formats (fixed values of the contract).
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does, as the match before it ends where one ends.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Generators of further candidates: a superset of what a reader might take for the kind.
_DOT = r"(?:[ \t]*(?:\.|\(dot\)|\[dot\]|\{dot\})[ \t]*|[ \t]+dot[ \t]+)"
_AT = rf"(?:[ \t]*(?:\(at\)|\[at\]|\{{at\}})[ \t]*|[ \t]+at[ \t]+)(?P<host>[A-Za-z0-9-]++)(?:{_DOT}[A-Za-z0-9-]{{2,}}+)+"
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+" + _AT, re.I)
#: The second half of a spelt-out address: where it is nowhere, there is none.
_AT_HOST = re.compile(_AT, re.I)
_AT_SIGN = re.compile(r"\(at\)|\[at\]|\{at\}|[ \t]at[ \t]")
_LABEL = re.compile(rf"{_DOT}[A-Za-z0-9-]{{2,}}+", re.I)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+|:)(?::[0-9A-Fa-f]{0,4}+){2,7}(?![0-9A-Za-z:])")
_NUMBERS = re.compile(r"(?<![A-Za-z0-9+])[0-9](?:[ ().\-/:_]{0,3}[0-9])++")
_GROUP = re.compile(r"[0-9]++")
#: What a number goes on with on either side of a span.
_GOES_ON, _WENT_ON = re.compile(r"[ ().\-/:_]{0,3}([0-9]{1,19})"), re.compile(r"([0-9]{1,19})[ ().\-/:_]{0,3}$")
_DATED = re.compile(r"(?<![0-9])(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4}) ?$")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
#: Context words by kind, for features (plain lists in natural order).
_CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "login", "connect", "ping"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay", "expires", "cvv"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "whatsapp", "contact"),
}
#: Endings that most addresses have (plain list).
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "ru", "ch", "at", "pl")
_NOT_CUES = ("version", "v", "order", "invoice", "isbn", "total", "sum", "page", "section", "serial", "sku", "date", "id", "ref", "build", "release")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed formats, by kind as listed, then start."""
    out = []
    floor, at = 0, text.find("@")
    while at >= 0:
        local = text[floor:at]
        start = floor + len(local.rstrip(_LOCAL))
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(floor, at + 1))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Further spans by the generators; they may overlap one another and the base spans."""
    out = []
    low = text.lower()
    if _AT_SIGN.search(low) and _AT_HOST.search(text):
        for m in _SPELT.finditer(text):
            # every end of a label is an end of the address, as words may follow
            out += [("email", m.start(), d.end()) for d in _LABEL.finditer(text, m.end("host"), m.end())]
    if text.count(":") > 1:
        out += [("ip", *m.span()) for m in _COLONS.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() >= 7:
                out += _number_windows(text, *m.span())
    return out


def _number_windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Consecutive digit groups of a run whose digit counts suit a kind: at most 19 for each first group."""
    out = []
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    for i, (a, _) in enumerate(groups):
        a -= a > 0 and text[a - 1] == "("
        digits = 0
        for j in range(i, len(groups)):
            b = groups[j][1]
            digits += b - groups[j][0]
            if digits > 19:
                break
            if 7 <= digits <= 15 and b - a >= 7:
                out.append(("phone", a, b))
            if 13 <= digits:
                out.append(("card", a, b))
            if 4 <= digits <= 12 and j - i == 3:
                out.append(("ip", a, b))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    near = _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]
    cues = _CUES[kind]
    sizes = [len(g) for g in groups] + [0] * 4
    seps = {c for c in span if not c.isalnum()}
    on, off = _GOES_ON.match(after), _WENT_ON.search(before[-22:])
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        *map(float, sizes[:4]),
        float(bool(digits) and luhn("".join(digits))),
        float(max((int(g) for g in groups if len(g) < 5), default=0)),
        float(span.startswith("(")),
        float("-" in seps),
        float(" " in seps),
        float("." in seps),
        float("/" in seps or ":" in seps or "_" in seps),
        float(len(seps)),
        float(sum(any(w.startswith(c) for c in cues) for w in near)),
        float(sum(w in _NOT_CUES for w in near)),
        float(before[-1:] in "$€£#" and before != ""),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum() or after[:1] in "%°€$"),
        float(sum(span.lower().count(c) for c in ("(at)", "[at]", "{at}"))),
        float(" dot " in span.lower() or "(dot)" in span.lower() or "[dot]" in span.lower() or "{dot}" in span.lower()),
        float(len(set(digits))),
        float(len(on[1]) if on else 0),
        float(len(off[1]) if off else 0),
        float(len(on[0]) - len(on[1]) if on else 0),
        float(len(off[0]) - len(off[1]) if off else 0),
        float(on is not None and after[:1] == text[start - 1 : start]),
        float(sizes[len(groups) - 1] if len(groups) <= len(sizes) and groups else 0),
        float(len({c for c in span if c in "-./:_"})),
        float(span.count(" ")),
        float(span.count("(")),
        float(len({len(g) for g in groups[:-1]})),
        float(off is not None and _DATED.search(before) is not None),
        float(re.split(r"[^a-z0-9-]+", span.lower())[-1] in _ENDINGS),
        float(re.split(r"[ \t]|\(at|\[at|\{at", span, maxsplit=1)[0].count(".") + any(c.isdigit() for c in span[:12])),
        float(span.count(":")),
        float("::" in span),
        float(sum(c in "abcdefABCDEF" for c in span) if kind == "ip" else 0),
        float(len(re.findall(r"[. \t][a-zA-Z0-9-]+", span))),
        float(re.match(r"[ \t]*(?:\.|\(dot|\[dot|\{dot|dot )[a-z0-9 ]", after) is not None),
    ]


class BoostedTrees:
    """Gradient boosting of small regression trees on the logistic loss."""

    def __init__(self, rounds: int = 140, depth: int = 3, rate: float = 0.2, least: int = 10):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.bias = 0.0
        self.trees: list[list[tuple[int, float, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        cuts = [np.unique(x[:, f]) for f in range(x.shape[1])]
        cuts = [((c[1:] + c[:-1]) / 2)[:: max(1, len(c) // 64)] for c in cuts]
        codes = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            # a tree is a full binary heap of (feature, cut, value); feature -1: leaf
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            rows = {0: np.arange(len(y))}
            for node in range(len(tree)):
                mine = rows.pop(node, None)
                if mine is None:
                    continue
                g, h = grad[mine].sum(), hess[mine].sum()
                best = (1e-6, -1, 0)
                if node < 2**self.depth - 1 and len(mine) >= 2 * self.least:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        k = codes[f][mine]
                        gl, hl, nl = (np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (grad[mine], hess[mine], None))
                        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                        gain[(nl < self.least) | (len(mine) - nl < self.least)] = 0
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], f, j)
                if best[1] < 0:
                    tree[node] = (-1, 0.0, self.rate * g / (h + 1))
                    score[mine] += tree[node][2]
                else:
                    _, f, j = best
                    tree[node] = (f, float(cuts[f][j]), 0.0)
                    low = codes[f][mine] <= j
                    rows[2 * node + 1], rows[2 * node + 2] = mine[low], mine[~low]
            self.trees.append(tree)
        return self

    def score(self, row: list[float]) -> float:
        total = self.bias
        for tree in self.trees:
            node = 0
            while (f := tree[node][0]) >= 0:
                node = 2 * node + (1 if row[f] <= tree[node][1] else 2)
            total += tree[node][2]
        return 1 / (1 + np.exp(-total))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, valid: bool) -> str:
    n = rng.choice((13, 14, 15, 16, 16, 16, 19))
    d = rng.choice("3456") + _digits(rng, n - 2)
    check = next(c for c in "0123456789" if luhn(d + c))
    last = check if valid else str((int(check) + rng.randint(1, 9)) % 10)
    d, sep = d + last, rng.choice((" ", "-", ".", "", ""))
    if n == 15 and rng.random() < 0.7:
        return sep.join((d[:4], d[4:10], d[10:]))
    return sep.join(d[i : i + 4] for i in range(0, len(d), 4))


def _phone(rng: random.Random, form: int, sep: str, code: str) -> str:
    if form == 0:
        return f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"
    if form == 1:
        return sep.join((_digits(rng, 3), _digits(rng, 3), _digits(rng, 4)))
    if form == 4:
        return f"{_digits(rng, 3)}-{_digits(rng, 4)}"
    return sep.join(("0" + _digits(rng, 3), _digits(rng, 6))) if form == 2 else f"00{code} {_digits(rng, 3)} {_digits(rng, 7)}"


def _colons(rng: random.Random) -> str:
    """An address of eight groups, or of fewer with a gap."""
    groups = [f"{rng.randrange(1 << rng.choice((4, 12, 16, 16))):x}" for _ in range(8)]
    if rng.random() < 0.6:
        a = rng.randint(1, 4)
        return ":".join(groups[:a]) + "::" + ":".join(groups[8 - rng.randint(1, 3) :])
    return ":".join(groups)


def examples(n: int = EXAMPLES, seed: int = SEED, records: bool = False) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, is personal data): invented contexts around candidates, in prose or in ``records``."""
    rng = random.Random(seed)
    syllables = "an er in on at re th st en ou la de le que der und ein los con pa".split()

    def words(k):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))

    def date():
        return rng.choice((f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2099)}", f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"))

    out = []
    while len(out) < n:
        kind = rng.choices(KINDS, (5, 5, 3, 1))[0]  # a list of numbers makes many candidates
        true = rng.random() < 0.5
        cue, whole = "", []
        if kind == "phone":
            if true:
                sep, form, code = rng.choice(("-", " ", ".")), rng.randrange(5), _digits(rng, 2)
                whole = [_phone(rng, form, sep, code) for _ in range(rng.choice((1, 1, 2, 3)))]
                s = rng.choice((" ", " ", " / ")).join(whole)
                if rng.random() < 0.15:
                    s = date() + " " + s
            else:
                s = rng.choice((_digits(rng, rng.randint(7, 15)), f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2099)}", f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 999)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}:{_digits(rng, 2)} {_digits(rng, 4)}", " ".join(_digits(rng, 2) for _ in range(rng.randint(4, 7)))))
        elif kind == "card":
            s = _card(rng, true)
        elif kind == "ip":
            parts = [str(rng.randint(0, 255)) for _ in range(4)]
            if true:
                s = _colons(rng) if rng.random() < 0.5 else rng.choice((" . ", ". ", "..", ".")).join(parts)
            elif rng.random() < 0.5:
                pair = lambda k, most: ":".join(f"{rng.randrange(most):02d}" for _ in range(k))
                s = rng.choice((pair(3, 60), pair(4, 60), ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), f"{rng.randint(1, 99)}:{rng.randint(1, 99)}:{rng.randint(1, 999)}"))
            else:
                s = rng.choice((".", "-", " ", "/")).join(rng.choice((parts, [str(rng.randint(0, 9)) for _ in range(4)], [_digits(rng, rng.randint(1, 3)) for _ in range(4)])))
        else:
            end = rng.choice(_ENDINGS[:12])
            name = words(1) + rng.choice(("", "." + words(1), str(rng.randint(0, 99)), "_" + words(1)))
            if true:
                at, dot = rng.choice((("(at)", "."), ("[at]", "(dot)"), (" (at) ", " [dot] "), ("{at}", " dot "), (" at ", " dot "), (" at ", "."), ("(AT)", "."), ("[AT]", "[DOT]")))
                s = f"{name}{at}{words(1)}{dot}{end}"
                whole = [s]
                if rng.random() < 0.2:
                    s += rng.choice((". ", ".")) + words(1)
            else:
                s = rng.choice((f"{words(1)} at {words(1)}{rng.choice(('. ', '.', ' . '))}{words(1)}", f"{words(1)} at {words(1)} dot {words(1)}", f"{words(1)} at {words(1)}. {rng.choice(_ENDINGS[-6:])} {words(1)}"))
        if kind == "card" and rng.random() < 0.3:
            whole = [s]
            s += f" {rng.randint(1, 12):02d}/{rng.choice(('', '20'))}{rng.randint(20, 39)}"
        elif kind == "phone" and not true and rng.random() < 0.2:
            s += rng.choice((" ", " / ")) + rng.choice((date(), _digits(rng, rng.randint(1, 6)), s))
        if rng.random() < (0.5 if true else 0.1):
            cue = rng.choice(_CUES[kind]) + rng.choice((" ", ": "))
        elif not true and rng.random() < 0.5:
            cue = rng.choice(_NOT_CUES) + rng.choice((" ", ": ", " #"))
        if not true and not cue and kind == "card" and rng.random() < 0.3:
            cue = rng.choice(("$", "#"))
        left, right = words(rng.randint(0, 6)), rng.choice(("", ".", ",", " ")) + " " + words(rng.randint(0, 5))
        text = f"{left} {cue}{s}{right}"
        if records:
            named = cue.strip(" :#") or words(1)
            text = rng.choice((f'{{"{words(1)}": "{words(1)}", "{named}": "{s}", "n": {rng.randint(0, 999)}}}', f"{words(1)}, {cue}{s}, {words(2)}", f"| {words(1)} | {cue}{s} | {rng.randint(0, 99)} |", f"{named}={s}; {words(1)}={words(1)}", f"[{rng.randint(10, 23)}:{rng.randint(10, 59)}] {named}: {s}", f"<td>{named}</td><td>{s}</td>", f"- {cue}{s}\n- {words(3)}"))
        # what overlaps a base span never comes to the trees
        base = _union(base_spans(text))
        spans = [c for c in candidates(text) if c[0] == kind and not _overlaps(base, *c[1:])]
        at, held = text.find(s), []
        for part in whole or [s]:
            at = text.find(part, at)
            held.append((at, len(part)))
            at += len(part)
        for k, a, b in spans:
            out.append((text, k, a, b, int(true and any(a <= at + 1 and b >= at + size and b - a <= size + 1 for at, size in held))))
    return out[:n]


@lru_cache(maxsize=1)
def model() -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and the threshold of each kind, calibrated on examples that they were not fitted to."""
    def table(rows):
        return np.array([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([r[4] for r in rows], float)

    trees = BoostedTrees().fit(*table(examples()))
    x, y = table(examples(EXAMPLES // 2, SEED + 1, records=True))
    held = np.array([trees.score(r) for r in x.tolist()])
    limits = {}
    for i, kind in enumerate(KINDS):
        mine = x[:, 0] == i
        order = np.argsort(-held[mine], kind="stable")
        s, t = held[mine][order], y[mine][order]
        good = np.flatnonzero(np.cumsum(t) / np.arange(1, len(t) + 1) >= PRECISION)
        limits[kind] = max(0.5, float(s[good[-1]])) if len(good) else 2.0
    return trees, limits


def find(text: str, trees: BoostedTrees, limits: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    taken = _union(base)
    scored = []
    for kind, a, b in candidates(text):
        if not _overlaps(taken, a, b):
            p = trees.score(features(text, kind, a, b))
            if p >= limits[kind]:
                scored.append((-p, a, a - b, KINDS.index(kind), b))
    more: list[tuple[str, int, int]] = []
    for _, a, _, k, b in sorted(scored):
        if not _overlaps(taken, a, b):
            taken.insert(bisect.bisect_left(taken, (a, -1)), (a, b))
            more.append((KINDS[k], a, b))
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, as sorted disjoint stretches: spans of different kinds may overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) meets one of the disjoint stretches."""
    i = bisect.bisect_left(taken, (a, -1))
    return i < len(taken) and taken[i][0] < b or i > 0 and taken[i - 1][1] > a


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone long, base_sha256, spans string, n_spans long) of every row.

    The counts by kind are of base spans; ``n_spans`` counts all spans, those that the trees add too.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    trees, limits = model()

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, every = find((value.as_py() or b"").decode("utf-8", "replace"), trees, limits)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), len(every)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "e", "i", "c", "p", "b", "s", "n"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = out.mapInArrow(lean(run), f"id {id_type}, e long, i long, c long, p long, b string, s string, n long")
    return out.toDF(id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, redacted string): every span replaced by its kind in angle brackets; null stays null."""
    id_type = docs.schema[id_col].dataType.simpleString()
    trees, limits = model()

    def mask(text):
        out, at = [], 0
        for k, a, b in sorted(find(text, trees, limits)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{k}>"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            out = [mask(v.as_py().decode("utf-8", "replace")) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "t"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return out.mapInArrow(lean(run), f"id {id_type}, t string").toDF(id_col, "redacted")
