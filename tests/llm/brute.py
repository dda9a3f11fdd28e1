"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def line_dedup(rows, min_docs=10, min_chars=1):
    """[(doc_id, kept text, lines, dropped)] of [(doc_id, text)]."""
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            where[fold(line).strip(SPACE)].add(i)
    gone = {k for k, ids in where.items() if len(ids) >= min_docs and len(k) >= min_chars}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if fold(x).strip(SPACE) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(rows, k, percent):
    """{doc_id: (set size, component)} of [(doc_id, text)], by all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def mix(rows, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """{doc_id: times taken} of [(doc_id, text, source)], by sorting."""
    size = {i: len(words(t)) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by[s]) for s in order}
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    budget, capped = share * sum(total.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = budget - sum(capped.values()), sum(weight[s] for s in free)
        goal = {s: left * weight[s] / w for s in free}
        over = [s for s in free if goal[s] > most * total[s]]
        if not over:
            break
        capped |= {s: most * total[s] for s in over}
    goal |= capped
    out = {}
    for s in order:
        whole = int(goal[s] // total[s]) if total[s] else 0
        rest = goal[s] - whole * total[s]
        more = rest > 0
        for i in sorted(by[s], key=lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)):
            rest -= size[i]
            out[i] = whole + (more and rest >= 0)
    return out


def mix64(x):
    """The splitmix64 finaliser, on plain integers."""
    full = 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ x >> 27) * 0x94D049BB133111EB & full
    return x ^ x >> 31


def lz_fingerprint(text, slots=256, base=0x9E3779B97F4A7C15):
    """Smallest hash by slot (None: empty) of the distinct LZ78 phrases of a text."""
    full, phrases, now = 2**64 - 1, set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    phrases |= {now} if now else set()
    out = [None] * slots
    for p in phrases:
        h = mix64(sum(mix64(ord(c) + 1) * pow(base, i, 2**64) for i, c in enumerate(p)) & full ^ len(p) * base & full)
        slot, value = h % slots, h // slots
        out[slot] = value if out[slot] is None else min(value, out[slot])
    return out


def lz_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used) if used else 1.0
