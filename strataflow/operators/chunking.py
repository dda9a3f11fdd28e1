"""Greedy chunking of blocks: the folds that no frame of a window expresses.

A document's blocks are one sorted array and reach one call of :func:`chunk_blocks`
in Arrow batches; everything before and after is relational.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters.
CHUNK_SIZE, COALESCE_MAX, STANDALONE_MIN, SMALL_CHUNK, SLIDE_TEXT, SLIDE_MEAN = 1200, 1150, 40, 300, 2000, 120


def _joined(a: dict, b: dict) -> dict:
    return a | {"text": f"{a['text']}\n{b['text']}"}


def _merged(a: dict, b: dict) -> dict:
    return a | {"text": f"{a['text']}\n\n{b['text']}".strip()}


def _unique_lines(text: str) -> str:
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        key = line.strip()
        if len(key) <= 20 or key not in seen:
            out.append(line)
        if len(key) > 20:
            seen.add(key)
    return "\n".join(out)


def coalesce_blocks(blocks: list[dict]) -> list[dict]:
    """Text blocks of one page and section packed up to COALESCE_MAX; slides become one block; short ones lean on neighbours."""
    texts: dict[int, list[int]] = {}
    for b in blocks:
        if b["type"] != "table" and b["page"] is not None:
            texts.setdefault(b["page"], []).append(len(b["text"]))
    slides = {p for p, sizes in texts.items() if sum(sizes) / len(sizes) < SLIDE_MEAN}
    packed: list[dict] = []
    for (is_table, page), run in groupby(blocks, key=lambda b: (b["type"] == "table", None if b["type"] == "table" else b["page"])):
        run = list(run)
        if is_table:
            packed += run
        elif page in slides:
            body = "\n".join(b["text"] for b in run if b["text"].strip())
            title = next((x.strip() for x in body.split("\n") if x.strip()), body[:80])
            packed.append(run[0] | {"type": "paragraph", "text": body, "section": title})
        else:
            for _, group in groupby(run, key=lambda b: b["section"]):
                held: dict | None = None
                for b in group:
                    if held is not None and len(held["text"]) + 1 + len(b["text"]) < COALESCE_MAX:
                        held = _joined(held, b)
                    else:
                        packed += [held] if held is not None else []
                        held = b | {"type": "paragraph"}
                packed.append(held)
    out: list[dict] = []
    waiting: dict | None = None
    for b in packed:
        if b["type"] == "table":
            out += [waiting, b] if waiting is not None else [b]
            waiting = None
            continue
        if waiting is not None:
            b = b | {"text": f"{waiting['text']}\n{b['text']}"}
            waiting = None
        if len(b["text"].strip()) >= STANDALONE_MIN:
            out.append(b)
        elif out and out[-1]["type"] != "table":
            out[-1] = _joined(out[-1], b)
        else:
            waiting = b
    return out + ([waiting] if waiting is not None else [])


def window_lines(blocks: list[dict]) -> list[dict]:
    """Windows of lines under CHUNK_SIZE that share one line with the next window.

    A single line of that size is a chunk of its own; where the shared line and the
    next one are too long together, the shared line stands alone.
    """
    lines = [(line, b) for b in blocks for line in b["text"].split("\n") if line.strip()]
    any_page = next((b["page"] for b in blocks if b["page"] is not None), None)
    out: list[dict] = []
    at = 0
    shared = False
    while at < len(lines):
        end, size = at + 1, len(lines[at][0])
        if shared or size < CHUNK_SIZE:
            while end < len(lines) and size + 1 + len(lines[end][0]) < CHUNK_SIZE:
                size += 1 + len(lines[end][0])
                end += 1
        text = _unique_lines("\n".join(x for x, _ in lines[at:end]).strip())
        if text:
            b = lines[at][1]
            out.append({"text": text, "kind": "text", "section": b["section"], "page": b["page"] if b["page"] is not None else any_page})
        if end >= len(lines):
            break
        shared = end - at > 1
        at = end - 1 if shared else end
    return out


def merge_small(chunks: list[dict]) -> list[dict]:
    """Text chunks under SMALL_CHUNK take in those after them, then join the one before, parted by an empty line; no merge crosses a table."""
    ahead: list[dict] = []
    for c in chunks:
        if ahead and c["kind"] == ahead[-1]["kind"] == "text" and len(ahead[-1]["text"]) < SMALL_CHUNK:
            ahead[-1] = _merged(ahead[-1], c)
        else:
            ahead.append(c)
    for _ in range(2):
        if sum(c["kind"] == "text" for c in ahead) <= 1:
            break
        back: list[dict] = []
        for c in ahead:
            if back and c["kind"] == back[-1]["kind"] == "text" and len(c["text"]) < SMALL_CHUNK:
                back[-1] = _merged(back[-1], c)
            else:
                back.append(c)
        ahead = back
    return ahead


_LATIN, _CYRILLIC = re.compile("[^a-z]+"), re.compile("[^а-яё]+")


def language(text: str) -> str:
    """'en' if Latin letters outnumber Cyrillic ones, else 'ru'."""
    low = text.lower()
    return "en" if len(_LATIN.sub("", low)) > len(_CYRILLIC.sub("", low)) else "ru"


def chunk_blocks(blocks: list[dict], presentation: bool = False) -> list[dict]:
    """Chunks of one document's blocks in order; bibliography is left out."""
    blocks = [b for b in blocks if b["section"] != "references"]
    out: list[dict] = []
    if presentation:
        context = None
        for page, run in groupby(blocks, key=lambda b: b["page"]):
            for is_table, part in groupby(list(run), key=lambda b: b["type"] == "table"):
                part = list(part)
                if is_table:
                    for b in part:
                        out.append({"text": f"{context}\n\n{b['text']}" if context else b["text"], "kind": "table", "section": b["section"], "page": page, "of": b["text"]})
                        context = None
                    continue
                whole = "\n".join(b["text"] for b in part if b["text"].strip())
                for text, b in [(whole, part[0])] if len(whole) <= SLIDE_TEXT else [(b["text"], b) for b in part]:
                    if text.strip():
                        out.append({"text": _unique_lines(text.strip()), "kind": "text", "section": b["section"], "page": page})
                context = next((b["text"] for b in reversed(part) if b["type"] == "paragraph"), context)
    else:
        context = None
        for is_table, run in groupby(coalesce_blocks(blocks), key=lambda b: b["type"] == "table"):
            run = list(run)
            if not is_table:
                out += window_lines(run)
                context = run[-1]["text"]
                continue
            for b in run:
                out.append({"text": f"{context}\n\n{b['text']}" if context else b["text"], "kind": "table", "section": b["section"], "page": b["page"], "of": b["text"]})
                context = None
        out = merge_small(out)
    return [c | {"n": n, "lang": language(c.get("of", c["text"]))} for n, c in enumerate(out)]


CHUNKS = "doc_id string, chunk_id string, text string, kind string, section string, page int, lang string"


def chunk_documents(blocks: DataFrame, presentation: bool = False) -> DataFrame:
    """(doc_id, chunk_id, text, kind, section, page, lang) of blocks (doc_id, ord, type, text, page, section)."""


    def run(batches):
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            for doc, given in zip(docs, batch.column(1), strict=True):
                rows = [b | {"text": b["text"] or ""} for b in given.as_py()]
                out += [(doc, f"{doc}_{c['n']:05d}", c["text"], c["kind"], c["section"], c["page"], c["lang"]) for c in chunk_blocks(rows, presentation)]
            columns = zip(*out, strict=True) if out else [()] * 7
            types = (*[pa.string()] * 5, pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "chunk_id", "text", "kind", "section", "page", "lang"])

    rows = blocks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "type", "text", F.col("page").cast("int").alias("page"), "section"))).alias("blocks"))
    return rows.mapInArrow(run, CHUNKS)
