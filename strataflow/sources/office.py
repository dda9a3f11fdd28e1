"""DOCX and PPTX/POTX scans with the standard library: archives of XML, read in document order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The XML name spaces of the formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
NOTES_PREFIX = "[Заметки] "
BLOCKS = "doc_id string, ord int, type string, text string, level int, page int, rows array<array<string>>, status string, error string"


def _text(paragraph, run: str, breaks: tuple[str, ...]) -> str:
    return "".join("\n" if n.tag in breaks else (n.text or "") for n in paragraph.iter() if n.tag == run or n.tag in breaks)


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs, headings (style 'Heading N') and tables of the body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                if name is not None:
                    names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") or ""
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            text = _text(node, f"{_W}t", (f"{_W}br", f"{_W}cr")).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            m = re.fullmatch(r"heading\s*(\d+)", names.get(key, key or ""), re.I)
            if text:
                out.append({"type": "heading" if m else "paragraph", "text": text, "level": int(m[1]) if m else None})
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(_text(p, f"{_W}t", (f"{_W}br",)) for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            out.append({"type": "table", "rows": rows})
    return out


def _shapes(tree):
    """Shapes of a slide with their place; groups are opened."""
    for node in tree:
        if node.tag == f"{_P}grpSp":
            yield from _shapes(node)
        elif node.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}pic"):
            off = next(node.iter(f"{_A}off"), None)
            yield (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0), node


def pptx_blocks(content: bytes) -> tuple[list[dict], int]:
    """(blocks of all slides, slides without text): shapes by (top, left), titles as headings, notes last."""
    out, bare = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        files = set(z.namelist())
        order = []
        if "ppt/_rels/presentation.xml.rels" in files:
            rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
            for ref in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId"):
                order.append(posixpath.normpath(posixpath.join("ppt", rels[ref.get(f"{_R}id")])))
        order = [s for s in order if s in files] or sorted((f for f in files if re.fullmatch(r"ppt/slides/slide\d+\.xml", f)), key=lambda f: int(re.search(r"(\d+)\.xml", f)[1]))
        for page, slide in enumerate(order, 1):
            found = []
            tree = ET.fromstring(z.read(slide)).find(f"{_P}cSld/{_P}spTree")
            for _, shape in sorted(_shapes(tree if tree is not None else ()), key=lambda s: s[0]):
                table = next(shape.iter(f"{_A}tbl"), None)
                if table is not None:
                    found.append({"type": "table", "page": page, "rows": [["\n".join(_text(p, f"{_A}t", (f"{_A}br",)) for p in c.iter(f"{_A}p")).strip() for c in r.findall(f"{_A}tc")] for r in table.findall(f"{_A}tr")]})
                    continue
                text = "\n".join(x for x in (_text(p, f"{_A}t", (f"{_A}br",)).strip() for p in shape.iter(f"{_A}p")) if x)
                if text:
                    kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                    found.append({"type": "heading" if title else "paragraph", "text": text, "level": 2 if title else None, "page": page})
            rels = posixpath.join(posixpath.dirname(slide), "_rels", posixpath.basename(slide) + ".rels")
            for r in ET.fromstring(z.read(rels)) if rels in files else ():
                target = posixpath.normpath(posixpath.join(posixpath.dirname(slide), r.get("Target", "")))
                if "notesSlide" in target and target in files:
                    said = [_text(p, f"{_A}t", (f"{_A}br",)).strip() for s in ET.fromstring(z.read(target)).iter(f"{_P}sp") if (k := s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")) is not None and k.get("type") == "body" for p in s.iter(f"{_A}p")]
                    if text := "\n".join(x for x in said if x):
                        found.append({"type": "paragraph", "text": NOTES_PREFIX + text, "page": page})
            bare += not found
            out += found
    return out, bare


def parse(name: str, content: bytes, pdf=None) -> tuple[list[dict], int]:
    """Blocks by suffix; a PDF needs a provider ``pdf(content) -> blocks``."""
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix == "docx":
        return docx_blocks(content), 0
    if suffix in ("pptx", "potx"):
        return pptx_blocks(content)
    if suffix == "pdf" and pdf is not None:
        return pdf(content), 0
    raise ValueError(f"no parser for .{suffix}")


def parse_files(listing: DataFrame, pdf=None) -> DataFrame:
    """Blocks of the listed files (doc_id, file_name, content); a file that fails is one row with status 'error'."""

    def run(frames):
        for frame in frames:
            out = []
            for doc, name, content in zip(frame["doc_id"], frame["file_name"], frame["content"], strict=True):
                try:
                    blocks, _ = parse(name, bytes(content), pdf)
                    out += [(doc, i, b["type"], b.get("text"), b.get("level"), b.get("page"), b.get("rows"), "ok", None) for i, b in enumerate(blocks)]
                except Exception as e:  # one bad file must not end the job; its row says what happened
                    out.append((doc, 0, None, None, None, None, None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "type", "text", "level", "page", "rows", "status", "error"]).astype({"ord": "int32", "level": "Int32", "page": "Int32"})

    from strataflow.functions.text import office_table

    rows = listing.where("content is not null").select("doc_id", "file_name", "content").mapInPandas(run, BLOCKS)
    return rows.withColumn("text", F.when(F.col("type") == "table", office_table(F.col("rows"))).otherwise(F.col("text"))).drop("rows")
