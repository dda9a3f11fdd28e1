"""Chunks of a document by the written rules, one character budget at a time; slow and plain."""


def spread(texts, limit):
    """Lists of consecutive texts whose joined length stays under ``limit``."""
    groups = [[]]
    for t in texts:
        if groups[-1] and len("\n".join([*groups[-1], t])) >= limit:
            groups.append([])
        groups[-1].append(t)
    return [g for g in groups if g]


def pieces(blocks, slide_mean=120, pack=1150):
    """[(kind, page, section, text)]: slides whole, texts of one page and section packed."""
    out, i = [], 0
    mean = {}
    for kind, page, _, text in blocks:
        if kind != "table" and page is not None:
            mean.setdefault(page, []).append(len(text))
    while i < len(blocks):
        kind, page, section, text = blocks[i]
        if kind == "table":
            out.append(blocks[i])
            i += 1
            continue
        slide = page in mean and sum(mean[page]) / len(mean[page]) < slide_mean
        j = i
        while j < len(blocks) and blocks[j][0] != "table" and blocks[j][1] == page and (slide or blocks[j][2] == section):
            j += 1
        texts = [b[3] for b in blocks[i:j]]
        if slide:
            body = "\n".join(t for t in texts if t.strip())
            named = [x.strip() for x in body.split("\n") if x.strip()]
            out.append(("text", page, named[0] if named else body[:80], body))
        else:
            out += [("text", page, section, "\n".join(g)) for g in spread(texts, pack)]
        i = j
    return out


def settled(parts, least=40):
    """Short texts go to the text before, else to the text after; a table between them lets them stand."""
    out, held = [], None
    for kind, page, section, text in parts:
        if kind == "table":
            if held:
                out.append(held)
            held = None
            out.append((kind, page, section, text))
            continue
        if held:
            text, held = held[3] + "\n" + text, None
        if len(text.strip()) >= least:
            out.append((kind, page, section, text))
        elif out and out[-1][0] != "table":
            out[-1] = (*out[-1][:3], out[-1][3] + "\n" + text)
        else:
            held = (kind, page, section, text)
    return out + ([held] if held else [])


def distinct_lines(text):
    out = []
    for n, line in enumerate(text.split("\n")):
        if len(line.strip()) <= 20 or line.strip() not in [x.strip() for x in text.split("\n")[:n]]:
            out.append(line)
    return "\n".join(out)


def windows(run, size=1200):
    """Chunks of lines under ``size`` that share a line with the next."""
    lines = [(x, page, section) for _, page, section, text in run for x in text.split("\n") if x.strip()]
    some = next((p for _, p, _, _ in run if p is not None), None)
    out, at, overlapped = [], 0, False
    while at < len(lines):
        n = 1
        while at + n < len(lines) and (overlapped or len(lines[at][0]) < size) and len("\n".join(x for x, _, _ in lines[at : at + n + 1])) < size:
            n += 1
        text = distinct_lines("\n".join(x for x, _, _ in lines[at : at + n]).strip())
        page = lines[at][1]
        if text:
            out.append(["text", some if page is None else page, lines[at][2], text])
        if at + n == len(lines):
            break
        overlapped = n > 1
        at += n - 1 if overlapped else n
    return out


def chunks(blocks):
    """[(kind, page, section, text)] of blocks (kind, page, section, text)."""
    parts = settled(pieces([b for b in blocks if b[2] != "references"]))
    out, i, context = [], 0, None
    while i < len(parts):
        if parts[i][0] == "table":
            out.append([*parts[i][:3], parts[i][3] if not context else context + "\n\n" + parts[i][3]])
            context, i = None, i + 1
            continue
        j = i
        while j < len(parts) and parts[j][0] != "table":
            j += 1
        out += windows(parts[i:j])
        context, i = parts[j - 1][3], j
    return [tuple(c) for c in whole(out)]


def whole(out, least=300):
    """Texts under ``least`` take in those after them, then, twice, join the one before."""
    n = 0
    while n < len(out):
        while out[n][0] == "text" and len(out[n][3]) < least and n + 1 < len(out) and out[n + 1][0] == "text":
            out[n][3] = (out[n][3] + "\n\n" + out.pop(n + 1)[3]).strip()
        n += 1
    for _ in range(2):
        if sum(c[0] == "text" for c in out) < 2:
            return out
        n = 1
        while n < len(out):
            if out[n][0] == out[n - 1][0] == "text" and len(out[n][3]) < least:
                out[n - 1][3] = (out[n - 1][3] + "\n\n" + out.pop(n)[3]).strip()
            else:
                n += 1
    return out


def presentation(blocks, most=2000):
    """Chunks of slides: one a slide and run of texts, or one a block where the run is long."""
    blocks = [b for b in blocks if b[2] != "references"]
    out, i, context = [], 0, None
    while i < len(blocks):
        kind, page, section, text = blocks[i]
        if kind == "table":
            out.append((kind, page, section, text if not context else context + "\n\n" + text))
            context, i = None, i + 1
            continue
        j = i
        while j < len(blocks) and blocks[j][0] != "table" and blocks[j][1] == page:
            j += 1
        body = "\n".join(b[3] for b in blocks[i:j] if b[3].strip())
        for t, s in [(body, section)] if len(body) <= most else [(b[3], b[2]) for b in blocks[i:j]]:
            if t.strip():
                out.append(("text", page, s, distinct_lines(t.strip())))
        said = [b[3] for b in blocks[i:j] if b[0] == "paragraph"]
        context, i = said[-1] if said else context, j
    return out
