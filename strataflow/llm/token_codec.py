"""Token-ID output (operator 8): Simple-8b word-aligned coding.

A 64-bit word holds a selector in its top four bits and, below, as many ids as
fit at one width.  Selector 15 is an escape: the word that follows it is one raw
64-bit value, for values that need more than 60 bits.  Ids are coded in blocks
of ``BLOCK`` values that never share a word, and a frame keeps the word at which
every block starts, so decoding works on all blocks, and on all words of one
selector, at once.

A frame is a run of consecutive documents.  Its layout, little-endian:

    8 bytes  magic ``SFS8B\\x00\\x00\\x01``
    3 x u64  number of documents, of ids, of words
    u64 x documents   document ids (two's complement)
    u64 x documents   ids of each document
    u32 x blocks      first word of each block
    u64 x words       the packed words

Frames are written through Spark as the binary column of a Parquet dataset
(part, seq, before, n_ids, frame), so that any file system serves, a lost task is
written anew and readers may take frames in any order; (part, seq) is the order of
the ids and ``before`` counts those of the part's earlier frames, so a reader needs
the totals of the parts only (one number a writing task) and shuffles no frame.  Ids
wider than 32 bits are possible in the codec, not in the tokenizer.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.llm.common import held, lean, scratch_path, shuffle_partitions

#: (values in a word, bits of each) by selector: fixed values of the Simple-8b format, of which the runs of zeros are not used.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 128
MAGIC = b"SFS8B\x00\x00\x01"
#: Ids after which a frame ends (with its document); words and pretokens that a worker remembers.
FRAME_IDS, WORD_CACHE, PART_CACHE = 1 << 18, 400_000, 1_000_000


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each uint64 value needs, as uint8 (at 2**53 and above it may be one more)."""
    exponent = values.astype(np.float64).view(np.uint64) >> np.uint64(52)
    return np.maximum(exponent.astype(np.int16) - 1022, 0).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, first word of each block uint32) of uint64 ``values``.

    Each word takes as many values as fit; zeros that pad a block's end count as
    fitting.  Windows of all lengths get their widest value by doubling, then all
    blocks follow their words side by side.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks, row = -(-n // BLOCK), BLOCK + 64
    padded = np.zeros((blocks, row), np.uint64)
    full = n // BLOCK
    padded[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    padded[full:, : n - full * BLOCK] = values[full * BLOCK :]
    padded = padded.ravel()
    widest = {1: _bits(padded)}  # of 1, 2, 4, ... values from each position
    for k in (1, 2, 4, 8, 16):
        w = widest[k]
        widest[2 * k] = np.maximum(w, np.concatenate([w[k:], np.zeros(k, np.uint8)]))
    selector = np.full(len(padded), ESCAPE, np.uint8)
    for s in range(len(PACKS) - 1, -1, -1):
        count, width = PACKS[s]
        k = 1 << (count.bit_length() - 1)
        w = widest[k]
        fits = w <= width
        if count > k:
            fits[: len(w) - (count - k)] &= fits[count - k :].copy()
        selector[fits] = s
    steps = np.array([c for c, _ in PACKS] + [0, 1])
    at = np.arange(blocks) * row
    end = at + BLOCK
    end[-1] = at[-1] + n - (blocks - 1) * BLOCK
    starts = []
    while len(at):
        starts.append(at)
        at = at + steps[selector[at]]
        live = at < end
        at, end = at[live], end[live]
    starts = np.sort(np.concatenate(starts), kind="stable")
    chosen = selector[starts]
    raw = np.flatnonzero(chosen == ESCAPE)
    where = np.arange(len(starts))
    if len(raw):
        where += np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(len(starts) + len(raw), np.uint64)
    for s, (count, width) in enumerate(PACKS):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word = np.full(len(mine), s << 60, np.uint64)
            for k in range(count):
                word |= padded[starts[mine] + k] << np.uint64(k * width)
            words[where[mine]] = word
    words[where[raw]] = np.uint64(ESCAPE << 60)
    words[where[raw] + 1] = padded[starts[raw]]
    first = where[np.searchsorted(starts, np.arange(blocks) * row)]
    return words, first.astype(np.uint32)


def decode(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`encode`."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word may look like any selector: walk the blocks side by side
        at, stop = first.astype(np.int64), np.concatenate([first[1:], [len(words)]]).astype(np.int64)
        while (live := at < stop).any():
            esc = live & (selector[np.minimum(at, len(words) - 1)] == ESCAPE)
            raw[at[esc] + 1] = True
            at[live] += 1 + esc[live]
    head = np.flatnonzero(~raw)
    chosen = selector[head]
    count = np.array([c for c, _ in PACKS] + [0, 1])[chosen]
    block = np.searchsorted(first, head, "right") - 1
    begin = np.searchsorted(head, first)
    total = np.cumsum(count)
    pos = total - count - (total - count)[begin][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s, (most, width) in enumerate(PACKS):
        mine = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << width) - 1)
        for k in range(most if len(mine) else 0):
            mine = mine[pos[mine] + k < end[mine]]
            out[pos[mine] + k] = words[head[mine]] >> np.uint64(k * width) & mask
    esc = np.flatnonzero(chosen == ESCAPE)
    out[pos[esc]] = words[head[esc] + 1]
    return out


def pack(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> bytes:
    """A frame of documents ``ids`` with ``sizes`` values each."""
    words, first = encode(values)
    head = np.array([len(ids), len(values), len(words)], "<u8")
    return b"".join([MAGIC, head.tobytes(), ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, sizes, values) of a frame."""
    if frame[:8] != MAGIC:
        raise ValueError("not a frame of this format")
    docs, n, n_words = (int(x) for x in np.frombuffer(frame, "<u8", 3, 8))
    at = 32
    ids = np.frombuffer(frame, "<i8", docs, at)
    sizes = np.frombuffer(frame, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    first = np.frombuffer(frame, "<u4", -(-n // BLOCK), at)
    words = np.frombuffer(frame, "<u8", n_words, at + 4 * len(first))
    return ids, sizes, decode(words, first, n)


class WordTokenizer:
    """Ids of raw texts by a tokenizers file.

    Where the file's steps are ``_STEPS``, no pretoken crosses white space: words
    between ASCII white space are encoded once and remembered.  Of words in Latin
    letters, digits and ASCII signs, only the pretokens that are new go to the
    library's model, as these steps do nothing to them but lower the case and part
    letters, digits and signs; all other words go through the whole library.  Of a
    file with any other steps, whole texts go through the library.
    """

    # The steps that the shortcut stands for.
    _STEPS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "truncation": None,
        "padding": None,
    }

    #: Contractions, letters, single digits, runs of signs (the pattern of the file, for Latin text).
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sa-z0-9\u00c0-\u024f]+")
    #: ASCII and precomposed Latin letters, which normalisation to NFC leaves as they are.
    _PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01c3]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Words(self, {})
        self.parts: dict[str, bytes] = {}
        self.signs = {}
        free = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.signs = {b: chr(256 + free.index(b)) if b in free else chr(b) for b in range(256)}
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        added = [t["content"] for t in steps.get("added_tokens") or []]
        self.quick = {k: steps.get(k) for k in self._STEPS} == self._STEPS and steps["model"].get("dropout") is None and all("<|" in t and not re.search(r"\s", t) for t in added)

    def _pieced(self, word: str) -> bytes | None:
        """Ids of a plain word from its parts, None if it is not plain."""
        if not self._PLAIN.fullmatch(word) or "<|" in word:
            return None
        return b"".join([self._part(p) for p in self._PARTS.findall(word.lower())])

    def _part(self, part: str) -> bytes:
        """Ids of a pretoken."""
        ids = self.parts.get(part)
        if ids is None:
            text = part if part.isascii() else "".join(map(self.signs.__getitem__, part.encode()))
            found = [x.id for x in self.model.tokenize(text)]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.parts) >= PART_CACHE:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def encode_word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters
            return self._part(raw.lower().decode())
        if raw[-1] in b".,:;!?" and raw[:-1].isalpha():
            return self.known[raw[:-1]] + self._part(chr(raw[-1]))
        word = raw.decode("utf-8", "replace")
        ids = self._pieced(word)
        return self._whole(word) if ids is None else ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not self.quick:
            return self._whole(text.decode("utf-8", "replace")) if text else b""
        if len(self.known) > WORD_CACHE:
            self.known = _Words(self, dict(self.known))
        if not text:
            return b""
        # the steps lower the case, and no normal form depends on it; but special tokens are told by it
        return b"".join(map(self.known.__getitem__, (text if b"<|" in text else text.lower()).split()))


class _Words(dict):
    """word -> ids; keeps what the generation before it knew at hand."""

    def __init__(self, of: WordTokenizer, old: dict[bytes, bytes]):
        self.of, self.old = of, old

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.old.get(raw)
        self[raw] = ids = self.of.encode_word(raw) if ids is None else ids
        return ids


@held
@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write frames to ``path`` in ascending id order.

    Null and empty texts hold the end id only; rows that repeat an id stand side by
    side, in any order; null ids are written as the smallest 64-bit integer, so they come
    first; ids that are not numbers end in a cast error; a text of any length is one
    document of one frame; extra columns are not read.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, part, seq = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        ids, raw, size, before = [], [], 0, 0

        def frame():
            values = np.frombuffer(b"".join(raw), "<u4").astype(np.uint64)
            packed = pack(np.array(ids, np.int64), np.array([len(r) // 4 for r in raw]), values)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(values)], pa.int64()), "frame": pa.array([packed], pa.binary())})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                raw.append(known(text.as_py()) + end)
                size += len(raw[-1]) // 4
                if size >= FRAME_IDS:
                    yield frame()
                    seq, before = seq + 1, before + size
                    ids, raw, size = [], [], 0
        if ids:
            yield frame()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.repartitionByRange(max(shuffle_partitions(docs.sparkSession), 2), "id").sortWithinPartitions("id")
    rows.mapInArrow(lean(run, tokenizer), "part int, seq long, before long, n_ids long, frame binary").write.option("compression", "uncompressed").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(start, frame): frames with the number of ids before them; parts are as many as the writing tasks."""
    frames = spark.read.schema("part int, seq long, before long, n_ids long, frame binary").parquet(path)
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))  # a row a writing task
    return frames.join(F.broadcast(parts), frames["part"] == parts["of"]).select((F.col("before") + F.col("part_start")).alias("start"), "frame")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id long, start long, token_ids array<int>) of every document, decoded from the frames."""

    def run(batches):
        for batch in batches:
            for start, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sizes, values = unpack(frame)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start + ends - sizes), lists], names=["doc_id", "start", "token_ids"])

    return _placed(spark, path).mapInArrow(lean(run), "doc_id long, start long, token_ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the frames."""

    def run(batches):
        for batch in batches:
            for start, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, sizes, values = unpack(frame)
                ends = np.cumsum(sizes)
                raw = memoryview(values.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, end_id)
    return token_digests(docs.sparkSession, path)
