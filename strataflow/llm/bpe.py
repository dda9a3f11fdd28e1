"""Byte-level BPE encoding and decoding in linear time (operator 2).

Each pretoken is mapped byte for byte to Latin-1 so that a string automaton
(pyahocorasick) reports, in one pass, the longest vocabulary entry that starts
at every byte.  The encoder then walks left to right from those longest
matches; a candidate is accepted only if it may stand beside its left
neighbour (the pair would not be merged or split differently by the ranks; this
test is memoised), else it falls back to its next shorter prefix and, when
none is left, backtracks one token and marks the position as a dead end.  Every
position is closed at most once, so the walk is linear in the pretoken.

Null or empty text encodes to no ids.  Repeated rows give repeated results, an
empty table an empty result; columns other than the id and the text are not
read.  Ties do not arise: the encoding of a text is unique.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import held, lean

#: Entries a worker memoises before it starts anew (a cache bound, not a limit on the input).
CACHE_ENTRIES = 250_000


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Ranges of code points of the general categories L and N, for a character class."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for cp in range(sys.maxunicode + 1):
        kind = spans.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            if kind and kind[-1][1] == cp - 1:
                kind[-1][1] = cp
            else:
                kind.append([cp, cp])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[k]) for k in "LN")


#: Unicode White_Space (fixed values).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


@lru_cache(maxsize=4)
def splitter(pattern: str) -> re.Pattern:
    r"""``pattern`` for the standard library: \p{L}, \p{N} and \s become explicit classes."""
    letters, numbers = _classes()
    parts = pattern.split("|")
    if parts[-4:-3] == [r" ?\p{N}+"]:  # words first: no word starts as a contraction does, so the order is free and this one is quicker
        parts.insert(0, parts.pop(parts.index(r" ?\p{L}+")))
    out = "|".join(parts).replace(r"[^\s\p{L}\p{N}]+", f"[^{_SPACE}{letters}{numbers}]++")
    out = out.replace(r"\p{L}+", f"[{letters}]++").replace(r"\p{N}+", f"[{numbers}]++")
    out = out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(out.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token, rank a line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries
        self.vocab = {i: t for t, i in ranks.items()}
        self.split = splitter(pattern)
        self.words = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            self.words.add_word(token.decode("latin-1"), i)
        self.words.make_automaton()
        # by id: length, longest proper prefix, and the two halves that it was merged from
        size = 1 + max(self.vocab, default=-1)
        self.length, self.shorter, self.left, self.right = [0] * size, [-1] * size, [-1] * size, [-1] * size
        for i, t in self.vocab.items():
            self.length[i], self.shorter[i] = len(t), self._prefix(t)
        self.merged: dict[int, int] = {}
        self.decimal = [str(i) for i in range(size)]
        self.beside: dict[int, bool] = {}
        self._derive_merges()
        self.pieces = _Memo(self)

    @classmethod
    def load(cls, path: str, pattern: str, entries: int = CACHE_ENTRIES) -> ByteBPE:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(t): int(i) for t, i in pairs}, pattern, entries)

    def _prefix(self, token: bytes) -> int:
        """The longest proper prefix of ``token`` that is itself a token (-1: none)."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ranks.get(token[:n])) is not None:
                return i
        return -1

    def _derive_merges(self) -> None:
        """The pair of ids whose merge made each token, found from the ranks alone."""
        for i in sorted(self.vocab):
            token, left = self.vocab[i], self.shorter[i]
            self.left[i] = self.right[i] = i
            while left >= 0:
                right = self.ranks.get(token[self.length[left] :])
                if right is not None and left < i and right < i and self._compatible(left, right):
                    self.merged[left << 32 | right] = i
                    self.left[i], self.right[i] = left, right
                    break
                left = self.shorter[left]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` survive side by side when their bytes are merged by rank.

        Going back in time: the younger of the two tokens is undone first, and
        at no moment may the pieces that touch form a merge older than it.
        """
        merged, left, right = self.merged.get, self.left, self.right
        limit = sys.maxsize
        while True:
            if merged(a << 32 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        length, shorter, beside = self.length, self.shorter, self.beside
        for end, i in self.words.iter(piece.decode("latin-1")):
            longest[end + 1 - length[i]] = i  # later ends come later, so the longest stays
        dead = None
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if dead is None or not dead[end]:
                    if last < 0:
                        break
                    pair = last << 32 | token
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) >= 2 * self.entries:
                            beside.clear()
                        fits = beside[pair] = self._compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                if dead is None:
                    dead = bytearray(n + 1)
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def encode_raw(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        pieces = self.split.findall(text)
        if len(self.pieces) > self.entries:
            self.pieces.age()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(self.encode_raw(text), dtype="<u4")

    def decode(self, ids) -> bytes:
        """The bytes that ``ids`` stand for; an unknown id raises KeyError."""
        return b"".join(map(self.vocab.__getitem__, ids if isinstance(ids, list) else np.asarray(ids).tolist()))


class _Memo(dict):
    """pretoken -> its ids as bytes; what was not used since the last but one :meth:`age` is forgotten."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.old = bpe, {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            ids = self.bpe.encode_piece(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = out
        return out


@held
@lru_cache(maxsize=1)
def load(path: str, pattern: str, entries: int = CACHE_ENTRIES) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE.load(path, pattern, entries)


def texts(column: pa.Array) -> Iterator[str]:
    """Texts of a binary column; null is empty, bytes that are not UTF-8 are replaced."""
    for value in column:
        raw = value.as_py()
        yield raw.decode("utf-8", "replace") if raw else ""


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids: (id_col, n_tokens long, token_ids array<int>)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            rows = [bpe.encode(t).astype(np.int32) for t in texts(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), ids], names=["id", "n", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = out.mapInArrow(lean(run, load), f"id {id_type}, n long, ids array<int>")
    return out.toDF(id_col, "n_tokens", "token_ids")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The inverse of :func:`encode`: (id_col, decoded binary); null ids give empty bytes."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            raw = [bpe.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else b"" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "decoded"])

    out = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return out.mapInArrow(lean(run, load), f"id {id_type}, decoded binary").toDF(id_col, "decoded")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Encode, decode the ids again and digest both.

    Returns (id_col, n_tokens long, ids_sha256 string, decoded_sha256 string) and, if
    asked for ``ids``, token_ids array<int>; else ids do not leave the worker.  A worker
    remembers some ``entries`` pretokens: fewer take less memory and more time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def flush(keys, rows, n, said, back):
        columns = [keys, pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
        if ids:
            offsets = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4"))))
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "a", "b", "ids"][: len(columns)])

    def run(batches):
        bpe = load(path, pattern, entries)
        for batch in batches:
            start, size, rows, n, said, back = 0, 0, [], [], [], []
            for i, text in enumerate(texts(batch.column(1))):
                raw = bpe.encode_raw(text)
                tokens = np.frombuffer(raw, dtype="<u4").tolist()
                n.append(len(tokens))
                said.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, tokens)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(tokens)).hexdigest())
                if ids:
                    rows.append(raw)
                    size += len(raw)
                if size > 1 << 21 or i + 1 == batch.num_rows:
                    yield flush(batch.column(0).slice(start, len(n)), rows, n, said, back)
                    start, size, rows, n, said, back = i + 1, 0, [], [], [], []

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = out.mapInArrow(lean(run, load), f"id {id_type}, n long, a string, b string" + ", ids array<int>" * ids)
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids)
