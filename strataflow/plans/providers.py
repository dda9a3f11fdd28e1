"""Pluggable providers for encoders, extractors, judges and synthesis, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Hashed character trigrams, signed and scaled to length 1: no model, the same everywhere."""

    def __init__(self, width: int = 256):
        self.width, self.name = width, f"hash-{width}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            padded = f"  {' '.join(text.lower().split())}  "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                row[h % self.width] += 1 if h >> 63 else -1
            size = np.sqrt((row * row).sum())
            if size:
                row /= size
        return out


def embed(chunks: DataFrame, embedder: Embedder, cache: DataFrame | None = None, batch: int = 32) -> DataFrame:
    """(chunk_id, text_hash, model, vec): vectors of chunk texts; those of the cache are used again.

    A cached vector counts only if model and text hash are equal, so a changed text is
    encoded anew.
    """
    wanted = chunks.select("chunk_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.lit(embedder.name).alias("model"))
    known = None
    if cache is not None:
        known = wanted.join(cache.select("chunk_id", "text_hash", "model", "vec"), ["chunk_id", "text_hash", "model"])
        wanted = wanted.join(known.select("chunk_id"), "chunk_id", "left_anti")

    def run(frames):
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            vec = [v.tolist() for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield frame[["chunk_id", "text_hash", "model"]].assign(vec=pd.Series(vec, index=frame.index, dtype=object))

    key = chunks.schema["chunk_id"].dataType.simpleString()
    new = wanted.mapInPandas(run, f"chunk_id {key}, text_hash string, model string, vec array<double>")
    return new if known is None else new.unionByName(known.select("chunk_id", "text_hash", "model", "vec"))


class RuleExtractor:
    """Offline extraction: numbers with units become properties of the capitalised words before them."""

    name = "rules"
    _FACT = re.compile(r"([^\W\d_]\w+)\s+(\w+)\s*(<=|>=|=)\s*(\d+(?:[.,]\d+)?)\s*([^\W\d_°%][^\s.,;]*|%|°C)")

    def __call__(self, text: str) -> dict:
        entities, relations = [], []
        for n, (name, parameter, op, value, unit) in enumerate(self._FACT.findall(text)):
            entities += [{"tmp_id": f"e{2 * n + 1}", "type": "Material", "name": name, "name_norm": name.lower(), "aliases": [], "confidence": 0.8}, {"tmp_id": f"e{2 * n + 2}", "type": "Property", "name": parameter, "name_norm": parameter.lower(), "aliases": [], "confidence": 0.8}]
            relations.append({"source": f"e{2 * n + 1}", "target": f"e{2 * n + 2}", "type": "has_property", "confidence": 0.8, "numeric": {"parameter": parameter, "operator": op, "value": value, "unit": unit}})
        return {"entities": entities, "relations": relations}


def extract(chunks: DataFrame, extractor: Callable[[str], dict], attempts: int = 3) -> DataFrame:
    """(chunk_id, doc_id, raw json, retries): answers of an extractor; null after ``attempts`` failures."""
    import json

    def run(frames):
        for frame in frames:
            raw, tries = [], []
            for text in frame["text"].fillna(""):
                answer, n = None, 0
                while answer is None and n < attempts:
                    try:
                        answer = json.dumps(extractor(text), ensure_ascii=False)
                    except Exception:  # a provider may fail; the row says how often
                        n += 1
                raw.append(answer)
                tries.append(n)
            yield frame[["chunk_id", "doc_id"]].assign(raw=raw, retries=np.array(tries, "int32"))

    key, doc = (chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id"))
    return chunks.select("chunk_id", "doc_id", "text").mapInPandas(run, f"chunk_id {key}, doc_id {doc}, raw string, retries int")


def judge_pairs(pairs: Iterable[tuple[str, str]], ask: Callable[[list[tuple[str, str]]], list[bool]], batch: int = 30, attempts: int = 3) -> list[bool]:
    """Answers for all pairs, in batches; short answers are filled with False, no answer at all raises."""
    pairs, out = list(pairs), []
    for i in range(0, len(pairs), batch):
        part, got = pairs[i : i + batch], None
        for _ in range(attempts):
            try:
                got = ask(part)
            except Exception:
                got = None
            if got:
                break
        if not got:
            raise RuntimeError("the judge gave no answer")
        out += [bool(x) for x in (list(got) + [False] * len(part))[: len(part)]]
    return out


def with_backoff(call: Callable[[], object], retryable: tuple[type[Exception], ...], attempts: int = 6, first: float = 2.0, most: float = 60.0, sleep=time.sleep, seed: int = 0):
    """``call()`` with growing, jittered pauses between bounded attempts."""
    rng, pause = random.Random(seed), first
    for n in range(attempts):
        try:
            return call()
        except retryable:
            if n + 1 == attempts:
                raise
            sleep(min(most, pause) * (1 + rng.random() / 10))
            pause *= 2
    raise AssertionError
