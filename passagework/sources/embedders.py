"""Embedders: lists of texts to rows of numbers. The hashing embedder needs no model; others are plugged in."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidModel

#: Texts of a request, seconds until it fails.
BATCH, TIMEOUT = 256, 5.0
#: Words whose hashes a worker keeps, and one text's.
WORDS = 1 << 16
#: Tokens of a text that a local model reads; these models take no more.
MOST_TOKENS = 512

# Models of the remote providers and their dimensions.
OPENAI_MODELS = {"text-embedding-3-large": 3072, "text-embedding-3-small": 1536, "text-embedding-ada-002": 1536}
LOCAL_MODELS = {"Xenova/bge-small-en-v1.5": 384, "Xenova/bge-large-en-v1.5": 1024, "Xenova/bge-base-en-v1.5": 768, "Qdrant/all-MiniLM-L6-v2-onnx": 384, "Xenova/all-MiniLM-L12-v2": 384}


class Embedder(Protocol):
    id: str
    default_model: tuple[str, int]

    def models(self) -> dict[str, int]: ...

    def embed(self, texts: list[str], model: str) -> np.ndarray: ...


def size_of(e: Embedder, model: str) -> int:
    """The model's dimension."""
    known = e.models()
    if model not in known:
        raise InvalidModel(model)
    return known[model]


class _Slots(dict):
    """word -> its place in the sums, or `size` plus it where it is added."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        h = int(hashlib.md5(word.strip(".,;:!?()[]\"'").encode()).hexdigest()[:16], 16)
        self[word] = slot = h % self.size + (h >> 63) * self.size
        return slot


#: What a worker keeps between batches, by size.
_SLOTS: dict[int, _Slots] = {}


class HashingEmbedder:
    """Signed sums of hashed words, scaled to length 1: deterministic, and close for texts that share words."""

    id = "hashing"
    default_model = ("hashing-64", 64)

    def models(self) -> dict[str, int]:
        return {"hashing-64": 64, "hashing-256": 256}

    def embed(self, texts: list[str], model: str = "hashing-64") -> np.ndarray:
        size = size_of(self, model)
        known = _SLOTS.setdefault(size, _Slots(size))
        out = np.zeros((len(texts), size))
        for k, t in enumerate(texts):
            words = (t or "").lower().split()
            if len(known) > WORDS:
                known.clear()
            counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=2 * size)
            out[k] = counts[size:] - counts[:size]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


class _Remote:
    """Requests of BATCH texts. A failed one is sent again, it alone, after a wait that doubles (or that the server names): an
    answer of 429 or 5xx, no answer in time, a broken one, or one without a row for each text. `concurrency` requests of a
    task are under way at once; `rate` bounds a task's requests a second, so a budget for all tasks is divided by the
    number that run at once. Rows come in the order of the texts."""

    def __init__(self, concurrency: int = 1, attempts: int = 6, wait: float = 0.2, rate: float | None = None):
        self.concurrency, self.attempts, self.wait, self.rate = concurrency, attempts, wait, rate

    def _once(self, url: str, body: dict | None, headers: dict[str, str] | None) -> dict:
        data = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return json.load(answer)

    def _call(self, url: str, body: dict | None = None, headers: dict[str, str] | None = None, read: Callable[[dict], object] = lambda x: x) -> object:
        for attempt in range(self.attempts):
            pause = self.wait * 2**attempt
            try:
                return read(self._once(url, body, headers))
            except urllib.error.HTTPError as e:
                if attempt + 1 == self.attempts or e.code != 429 and e.code < 500:
                    raise
                named = e.headers.get("Retry-After", "")
                pause = max(pause, float(named)) if named.replace(".", "", 1).isdigit() else pause
            except (OSError, ValueError, KeyError):
                if attempt + 1 == self.attempts:
                    raise
            time.sleep(pause)
        raise AssertionError

    def _rows(self, texts: list[str], ask: Callable[[list[str]], list]) -> np.ndarray:
        gap, lock, free = 1 / self.rate if self.rate else 0.0, threading.Lock(), [0.0]

        def one(part: list[str]) -> list:
            if gap:
                with lock:
                    at = max(time.monotonic(), free[0])
                    free[0] = at + gap
                time.sleep(max(0.0, at - time.monotonic()))
            return ask(part)

        parts = [texts[i : i + BATCH] for i in range(0, len(texts), BATCH)]
        if self.concurrency <= 1:
            found = map(one, parts)
            return np.array([v for rows in found for v in rows], float)
        with ThreadPoolExecutor(self.concurrency) as pool:
            return np.array([v for rows in pool.map(one, parts) for v in rows], float)


def _as_many(rows: list, texts: list[str]) -> list:
    if len(rows) != len(texts):
        raise ValueError(f"{len(rows)} rows for {len(texts)} texts")
    return rows


class RemoteEmbedder(_Remote):
    """A server with GET list (names and dimensions) and POST embed ({"model", "content"})."""

    id = "remote"
    default_model = ("Xenova/bge-base-en-v1.5", 768)

    def __init__(self, url: str, **how):
        super().__init__(**how)
        self.url = url.rstrip("/")

    def models(self) -> dict[str, int]:
        return dict(self._call(f"{self.url}/list"))

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        return self._rows(texts, lambda part: self._call(f"{self.url}/embed", {"model": model, "content": part}, read=lambda x: _as_many(x["embeddings"], part)))


class OpenAiEmbedder(_Remote):
    """The embeddings endpoint of the OpenAI API; the key is read from the worker's environment."""

    id = "openai"
    default_model = ("text-embedding-ada-002", 1536)

    def __init__(self, url: str = "https://api.openai.com/v1/embeddings", **how):
        super().__init__(**how)
        self.url = url

    def models(self) -> dict[str, int]:
        return dict(OPENAI_MODELS)

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        if not texts:
            raise InvalidInput("nothing to embed")
        size_of(self, model)
        key = {"Authorization": f"Bearer {os.environ['OPENAI_API_KEY']}"}

        def read(answer: dict, part: list[str]) -> list:
            data = answer["data"]
            # answers may come in another order than the texts, with their places
            data = sorted(data, key=lambda x: x["index"]) if all("index" in x for x in data) else data
            return _as_many([x["embedding"] for x in data], part)

        return self._rows(texts, lambda part: self._call(self.url, {"model": model, "input": part}, key, lambda x: read(x, part)))


class LocalEmbedder:
    """ONNX models in folders <base>/<name> with model.onnx and tokenizer.json, run where the texts are. A worker loads a
    model once. A text's embedding is that of its first token (bge) or the mean of its tokens', scaled to length 1."""

    id = "local"
    default_model = ("Xenova/bge-base-en-v1.5", 768)

    def __init__(self, base: str):
        self.base = base

    def models(self) -> dict[str, int]:
        return dict(LOCAL_MODELS)

    def embed(self, texts: list[str], model: str) -> np.ndarray:
        size = size_of(self, model)
        if not texts:
            return np.zeros((0, size))
        session, tokenizer = _loaded(f"{self.base}/{model}")
        out = []
        for i in range(0, len(texts), BATCH):
            encoded = tokenizer.encode_batch(texts[i : i + BATCH])
            longest = max(1, max(len(e.ids) for e in encoded))
            pad = lambda row: row + [0] * (longest - len(row))  # noqa: E731, B023
            fed = {n: np.array([pad(list(x)) for x in rows], np.int64) for n, rows in (("input_ids", [e.ids for e in encoded]), ("attention_mask", [e.attention_mask for e in encoded]), ("token_type_ids", [e.type_ids for e in encoded]))}
            asked = {x.name for x in session.get_inputs()}
            hidden = session.run(None, {n: v for n, v in fed.items() if n in asked})[0].astype(np.float64)
            mask = fed["attention_mask"][:, :, None]
            out.append(hidden[:, 0] if "bge" in model else (hidden * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1))
        rows = np.concatenate(out)
        if rows.shape[1] != size:
            raise InvalidModel(f"{model} gives {rows.shape[1]} numbers, not {size}")
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, length, out=rows, where=length > 0)


@cache
def _loaded(folder: str):
    if not os.path.exists(f"{folder}/model.onnx"):
        raise InvalidModel(f"no model in {folder}")
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
    tokenizer.no_padding()
    tokenizer.enable_truncation(MOST_TOKENS)
    return onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"]), tokenizer


def embedding(text: Column, e: Embedder, model: str | None = None) -> Column:
    """The embedding of each text as array<double>; a batch is one call of the embedder."""
    name = model or e.default_model[0]
    size = size_of(e, name)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.asarray(e.embed([t or "" for t in texts.to_pylist()], name), np.float64) if len(texts) else np.zeros((0, size))
            edges = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.ListArray.from_arrays(pa.array(edges), pa.array(rows.ravel()))

    return run(text)
