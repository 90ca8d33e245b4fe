"""Models as plug-ins: created once in each Python worker, called with whole Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import logging
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.runs import embeddable

BATCH = 16
#: Failed batches of a task that are logged, each; the rest are counted.
LOGGED = 3
VISION_PROMPT = "Describe this image. Answer with three labelled parts: CAPTION: one line. OCR_TEXT: all text in the image. DESCRIPTION: what it shows."
MIME = {"jpg": "image/jpeg", "tif": "image/tiff", "jpx": "image/jp2"}
log = logging.getLogger(__name__)


class VisionModel(Protocol):
    def analyze(self, image: bytes, ext: str, width: int | None, height: int | None) -> tuple[str, str, str]:
        """caption, recognised text, description; raises where it can't."""


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class OfflineVision:
    """A stand-in for tests: says the type and size."""

    def analyze(self, image: bytes, ext: str, width: int | None, height: int | None) -> tuple[str, str, str]:
        if not image:
            raise ValueError("no image")
        return f"{ext} image", "", f"A {ext} image of {width} by {height} pixels, {len(image)} bytes"


class OfflineEmbedder:
    """A stand-in for tests: hashed words, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.dim, np.float32)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())
                v[h % self.dim] += 1 - 2 * (h >> 63)
            n = float(np.linalg.norm(v))
            out.append((v / n).tolist() if n else None)
        return out


def post_json(url: str, body: dict, headers: dict[str, str], seconds: float = 60) -> dict:
    """POST ``body`` and read the JSON answer; raises where the answer isn't one."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return json.load(answer)


Post = Callable[[str, dict, dict[str, str]], dict]


class ChatVision:
    """A vision model behind a chat-completions address. post: how a request is sent."""

    def __init__(self, url: str, model: str, key: str = "", prompt: str = VISION_PROMPT, post: Post = post_json, headers: dict[str, str] | None = None):
        self.url, self.model, self.prompt, self.post = url, model, prompt, post
        self.headers = headers if headers is not None else {"Authorization": f"Bearer {key}"} if key else {}

    def analyze(self, image: bytes, ext: str, width: int | None, height: int | None) -> tuple[str, str, str]:
        if not image:
            raise ValueError("no image")
        address = f"data:{MIME.get(ext, 'image/' + ext)};base64,{base64.b64encode(image).decode()}"
        content = [{"type": "text", "text": self.prompt}, {"type": "image_url", "image_url": {"url": address}}]
        answer = self.post(self.url, {"model": self.model, "messages": [{"role": "user", "content": content}]}, self.headers)
        return reply_parts(answer["choices"][0]["message"]["content"] or "")


class RestEmbedder:
    """Vectors from an embeddings address; texts of which the answer has no vector get None, and a short answer is logged."""

    def __init__(self, url: str, model: str, dim: int, key: str = "", post: Post = post_json, headers: dict[str, str] | None = None):
        self.url, self.model, self.dim, self.post = url, model, dim, post
        self.headers = headers if headers is not None else {"Authorization": f"Bearer {key}"} if key else {}

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        answer = self.post(self.url, {"model": self.model, "input": texts}, self.headers)
        out: list[list[float] | None] = [None] * len(texts)
        for place, one in enumerate(answer.get("data", [])):
            at = one.get("index", place)
            if 0 <= at < len(texts):
                out[at] = one.get("embedding")
        if (missing := sum(v is None for v in out)) > 0:
            log.warning("%d of %d texts came back without a vector", missing, len(texts))
        return out


_LABELS = re.compile(r"(?im)^\s*(caption|ocr_text|description)\s*:\s*")


def reply_parts(text: str) -> tuple[str, str, str]:
    """caption, recognised text and description of a labelled reply; of a label that comes twice the first counts. A reply without labels is a description."""
    parts = _LABELS.split(text)
    if len(parts) == 1:
        return "", "", text.strip()
    found: dict[str, str] = {}
    for label, body in zip(parts[1::2], parts[2::2], strict=True):
        found.setdefault(label.lower(), body.strip())
    return found.get("caption", ""), found.get("ocr_text", ""), found.get("description", "")


def analyzed(images: DataFrame, make: Callable[[], VisionModel]) -> DataFrame:
    """(doc_id, image_id, caption, ocr_text, description, error) of images; an image that fails has its error and NULLs."""

    @F.pandas_udf("caption string, ocr_text string, description string, error string")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = make()
        for data, ext, width, height in parts:
            rows = []
            for d, e, w, h in zip(data, ext, width, height, strict=True):
                try:
                    rows.append((*model.analyze(bytes(d or b""), e, None if pd.isna(w) else int(w), None if pd.isna(h) else int(h)), None))
                except Exception as x:  # the model's failure is the image's
                    rows.append((None, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["caption", "ocr_text", "description", "error"])

    return images.select("doc_id", "image_id", run("image_bytes", "ext", "width", "height").alias("v")).select("doc_id", "image_id", "v.*")


def embedded(text: Column, make: Callable[[], Embedder], limit: int = 8000, batch: int = BATCH) -> Column:
    """Vectors of a column of texts; NULL for blank ones, for those of a batch that fails, and for those an answer leaves out."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, failed = make(), 0
        for texts in parts:
            out: list[list[float] | None] = [None] * len(texts)
            own = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(own), batch):
                group = own[at : at + batch]
                try:
                    found = model.embed([texts.iloc[i] for i in group])
                except Exception as e:  # the batch stays without vectors and is reported as degraded
                    failed += 1
                    if failed <= LOGGED:
                        log.warning("a batch of %d texts has no vectors: %s: %s", len(group), type(e).__name__, e)
                    continue
                if len(found) < len(group):
                    log.warning("%d vectors for %d texts", len(found), len(group))
                for i, v in zip(group, found, strict=False):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return run(embeddable(text, limit))


def embed_missing(chunks: DataFrame, make: Callable[[], Embedder], limit: int = 8000) -> DataFrame:
    """``chunks`` with vectors where ``embedding`` is NULL."""
    need = F.when(F.col("embedding").isNull(), F.col("content"))
    return chunks.withColumn("embedding", F.coalesce("embedding", embedded(need, make, limit)))
