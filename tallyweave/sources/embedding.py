"""Embedding providers: a column expression without network, or HTTP services called in Arrow batches."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.vectors import mock_embedding

#: Services: address and the field that tells documents from queries (None: no such field). Fixed values.
SERVICES = {"voyage": ("https://api.voyageai.com/v1/embeddings", "input_type"), "openai": ("https://api.openai.com/v1/embeddings", None)}


def mock(dim: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("embedding", mock_embedding(F.col("text"), dim).cast("array<float>"))


def http(service: str, key: str, model: str, *, kind: str = "document", batch: int = 128, post: Callable | None = None, errors: str = "raise", turns: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """post(url, headers, body) -> parsed answer, for tests; by default a plain HTTP POST.

    errors: "raise", a failed or malformed answer fails the job; "rows", it costs no other row: a batch is asked for `turns` times, then in
    halves, down to single texts, and what still fails has a null embedding and its reason in embedding_error."""
    url, field = SERVICES[service]
    if errors not in ("raise", "rows"):
        raise ValueError("errors is raise or rows")

    def send(u: str, headers: dict, body: dict) -> dict:
        request = urllib.request.Request(u, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.loads(r.read())

    call = post or send

    def asked(texts: list[str]) -> list:
        answer = call(url, {"Authorization": f"Bearer {key}"}, {"model": model, "input": texts} | ({field: kind} if field else {}))
        data = answer.get("data") if isinstance(answer, dict) else None
        if not isinstance(data, list) or len(data) != len(texts):
            raise RuntimeError(f"{service}: {len(texts)} vectors expected")
        return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]

    def answered(texts: list[str]) -> list[tuple[list | None, str | None]]:
        reason = ""
        for turn in range(turns):
            if turn:
                sleep(pause * 2 ** (turn - 1))
            try:
                return [(v, None) for v in asked(texts)]
            except Exception as e:  # whatever a service may do, it concerns these texts only
                reason = f"{type(e).__name__}: {e}"
        if len(texts) == 1:
            return [(None, reason)]
        half = len(texts) // 2
        return answered(texts[:half]) + answered(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [list(frame["text"].iloc[at : at + batch]) for at in range(0, len(frame), batch)]
            if errors == "raise":
                yield frame.assign(embedding=[v for p in parts for v in asked(p)])
            else:
                found = [x for p in parts for x in answered(p)]
                yield frame.assign(embedding=[v for v, _ in found], embedding_error=[e for _, e in found])

    def apply(df: DataFrame) -> DataFrame:
        rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{rest}, embedding array<float>" + (", embedding_error string" if errors == "rows" else ""))

    return apply


def provider(name: str, dim: int, **options) -> Callable[[DataFrame], DataFrame]:
    if name == "mock":
        return mock(dim)
    if name in SERVICES:
        return http(name, **options)
    raise ValueError(f"unknown embedding provider: {name}")


def embedded(df: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with column text and an embedding; blank texts are left out."""
    return embed(df.where(F.trim(F.coalesce("text", F.lit(""))) != ""))
