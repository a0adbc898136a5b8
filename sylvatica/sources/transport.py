"""What is fetched or called over the network or the file system of a worker: pictures and a model gateway.

Operators take these as callables or Columns; nothing here runs unless a caller passes it in.
"""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from typing import IO, Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "sylvatica/1"
#: What a gateway is asked for unless a caller says otherwise.
MAX_TOKENS, TEMPERATURE, TIMEOUT, PICTURE_TIMEOUT = 200, 0.0, 90.0, 30.0
LONGEST_ERROR = 2000


def picture_bytes(url: str, timeout: float = PICTURE_TIMEOUT) -> bytes:
    """The bytes of a picture: a local path, ``file://`` or an address."""
    if "://" not in url or url.startswith("file://"):
        with open(url.removeprefix("file://"), "rb") as file:
            return file.read()
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
        return answer.read()


def pictures(frames: DataFrame, timeout: float = PICTURE_TIMEOUT) -> DataFrame:
    """``frames`` with ``picture`` (bytes of the local file, else of the address) and ``error``: a frame that cannot be
    read is a row like any other."""

    @F.pandas_udf("struct<picture: binary, error: string>")
    def load(places: pd.Series) -> pd.DataFrame:
        rows: list[tuple[bytes | None, str | None]] = []
        for place in places:
            try:
                rows.append((picture_bytes(place, timeout), None))
            except Exception as wrong:  # noqa: BLE001  whatever fails is told in the row
                rows.append((None, f"{type(wrong).__name__}: {wrong}"))
        return pd.DataFrame(rows, columns=["picture", "error"])

    place = F.coalesce(F.when(F.col("local_path") != "", F.col("local_path")), F.col("image_url"), F.lit(""))
    return frames.withColumn("__got", load.asNondeterministic()(place)).select(*frames.columns, "__got.picture", "__got.error")


def gateway_content(parts: Sequence[dict[str, str]]) -> list[dict[str, Any]]:
    """The parts of a prompt in the form of a chat message."""
    shown = {"image": lambda v: {"type": "image_url", "image_url": {"url": v}}, "text": lambda v: {"type": "text", "text": v}}
    return [shown[p["kind"]](p["value"]) for p in parts]


def answer_text(content: Any) -> str:
    """The text of an answer, which is a text or a list of parts."""
    if isinstance(content, list):
        content = "\n".join(str(p.get("text", "")) if isinstance(p, dict) else str(p) for p in content)
    return str(content or "").strip()


def gateway_call(
    base_url: str, key: str, max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE, timeout: float = TIMEOUT, headers: dict[str, str] | None = None,
) -> Callable[[str, list[dict[str, str]]], str]:
    """A callable for ``trials.model_call`` that asks a chat-completions gateway.  Failures raise RuntimeError."""
    if not key.strip():
        raise ValueError("a gateway key is required")

    def call(model: str, parts: list[dict[str, str]]) -> str:
        if not model.strip():
            raise ValueError("a model is required")
        payload = {"model": model.strip(), "messages": [{"role": "user", "content": gateway_content(parts)}], "max_tokens": max_tokens, "temperature": temperature}
        fields = {"Authorization": f"Bearer {key}", "Content-Type": "application/json", "User-Agent": AGENT} | (headers or {})
        asked = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", data=json.dumps(payload).encode(), headers=fields, method="POST")
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as answer:
                told = json.loads(answer.read())
        except urllib.error.HTTPError as wrong:
            raise RuntimeError(f"HTTP {wrong.code}: {wrong.read().decode('utf-8', 'replace')[:LONGEST_ERROR]}") from wrong
        except urllib.error.URLError as wrong:
            raise RuntimeError(f"network error: {wrong}") from wrong
        try:
            return answer_text(told["choices"][0]["message"]["content"])
        except (KeyError, IndexError, TypeError) as wrong:
            raise RuntimeError(f"unexpected answer: {json.dumps(told)[:LONGEST_ERROR]}") from wrong

    return call


def asked_once(call: Callable[[str, list[dict[str, str]]], str], stream: IO[str] | None = None) -> str:
    """The answer to one request read as JSON from ``stream`` (the standard input): {"model", "parts"}; a part is a
    text or {"image": address}."""
    request = json.load(stream or sys.stdin)
    parts = request.get("parts")
    if not isinstance(parts, list):
        raise ValueError("the request has no list of parts")
    kinds = [{"kind": "text", "value": p} if isinstance(p, str) else {"kind": "image", "value": p["image"]} for p in parts]
    return call(str(request.get("model") or ""), kinds)

