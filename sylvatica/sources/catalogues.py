"""Model catalogues as tables: the fetch is the caller's, the rows are typed here."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = (
    "struct<id: string, name: string, pricing: struct<prompt: string, completion: string>, "
    "architecture: struct<input_modalities: array<string>, output_modalities: array<string>>>"
)


def fetch_json(url: str, timeout: float = 30.0) -> Callable[[], str]:
    """A fetch of one small document over HTTP, made on the driver when it is called."""

    def fetch() -> str:
        with urllib.request.urlopen(urllib.request.Request(url, method="GET"), timeout=timeout) as response:
            return response.read().decode("utf-8")

    return fetch


def model_catalogue(spark: SparkSession, fetch: Callable[[], str]) -> DataFrame:
    """(ordinal, id, name, pricing, architecture) of a catalogue document ``{"data": [...]}``, in its order."""
    text = json.dumps(json.loads(fetch()).get("data", []))
    rows = spark.createDataFrame([(text,)], "value string").select(F.posexplode(F.from_json("value", f"array<{MODEL}>")).alias("ordinal", "m"))
    return rows.select("ordinal", "m.*")
