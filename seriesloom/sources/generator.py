"""Text generators behind one protocol: prompts in, raw answers out."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ANSWER = T.StructType([T.StructField(c, T.StringType()) for c in ("raw", "status", "error_message")] + [T.StructField("elapsed_time_seconds", T.DoubleType())])
#: Makes, once in each task, a function from prompt to answer.
Generator = Callable[[], Callable[[str], str]]


def replay(answers: dict[str, str], default: str = "[]") -> Generator:
    """Offline: stored answers by prompt."""
    return lambda: lambda prompt: answers.get(prompt, default)


def http(url: str, model: str, temperature: float = 0.7, num_predict: int = 2048, timeout: float = 300.0) -> Generator:
    """A local model server that takes one JSON request a prompt and doesn't stream."""

    def make():
        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": num_predict}}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["response"]

        return ask

    return make


def generate(prompts: DataFrame, generator: Generator, parallel: int, attempts: int = 1, wait: float = 1.0) -> DataFrame:
    """Adds raw, status, error_message and elapsed_time_seconds; ``parallel`` requests at a time.

    A failed call is tried ``attempts`` times in all, each after twice the wait
    of the one before; then it is a row, not an exception.
    """

    def call(ask: Callable[[str], str], prompt: str) -> tuple[str | None, str, str | None, float]:
        began, error = time.monotonic(), None
        for i in range(attempts):
            if i:
                time.sleep(wait * 2 ** (i - 1))
            try:
                return ask(prompt), "success", None, time.monotonic() - began
            except Exception as e:  # noqa: BLE001  any failure of a call becomes its record
                error = f"{type(e).__name__}: {e}"
        return None, "failed", error, time.monotonic() - began

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = generator()
        for frame in frames:
            rows = [call(ask, p) for p in frame["prompt"]]
            yield frame.assign(**{c: [r[i] for r in rows] for i, c in enumerate(("raw", "status", "error_message", "elapsed_time_seconds"))})

    schema = T.StructType([*prompts.schema.fields, *ANSWER.fields])
    return prompts.repartition(parallel).mapInPandas(run, schema)
