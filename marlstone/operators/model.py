"""Batch completion by an external model, with a content-addressed cache of answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Completer = Callable[[str], str]


def stub(prompt: str) -> str:
    """A deterministic answer, for tests and dry runs."""
    return '{"answer": "' + hashlib.sha256(prompt.encode()).hexdigest()[:8] + '"}'


def cache_key(*parts: str):
    """SHA-256 of the parts with NUL between them; a null part counts as U+0001, so that no part can be skipped."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(p).cast("string"), F.lit("\1")) for p in parts]).cast("binary"), 256)


def complete(requests: DataFrame, completer: Completer, prompt: str = "prompt", attempts: int = 3) -> DataFrame:
    """Add ``answer`` and ``error``; a failing prompt is tried ``attempts`` times and then reported.

    A failure stays with its row: ``answer`` is null and ``error`` says why.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", answer string, error string"

    def ask(p: str | None) -> tuple[str | None, str | None]:
        why = None
        for _ in range(attempts):
            try:
                return completer(p or ""), None
            except Exception as e:  # the model is outside this program
                why = f"{type(e).__name__}: {e}"
        return None, why

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [ask(p) for p in f[prompt]]
            yield f.assign(answer=[a for a, _ in told], error=[e for _, e in told])

    return requests.mapInPandas(run, schema)


def complete_cached(requests: DataFrame, held: DataFrame, completer: Completer, key: str = "cache_key", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Answers for all requests, and the new answers to append to the cache.

    Each distinct missing key is asked once; ``held`` has columns ``key, answer, error``.
    """
    misses = requests.join(held.select(key), key, "left_anti").groupBy(key).agg(F.min(prompt).alias(prompt))
    new = complete(misses, completer, prompt).select(key, "answer", "error")
    return requests.join(held.select(key, "answer", "error").unionByName(new), key, "left"), new


def as_abstention(df: DataFrame) -> DataFrame:
    """A row with an error counts as an abstention with an empty label."""
    failed = F.col("error").isNotNull()
    return df.withColumn("abstained", failed | F.coalesce(F.col("abstained"), F.lit(False))).withColumn("predicted_label", F.when(failed, "").otherwise(F.col("predicted_label")))
