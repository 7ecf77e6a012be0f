"""The boundary to models: batched, memoised calls of a function of texts, and configuration overlays."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.shipping import shipped


def generated(rows: DataFrame, prompt: str, output: str, generate: Callable[[Sequence[str]], Sequence[str]], batch: int = 32) -> DataFrame:
    """rows with the model's output for their prompt. Each distinct prompt is sent once, in batches; null prompts give null.

    ``generate`` maps a list of prompts to as many outputs; it runs on the executors, so it loads its model there.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame["__p"].tolist()
            said: list[str] = []
            for at in range(0, len(asked), batch):
                said += generate(asked[at : at + batch])
            yield pd.DataFrame({"__p": asked, output: said})

    once = rows.select(F.col(prompt).alias("__p")).filter("__p IS NOT NULL").distinct()
    answers = once.mapInPandas(call, f"__p string, {output} string")
    return rows.join(answers, F.col(prompt) == F.col("__p"), "left").drop("__p")


_MODELS: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]) -> object:
    """The model of a worker process: loaded once, whatever the number of tasks."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def _by_length(texts: Sequence, size: Callable[[object], int], batch: int, run: Callable[[list], Sequence]) -> list:
    """run over batches of inputs of like length; results in the order of the inputs."""
    order = sorted(range(len(texts)), key=lambda i: size(texts[i]))
    out: list = [None] * len(texts)
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        got = run([texts[i] for i in own])
        if len(got) != len(own):
            raise ValueError(f"{len(got)} results for {len(own)} inputs")
        for i, x in zip(own, got):
            out[i] = x
    return out


def encoded(rows: DataFrame, text: str, output: str, name: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 32) -> DataFrame:
    """rows with a vector (array of floats) for their text. ``load`` returns the encoder; it runs once in a worker process,
    under ``name``. Each distinct text is encoded once, in batches of like length; a null text gives null."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _model(name, load)
        for frame in frames:
            vectors = _by_length(frame["__p"].tolist(), len, batch, encode)
            yield pd.DataFrame({"__p": frame["__p"], output: [[float(x) for x in v] for v in vectors]})

    shipped(rows.sparkSession)
    once = rows.select(F.col(text).alias("__p")).filter("__p IS NOT NULL").distinct()
    return rows.join(once.mapInPandas(call, f"__p string, {output} array<float>"), F.col(text) == F.col("__p"), "left").drop("__p")


def pair_scored(rows: DataFrame, query: str, passage: str, output: str, name: str, load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = 32) -> DataFrame:
    """rows with a score (double) of their (query, passage) pair, null if one is null. Loading and batches as in
    ``encoded``; rows stay where they are, no shuffle is needed."""
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.DoubleType())])

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _model(name, load)
        for frame in frames:
            pairs = list(zip(frame[query], frame[passage]))
            known = [i for i, p in enumerate(pairs) if None not in p]
            got: list = [None] * len(pairs)
            for i, x in zip(known, _by_length([pairs[i] for i in known], lambda p: len(p[0]) + len(p[1]), batch, score)):
                got[i] = float(x)
            yield frame.assign(**{output: pd.Series(got, index=frame.index, dtype="float64")})

    shipped(rows.sparkSession)
    return rows.mapInPandas(call, schema)


def merged(base: Mapping, over: Mapping) -> dict:
    """A configuration laid over another: nested mappings merge, other values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def retrying(call: Callable, times: int = 5, wait: float = 1.0, limited: Callable[[Exception], bool] = lambda e: False, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, repeated after errors: waits double, and are five times as long where a limit of requests was met. The
    last error is raised. Spark's own retries of tasks come on top."""

    def run(*args, **kwargs):
        for k in range(times):
            try:
                return call(*args, **kwargs)
            except Exception as e:  # noqa: BLE001  whatever a service raises
                if k + 1 == times:
                    raise
                sleep(wait * 2**k * (5 if limited(e) else 1))

    return run
