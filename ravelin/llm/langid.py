"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over fixed-length windows of a text's bytes; each filter's largest response in a window
feeds a softmax over the learned languages. A text's prediction is the mean over its windows, by length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._common import in_slices, table, trimmed

#: Bytes in a window, widths of filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The training sample: about so many texts of each language, at most twice as many, and windows of each text, at most.
SAMPLE, PER_TEXT = 500, 6
EPOCHS, BATCH, RATE = 14, 96, 0.02
UNKNOWN = "und"
#: Windows that go through the network at a time.
BLOCK = 96


def _byte_classes() -> np.ndarray:
    """Bytes by class: padding 0, white space and controls, digits, other ASCII, letters without case, each UTF-8 byte beyond."""
    out = np.zeros(256, np.uint8)
    out[:128] = 3
    out[:33] = out[127] = 1
    out[48:58] = 2
    for k in range(26):
        out[65 + k] = out[97 + k] = 4 + k
    out[128:192] = 30 + np.arange(64)  # continuation bytes
    out[192:256] = 94 + np.arange(64) // 2  # lead bytes by pairs
    return out


CLASSES = _byte_classes()
SIZE = 128
assert CLASSES.max() < SIZE


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The whole text's byte classes in windows, the last one padded by 0, and the bytes in each."""
    raw = CLASSES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW), np.minimum(WINDOW, len(raw) - WINDOW * np.arange(n))


@dataclass
class Model:
    labels: list[str]
    filters: list[np.ndarray]  # by width: [offset, class, filter]
    bias: np.ndarray  # of all filters
    weights: np.ndarray  # [all filters, labels]
    shift: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """By width, tables over two neighbouring classes: two offsets cost one look-up."""
        out = []
        for f in self.filters:
            steps = []
            for o in range(0, len(f), 2):
                one = f[o][:, None, :]
                steps.append(np.ascontiguousarray((one + f[o + 1][None] if o + 1 < len(f) else one + np.zeros((1, SIZE, 1), np.float32)).reshape(SIZE * SIZE, -1)))
            out.append(steps)
        return out


def _responses(block: np.ndarray, tables: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
    """By width: [window, position, filter]. A filter may hang over the end, onto padding."""
    wide = np.zeros((len(block), WINDOW + max(WIDTHS) + 1), np.int32)
    wide[:, :WINDOW] = block
    pair = wide[:, :-1] * SIZE + wide[:, 1:]
    for steps in tables:
        out = steps[0][pair[:, :WINDOW]]
        for k, t in enumerate(steps[1:], 1):
            out += t[pair[:, 2 * k : 2 * k + WINDOW]]
        yield out


def probabilities(model: Model, block: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    hidden = np.concatenate([r.max(axis=1) for r in _responses(block, tables)], axis=1)
    logits = np.maximum(hidden + model.bias, 0) @ model.weights + model.shift
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    return logits / logits.sum(axis=1, keepdims=True)


def train(blocks: np.ndarray, labels: Sequence[str], seed: int = 7) -> Model:
    """Adam on the cross entropy; the gradient of a max goes to the position that gave it."""
    names = sorted(set(labels))
    want = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    hidden = FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = 0
    model = Model(names, filters, np.zeros(hidden, np.float32), rng.normal(0, 0.2, (hidden, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [*model.filters, model.bias, model.weights, model.shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = 1 / np.maximum(np.bincount(want, minlength=len(names)), 1)
    share = (share / share[want].mean()).astype(np.float32)
    step = 0
    total = EPOCHS * -(-len(blocks) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(blocks))
        for at in range(0, len(order), BATCH):
            step += 1
            take = order[at : at + BATCH]
            x, y = blocks[take].copy(), want[take]
            short = rng.random(len(x)) < 0.3  # texts may be short
            for k in np.flatnonzero(short):
                x[k, rng.integers(16, WINDOW) :] = 0
            tops, tails = [], []
            for r in _responses(x, model.pairs()):
                tails.append(r.argmax(axis=1))
                tops.append(np.take_along_axis(r, tails[-1][:, None], axis=1)[:, 0])
            h = np.concatenate(tops, axis=1) + model.bias
            a = np.maximum(h, 0)
            logits = a @ model.weights + model.shift
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            d = p * share[y][:, None] / len(y)
            dh = (d @ model.weights.T) * (h > 0)
            grads = []
            wide = np.zeros((len(x), WINDOW + max(WIDTHS) + 1), np.int64)
            wide[:, :WINDOW] = x
            rows = np.arange(len(x))[:, None]
            for k, w in enumerate(WIDTHS):
                g, dk = np.zeros_like(model.filters[k]), dh[:, k * FILTERS : (k + 1) * FILTERS]
                for o in range(w):
                    np.add.at(g[o], (wide[rows, tails[k] + o], np.arange(FILTERS)[None]), dk)
                g[:, 0] = 0  # padding says nothing
                grads.append(g)
            grads += [dh.sum(axis=0), a.T @ d, d.sum(axis=0)]
            rate = RATE * (1 - step / (total + 1))
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32(doc_id as text) mod 5 is 0. A row without doc_id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on a bounded sample of the labelled rows that aren't held out, drawn by a hash of doc_id.

    None if no row has a label. The sample holds about ``sample`` texts of each label, 2 * sample at most on average
    over labels, and PER_TEXT windows of each, spread over the whole text.
    """
    ready = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & has_letter(F.col("text")))
    counts = {r.lang: r.n for r in ready.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    grain = 1 << 20
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(grain))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (draw < min(grain, -(-sample * grain // n))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch["lang"], batch["text"]):
                got, _ = windows(text)
                for k in sorted({*np.linspace(0, len(got) - 1, PER_TEXT).astype(int).tolist()}):
                    langs.append(lang)
                    out.append(got[k].tobytes())
            yield pd.DataFrame({"lang": langs, "block": out})

    drawn = ready.filter(chosen).orderBy(draw, "doc_id").limit(2 * sample * len(counts)).select("lang", "text")
    got = in_slices(drawn, cut, "lang string, block binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "block"])  # the order of partitions has no say
    model = train(np.frombuffer(b"".join(got["block"]), np.uint8).reshape(-1, WINDOW), got["lang"].tolist())
    del got
    trimmed()
    return model


def predict(texts: Sequence[str | None], model: Model | None, tables: list | None = None) -> tuple[list[str], list[float], list[float]]:
    """Labels, scores and confidences of whole texts; ``und``, 0 and 0 for a text without letters, or without a model.

    The score is the label's mean probability over the text's windows, the confidence the mean of each window's largest:
    a text in two languages has a low score and a high confidence, one in neither has both low.
    """
    tables = tables or (model.pairs() if model else None)
    labels, scores, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    sums = np.zeros((len(texts), len(model.labels) if model else 1))
    tops = np.zeros(len(texts))

    def flush() -> None:
        if not held:
            return
        blocks, (who, size) = np.concatenate(held), np.concatenate(owners, axis=1)
        for at in range(0, len(blocks), BLOCK):
            p = probabilities(model, blocks[at : at + BLOCK], tables)
            np.add.at(sums, who[at : at + BLOCK], p * size[at : at + BLOCK, None])
            np.add.at(tops, who[at : at + BLOCK], p.max(axis=1) * size[at : at + BLOCK])
        held.clear()
        owners.clear()

    waiting = 0
    spoken = []
    for k, text in enumerate(texts):
        if model is None or text is None or not any(map(str.isalpha, text)):
            continue
        spoken.append(k)
        got, sizes = windows(text)
        held.append(got)
        owners.append(np.stack([np.full(len(got), k), sizes]))
        waiting += len(got)
        if waiting > 64 * BLOCK:
            flush()
            waiting = 0
    flush()
    for k in spoken:
        p = sums[k] / sums[k].sum()
        best = int(p.argmax())
        labels[k], scores[k], sure[k] = model.labels[best], float(min(1.0, p[best])), float(min(1.0, tops[k] / sums[k].sum()))
    return labels, scores, sure


def identify(docs: DataFrame, model: Model | None, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, confidence and the carried columns, one row for each input row.

    * null or empty text, or one without a letter: lang_pred ``und``, score and confidence 0. So too where nothing could be learned.
    * long texts are read whole, window by window; equal texts get equal results.
    * null doc_id: counts as held out. Repeated rows: one row each. Empty table: no rows.
    * of the columns, only text is an input of a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t"), held_out(F.col("doc_id")).alias("h"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "t" or "text" in carry], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType())])
    if "text" in carry:  # it goes to Python once
        rows = rows.drop(f"c{list(carry).index('text')}")
        schema = T.StructType([*rows.schema.fields, *schema.fields[-3:]])
    keep = [f.name for f in schema.fields[:-3]]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        tables = own.pairs() if own else None
        for batch in batches:
            labels, *numbers = predict(batch["t"].tolist(), own, tables)
            score, confidence = (pd.Series(x, index=batch.index, dtype="float64") for x in numbers)
            yield batch[keep].assign(lang_pred=pd.Series(labels, index=batch.index, dtype=object), score=score, confidence=confidence)

    out = in_slices(rows, label, schema)
    named = {c: F.col("t" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(carry)}
    return out.select(F.col("d").alias("doc_id"), F.col("h").alias("held_out"), "lang_pred", "score", "confidence", *named.values())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
