"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's words are taken at white space. Two series of n-grams are hashed: of the words themselves
(one and two words) and of their shapes (one to three), a shape being the word with letters and
digits classed by case and kind, runs cut to one, and every other character kept. A word that repeats its predecessor
adds a gram of its own. The value of a gram is its share of its series, so a text's length does not
matter, and a score is the logistic of one sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, crc_remainder, free_name, held_by, slices, texts_of, trim

BITS = 20
MEMO_ENTRIES = 150_000
_SHAPE = (
    (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"),
    (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "B"),
    (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"),
    (re.compile(r"\d+"), "0"),
)

_RUN = re.compile(r"(.)\1{2,}", re.S)


def shape(word: str) -> str:
    """Lower-case runs as a, a capital as A, more capitals as B, digits as 0; other characters stay, a run of one character as that character once more than once."""
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return _RUN.sub(r"\1\1", word)


class _Words(dict):
    """Word to its two 31-bit hashes, packed; emptied when full."""

    def __missing__(self, word: str) -> int:
        code = (xxhash.xxh32_intdigest(word.lower().encode()) >> 1) << 31 | xxhash.xxh32_intdigest(shape(word).encode(), 7) >> 1
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = code
        return code


_WORDS = _Words()
_M = np.uint64(0x9E3779B97F4A7C15)


def _slot(code: np.ndarray, series: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (code + np.uint64(series * 0x51ED270B)) * _M
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def grams(text: str) -> list[np.ndarray]:
    """Slots of a text's grams, a series each."""
    words = text.split()
    packed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    word, form = packed >> np.uint64(31), packed & np.uint64(0x7FFFFFFF)
    out = [_slot(word, 1), _slot(form, 2)]
    if len(words) > 1:
        with np.errstate(over="ignore"):
            pair = form[:-1] * np.uint64(0x1000193) + form[1:]
            out += [_slot(word[:-1] * np.uint64(0x1000193) + word[1:], 3), _slot(pair, 4)]
            if len(words) > 2:
                out.append(_slot(pair[:-1] * np.uint64(0x1000193) + form[2:], 5))
        out.append(_slot((word[:-1] == word[1:]).astype(np.uint64), 6))
    return out


@dataclass
class Model:
    """Weights by slot and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = self.bias
        for slots in grams(text):
            if len(slots):
                z += float(self.weights[slots].sum(dtype=np.float64)) / len(slots)
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -50, 50))))


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7
) -> Model:
    """FTRL-proximal over (slots, values, label) rows: per-slot learning rates, weights from the sums of gradients."""
    z, n, bias_z, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for r in rng.permutation(len(rows)):
            slots, values, label = rows[r]
            values = values.astype(np.float64)
            zs, ns = z[slots], n[slots]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values + bias, -35, 35)))
            g = (p - label) * values
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slots] = ns + g * g
            gb = p - label
            bias_z += gb - (np.sqrt(bias_n + gb * gb) - np.sqrt(bias_n)) / alpha * bias
            bias_n += gb * gb
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)))


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text, for training."""
    series = [s for s in grams(text) if len(s)]
    if not series:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    slots, at = np.unique(np.concatenate(series), return_inverse=True)
    return slots.astype(np.int32), np.bincount(at, np.concatenate([np.full(len(s), 1 / len(s)) for s in series])).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_fold: int = 0, max_rows: int = 8000) -> Model:
    """Train on labelled rows outside the held-out fold (crc32 of the id modulo ``folds``).

    ``max_rows`` bounds the sample: the rows whose ids hash lowest, which no order of the input
    changes. The sample's labels, and later its gram vectors, are all that reaches the driver. A
    document with several labels counts as its lowest; null ids and labels, and labels without a
    document, are left out. Without any label every score is 0.5.
    """
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc_remainder(id_col, folds) != held_fold))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(F.col(label)).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), "__id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by("quality")
        for whole in batches:
            for batch in slices(whole):
                made = [_vector(t) for t in texts_of(batch, "__text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").cast(pa.int64()), batch.column("__label"), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([b for _, b in made], pa.list_(pa.float32()))],
                    names=["id", "label", "slots", "values"],
                )

    got = chosen.mapInArrow(vectors, "id long, label int, slots array<int>, values array<float>").toArrow()
    # the vectors stay in Arrow's buffers: a row is a view, in the order of ids; of rows of one id the one with the least vector counts
    rows: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for batch in got.to_batches():
        parts = [(batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("slots", "values")]
        for k, (i, y) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            slots, values = (x[at[k] : at[k + 1]] for x, at in parts)
            if i not in rows or (len(slots), slots.tobytes(), values.tobytes()) < (len(rows[i][0]), rows[i][0].tobytes(), rows[i][1].tobytes()):
                rows[i] = (slots, values, y)
    model = train_ftrl([rows[i] for i in sorted(rows)]) if rows else Model(np.zeros(1 << BITS, np.float32), 0.0)
    del got, rows
    trim()
    return model


def score(df: DataFrame, model: Model, text: str = "text", output: str = "quality_score") -> DataFrame:
    """Add ``output``: the probability (0 to 1) that a text is good. A map without a shuffle.

    Null and empty texts get the bias alone. Other columns pass through; one named ``output`` is replaced.
    The model is one array of fixed size, sent to each executor once.
    """
    weights = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kept = [c for c in df.columns if c.lower() != output.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    hidden = free_name(source, "__text")
    reads = bounded(source).withColumn(hidden, F.col(f"`{text}`") if text in kept else F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by("quality")
        model = Model(*weights.value)
        for whole in batches:
            for batch in slices(whole):
                scores = pa.array([model.score(t) for t in texts_of(batch, hidden)], pa.float64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], names=[*kept, output])

    return reads.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(output, T.DoubleType(), False)]))
