"""Language identification by mixtures: each document's language shares from n-gram likelihoods.

A model holds, for each language, a smoothed distribution over hashed byte n-grams of letters. A
document is taken as a mixture: expectation-maximisation finds the shares under which its words,
each by the likelihood of its n-grams, are likeliest, and the set of languages is the one whose likelihood, less a penalty for every
language, is greatest among the nested sets by share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, free_name, slices, texts_of

BITS = 17
#: Bytes that are no part of a letter become blanks; bytes over 127 belong to letters here.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-case bytes with blanks for all but letters, three blanks before each text; where each text begins."""
    raw = [t.lower().encode() for t in texts]
    starts = np.cumsum([0] + [len(r) + 3 for r in raw])
    return _LETTER[np.frombuffer(b"".join(b"   " + r for r in raw) + b"   ", np.uint8)].astype(np.uint32), starts


def grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte 4-grams whose second byte is a letter, and where in ``b`` that byte is."""
    at = np.flatnonzero(b[1:-2] != 32) + 1
    code = b[at - 1] << np.uint32(24) | b[at] << np.uint32(16) | b[at + 1] << np.uint32(8) | b[at + 2]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), at


@dataclass
class Model:
    """Languages in order, and log likelihoods by slot and language."""

    langs: list[str]
    table: np.ndarray

    def mixtures(self, texts: list[str], rounds: int = 10, penalty: float = 2.0, least: float = 0.02) -> list[list[tuple[str, float]]]:
        """For each text the chosen languages with their shares, largest first; none for a text without letters.

        The units of the mixture are words: a word's likelihood is the product of its n-grams'. A
        language joins the set only with a share of ``least`` or more in the mixture of all.
        """
        b, starts = letters(texts)
        slots, at = grams(b)
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        if not len(at) or not self.langs:
            return out
        heads = np.flatnonzero(b[at - 1] == 32)
        like = np.add.reduceat(self.table[slots], heads, axis=0)
        like -= like.max(1, keepdims=True)
        like = np.exp(like.astype(np.float64)) + 1e-12
        bounds = np.searchsorted(at[heads], starts)
        for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if high > low:
                out[k] = self._mixture(like[low:high], rounds, penalty, least)
        return out

    def _mixture(self, like: np.ndarray, rounds: int, penalty: float, least: float) -> list[tuple[str, float]]:
        n, count = like.shape

        def fitted(columns: np.ndarray) -> tuple[np.ndarray, float]:
            part = like[:, columns]
            share = np.full(len(columns), 1.0 / len(columns))
            for _ in range(rounds if len(columns) > 1 else 0):
                share = share * ((1.0 / (part @ share)) @ part) / n
            return share, float(np.log(part @ share).sum())

        share, _ = fitted(np.arange(count))
        order = np.argsort(-share, kind="stable")
        best, best_share, chosen = -np.inf, share, order[:1]
        for k in range(1, max(1, int((share >= least).sum())) + 1):
            s, fit = fitted(order[:k])
            value = fit - penalty * k * np.log(n + 1)
            if value > best:
                best, best_share, chosen = value, s, order[:k]
        return sorted(((self.langs[i], float(s)) for i, s in zip(chosen, best_share, strict=True)), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = 3000, smoothing: float = 0.2) -> Model:
    """Count n-grams of a sample of each language's documents.

    ``rows_per_lang`` bounds the sample: about so many documents of a language, those whose texts
    hash under its rate, so each language is kept however rare. Rows with a null text or language
    are left out. What reaches the driver is one array of fixed size for each language and each of
    eight tasks.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("__lang"), F.col(text).alias("__text"))
    sizes = {r["__lang"]: r["n"] for r in known.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    langs = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows_per_lang / sizes[k]))]), F.col("__lang"))
    sample = known.where(F.pmod(F.xxhash64("__text"), F.lit(1_000_003)) < rate * 1_000_003).repartition(8)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole):
                for k, t in zip(batch.column("__lang").to_pylist(), texts_of(batch, "__text"), strict=True):
                    sums.setdefault(k, np.zeros(1 << BITS, np.int64))
                    sums[k] += np.bincount(grams(letters([t])[0])[0], minlength=1 << BITS)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.astype(np.uint32).tobytes()], pa.binary())], names=["lang", "counts"])

    table = np.full((1 << BITS, len(langs)), smoothing)
    for r in sample.mapInArrow(counted, "lang string, counts binary").collect():
        table[:, langs.index(r.lang)] += np.frombuffer(r.counts, np.uint32)
    return Model(langs, np.log(table / table.sum(0)).astype(np.float32))


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", share: str = "lang_score", shares: str | None = None) -> DataFrame:
    """Add the language with the largest share, and that share (0 to 1); ``shares`` names a column for all of the mixture.

    A text that is null or without a letter is ``und`` with score 0. A text with letters that no
    model knows takes the first language with score 0. A map without a shuffle; other columns pass
    through, and those named as outputs are replaced.
    """
    outputs = [lang, share] + ([shares] if shares else [])
    kept = [c for c in df.columns if c.lower() not in {o.lower() for o in outputs}]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    fields = [T.StructField(lang, T.StringType(), False), T.StructField(share, T.DoubleType(), False)]
    kind = pa.list_(pa.struct([pa.field("lang", pa.string()), pa.field("share", pa.float64())]))
    if shares:
        fields.append(T.StructField(shares, T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))))
    sent = df.sparkSession.sparkContext.broadcast((model.langs, model.table))
    hidden = free_name(source, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for whole in batches:
            for batch in slices(whole):
                found = []
                texts = texts_of(batch, hidden)
                for t, mix in zip(texts, model.mixtures(texts), strict=True):
                    if not mix:
                        mix = [(model.langs[0], 0.0)] if model.langs and any(map(str.isalpha, t)) else [("und", 0.0)]
                    elif not any(map(str.isalpha, t)):
                        mix = [("und", 0.0)]
                    found.append(mix)
                columns = [pa.array([m[0][0] for m in found], pa.string()), pa.array([min(1.0, m[0][1]) for m in found], pa.float64())]
                if shares:
                    columns.append(pa.array([[{"lang": k, "share": s} for k, s in m] for m in found], kind))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *outputs])

    return bounded(source).withColumn(hidden, F.col(f"`{text}`")).mapInArrow(run, T.StructType([*source.schema.fields, *fields]))
