"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND for every training passage.

The index is over the items, whose number is bounded and checked; every passage of every document is
a query. A passage's terms with their counts are matched against the posting lists: first a bound
from each term's greatest impact (vectorised over a document's passages), then for the passages
that could reach the threshold WAND, which moves a pivot through the lists by the bounds of blocks
of items and scores only items that can reach it. What is retrieved is verified: a run of words that
the passage shares with the item's question, or with its answer, of a given share of that part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, free_name, slices, texts_of, tidy

#: Most test items, and most bytes of their texts, that an index takes: it is sent to every executor (about 40 bytes in an index for one of a text).
MOST_ITEMS, MOST_BYTES = 200_000, 8 << 20
BLOCK = 4
_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"\n\s*answer\s*:|\n(?=[^\n]*\Z)", re.I)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: what stands before and after ``answer:`` on a line of its own, or before and after the last line break; all is question without one."""
    m = _ANSWER.search(text)
    return (words_of(text[: m.start()]), words_of(text[m.end() :])) if m else (words_of(text), [])


def gram_size(part: list[str], question: list[str], gram: int) -> int:
    """Words of the grams that verify a part alone; 0 if it has none, as an answer that is shorter than the question's grams."""
    n = min(gram, len(part))
    return n if n >= min(gram, len(question)) else 0


@dataclass
class Index:
    """Units of items (of question and answer, runs of at most ``unit`` words) in order of size; postings by term with impacts relative to a unit's own score.

    So one threshold holds for all units. Each list has its greatest impact and that of each block of
    units; ``bounds`` has, for terms by blocks, the greatest impact, with a last row of zeros.
    """

    ids: list[int]
    parts: list[tuple[list[str], list[str]]]
    numbers: dict[str, int] = field(default_factory=dict)
    lists: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    unit_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    block: int = BLOCK
    #: Postings by term and block: units, impacts, greatest impact.
    slices: dict[int, tuple[list[int], list[float], float]] = field(default_factory=dict)

    @staticmethod
    def build(items: list[tuple[int, str]], unit: int = 48, k1: float = 1.2, b: float = 0.75, gram: int = 5) -> Index:
        """Impacts are BM25's: idf times the saturated, length-normed count. Each part that can be verified alone has units of its own; short ones are also indexed together."""
        index = Index([i for i, _ in items], [parts_of(t) for _, t in items])
        units = []
        for k, (q, a) in enumerate(index.parts):
            alone = [part for part in (q, a) if gram_size(part, q, gram)]
            for words in alone if min(len(q), len(a)) >= 8 or not a else [*alone, q + a]:
                n = max(1, -(-len(words) // unit))
                units += [(words[len(words) * j // n : len(words) * (j + 1) // n], k) for j in range(n)]
        units.sort(key=lambda u: len(u[0]))
        index.unit_item = np.array([k for _, k in units], np.int64)
        index.block = max(BLOCK, -(-len(units) // 128))
        mean = max(1.0, sum(len(w) for w, _ in units) / max(1, len(units)))
        postings: dict[str, dict[int, int]] = {}
        for i, (words, _) in enumerate(units):
            for w in words:
                of = postings.setdefault(w, {})
                of[i] = of.get(i, 0) + 1
        own, made = np.zeros(len(units)), []
        for w in sorted(postings):
            at, counts = np.array(list(postings[w])), np.array(list(postings[w].values()), float)
            idf = np.log(1 + (len(units) - len(at) + 0.5) / (len(at) + 0.5))
            impact = idf * counts * (k1 + 1) / (counts + k1 * (1 - b + b * np.array([len(units[i][0]) for i in at]) / mean))
            index.numbers[w] = len(made)
            made.append((at, impact))
            own[at] += impact
        index.lists = [(at, impact / own[at]) for at, impact in made]
        index.most = np.array([x.max() for _, x in index.lists] + [0.0], np.float32)
        index.bounds = np.zeros((len(made) + 1, max(1, -(-len(units) // index.block))), np.float32)
        for t, (at, impact) in enumerate(index.lists):
            blocks = at // index.block
            np.maximum.at(index.bounds[t], blocks, impact.astype(np.float32))
            for k in np.unique(blocks).tolist():
                own = blocks == k
                index.slices[t << 16 | k] = (at[own].tolist(), impact[own].tolist(), float(impact[own].max()))
        return index

    def wand(self, terms: np.ndarray, share: float, block: int) -> list[int]:
        """Units of a block whose relative score for these terms is ``share`` or more."""
        lists = []
        for t in terms.tolist():
            own = self.slices.get(t << 16 | block)
            if own:
                lists.append(own)
        place = [0] * len(lists)
        live = list(range(len(lists)))
        out = []
        while live:
            live.sort(key=lambda i: lists[i][0][place[i]])
            total, pivot = 0.0, -1
            for k, i in enumerate(live):
                total += lists[i][2]
                if total >= share - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            unit = lists[live[pivot]][0][place[live[pivot]]]
            if lists[live[0]][0][place[live[0]]] == unit:
                front = [i for i in live if lists[i][0][place[i]] == unit]
                if sum(lists[i][1][place[i]] for i in front) >= share:
                    out.append(unit)
                for i in front:
                    place[i] += 1
            else:
                for i in live[:pivot]:
                    at = lists[i][0]
                    while place[i] < len(at) and at[place[i]] < unit:
                        place[i] += 1
            live = [i for i in live if place[i] < len(lists[i][0])]
        return out

    def shares(self, words: list[str], item: int, gram: int) -> tuple[float, float]:
        """The shares of the grams of the item's question and of its answer that the words hold; 0 for a part that has no gram to be told by."""
        out = []
        for part in self.parts[item]:
            n = gram_size(part, self.parts[item][0], gram)
            grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if n else set()
            out.append(len(grams & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(grams) if grams else 0.0)
        return out[0], out[1]

    def verify(self, words: list[str], item: int, overlap: float, gram: int, both: bool = False) -> tuple[float, float] | None:
        """The shares of question and answer, if one of them (with ``both`` each that can be told) reaches ``overlap``; None otherwise."""
        question, answer = self.shares(words, item, gram)
        told = [x for part, x in zip(self.parts[item], (question, answer), strict=True) if gram_size(part, self.parts[item][0], gram)]
        return (question, answer) if told and (all if both else any)(x >= overlap for x in told) else None


def search(index: Index, text: str, passage: int, share: float, overlap: float, gram: int, both: bool = False) -> list[tuple[int, int, int, float, float]]:
    """(item number, first word, words, share of question, of answer) for each item that a passage of the text leaks, with the first such passage.

    Passages are ``passage`` words long and start every half of that. What is retrieved is verified
    over the passage and as many words on either side as the item has.
    """
    words = words_of(text)
    if not words or not index.lists:
        return []
    get, none = index.numbers.get, len(index.lists)
    terms = np.fromiter((get(w, none) for w in words), np.int64, len(words))
    step = max(1, passage // 2)
    count = max(1, -(-(len(words) - step) // step))
    padded = np.concatenate([terms, np.full((count + 1) * step - len(terms) + passage, none)])
    found: dict[int, tuple[int, int, float, float]] = {}
    for low in range(0, count, 512):
        starts = np.arange(low, min(count, low + 512)) * step
        sets = np.sort(padded[starts[:, None] + np.arange(passage)], axis=1)
        sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = none  # each term counts once
        # a bound by terms alone, then one for each block of units
        near = np.flatnonzero(index.most[sets].sum(1) >= share - 1e-4)
        for part in np.split(near, range(64, len(near), 64)):
            at, blocks = np.nonzero(index.bounds[sets[part]].sum(1) >= share - 1e-4)
            for k, block in zip(part[at], blocks.tolist(), strict=True):
                for unit in index.wand(sets[k][sets[k] < none], share, block):
                    item = int(index.unit_item[unit])
                    if item not in found:
                        size = len(index.parts[item][0]) + len(index.parts[item][1])
                        held = index.verify(words[max(0, starts[k] - size) : starts[k] + passage + size], item, overlap, gram, both)
                        if held:
                            found[item] = (int(starts[k]), int(min(passage, len(words) - starts[k])), *held)
    return sorted((i, *x) for i, x in found.items())


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = 64, share: float = 0.5, overlap: float = 0.5, gram: int = 5, output: str = "leaks", both: bool = False) -> DataFrame:
    """Add ``output``: for each document the items that one of its passages leaks, as (item_id, first_word, words, question, answer), the last two the shares that it holds of them.

    A passage is retrieved for an item with a score of ``share`` of the item's score for itself, and
    kept if it holds ``overlap`` of the ``gram``-word grams of the item's question or of its answer:
    either alone spoils the item. With ``both`` it must hold that much of each that has such grams. Null and
    empty texts leak nothing; items with a null id or without words are left out; repeated items
    count each. More than ``MOST_ITEMS`` items, or ``MOST_BYTES``, are an error. A map over the documents without a
    shuffle; other columns pass through, one named as the output is replaced.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).limit(MOST_ITEMS + 1).toArrow()
    if rows.num_rows > MOST_ITEMS or rows["t"].nbytes > MOST_BYTES:
        raise ValueError(f"more than {MOST_ITEMS} test items or {MOST_BYTES} bytes: search them in parts, and union the leaks")
    listed = sorted((i, t) for i, t in zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True) if words_of(t))
    index = Index.build(listed, gram=gram)
    sent = documents.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in documents.columns if c.lower() != output.lower()]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    hidden = free_name(source, "__text")
    entry = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for whole in batches:
            for batch in slices(whole):
                made = [[{"item_id": index.ids[i], "first_word": a, "words": n, "question": q, "answer": r} for i, a, n, q, r in search(index, t, passage, share, overlap, gram, both)] for t in texts_of(batch, hidden)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, kind)], names=[*kept, output])

    return bounded(source).withColumn(hidden, F.col(f"`{text}`")).mapInArrow(tidy(run), T.StructType([*source.schema.fields, T.StructField(output, T.ArrayType(entry), False)]))
