"""Repeated substrings across documents, found by merging shard Burrows-Wheeler transforms.

Every 100-byte string that also starts earlier is marked, exactly, over all documents:

1. Anchors. In each window of 100 bytes the 20-byte gram with the lowest hash is its anchor, the
   leftmost on ties. That depends on the window's bytes alone, so equal windows have equal anchors
   at equal offsets, and neighbouring windows mostly share one. An occurrence of an anchor owns a
   run of windows; the bytes they cover are its context.
2. Occurrences with equal contexts own equal windows: all but the earliest are repeated as a whole.
   What is left are the earliest occurrences of distinct contexts, and only anchors with several
   contexts can still hide equal windows. An anchor that a sample shows to have very many contexts
   is dealt by context here and by window in the next step, so no task gets all of it.
3. Those contexts are gathered by anchor and read as streams in that order. Shards of them get a
   Burrows-Wheeler transform each: for every suffix, in the shard's order, the symbol before it. A
   symbol is a block of 25 bytes, so a text is 25 interlocked strings of blocks. Shards are merged
   from their transforms alone: an interleave (the shard of each merged suffix) starts as the shards
   one after the other; a round reads each shard's symbols in the interleave's order and deals the
   shards' numbers to the symbols' buckets, which orders by one more symbol. Where a round first
   tells neighbours apart their common prefix ends, so the rounds give the common prefixes too, and
   no suffixes of different shards are ever compared or sorted. After four rounds, neighbours that
   are still together share 100 bytes: such an interval's windows but the earliest are repeated.
4. Repeated windows become byte spans of their documents.

A task holds the anchors of about ``CHUNK`` bytes at a time. Of an anchor with more contexts than
that it keeps, from one chunk to the next, each distinct window once.
Blocks are compared by 64-bit hashes (four of them for a window), contexts by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batches_of, bounded, cut, discard, free_name, id_marks, marked, small_batches
from tessera.llm.hashing import Rolling, mix

GRAM = 20
#: Bytes of contexts that are merged at a time, and of a shard of them.
CHUNK, SHARD = 1 << 16, 1 << 14
#: Documents in the sample that finds hot anchors, contexts there that make an anchor hot, and hot anchors at most. Those beyond have less than a 65,536th of all contexts each.
SAMPLE, HOT, HOTTEST = 20_000, 200, 65_536
#: Occurrences that a task looks through for equal contexts, and windows of hot anchors that it looks through for equal ones, before it sends them.
HELD, HELD_WINDOWS = 400_000, 50_000


def anchors(data: np.ndarray, starts: np.ndarray, length: int):
    """Of documents in one array of bytes (``starts`` has one entry more): for each anchor occurrence its hash, its context's hash, its document's number, first window, windows, and offset in the first."""
    n, span = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    roll = Rolling(data)
    at = np.arange(n - GRAM + 1)
    gram = roll.of(at, at + GRAM)
    low = (gram & ~np.uint64((1 << 31) - 1)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
    first = np.flatnonzero(starts[doc + 1] - at[: len(place)] >= length)
    if not len(first):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (place[first[1:]] != place[first[:-1]]) | (doc[first[1:]] != doc[first[:-1]])]))
    begin = first[new]
    windows = np.diff(np.append(new, len(first)))
    anchor = place[begin]
    offset = anchor - begin
    with np.errstate(over="ignore"):
        context = mix(roll.of(begin, begin + windows + length - 1) + (windows << 8 | offset).astype(np.uint64), 2)
    return gram[anchor], context, doc[begin], begin - starts[doc[begin]], windows, offset


def pack(sub: np.ndarray, first: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """One number that orders by row (18 bits of its text's hash), then position; windows and offset (under 128) below."""
    return ((sub << 31 | first) << 7 | (windows - 1)) << 7 | offset


def sub_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) >> 46 for a, b in zip(starts[:-1], starts[1:], strict=True)], np.int64)


def merged_runs(doc: np.ndarray, row: np.ndarray, windows: np.ndarray, length: int):
    """Runs of windows (row: packed row and position; windows in each) as few spans: (doc, row, length in bytes)."""
    if not len(doc):
        return doc, row, windows
    order = np.lexsort((row, doc))
    doc, row, end = doc[order], row[order], (row + windows + length - 1)[order]
    group = np.concatenate([[True], doc[1:] != doc[:-1]])
    parts = np.split(end, np.flatnonzero(group)[1:])
    reach = np.concatenate([np.maximum.accumulate(p) for p in parts])
    new = group | np.concatenate([[True], row[1:] > reach[:-1]])
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(doc)) - 1
    return doc[heads], row[heads], reach[last] - row[heads]


def stable_order(codes: np.ndarray, most: int) -> np.ndarray:
    """The stable order of numbers from 0 to ``most``, by counting 16 bits at a time."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if most > 0xFFFF:
        order = order[np.argsort((codes >> 16)[order].astype(np.uint16), kind="stable")]
    return order


def transform(symbols: np.ndarray, before: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform and the positions of its suffixes, in order.

    ``symbols`` has, for each position of the shard's texts (and one behind each), the number of the
    block that starts there, 0 where none does; ``before`` that of the block that ends there. Suffixes
    of equal blocks are in the order of the positions where they end.
    """
    ends = np.flatnonzero(symbols == 0)
    order = np.arange(len(symbols))
    while True:
        symbol = before[order]
        live = np.flatnonzero(symbol)
        after = np.concatenate([ends, order[live[stable_order(symbol[live], most)]] - step])
        if (after == order).all():
            return symbol, order
        order = after


def interleave(transforms: list[np.ndarray], rounds: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards from their transforms: the shard of each merged suffix, and how many symbols it shares with the one before it (-1: ``rounds`` or more).

    Only the interleave is refined. Where it is ordered by the first h symbols, dealing it by the
    symbols that stand before orders it by h + 1.
    """
    symbols = np.concatenate(transforms) if transforms else np.zeros(0, np.int32)
    mixed = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    ends = np.repeat(np.arange(len(transforms), dtype=np.uint16), [int((t == 0).sum()) for t in transforms])
    group, shared = np.zeros(len(mixed), np.int32), np.full(len(mixed), -1)
    for depth in range(rounds):
        symbol = np.empty(len(mixed), symbols.dtype)
        symbol[np.argsort(mixed, kind="stable")] = symbols  # each shard's transform is read from its start
        live = np.flatnonzero(symbol)
        moved = live[stable_order(symbol[live], most)]
        new = np.ones(len(mixed), bool)
        own, was = symbol[moved], group[moved]
        new[len(ends) + 1 :] = (own[1:] != own[:-1]) | (was[1:] != was[:-1])
        shared[new & (shared < 0)] = depth
        mixed, group = np.concatenate([ends, mixed[moved]]), np.cumsum(new, dtype=np.int32)
        if new.all():
            break
    return mixed, shared


def repeated_windows(texts: list[bytes], doc: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's windows (a text's document and packed row, and its first window's position): text numbers, positions, and whether an equal window is earlier."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    step = max(k for k in range(1, 26) if length % k == 0)
    heads = np.cumsum(sizes + 1) - sizes - 1
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(text)) - heads[text]
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    starts = np.flatnonzero(place + step <= sizes[text])
    numbers, known = pd.factorize(Rolling(raw).of(starts, starts + step))
    symbols, before = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
    symbols[starts] = numbers + 1
    before[starts + step] = numbers + 1
    cuts = heads[np.flatnonzero(np.concatenate([[True], np.diff(heads // SHARD) > 0]))].tolist() + [len(text)]
    made = [transform(symbols[a:b], before[a:b], step, len(known)) for a, b in zip(cuts, cuts[1:])]
    mixed, shared = interleave([t for t, _ in made], length // step, len(known))
    at = np.empty(len(text), np.int64)
    at[np.argsort(mixed, kind="stable")] = np.concatenate([order + a for (_, order), a in zip(made, cuts)])
    again = np.zeros(len(text), bool)
    several = np.flatnonzero(np.concatenate([(shared[1:] < 0), [False]]) | (shared < 0))
    at, new = at[several], shared[several] >= 0
    if len(at):
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        docs, rows = doc[text[at]], row[text[at]] + place[at]
        least = np.minimum.reduceat(docs, first)[group]
        least_row = np.minimum.reduceat(np.where(docs == least, rows, np.iinfo(np.int64).max), first)[group]
        again[at] = (docs > least) | (rows > least_row)
    whole = np.flatnonzero(place + length <= sizes[text])
    return text[whole], place[whole], again[whole]


def spans(documents: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(id, sub, spans): for each row with repeated windows, its spans [start, end) in bytes, sorted and apart.

    ``sub`` are 18 bits of the text's hash: it tells rows of one id apart. Earlier is a smaller id,
    then (for rows that repeat an id) the smaller ``sub``, then the earlier start; a row repeated as a
    whole counts once. Null texts are empty. Rows with a null id take no part. ``length`` is 40 to 127.
    """
    spark = documents.sparkSession
    with small_batches(spark):
        return _spans(documents, id_col, text, length)


def _spans(documents: DataFrame, id_col: str, text: str, length: int) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rate = min(1.0, SAMPLE / max(1, rows))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (64 << 20) + 1)

    def occurrences(batches: Iterator[pa.RecordBatch]):
        for (ids,), data, starts in batches_of(batches, ["id"], 1 << 20):
            h, c, d, first, windows, offset = anchors(data, starts, length)
            yield h, c, np.array(ids, np.int64)[d], pack(sub_of(data, starts)[d], first, windows, offset)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, _, _ in occurrences(batches):
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[: len(h)]
            items, counts = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(items[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], names=["h", "n"])

    chosen = docs.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < rate * 1_000_003)
    hot = chosen.mapInArrow(sampled, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(HOTTEST).toArrow()
    hot_anchors = spark.sparkContext.broadcast(np.sort(hot["h"].to_numpy().astype(np.int64)))

    def is_hot(h: np.ndarray) -> np.ndarray:
        known = hot_anchors.value
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

    def later_rows(doc, place):
        """Occurrences that are repeated as a whole, as rows of spans."""
        d, r, n = merged_runs(doc, place >> 14, (place >> 7 & 127) + 1, length)
        return [pa.array(d), pa.array(r), pa.array(n)]

    def dealt(k: int) -> pa.Array:
        """Keys that deal spans evenly."""
        return pa.array(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, k))

    NAMES = ["h", "salt", "c", "doc", "place", "row", "bytes"]
    kinds = "h long, salt int, c long, doc long, place long, row long, bytes long"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences, the earliest of each context among those held; the others at once as spans."""
        held, size = [], 0

        def settle():
            h, c, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(h):
                return
            order = np.lexsort((place, doc, c))
            h, c, doc, place = h[order].view(np.int64), c[order].view(np.int64), doc[order], place[order]
            new = np.concatenate([[True], c[1:] != c[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc > doc[lead]) | (place >> 14 > place[lead] >> 14)
            salt = np.where(is_hot(h[new]), c[new] & 0x3FFFFFFF, -1).astype(np.int32)
            k = int(new.sum())
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(salt, pa.int32()), pa.array(c[new]), pa.array(doc[new]), pa.array(place[new]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=NAMES)
            spare = later_rows(doc[later], place[later])
            k = len(spare[0])
            yield pa.RecordBatch.from_arrays([dealt(k), pa.array(np.full(k, -2), pa.int32()), pa.nulls(k, pa.int64()), spare[0], pa.nulls(k, pa.int64()), *spare[1:]], names=NAMES)

        for part in occurrences(batches):
            held.append(part)
            size += len(part[0])
            if size > HELD:
                yield from settle()
                held, size = [], 0
        if held:
            yield from settle()

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a stream by anchor and context: spans of repeated contexts, and the earliest of each context where an anchor has several.

        What is carried to the next batch are an anchor's first and latest context; the first is sent when a second one comes.
        """
        names = ["h", "salt", "doc", "place", "row", "bytes"]
        carried = tuple(np.zeros(0, np.int64) for _ in range(5))
        sent = np.zeros(0, bool)
        for batch in batches:
            done = batch.filter(batch.column("row").is_valid())
            if done.num_rows:
                yield done.select(names)
            batch = batch.filter(batch.column("row").is_null())
            if not batch.num_rows:
                continue
            h, salt, c, doc, place = (np.concatenate([old, batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64)]) for old, x in zip(carried, ("h", "salt", "c", "doc", "place"), strict=True))
            old = np.concatenate([sent, np.zeros(batch.num_rows, bool)])
            anchor = np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
            new = anchor | np.concatenate([[True], c[1:] != c[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc > doc[lead]) | (place >> 14 > place[lead] >> 14)
            spare = later_rows(doc[later], place[later])
            k = len(spare[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), spare[0], pa.nulls(k, pa.int64()), *spare[1:]], names=names)
            of = np.cumsum(anchor) - 1
            keep = new & ~old & ((np.bincount(of, new)[of] > 1) | (salt >= 0))
            k = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(salt[keep].astype(np.int32)), pa.array(doc[keep]), pa.array(place[keep]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
            last = np.unique([np.flatnonzero(anchor)[-1], lead[-1]])
            carried, sent = tuple(x[last] for x in (h, salt, c, doc, place)), (old | keep)[last]

    first = docs.mapInArrow(found, kinds).repartition(partitions, "h", "salt").sortWithinPartitions("h", "salt", "c", "doc", "place").mapInArrow(resolved, "h long, salt int, doc long, place long, row long, bytes long")
    first = cut(first, "bwt-contexts")
    asked = first.where("place IS NOT NULL").groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("place", "h", "salt")).alias("asked"))
    marks = id_marks(first.where("place IS NOT NULL").select(F.col("doc").alias("id")))
    near = marked(docs, "id", marks, True)
    CONTEXTS = ["h", "salt", "doc", "row", "bytes", "context"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the contexts that were asked for; of hot anchors a row for each window, dealt by its bytes, equal ones among those held once."""
        windows: dict[bytes, tuple[int, int, int]] = {}
        again: list[tuple[int, int]] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=CONTEXTS)

        def settle():
            yield table([(h, xxhash.xxh3_64_intdigest(w) & 0x3FFFFFFF, doc, row, None, w) for w, (doc, row, h) in windows.items()])
            d, r, n = merged_runs(np.array([a for a, _ in again], np.int64), np.array([b for _, b in again], np.int64), np.ones(len(again), np.int64), length)
            k = len(d)
            yield pa.RecordBatch.from_arrays([dealt(k), pa.array(np.full(k, -2), pa.int32()), pa.array(d), pa.array(r), pa.array(n), pa.nulls(k, pa.binary())], names=CONTEXTS)
            windows.clear(), again.clear()

        for (asked,), data, starts in batches_of(batches, ["asked"], 1 << 20):
            sub = sub_of(data, starts)
            rows = []
            for k, wanted in enumerate(asked):
                raw = data[starts[k] : starts[k + 1]].tobytes()
                for w in wanted:
                    row, count = w["place"] >> 14, (w["place"] >> 7 & 127) + 1
                    if row >> 31 != sub[k]:
                        continue  # of another row with this id
                    at = row & (1 << 31) - 1
                    if w["salt"] < 0:
                        rows.append((w["h"], -1, w["id"], row, None, raw[at : at + count + length - 1]))
                        continue
                    for p in range(count):
                        own, string = (w["id"], row + p, w["h"]), raw[at + p : at + p + length]
                        had = windows.get(string)
                        if had is None or own[:2] < had[:2]:
                            windows[string], own = own, had
                        if own is not None and own[:2] != windows[string][:2]:
                            again.append(own[:2])
            yield table(rows)
            if len(windows) + len(again) > HELD_WINDOWS:
                yield from settle()
        if windows:
            yield from settle()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a stream by anchor: repeated windows as spans. Chunks end between anchors, or keep each window of the last one once."""
        names = ["doc", "row", "bytes"]
        held: list[tuple[tuple[int, int], int, int, bytes]] = []
        size = 0

        def settle(last: bool):
            nonlocal held, size
            key = held[-1][0]
            open_ = 0 if last else next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != key), -1) + 1
            part = held if last or not open_ else held[:open_]
            rest = [] if last or not open_ else held[open_:]
            doc, row = np.array([x[1] for x in part], np.int64), np.array([x[2] for x in part], np.int64)
            text, place, again = repeated_windows([x[3] for x in part], doc, row, length)
            d, r, n = merged_runs(doc[text[again]], row[text[again]] + place[again], np.ones(int(again.sum()), np.int64), length)
            if not last and not open_:  # one anchor fills the chunk: its windows that are not repeated stay, as runs
                fresh = np.flatnonzero(~again)
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(fresh) != 1) | (np.diff(text[fresh]) != 0)]))
                tails = np.append(heads[1:], len(fresh)) - 1
                rest = [(key, part[t][1], part[t][2] + a, part[t][3][a : b + length]) for t, a, b in zip(text[fresh[heads]].tolist(), place[fresh[heads]].tolist(), place[fresh[tails]].tolist(), strict=True)]
            held, size = rest, sum(len(x[3]) for x in rest)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(r), pa.array(n)], names=names)

        limit = CHUNK
        for batch in batches:
            done = batch.filter(batch.column("bytes").is_valid())
            if done.num_rows:
                yield done.select(names)
            batch = batch.filter(batch.column("bytes").is_null())
            for h, salt, doc, row, context in zip(*(batch.column(c).to_pylist() for c in ("h", "salt", "doc", "row", "context")), strict=True):
                held.append(((h, salt), doc, row, context))
                size += len(context)
                if size >= limit:
                    yield settle(False)
                    limit = max(CHUNK, 2 * size)
        if held:
            yield settle(True)

    with_id = asked.withColumn("asked", F.expr("transform(asked, x -> named_struct('place', x.place, 'h', x.h, 'salt', x.salt, 'id', id))"))
    texts = near.join(with_id, "id").select("asked", "text")
    second = texts.mapInArrow(contexts, "h long, salt int, doc long, row long, bytes long, context binary").repartition(partitions, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(merged, "doc long, row long, bytes long")
    every = first.where("row IS NOT NULL").select("doc", "row", "bytes").unionByName(second)
    grouped = every.groupBy(F.col("doc").alias("id"), F.shiftright("row", 31).cast("int").alias("sub")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("row").bitwiseAND((1 << 31) - 1).alias("start"), (F.col("row").bitwiseAND((1 << 31) - 1) + F.col("bytes")).alias("end")))).alias("raw")
    )
    apart = F.expr(
        """aggregate(raw, cast(array() as array<struct<start: bigint, end: bigint>>), (a, x) ->
             if(size(a) > 0 and x.start <= element_at(a, -1).end,
                concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
                concat(a, array(named_struct('start', x.start, 'end', x.end)))))"""
    )
    out = cut(grouped.select("id", "sub", apart.alias("spans")), "bwt-spans")
    discard(first)
    return out


def remove(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text", prefix: str = "dedup_") -> DataFrame:
    """``documents`` with the spans' bytes taken out.

    Adds ``{prefix}bytes``, ``{prefix}removed``, ``{prefix}spans`` (counts) and ``{prefix}kept`` (the
    remaining bytes); ``text`` becomes those bytes as a string, a character that a span cuts left out.
    A text without spans, and a null one, stays as it is (null counts as 0 bytes). Names that clash
    with the added columns are replaced.
    """
    documents = bounded(documents)
    added = [prefix + c for c in ("bytes", "removed", "spans", "kept")]
    kept = [c for c in documents.columns if c.lower() not in {a.lower() for a in added}]
    source = documents.select(*[F.col(f"`{c}`") for c in kept])
    fields = [T.StructField(added[0], T.LongType(), False), T.StructField(added[1], T.LongType(), False), T.StructField(added[2], T.LongType(), False), T.StructField(added[3], T.BinaryType(), False)]
    marks = id_marks(found.select("id"))
    key, sub = free_name(source, "__id"), free_name(source, "__sub")
    keyed = source.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    plain = marked(keyed, key, marks, False).select(*kept, F.length(raw).cast("long").alias(added[0]), F.lit(0).cast("long").alias(added[1]), F.lit(0).cast("long").alias(added[2]), raw.alias(added[3]))
    spans_of = free_name(source, "__spans")
    lists = found.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("sub", "spans")).alias(spans_of))
    touched = marked(keyed, key, marks, True).join(lists, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, made = [], []
                for t, lists in zip(batch.column(text).to_pylist(), batch.column(spans_of).to_pylist(), strict=True):
                    raw = (t or "").encode()
                    own = [x["spans"] for x in lists or () if x["sub"] == xxhash.xxh3_64_intdigest(raw) >> 46]
                    own = own[0] if own else []
                    parts, last = [], 0
                    for x in own:
                        parts.append(raw[last : x["start"]])
                        last = x["end"]
                    rest = b"".join([*parts, raw[last:]])
                    texts.append(t if not own else rest.decode("utf-8", "ignore"))
                    made.append((len(raw), len(raw) - len(rest), len(own), rest))
                columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=[*kept, *added])

    return plain.unionByName(touched.mapInArrow(run, T.StructType([*source.schema.fields, *fields])))
