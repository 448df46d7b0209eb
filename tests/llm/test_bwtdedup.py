import hashlib
import random

import numpy as np

from tessera.llm import bwtdedup
from tests.conftest import SF01


def brute(rows, length=100):
    """(id, bytes, removed, spans, digest) from a table of all windows."""
    first = {}
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, raw in rows:
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (i, p))
    out = set()
    for i, raw in rows:
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] != (i, p):
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:-1], strict=True) if not g)
        out.add((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **more):
    out = bwtdedup.remove(df, bwtdedup.spans(df, **more))
    return [(r.doc_id, r.dedup_bytes, r.dedup_removed, r.dedup_spans, hashlib.sha256(bytes(r.dedup_kept)).hexdigest()) for r in out.collect()]


def corpus(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abé ñz") for _ in range(k))
    passages = [text(rng.choice([99, 100, 101, 150, 300])) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.3 and rows:
            t = rng.choice(rows)[1]
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(["", "x"]) + t[k + rng.randrange(3) :]
        elif kind < 0.4:
            t = rng.choice(["ab", "a", "é ", "abc abd "]) * rng.randrange(150)
        else:
            t = text(rng.randrange(260))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(t) + 1)
                t = t[:k] + rng.choice(passages) + t[k:]
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


def test_random_corpora_equal_brute_force(spark, monkeypatch):
    rows = corpus(1, 250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert set(result(df)) == want
    monkeypatch.setattr(bwtdedup, "SHARD", 500)
    monkeypatch.setattr(bwtdedup, "CHUNK", 2000)
    monkeypatch.setattr(bwtdedup, "HOT", 3)  # most anchors are dealt as hot ones
    got = result(df)
    assert set(got) == want and len(got) == len(rows)


def test_query_equals_brute_force_on_a_whole_table(spark):
    from tessera.llm.queries import op9_bwt_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    assert {tuple(r) for r in op9_bwt_dedup(spark, SF01).collect()} == brute(rows)


def blocks_of(texts, step):
    """Positions, block numbers (from 1), and each position's blocks up to its text's end."""
    numbers, symbols, before, tails = {}, [], [], []
    for t in texts:
        starts = [numbers.setdefault(t[p : p + step], len(numbers) + 1) if p + step <= len(t) else 0 for p in range(len(t) + 1)]
        symbols += starts
        before += [starts[p - step] if p >= step else 0 for p in range(len(t) + 1)]
        tails += [tuple(starts[p::step]) for p in range(len(t) + 1)]
    return np.array(symbols, np.int32), np.array(before, np.int32), tails, len(numbers)


def merged_order(shards, step, rounds):
    symbols, before, tails, most = blocks_of([t for s in shards for t in s], step)
    cuts = np.cumsum([0] + [sum(len(t) + 1 for t in s) for s in shards])
    made = [bwtdedup.transform(symbols[a:b], before[a:b], step, most) for a, b in zip(cuts, cuts[1:])]
    mixed, shared = bwtdedup.interleave([t for t, _ in made], rounds, most)
    taken = [iter(order + a) for (_, order), a in zip(made, cuts)]
    return made, [tails[next(taken[k])] for k in mixed], shared, most


def test_merging_transforms_orders_all_suffixes_and_gives_common_prefixes():
    rng = random.Random(6)
    shards = [["".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(n)] for n in (1, 12, 3, 40)]
    for rounds in (1, 2, 4):
        made, got, shared, most = merged_order(shards, 3, rounds)
        assert [g[:rounds] for g in got] == sorted(g[:rounds] for g in got)
        for i in range(1, len(got)):
            a, b = got[i - 1][:rounds], got[i][:rounds]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y or x == 0), rounds)
            assert shared[i] == (same if same < rounds else -1)
    # the interleave is read through the shards' own orders: with one of them spoiled the result is another
    mixed, _ = bwtdedup.interleave([t for t, _ in made], 4, most)
    spoiled, _ = bwtdedup.interleave([made[0][0], made[1][0][::-1].copy(), *[t for t, _ in made[2:]]], 4, most)
    assert (mixed != spoiled).any()


def test_one_anchor_in_many_chunks(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = text(160)
    rows = [(i, text(rng.randrange(60)) + passage[rng.randrange(20) : 160 - rng.randrange(20)] + text(rng.randrange(60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bwtdedup, "CHUNK", 3000)
    monkeypatch.setattr(bwtdedup, "HELD_WINDOWS", 40)
    want = brute(rows)
    for hot in (3, 10_000):
        monkeypatch.setattr(bwtdedup, "HOT", hot)
        assert set(result(df)) == want


def test_edge_rows(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefghijk ") for _ in range(n)) for n in (130, 160))
    rows = [(1, None), (2, ""), (3, a), (3, a), (None, a), (4, "é" * 30 + a), (5, a + b), (6, b + "x"), (7, "z" * 200_000), (8, a[:99]), (9, b), (9, "y" + b[:120])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, dedup_bytes int, id int")
    out = bwtdedup.remove(df, bwtdedup.spans(df))
    assert out.columns == ["doc_id", "text", "id", "dedup_bytes", "dedup_removed", "dedup_spans", "dedup_kept"]
    got = sorted(((r.doc_id or 0, r.text, r.dedup_bytes, r.dedup_removed, r.dedup_spans) for r in out.collect()), key=str)
    removed = [(i, t, r) for i, t, _, r, _ in got]
    assert len(got) == len(rows)
    assert removed.count((3, a, 0)) == 2 and (0, a, 0) in removed and (4, "é" * 30, 130) in removed and (5, b, 130) in removed and (6, "x", 160) in removed
    assert (7, "z", 199_999) in removed and (8, a[:99], 0) in removed and (1, None, 0) in removed and (2, "", 0) in removed
    assert (9, "", 160) in removed and (9, "y", 120) in removed
    empty = df.where("false")
    assert bwtdedup.remove(empty, bwtdedup.spans(empty)).count() == 0
