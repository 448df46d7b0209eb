import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, token_ids string, __x string"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def samples():
    rng = random.Random(5)
    words = ["the", "Straße", "niño", "été", "don't", "x" * 300, "ab" * 200, "   ", "\n\n\n", "日本語", "👩‍👩‍👧", "12345678901", "<|endoftext|>", "!?!", " ", "\x1c", "\x85"]
    for _ in range(200):
        yield "".join(rng.choice(words) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randrange(40)))
    for _ in range(200):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(60)))


def test_encodes_as_the_public_library(reference):
    tok = bpe.tokenizer(PATH, PATTERN)
    for text in samples():
        ids = tok.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert "".join(tok.stream(ids)) == text


def test_transducer_equals_merging_and_has_bounded_state():
    t = bpe.Transducer(bpe.load_ranks(PATH))
    piece = "abcdefghij".encode() * 30
    assert [t.ranks[x] for x in t.merge(piece)] == t.encode(piece)
    assert max(len(pending) for _, pending, _, _ in t.states) < 4 * t.longest


def syllables(n):
    rng = random.Random(7)
    parts = ["the", "re", "on", "ing", "an", "er", "ble", "ou", "sh", "wh", "ti", "of", "nt", "ed", "ea", "ly"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 7))) for _ in range(n)]


def test_beginnings_that_differ_in_what_is_settled_share_states(reference):
    """Each state and transition costs a step in Python: most bytes of words not seen yet must meet known ones."""
    t, steps = bpe.Transducer(bpe.load_ranks(PATH)), []
    step = t._step
    t._step = lambda *a: steps.append(1) or step(*a)
    words = sorted(set(syllables(20_000)))
    assert [t.encode(w.encode()) for w in words] == [reference.encode_ordinary(w) for w in words]
    beginnings = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert len(t.states) < len(beginnings) / 4 and len(steps) < len(beginnings) / 2


def test_tables_are_bounded_inside_a_piece_too(reference, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    t = bpe.Transducer(bpe.load_ranks(PATH))
    most, step = [0], t._step
    t._step = lambda *a: (step(*a), most.append(len(t.states)))[0]
    rng = random.Random(11)
    for piece in ["".join(syllables(2000)), " " * 3000, "日本語" * 500, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1000)), "x" * 2000, "7" * 2000, "-=" * 1000]:
        assert t.encode(piece.encode()) == reference.encode_ordinary(piece)
    assert max(most) <= 51


def test_any_bytes_encode_as_merging_does(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 300)
    ranks = bpe.load_ranks(PATH)
    t, rng, tokens = bpe.Transducer(ranks), random.Random(13), sorted(ranks)
    for _ in range(1500):
        kind = rng.randrange(3)
        if kind == 0:
            piece = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30)))
        elif kind == 1:
            piece = bytes(rng.choice(b"ab \n\xe3\x81t") for _ in range(rng.randrange(1, 60)))
        else:
            piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6)))
        assert t.encode(piece) == ([ranks[piece]] if piece in ranks else [ranks[x] for x in t.merge(piece)])


def test_streaming_decode_waits_for_whole_characters():
    m = bpe.Utf8Machine()
    data = "aé日👩z".encode()
    assert "".join([*(m.feed(data[i : i + 1]) for i in range(len(data))), m.close()]) == "aé日👩z"
    for bad in (b"a\xff", b"\xe0\x80z", b"\xf0\x9f\x91", b"\xc3", b"\xed\xa0\x80", b"\x80\x80"):
        m = bpe.Utf8Machine()
        assert "".join([*(m.feed(bad[i : i + 1]) for i in range(len(bad))), m.close()]) == bad.decode("utf-8", "replace")


def test_rows_nulls_repeats_and_clashing_names(spark, reference):
    rows = [(1, "hello world", "old", "x"), (1, "hello world", "old", "x"), (2, None, None, None), (None, "", "b", "c"), (3, "naïve " * 3000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = bpe.encode(df, PATH, PATTERN, decoded="back")
    assert out.columns == ["doc_id", "text", "__x", "token_ids", "back"]
    got = out.collect()
    assert len(got) == 5
    for r in got:
        assert r.token_ids == reference.encode_ordinary(r.text or "") and r.back == (r.text or "")
    again = bpe.decode(out.drop("text"), PATH, PATTERN)
    assert sorted(r.text for r in again.collect()) == sorted(r[1] or "" for r in rows)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_query_matches_the_library_on_a_whole_table(spark, reference):
    import hashlib

    from tessera.llm.queries import op4_byte_bpe
    from tests.conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_another_operators_step_drops_the_tokenizer():
    import public_tokenizers

    from tessera.llm import bpe, common

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tok = bpe.tokenizer(path, public_tokenizers.PATTERN)
    assert bpe.tokenizer(path, public_tokenizers.PATTERN) is tok and common._HELD == {"bpe": {(path, public_tokenizers.PATTERN): tok}}
    assert common.held_by("quality") == {} and common._HELD == {"quality": {}}


def test_idle_workers_keep_no_memo_tables(spark):
    from tessera.llm import common

    texts = spark.createDataFrame([(i, f"some unusualword{i} in text{i * 7919} of its own", None, None) for i in range(400)], SCHEMA).repartition(8)
    out = bpe.encode(texts, PATH, PATTERN)
    assert out.where(F.size("token_ids") > 0).count() == 400
    assert bpe.decode(out.drop("text"), PATH, PATTERN).where("text LIKE 'some unusualword%'").count() == 400

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            toks = list(common._HELD.get("bpe", {}).values())
            tables = [(len(t.pieces), len(t.pieces.transducer.states) - 1, len(t.pieces.transducer.moves), t.pieces.transducer.kept.cache_info().currsize) for t in toks]
            yield pa.RecordBatch.from_arrays([pa.array([len(toks)], pa.int64()), pa.array([sum(map(sum, tables))], pa.int64())], names=["toks", "entries"])

    got = spark.range(0, 64, 1, 64).mapInArrow(held, "toks long, entries long").collect()
    assert max(r.toks for r in got) == 1 and {r.entries for r in got} == {0}


def test_a_task_that_ends_early_is_tidied_too():
    from tessera.llm import common

    done = []
    run = common.tidy(lambda batches: (b for b in batches), lambda: done.append(1))
    assert list(run(iter([1, 2]))) == [1, 2] and done == [1]
    half = run(iter([1, 2]))
    next(half)
    half.close()
    assert done == [1, 1]
