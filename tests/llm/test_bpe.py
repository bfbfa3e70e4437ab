import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from urlintel.llm import bpe
from urlintel.llm.arrow import map_slices


@pytest.fixture(scope="module")
def coder():
    return bpe.load(*bpe.defaults())


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=bpe.defaults()[1], mergeable_ranks=coder.transducer.ranks, special_tokens={})


def samples():
    r = random.Random(1)
    out = ["", " ", "a", "\n\n x", "\x1f \x85 z  y", "a" * 5000 + "é" * 300 + "!?" * 999 + " " * 3000, "don't  stop\n 12345 "]
    for _ in range(3000):
        out.append("".join(r.choice("aeth \n\t  é中\U0001f600!!..-- 0123abzqe's \x1c") for _ in range(r.randint(1, 60))))
    return out


def test_same_ids_as_the_library(coder, library):
    for text in samples():
        assert coder.encode(text) == library.encode_ordinary(text)


def test_transducer_against_merging(coder):
    """Transitions and what they put out against the definition, with a table so small that it is started again and again."""
    r = random.Random(2)
    t = coder.transducer
    for _ in range(400):
        piece = "".join(r.choice("aethinos \u00e9\u4e2d.-0") for _ in range(r.randint(1, 40))).encode()
        assert t.encode(piece) == t.merge(piece)
        if r.random() < 0.1:
            t.restart()


def test_tokens_go_out_after_bounded_lookahead(coder):
    t = coder.transducer
    longest = max(t.length)
    for piece in (b"x" * 3000, b"international" * 200, bytes(range(256)) * 10):
        state, held, out = 0, 0, []
        for byte in piece:
            state, put = t.step(state, byte)
            held += 1 - sum(t.length[x] for x in put)
            out += put
            assert held <= 2 * longest
        ends = t.states[state][2]
        assert out + list(t.path(ends, len(ends))) == t.encode(piece)
        assert b"".join(t.bytes_of[x] for x in t.encode(piece)) == piece


def test_groups_of_texts(library, monkeypatch):
    """New pieces of many texts go through the transducer together: same ids, few of them alone, with tables that are full all the time too."""
    texts = [*samples(), None, " \n a", "b ", "b", "  b  c ", "x\x00 x\x00\x00 x", "\x00", *(f"w{i}rd,  thing{i}\n" for i in range(500))]
    want = [library.encode_ordinary(t or "") for t in texts]
    alone = []
    for share, group in ((1, bpe.GROUP), (1, 1), (0.00001, 2000)):
        monkeypatch.setattr(bpe, "GROUP", group)
        own = bpe.load(*bpe.defaults(), share)
        monkeypatch.setattr(own.transducer, "encode", lambda p, f=own.transducer.encode: alone.append(p) or f(p))
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_texts(texts)] == want
    assert {len(p) > bpe.WIDE for p in alone} == {True}
    assert own.encode_texts([]) == []
    odd = bpe.load(bpe.defaults()[0], r"\S+ ?|\s")
    assert odd.encode_texts(texts) == [odd.encode_bytes(t or "") for t in texts]


def test_lockstep_against_merging(coder):
    r = random.Random(4)
    pieces = {bytes(r.choice(b"aethinos .-0\xc3\xa9\x00") for _ in range(r.randint(1, bpe.WIDE))) for _ in range(3000)}
    found = coder.lockstep.encode(list(pieces))
    assert all(np.frombuffer(found[p], "<u4").tolist() == coder.transducer.merge(p) for p in pieces)
    assert coder.lockstep.encode(list(pieces)) == found


def test_another_pattern():
    import tiktoken

    path = bpe.defaults()[0]
    own = bpe.load(path, r"\S+ ?|\s")
    want = tiktoken.Encoding("other", pat_str=r"\S+ ?|\s", mergeable_ranks=own.transducer.ranks, special_tokens={})
    for text in ("one two  three", " a b", "don't\n stop"):
        assert own.encode(text) == want.encode_ordinary(text)


def test_stream_decoding(coder):
    for text in samples()[:300]:
        stream = bpe.StreamDecoder(coder)
        ids = coder.encode(text)
        assert "".join(stream.feed([i]) for i in ids) + stream.finish() == text
        assert coder.decode(np.array(ids, np.int64)) == (text, True)
    ids = coder.encode("\U00020021")
    assert len(ids) > 1
    assert coder.decode(np.array(ids[:1])) == ("\ufffd", False)
    r = random.Random(3)
    for _ in range(200):  # any bytes at all, against Python's own decoder
        raw = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF]) for _ in range(12))
        text, ok = coder.decode(np.array(coder.transducer.encode(raw)))
        assert ok == ("\ufffd" not in raw.decode(errors="replace")) == (text == raw.decode(errors="ignore"))


def test_query(spark, library):
    rows = [(1, "Hello wörld"), (2, None), (2, ""), (3, "x" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as n_tokens")
    got = {tuple(x)[:4] for x in bpe.round_trip(df, *bpe.defaults()).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == want
    back = bpe.decode(bpe.encode(df, *bpe.defaults()), *bpe.defaults())
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in rows)
    kept = bpe.with_ids(spark.createDataFrame(rows, "doc_id long, text string"), *bpe.defaults())
    assert kept.columns == ["doc_id", "text", "ids", "n_tokens", "decodes"] and all(x["decodes"] for x in kept.collect())
    assert bpe.round_trip(df.limit(0), *bpe.defaults()).count() == 0


def test_tables_go_with_other_work(spark):
    """A worker that has encoded serves other operators too, without the tables; smaller tables give the same ids."""
    docs = spark.range(64).selectExpr("id as doc_id", "concat('some words, ', id, ' of a text') as text").repartition(8).localCheckpoint()
    assert bpe.encode(docs, *bpe.defaults()).count() == 64

    def make():
        return lambda batch: pa.record_batch([pa.array([bpe.load.cache_info().currsize], pa.int64())], ["tables"])

    assert {r["tables"] for r in map_slices(docs, make, "tables long").collect()} == {0}
    text = " ".join(f"word{i} and more" for i in range(200))
    assert bpe.load(*bpe.defaults(), 0.001).encode(text) == bpe.load(*bpe.defaults()).encode(text)
