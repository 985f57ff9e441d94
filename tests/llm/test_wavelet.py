import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_helpers import LONG, ROWS, awkward, empty
from tokenizers import Tokenizer

from perennial.llm import wavelet
from perennial.llm.textops import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [r[1] or "" for r in ROWS]


tokenizer = cache(Tokenizer.from_file)


def library(texts, path=PATH):
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def encoded(texts, path=PATH):
    ids, sizes = wavelet.Encoder(path).encode(*utf8(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_encoder_gives_what_the_library_gives():
    draw = random.Random(1)
    alphabet = "aab  \n\t'sréß1٣½ .!-日本🙂 　\u0085\x1c\x0b(<|>"
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(4000)]
    texts += [f"{t}<|endoftext|>{t} <|endoftext|> {t}" for t in texts[:300]]
    texts += [*TEXTS, "<|endoftext|>", "don't we'll ''s '1 x's", "a" * 20_000, " " * 3000, "<|endoftext", ""]
    assert encoded(texts) == library(texts)


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(wavelet, "REMEMBERED", 3)
    coder = wavelet.Encoder(PATH)
    for texts in (TEXTS, TEXTS[::-1], TEXTS):
        ids, sizes = coder.encode(*utf8(pa.array(texts, pa.string())))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts)


def test_other_vocabularies_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert not wavelet.Encoder(path).cuts
    assert encoded(TEXTS, path) == library(TEXTS, path)


@pytest.mark.parametrize("width,size", [(1, 700), (3, 5000), (16, 3000), (20, 513), (16, 0), (5, 1), (4, 512)])
def test_matrix_against_the_plain_sequence(width, size):
    draw = np.random.default_rng(width)
    values = draw.integers(0, min(1 << width, 40), size)
    if size:
        values[0] = (1 << width) - 1
    m = wavelet.WaveletMatrix.build(values, width)
    assert m.decode().tolist() == values.tolist()
    assert m.access(range(size)).tolist() == values.tolist()
    for v in {0, 1, 7, (1 << width) - 1, *values[:5].tolist()}:
        at = np.flatnonzero(values == v)
        assert m.places(v).tolist() == at.tolist()
        assert m.places(v, 1, 3).tolist() == at[1:3].tolist()
        for lo, hi in ((0, size), (size // 3, size // 2), (size, size)):
            assert m.count(v, lo, hi) == int((values[lo:hi] == v).sum())
    assert m.count(1 << width) == 0 and not len(m.places(1 << width))
    with pytest.raises(IndexError):
        m.access([size])


def test_shard_bytes_round_trip():
    values = np.random.default_rng(2).integers(0, 50_257, 10_000)
    sizes = np.array([1, 0, 9000, 999])
    shard = wavelet.Shard(
        np.array([5, 0, -1, 1 << 62]), np.array([True, False, True, True]), sizes, wavelet.WaveletMatrix.build(values, 16)
    )
    body = shard.to_bytes()
    back = wavelet.Shard.from_bytes(body)
    assert back.matrix.decode().tolist() == values.tolist() and back.to_bytes() == body
    assert (back.keys.tolist(), back.present.tolist(), back.ends.tolist()) == (
        shard.keys.tolist(), shard.present.tolist(), shard.ends.tolist()
    )
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(body[:-9] + b"x" + body[-8:])


def plain(rows):
    """Rows of distinct keys."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*library([text or ""])[0], 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [1, 500, 1 << 22])
def test_documents_are_read_back_in_key_order(spark, shard_tokens):
    draw = random.Random(9)
    rows = [(k, draw.choice(TEXTS)) for k in draw.sample(range(-500, 500), 60)]
    rows += [(None, "without a key"), (1000, LONG), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = wavelet.write_shards(docs, PATH, shard_tokens=shard_tokens)
    assert store.count() == len(store.inputFiles())
    want = plain(rows)
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, wavelet.stored_documents(store).collect()), key=key) == want
    ids = {k: [*library([t or ""])[0], 0] for k, t in rows}
    token = ids[1000][1]
    assert sorted(map(tuple, wavelet.find_token(store, token).collect()), key=str) == sorted(
        ((k, i) for k, found in ids.items() for i, x in enumerate(found) if x == token), key=str
    )
    counts = {r["token"]: r["n"] for r in wavelet.count_tokens(store, [0, token, 50_256]).collect()}
    assert counts == {t: sum(x.count(t) for x in ids.values()) for t in (0, token, 50_256)}


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, {"key": "x", "hash": "y", "row": "z", "body": "b", "part": "p"})
    got = wavelet.stored_documents(wavelet.write_shards(docs, PATH)).collect()
    size = {(r[0], len(library([r[1] or ""])[0]) + 1) for r in ROWS}
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == size and len(got) == len(ROWS)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    none = wavelet.stored_documents(wavelet.write_shards(empty(spark), PATH))
    assert none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and none.count() == 0
