import random

import public_tokenizers
import pytest
from llm_helpers import LONG, ROWS, awkward, empty
from tokenizers import Tokenizer

from perennial.llm.token_count import Counter, with_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Counter(PATH), Tokenizer.from_file(PATH)


def library(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_random_texts(both):
    counter, tokenizer = both
    draw = random.Random(1)
    letters = "aab  \n\t'sré1٣½ .!日本🙂 　\u0085\x1c"
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        text += draw.choice(["", "<|endoftext|>", "x<|endoftext|> y"])
        assert counter.of(text) == library(tokenizer, text), text


def test_every_letter_of_two_planes(both):
    counter, tokenizer = both
    for code in range(0, 0x3200, 3):
        text = f"a {chr(code)}b{chr(code)} {chr(code)}{chr(code)} 1"
        assert counter.of(text) == library(tokenizer, text), hex(code)


def test_long_runs(both):
    counter, tokenizer = both
    for text in ("a" * 20_000, "ab" * 9_000, " " * 5_000, LONG):
        assert counter.of(text) == library(tokenizer, text)


def test_awkward_table(spark, both):
    got = with_token_counts(awkward(spark, {"n_tokens": "old", "note": "kept"}), PATH)
    assert got.columns == [*awkward(spark).columns, "note", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((r[0] or -1, len((r[1] or "").encode()), library(both[1], r[1] or "")) for r in ROWS)
    rows = got.collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert {r["doc_id"] for r in rows if r["over_limit"]} == {7}
    assert with_token_counts(empty(spark), PATH).count() == 0
