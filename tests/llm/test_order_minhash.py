import hashlib
import random

import numpy as np
from llm_helpers import ROWS, awkward, empty
from pyspark.sql import functions as F

from perennial.llm import order_minhash as omh


def plain(text, k=omh.K):
    """The signature by sorting all numbered k-mers for each hash function."""
    if not text:
        return np.zeros(0, np.uint32)
    numbered = omh.numbered_kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    out = []
    for x, odd in zip(omh._XOR[:, 0], omh._ODD[:, 0]):
        value = ((numbered >> np.uint64(32)).astype(np.uint32) ^ x) * odd
        least = sorted(np.lexsort((np.arange(len(value)), value))[: omh.TUPLE].tolist())
        made = np.zeros(1, np.uint64)
        for p in least:
            made = omh.mix64(made * np.uint64(omh._BASE) + numbered[p])
        out.append(int(made[0] >> np.uint64(32)))
    return np.array(out, np.uint32)


def test_signature(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice("abé日 ") for _ in range(n)) for n in (1, 2, 15, 16, 17, 18, 300, 3000)]
    want = [plain(t) for t in texts]
    monkeypatch.setattr(omh, "BLOCK", 128)
    for text, sign in zip(texts, want):
        assert (omh.signature(text) == sign).all()


def test_occurrences_are_numbered():
    kmers = omh.numbered_kmers(np.frombuffer(("ab" * 40).encode("utf-32-le"), np.uint32), 4)
    assert len(set(kmers.tolist())) == len(kmers)


def test_order_and_edits_matter():
    draw = random.Random(6)
    parts = ["".join(draw.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    text = "".join(parts)
    one = text[:1200] + "X" + text[1200:]
    turned = "".join(reversed(parts))
    sign = omh.signature(text)
    assert omh.alike(sign, omh.signature(one)) > 0.7
    assert omh.alike(sign, omh.signature(turned)) < omh.alike(sign, omh.signature(one))
    assert omh.alike(sign, omh.signature("other" + turned[::-1])) == 0


def test_neighbours(spark):
    docs = awkward(spark).repartition(5)
    ordered = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        changed = omh.edited(text, following)
        a, b, c = omh.signature(text), omh.signature(changed), omh.signature(following)
        want.append(
            (str(r[0]), len(text), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(),
             b.tobytes().hex(), omh.alike(a, b), omh.alike(a, c))
        )
    got = omh.compare_with_next(docs)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert omh.compare_with_next(empty(spark)).count() == 0


def test_columns(spark):
    docs = omh.with_fingerprint(awkward(spark, {"fingerprint": "old"})).where("doc_id IN (1, 4, 8)")
    pairs = docs.alias("a").crossJoin(docs.alias("b")).select(
        "a.doc_id", F.col("b.doc_id").alias("other"),
        omh.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("like"),
    )
    for r in pairs.collect():
        assert r["like"] == float(r["doc_id"] == r["other"])
