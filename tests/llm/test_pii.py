import hashlib
import random
import re

from llm_helpers import ROWS, awkward, empty

from perennial.llm import pii


def plain(text):
    """The base kinds by their patterns alone."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_random_texts():
    draw = random.Random(3)
    for _ in range(40_000):
        text = "".join(draw.choice("0123456789..--@@++ab() é1") for _ in range(draw.randint(0, 40)))
        found = [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS]
        assert found == plain(text), text


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.with_digest(docs).collect():
        found = plain(texts[r["doc_id"]])
        for kind in pii.BASE_KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, *_ in found)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("my iban GB82 WEST 1234 5698 7654 32 thanks") == ["iban"]
    assert kinds("social security 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    near, far = pii.find_spans("call +49 30 1234567"), pii.find_spans("order +49 30 1234567")
    assert near[0].score > far[0].score


def test_long_runs_end(spark):
    for text in ("a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000 + "x", "7" * 200_000 + "@b.c"):
        pii.find_spans(text)


def test_redaction():
    text = "write a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111!"
    assert pii.mask(text, pii.find_spans(text)) == "write <EMAIL> or <IP>, card <CARD>!"
    assert pii.mask("x", []) == "x"


def test_awkward_table(spark):
    docs = awkward(spark, {"spans": "old", "n_email": "old"})
    got = pii.with_digest(docs)
    assert got.count() == len(ROWS) and got.where("n_email > 0").count() == 0
    assert pii.redact(docs).columns == docs.columns
    assert sorted(str(r) for r in pii.redact(docs).collect()) == sorted(str(r) for r in docs.collect())
    assert pii.with_digest(empty(spark)).count() == 0


def test_addresses_of_very_many_digits(spark):
    text = "0" * 5000 + ".0.0.0 and " + "1" * 5000 + ".1.1.1 and 0255.1.2.03 and 256.1.1.1"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_digest(docs).first()
    assert row["n_ip"] == 2
