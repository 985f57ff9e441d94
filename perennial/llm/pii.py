"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are the leftmost non-overlapping matches of their
pattern that pass their validator (parts up to 255, Luhn, number of digits); a match that fails is
dropped and not tried again.  They are always reported.  Further kinds (``iban`` by mod-97, ``ssn``
by its excluded ranges, ``secret`` for assigned keys and tokens) are reported when their score
reaches ``MIN_SCORE``.  A score starts from the kind's prior, is raised by a confirmed checksum and by
words such as "card" or "call" close to the span, and is lowered by words such as "order" or "version".

Spans count code points, end exclusive.  A text is scanned once for digits, ``@`` and ``+``; only
texts that have them are matched, and no pattern backtracks over a run more than once, so the time
is linear in the length of a text.  A null or empty text has no spans; repeated rows get equal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perennial.llm.textops import with_result

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
MIN_SCORE = 0.5
#: Code points before and after a span in which words count.
NEAR = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(
    r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}"
    r"[\"']?([A-Za-z0-9+/_-]{16,128})(?![A-Za-z0-9+/_-])"
)

#: Words that raise (first) or lower (second) the score of a kind.
CONTEXT = {
    "email": (("mail", "contact", "write", "correo", "kontakt"), ("example", "sample")),
    "ip": (("ip", "host", "server", "address", "login"), ("version", "release", "chapter")),
    "card": (("card", "visa", "credit", "carte", "karte", "tarjeta"), ("order", "isbn", "serial")),
    "phone": (("phone", "call", "tel", "mobile", "fax", "telefon"), ("order", "serial")),
    "iban": (("iban", "bank", "account", "konto", "compte", "cuenta"), ("order", "serial")),
    "ssn": (("ssn", "social", "security", "taxpayer"), ("order", "part", "isbn", "serial")),
    "secret": (("token", "secret", "password", "key"), ("example", "placeholder", "xxxx")),
}
#: Score before looking at the surroundings; the validator has already agreed.
PRIOR = {
    "email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "secret": 0.6,
}
_WORDS = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Every second digit from the right doubles; the digit sum ends in 0."""
    odd, even = digits[-1::-2], digits[-2::-2]
    total = sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The country and check digits moved to the end, letters as 10 to 35: remainder 1."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m.groups())):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()


def _more(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        account = m.group().replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        value = m.group(1)
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            yield "secret", m.start(1), m.end(1)


def scored(text: str, kind: str, start: int, end: int) -> Span:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = {w.lower() for w in _WORDS.findall(around)}
    raising, lowering = CONTEXT[kind]
    near = sum(w in words for w in raising) - sum(w in words for w in lowering)
    return Span(kind, start, end, round(min(1.0, max(0.0, PRIOR[kind] + 0.2 * near)), 3))


_ANY_DIGIT = re.compile(r"[0-9]")


def find_spans(text: str | None) -> list[Span]:
    """All spans in the order of kinds, then of places."""
    if not text or not ("@" in text or _ANY_DIGIT.search(text)):
        return []
    spans = [scored(text, *s) for s in _base(text)]
    more = [scored(text, *s) for s in _more(text)]
    return spans + sorted(
        (s for s in more if s.score >= MIN_SCORE), key=lambda s: (KINDS.index(s.kind), s.start)
    )


SPANS = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.LongType())
    .add("end", T.LongType())
    .add("score", T.DoubleType())
)
_ARROW_SPANS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
    )
)


@F.arrow_udf(SPANS)
def spans_of(texts: pa.Array) -> pa.Array:
    return pa.array(
        [[s._asdict() for s in find_spans(t.as_py())] for t in texts], _ARROW_SPANS
    )


def with_spans(docs: DataFrame, text: str = "text", result: str = "spans") -> DataFrame:
    """Add the scored spans of each text."""
    return docs.withColumn(result, spans_of(F.col(f"`{text}`")))


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the first covers the rest."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.end <= at:
            continue
        out += [text[at : max(at, s.start)], f"<{s.kind.upper()}>" if s.start >= at else ""]
        at = s.end
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def masked(texts: pa.Array) -> pa.Array:
    values = [t.as_py() for t in texts]
    return pa.array([mask(v, find_spans(v)) if v else v for v in values], pa.string())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with personal data replaced by ``<KIND>``; the rows and other columns stay."""
    return docs.select(
        *[
            masked(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_DIGEST = T.StructType()
for _kind in BASE_KINDS:
    _DIGEST.add(f"n_{_kind}", T.LongType())
_DIGEST.add("base_sha256", T.StringType()).add("spans", T.StringType())


@F.arrow_udf(_DIGEST)
def digest_of(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts:
        spans = find_spans(t.as_py())
        base = [s for s in spans if s.kind in BASE_KINDS]
        row = {f"n_{k}": sum(s.kind == k for s in base) for k in BASE_KINDS}
        row["base_sha256"] = hashlib.sha256(_joined(base).encode()).hexdigest()
        row["spans"] = _joined(spans)
        rows.append(row)
    types = [*[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string())]
    return pa.array(rows, pa.struct([*types, ("spans", pa.string())]))


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the number of base spans by kind, a hash of their places, and all spans as text."""
    names = [*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]
    return with_result(docs, digest_of(F.col(f"`{text}`")), {n: n for n in names})
