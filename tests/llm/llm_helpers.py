"""Small tables with every awkward case, and plain versions of what operators compute."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} thing{i % 13}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then sleeps all day long", "en", "a", 72),
    (2, "The quick brown fox jumps over the lazy dog and then sleeps all day long", "en", "a", 72),
    (2, "The quick brown fox jumps over the lazy dog and then sleeps all day long", "en", "a", 72),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "  \n\t ", None, "b", 5),
    (6, "### $$$ 123", "de", None, 11),
    (None, "nobody knows this text by number", "en", "c", 32),
    (None, "nobody knows this text by number", "en", "c", 32),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Ça va très bien, merci beaucoup", "fr", "c", 31),
    (9, "日本語のテキスト 🙂", "ja", "d", 10),
]


def awkward(spark, extra: dict[str, str] | None = None):
    """The table, with further columns of the given names and constant values."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, value in (extra or {}).items():
        docs = docs.withColumn(name, F.lit(value))
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(fold(text))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def classes(texts: list[str | None], n: int, top: int, base: int = 100) -> list[int]:
    """Index of the first member of each text's class, by comparing all pairs."""
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and base * len(a & b) >= top * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]
