import random
import re
import zlib
from collections import Counter

import numpy as np
from llm_helpers import LONG, awkward, empty, fold

from perennial.llm import spelling

RESULT = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def texts(seed, size):
    draw = random.Random(seed)
    made = []
    for key in range(size):
        base = draw.choice(["planets", "planetès", "sunlight", "ABCDEF", "aaaaaaa"])
        for _ in range(draw.choice([0, 0, 1, 2])):
            at = draw.randrange(len(base))
            base = base[:at] + draw.choice(["", "a", "b", "é", base[at] * 2]) + base[at + 1 :]
        made.append((key, f"{base} {base}, {draw.choice(['planets', 'short', ''])}1{base}"))
    return made


def test_neighbourhood_is_every_one_edit_string_once():
    draw = random.Random(3)
    for size in (1, 2, 6, 9):
        words = np.array([[draw.randrange(3) for _ in range(size)] for _ in range(20)])
        rows, made = spelling.neighbourhood(words, 0, size + 1, 3)
        parts = [spelling.neighbourhood(words, at, at + 1, 3) for at in range(size + 1)]
        assert sorted(zip(rows, made)) == sorted(z for p in parts for z in zip(*p))
        for i, word in enumerate(words.tolist()):
            want = {tuple(word)}
            for at in range(size + 1):
                want |= {(*word[:at], c, *word[at:]) for c in range(3)}
                if at < size:
                    want.add((*word[:at], *word[at + 1 :]))
                    want |= {(*word[:at], c, *word[at + 1 :]) for c in range(3)}
            codes = [int(spelling.codes(np.array([w], int).reshape(1, -1), 3)[0]) for w in want]
            assert sorted(codes) == sorted(int(m) for r, m in zip(rows, made) if r == i)


def test_checksums_of_short_and_long_runs():
    draw = random.Random(4)
    runs = [bytes(draw.choices(range(97, 123), k=draw.choice([1, 3, 47, 48, 49, 500]))) for _ in range(300)]
    size = np.array([len(r) for r in runs])
    begin = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(runs), np.uint8), np.cumsum(size) - size, size, begin)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + r) for i, r in enumerate(runs)]


def test_variants_against_all_pairs(spark):
    rows = texts(5, 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.spelling_variants(docs)
    want = plain_variants(rows)
    assert got.columns == RESULT
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(form and root != form for _, form, root, *_ in want)
    assert any(n_near == 0 for *_, n_near, _ in want)


def test_ties_take_the_smallest_near_word(spark):
    rows = [(i, "letterz " + "lettera " * 6 + "letterb " * 6) for i in range(400)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = plain_words(rows)
    assert got["letterz"]["form"] == min(("lettera", "letterb"), key=lambda w: (-words[w], w))


def test_word_of_ten_thousand_letters(spark):
    long = "".join(random.Random(6).choices("abcdefgh", k=10_000))
    rows = [(i, f"{long} {long[:-1]}") for i in range(40)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_variants(rows)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark, {"word": "x", "n": "y", "code": "z", "near": "q"})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=str)
    assert got == plain_variants(rows) and LONG
    none = spelling.spelling_variants(empty(spark))
    assert none.columns == RESULT and none.count() == 0
    nulls = spark.createDataFrame([(None, "wordword " * 7), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, spelling.spelling_variants(nulls).collect()), key=str) == plain_variants(
        [(None, "wordword " * 7), (None, None)]
    )
