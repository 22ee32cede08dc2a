"""Spelling variants against comparing all words with all, for blocks of every size, and on odd rows."""

import random
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from factorloom.llm.registry import OP12_SQL, misspelt, op12_spelling_variants
from factorloom.llm.spelling import near_words, spelling_variants, vocabulary

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, shortest=7, at_least=2):
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= at_least}
    out = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, w, n[w], len(close), n[form] if form else None]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def words_like(rng, n):
    """Words around a few stems, so that blocks are crowded; letters with accents too."""
    letters, stems = "abcenoéÿ", ["abcabcabc", "understanding", "écouterécole"]
    made = []
    for _ in range(n):
        w = rng.choice(stems)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        made += [w] * rng.choice([1, 2, 3, 30, 400])
    return made


@pytest.mark.parametrize("most", [2, 8, 256])
def test_all_words_with_all(spark, most):
    words = words_like(random.Random(3), 250)
    got = spelling_variants(spark.createDataFrame([(w,) for w in words], "word string"), most=most).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(Counter(words))
    assert len(got) == len({r.word for r in got})


def test_chains_are_followed(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000}
    rows = [(w,) for w, n in counts.items() for _ in range(n)]
    got = {r.word: r.root for r in spelling_variants(spark.createDataFrame(rows, "word string")).collect()}
    assert set(got.values()) == {"abcdefghij"}


def test_odd_words(spark):
    long = "a" * 5000
    rows = [(None,), ("",), ("short",), (long,), (long,), (long + "b",), (long + "b",), ("seven77",), ("seven77",)]
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling_variants(spark.createDataFrame(rows, "word string").selectExpr("word", "1 as n", "2 as block")).collect()}
    assert got == {long: (None, long, 2, 1), long + "b": (None, long + "b", 2, 1), "seven77": (None, "seven77", 2, 0)}
    none = spark.createDataFrame([], "word string")
    assert spelling_variants(none).count() == 0 and near_words(vocabulary(none, 7)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(none, ratio=2)


def test_damage_of_the_query(spark):
    texts = [(None, "Wonderful wonderful Étagères abc"), (3, None), (4, ""), (5, "wonderful-wonderful"), (6, "pre×fixes of " + "elephants " * 40)]
    got = sorted(r.word for r in misspelt(spark.createDataFrame(texts, DOCS), 7).collect())
    want = []
    import re

    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if len(run) >= 7:
                want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run)
    assert got == sorted(want)


def test_registered_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = op12_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(con.execute(OP12_SQL).fetchall(), key=key)
