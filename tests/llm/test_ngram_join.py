"""The n-gram join against all pairs: bands, partitions, cut lists, copies, chains, and odd rows."""

import random

import duckdb
import numpy as np
import pytest

from factorloom.llm import near_dedup, ngram_join as nj
from factorloom.llm.registry import OP13_SQL, op13_ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text, width=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent=90):
    sets, root = {i: sets_of(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + rng.randint(0, 1)] = [f"w{rng.randrange(9999)}"]
    return words


def corpus(seed, groups=12, size=9):
    """Groups of near copies around the threshold, of sizes on both sides of bands; a passage that many share; short texts."""
    rng, texts = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([8, 11, 12, 13, 20, 60, 61, 150, 400]))]
        base += passage if g % 3 == 0 else []
        now = base
        for k in range(size):
            now = edited(rng, now if g % 2 else base, rng.choice([0, 1, 1, 2, max(1, len(base) // 60), max(1, len(base) // 30)]))
            texts.append(" ".join(now))
    texts += ["one", "one", "one two", "One Two", None, "", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


@pytest.mark.parametrize("neighbours", [0, nj.NEIGHBOURS])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed, neighbours):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(frame(spark, rows), neighbours=neighbours).collect()}
    assert got == brute(rows)


def test_similar_sets_meet_also_in_cut_lists():
    """Any two similar sets share a key, and one that is cut by its pair of segments still has them together."""
    rng = np.random.default_rng(7)
    seen = 0
    for _ in range(400):
        a = int(rng.integers(10, 500))
        common = rng.integers(0, 2**63, a, dtype=np.uint64)
        gone, more = int(rng.integers(0, a // 15 + 2)), int(rng.integers(0, a // 15 + 2))
        one, two = np.unique(common), np.unique(np.concatenate([common[gone:], rng.integers(0, 2**63, more, dtype=np.uint64)]))
        shared = len(np.intersect1d(one, two))
        if 100 * shared < 90 * (len(one) + len(two) - shared) or np.array_equal(one, two):
            continue
        seen += 1
        sides = []
        for x in (one, two):
            keys, cut = set(), set()
            for _, band, count in nj.plan(np.array([len(x)])):
                own = nj.posts_of(x, band, count).tolist()
                keys.update(own)
                cut.update(nj.neighbourhoods(x, band, count, set(own)))
            sides.append((keys, cut))
        assert sides[0][0] & sides[1][0] and sides[0][1] & sides[1][1]
    assert seen > 50


def test_bounds():
    for a in range(1, 300):
        for b in range(a, a * 100 // 90 + 1):
            starts = nj.bands(b + 1)
            under = [{band: m for _, band, m in nj.plan(np.array([n]))} for n in (a, b)]
            if nj.most_different(a, b):
                both = set(under[0]) & set(under[1])
                assert any(under[0][k] > nj.most_different(a, b) and under[0][k] % 2 == 0 for k in both), (a, b)
            assert starts[-1] > b


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(500)] + [(500 + i, " ".join(base)) for i in range(300)]
    got = {r.doc_id: r.component_id for r in nj.ngram_join(frame(spark, rows)).collect()}
    assert set(got.values()) == {0} and len(got) == 800


def test_odd_rows(spark):
    long = " ".join(f"x{i % 7919}y{i % 31}" for i in range(60_000))
    rows = [(None, long), (5, long + " end"), (5, "short"), (6, "short"), (7, None), (8, " "), (9, "A b C d"), (9, "a B c D")]
    df = frame(spark, rows).selectExpr("*", "1 as node", "'k' as key", "2 as id", "3 as posts", "4 as label")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in nj.ngram_join(df).collect())
    n = len(sets_of(long))
    assert got == sorted([(-1, n, None), (5, n + 1, None), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 1, 8), (9, 2, 9), (9, 2, 9)])
    assert nj.ngram_join(frame(spark, []).limit(0)).count() == 0


def test_registered_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = op13_ngram_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(OP13_SQL).fetchall())


def test_shingles_of_either_width():
    import pyarrow as pa

    for width in (3, 5):
        _, sizes = near_dedup.shingle_sets(pa.array(["a b c d e f", "a b", None, "a a a a a a a"]), width)
        assert sizes.tolist() == [7 - width, 1, 0, 1]


def test_sketches_tell_long_texts_apart():
    """They never lose a link, fold to fewer counters, and drop long sets that differ in twice what similar ones may."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for size in (40, 900, 4000):
        most = nj.most_different(size, size)
        one = rng.integers(0, 2**63, size, dtype=np.uint64)
        linked, apart = (np.concatenate([one[d:], rng.integers(0, 2**63, d, dtype=np.uint64)]) for d in (most // 2, most))
        count = nj.counters(size)
        long, short = nj.sketch_of(one, count), nj.sketch_of(one, nj.COUNTERS)
        assert (nj._Sketches([long.tobytes()]).of(nj.COUNTERS)[0] == short).all()
        member = lambda x, name: {"node": name, "label": name, "n_shingles": len(x), "sketch": nj.sketch_of(x, nj.counters(len(x))).tobytes()}
        kind = pa.list_(pa.struct({"node": pa.binary(), "label": pa.binary(), "n_shingles": pa.int64(), "sketch": pa.binary()}))
        batch = pa.record_batch({"key": pa.array([1]), "a_name": pa.array([0]), "b_name": pa.array([1]), "a_members": pa.array([[member(one, b"one")]], kind), "b_members": pa.array([[member(linked, b"linked"), member(apart, b"apart")]], kind)})
        found = {frozenset((r["node"], r["other"])) for out in nj._apart(90)(iter([batch])) for r in out.to_pylist()}
        assert frozenset((b"one", b"linked")) in found
        assert size < 900 or found == {frozenset((b"one", b"linked"))}
