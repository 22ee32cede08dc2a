"""The stages of the pipeline, one by one and together."""

import pytest

import corpus_pipeline
from factorloom.llm import registry
from factorloom.llm.common import materialize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        out.append((name, docs))
    return out


def test_each_stage_keeps_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(stages) == 5 and all(df.columns == columns for _, df in stages[:-1])


def test_decisions_take_effect(spark, stages):
    start, (quality, near, secrets, mixed, packed) = spark.read.parquet(f"{SF}/documents.parquet"), [df for _, df in stages]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = start.join(quality, "doc_id", "left_anti").join(labels, "doc_id")
    assert 0 < quality.count() < start.count() and gone.where("quality = 0").count() > 5 * gone.where("quality = 1").count()
    assert near.count() == near.select("doc_id").distinct().count() < quality.count()
    assert secrets.count() == near.count()
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r["doc_id"] for r in secrets.select("doc_id").collect()}
    pieces = {r["doc_id"]: r["count"] for r in packed.where("piece = 0").groupBy("doc_id").count().collect()}
    assert pieces == copies


def test_secrets_are_gone(stages):
    from factorloom.llm.secret_scan import scan_secrets

    assert scan_secrets(stages[2][1]).where("size(base) > 0").count() == 0


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_registered():
    import __spark_entry__

    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) == {"op6_url_filters", "op8_line_rules", "op9_near_dedup", "op11_conversation_repair", "op12_spelling_variants", "op13_ngram_join"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources", "best-fit packing"]


def test_stages_on_odd_rows(spark):
    """Null ids, sources and texts, empty, long and repeated ones: each stage against what it should do, by hand."""
    from collections import Counter

    from factorloom.llm.secret_scan import find_spans, masked, word_ranks
    from factorloom.llm.tokens import default_vocabulary
    from tests.llm.test_llm import DOCS, brute_components, by_hand, prose

    texts = [prose(k, 30 + k) for k in range(12)]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (3, prose(50, 3000), "en", "s0", 9), (40, texts[2] + " tail", "en", "s1", 9), (41, texts[2], "en", "s1", 9), (41, texts[2], "en", "s1", 9), (50, "a token=abcdef0123 b " + prose(60, 20), "en", "s0", 9)]
    docs = spark.createDataFrame(rows, DOCS)

    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    named = list(enumerate(t for _, t, *_ in rows))
    whole = {root for i, (n, root) in brute_components(named).items() if n} | {i for i, t in named if not t}
    assert Counter(r["text"] for r in kept) == Counter(rows[i][1] for i in whole)

    hidden = corpus_pipeline.hide_secrets(spark, docs, SF).collect()
    ranks = word_ranks(docs)
    want = [(i, t and masked(t, find_spans(t, ranks=ranks)[1]), s) for i, t, _, s, _ in rows]
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in hidden), key=str) == sorted(want, key=str)

    mixed = corpus_pipeline.mix(spark, docs, SF).collect()
    have, got = Counter(r[:4] for r in rows), Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in mixed)
    assert all(got[r] <= 2 * have[r] for r in got)

    packed = Counter((r["doc_id"], r["piece"], r["length"]) for r in corpus_pipeline.pack(spark, docs, SF).collect())
    cut = Counter((i, k // 2048, len(x[k : k + 2048])) for (i, *_), x in zip(rows, by_hand([t for _, t, *_ in rows], 0), strict=True) for k in range(0, len(x), 2048))
    assert packed == cut
    assert corpus_pipeline.keep_quality(spark, docs, SF).columns == docs.columns


def rows_with_shared_ids(spark):
    from tests.llm.test_llm import DOCS, prose

    texts = [(None, prose(1, 60)), (None, prose(1, 60) + " tail"), (None, prose(2, 60)), (7, prose(3, 60)), (9, prose(3, 60) + " tail"), (9, prose(4, 60)), (5, prose(5, 60)), (5, prose(5, 60)), (None, ""), (None, "")]
    return texts, spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in texts], DOCS)


def test_near_duplicates_go_by_row(spark):
    texts, docs = rows_with_shared_ids(spark)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    sure = [texts[i] for i in (2, 3, 5, 6, 8, 9)]
    assert len(kept) == 7 and sum(t in texts[:2] for t in kept) == 1
    assert sorted((t for t in kept if t not in texts[:2]), key=str) == sorted(sure, key=str)


def test_mix_goes_by_row(spark):
    from factorloom.llm.mixing import mix_sources
    from tests.llm.test_llm import DOCS, prose

    rows = [(None if k % 3 else 1, prose(k, 20 + k % 5), "en", f"s{k % 3}", 0) for k in range(120)] + [(None, "one and the same", "en", "s0", 0)] * 9
    docs = spark.createDataFrame(rows, DOCS)
    words = lambda df: {r["source"]: r["n"] for r in df.collect()}
    mixed = corpus_pipeline.mix(spark, docs, SF)
    got = words(mixed.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "n"))
    size = words(mixed.selectExpr("source", "size(split(trim(text), '[ \\n]+')) n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n"))
    target = words(mix_sources(docs).select("source", "target").distinct().withColumnRenamed("target", "n"))
    assert set(got) == set(target) and all(abs(size[s] - target[s]) <= 30 for s in target)


def test_columns_of_any_name_pass(spark):
    """Extra columns named like what the stages use come out as they went in."""
    from tests.llm.test_llm import DOCS, prose

    names = ["__hash", "__row", "__copy", "__copies", "__score", "key", "row", "n", "size", "copies", "copy", "share", "block", "chance", "target"]
    rows = [(k, prose(k, 40), "en", f"s{k % 2}", len(prose(k, 40))) for k in range(30)]
    docs = spark.createDataFrame([(*r, *[f"{name} {r[0]}" for name in names]) for r in rows], f"{DOCS}, " + ", ".join(f"`{n}` string" for n in names))
    have = set(docs.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert set(kept.collect()) <= have
    assert corpus_pipeline.pack(spark, docs, SF).count() == 30


def test_mix_tells_rows_apart_by_where_their_nulls_are(spark):
    from tests.llm.test_llm import DOCS

    docs = spark.createDataFrame([(1, "x", None, "en", 1), (1, "x", "en", None, 1)] * 3, DOCS)
    got = {(r["lang"], r["source"]) for r in corpus_pipeline.mix(spark, docs, SF).collect()}
    assert got == {(None, "en"), ("en", None)}
