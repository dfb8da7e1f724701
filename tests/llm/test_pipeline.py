"""The stages of corpus_pipeline on a small corpus, each against what its operator says."""

import random

import pytest

import corpus_pipeline
from quire.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from tests.llm.test_operators import VOCABULARY, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    good = [prose(rng.randint(30, 80), rng) for _ in range(120)]
    leak = prose(25, rng)
    passage = "\n".join(prose(9, rng) for _ in range(4))
    texts = good + [good[0], good[1] + " x"] + [f"{g}\n{leak}\n{g[::-1]}" for g in good[:3]] + [f"{prose(40, rng)}\n{passage}\n{prose(40, rng)}" for _ in range(4)]
    texts += [" ".join([rng.choice(VOCABULARY).upper() + "!!"] * 30) for _ in range(40)] + [None, ""]
    to = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{to}/documents.parquet")
    labels = [(i, int("!!" not in (t or "")), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))

    kept = stages["quality_classifier"](spark, docs, folder)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"]}
    assert len(ids & set(range(120, 129))) == 9 and not ids & set(range(129, 169))

    cut = stages["line_dedup"](spark, docs, folder)
    assert cut.columns == columns and cut.count() == docs.count()
    assert {(r["doc_id"], r["text"]) for r in cut.collect()} == {(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("text is not null").collect())

    one = stages["ngram_jaccard_join"](spark, docs, folder)
    assert {r["doc_id"] for r in one.collect()} == {r["component_id"] for r in jaccard_join.jaccard_join(docs).collect()}
    assert one.columns == columns and not {120, 121} & {r["doc_id"] for r in one.collect()}

    clean = stages["benchmark_decontamination"](spark, docs, folder)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} == {122, 123, 124} == {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}

    packed = stages["best_fit_packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()} and len(packed) == packing.pack(docs).count()


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert not ids & (set(range(122, 125)) | set(range(129, 169))) and set(range(2, 120)) <= ids


def test_stages_on_odd_tables(spark, folder):
    """Each stage on its own: an empty table, null ids and texts, repeated rows, a long text and a clashing column."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = docs.where("doc_id = 3").first()["text"]
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, good, "en", "s", 5, 7), (1, good, "en", "s", 5, 7), (None, good, "en", "s", 5, 8), (2, None, "en", "s", None, 9), (3, "", None, None, 0, 1), (4, long, "en", "s", 9, 2)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `_key` bigint")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.limit(0), folder)
        assert none.count() == 0
        got = stage(spark, odd, folder)
        if name != "best_fit_packing":
            assert none.columns == odd.columns == got.columns
        found = got.collect()
        if name == "line_dedup":
            assert sorted((r["_key"] for r in found)) == [1, 2, 7, 7, 8, 9] and {r["n_chars"] for r in found if r["doc_id"] == 4} == {len(long)}
        if name == "ngram_jaccard_join":
            assert sorted((r["_key"] for r in found)) == [1, 2, 7, 8, 9]
        if name == "benchmark_decontamination":
            assert len(found) == 6
        if name == "best_fit_packing":
            assert sum(r["length"] for r in found if r["doc_id"] == 2) == 1 and len([r for r in found if r["doc_id"] == 4]) > 1 and sum(r["doc_id"] is None for r in found) == 1
