import corpus_pipeline
from quillon.llm import decontaminate, quality, simhash
from quillon.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    start = docs.collect()
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, table(spark, SF, "labels")).collect()}
    kept = kept.cache()
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}

    single = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    rows = single.collect()
    sets = {r.doc_id: set(simhash.shingles(r.text, 5)) for r in kept.collect()}
    share = lambda a, b: len(a & b) / max(1, len(a | b))
    left = {r.doc_id for r in rows}
    # No two that stay are near copies; all that went had one.
    assert not [(a, b) for a in left for b in left if a < b and share(sets[a], sets[b]) >= 0.9]
    assert all(any(share(sets[i], sets[j]) >= 0.65 for j in sets if j != i) for i in sets.keys() - left)

    clean = corpus_pipeline.benchmark_decontamination(spark, single, SF).cache()
    hits = {r.doc_id for r in decontaminate.report(decontaminate.find_contamination(single, table(spark, SF, "benchmark"))).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == left - hits

    mixed = corpus_pipeline.source_mixing(spark, clean, SF)
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in start}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert rows and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_empty(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
