"""The pipeline's rows against plain versions of its stages on a small table."""

import os

import brute
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for n, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = docs
        if n < 4:
            assert docs.columns == columns
    good = {r.doc_id for r in kept["quality rules"].collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in before.items():
        n, _, _, _, repeated = brute.quality_counts(r.text)
        base = n < 50 or 100 * repeated > 50 * n
        assert not (base and i in good)
        if i in quality and not base:
            assert (i in good) == bool(quality[i])
    rows = [(i, before[i].text) for i in sorted(good)]
    exact = {i for (i, _), (k, _) in zip(rows, brute.exact(rows)) if i == k}
    assert {r.doc_id for r in kept["exact dedup"].collect()} == exact
    near = brute.near({i: before[i].text for i in exact})
    unique = {i for i, (_, c) in near.items() if i == c}
    assert {r.doc_id for r in kept["minhash near-dedup"].collect()} == unique
    mixed = [r.doc_id for r in kept["source mixing"].collect()]
    assert set(mixed) <= unique and all(mixed.count(i) <= 2 for i in set(mixed))
    packed = kept["best-fit packing"].collect()
    assert sum(r.n_words for r in packed) == sum(len(brute.words(before[i].text)) for i in mixed)
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.n_words) for r in ran.collect()) == sorted((r.doc_id, r.piece, r.n_words) for r in packed)
