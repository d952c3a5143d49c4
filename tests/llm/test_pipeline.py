"""The pipeline, stage by stage, on a small fixture; the stages' operators have brute-force tests."""

from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm import decontam, jaccard, substrings

WORDS = "the of and that with which where there when house river mountain window garden table letter morning evening".split()


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) + str(rng.randrange(40)) * rng.randrange(2) + " the" * (rng.random() < 0.2) for _ in range(n))
    base, item, passage = text(150), text(25), text(60)
    rows = [(1, base), (2, base), (3, base.replace("river", "ocean", 1)), (4, text(100) + " " + item + " " + text(20)), (5, text(90) + " " + passage), (6, passage + " " + text(90)), (7, "too short"), (8, None), (9, "$$$ " * 80), (10, text(200))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packed":
            assert docs.columns == columns
        seen[name] = docs.collect()
    ids = lambda n: {r.doc_id for r in seen[n]}
    assert ids("quality_rules") == {1, 2, 3, 4, 5, 6, 10}
    assert ids("near_duplicates") == {1, 4, 5, 6, 10}
    after = spark.createDataFrame(seen["repeated_passages"])
    assert ids("repeated_passages") == {1, 4, 5, 6, 10} and substrings.digests(after).filter("n_removed > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in seen["repeated_passages"])
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    assert decontam.hits(spark.createDataFrame(seen["benchmark_passages"]), bench).filter("n_hit > 0").count() == 0
    assert jaccard.classes(spark.createDataFrame(seen["near_duplicates"])).filter("doc_id <> component_id").count() == 0
    assert {r.doc_id for r in seen["packed"]} == {1, 4, 5, 6, 10}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.start, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in seen["packed"]}
