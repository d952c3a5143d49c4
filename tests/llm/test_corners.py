"""Clashing columns, null and repeated ids, empty tables and long texts, for the operators and the pipeline's stages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontam, jaccard, langid, packing, quality, queries, sharding, substrings, warc, wordpiece
from tessera.llm._util import scratch

WORDS = "the of and that with which where there when house river mountain window garden table letter morning evening".split()
#: Names that operators use inside or return.
CLASHES = ("mark", "content", "hash", "n", "h", "w", "i", "b", "start", "length", "offset", "ids", "sequence_id", "component_id", "n_shingles", "token", "size", "slot", "shard", "n_words", "kept",
           "spans", "formatted", "role_", "payload", "digest", "score", "has", "held_out", "key", "value", "part", "rank", "item", "lang_pred", "doc_tokens", "n_bytes", "n_hit", "position")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) + str(rng.randrange(50)) * rng.randrange(2) for _ in range(n))


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = prose(rng, 90)
    long = prose(rng, 60_000)
    return [(1, base), (2, base), (3, base + " more words at the end"), (4, None), (5, ""), (6, long), (7, base[:300] + " " + prose(rng, 40)), (8, prose(rng, 80)), (8, prose(rng, 80)), (9, base), (9, base), (None, prose(rng, 70)), (None, prose(rng, 70))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def same(run, docs):
    """The rows of run are equal with and without clashing columns."""
    plain, more = run(docs), run(clashing(docs))
    shared = [c for c in plain.columns if c in more.columns]
    assert set(plain.columns) <= set(more.columns)
    got = sorted(map(repr, more.select(shared).collect()))
    assert got == sorted(map(repr, plain.select(shared).collect()))
    return plain.collect()


def named(docs):
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id"])


def test_repeats(docs):
    got = {r.doc_id: r for r in same(substrings.digests, named(docs))}
    assert got[2].n_removed == got[2].n_bytes > 0 and got[4].n_bytes == got[5].n_bytes == 0 and got[6].n_removed == 0


def test_packing_of_all_kinds(docs):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = same(lambda d: packing.pack(d, path, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"), named(docs))
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.length for r in x) == x[0].doc_tokens for x in per.values()) and per[4][0].doc_tokens == per[5][0].doc_tokens == 1 and per[6][0].doc_tokens > 60_000


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "x" * 2000), (2, "http://a.b/2", "x" * 2000), (3, None, None), (4, "http://c.d/", ""), (5, "http://e.f/", "é" * 400_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in same(lambda p: warc.round_trip(p, scratch(spark)), pages)}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[3].payload_bytes == 0 and got[5].payload_bytes == 800_000


def test_links(docs):
    got = {r.doc_id: r for r in same(jaccard.classes, named(docs))}
    assert got[1].component_id == got[2].component_id == got[3].component_id == got[9].component_id == 1 and got[4].component_id == 4 and got[6].n_shingles > 30_000


def test_chats(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "x" * 300_000), (2, 0, None, "<|im_end|>"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in same(lambda d: chat.digest(chat.parse_chats(chat.format_chats(d))), rows)}
    assert got[1].n_turns == 4 and got[1].loss_chars == 300_000 and got[2].n_turns == 1


def test_languages_without_ids(spark):
    rng = random.Random(2)
    rows = [(None, prose(rng, 40), "en"), (None, None, "en"), (1, prose(rng, 40), "en"), (2, "12 34", None), (3, prose(rng, 4000), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = same(lambda d: langid.identified(d, langid.Trees(langid.training_sample(d))), docs)
    # A null doc_id has no remainder: it is neither held out nor learned from, and predicted like any other.
    assert sorted(r.held_out is None for r in got) == [False] * 3 + [True] * 2 and {r.lang_pred for r in got if r.doc_id in (1, 3)} == {"en"}
    assert {r.lang_pred for r in got if r.doc_id == 2} == {"und"}


def test_row_local_operators(docs):
    initial, continuing = wordpiece.sentencepiece_pieces(queries.vocabulary("piece_bpe_32k.model"))
    for run in (lambda d: wordpiece.token_counts(d, initial, continuing).select("doc_id", "n_words", "n_tokens", "n_unknown"), lambda d: quality.judged(d).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept")):
        got = same(run, docs)
        assert len(got) == 13 and max(r.n_words for r in got) == 60_000
    got = sharding.shuffle_shards(docs.withColumn("extra", F.lit(1)), 4).collect()
    assert len(got) == 13 and max(r.shard for r in got) == 3


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, rows, tmp_path, name, stage):
    rng = random.Random(5)
    spark.createDataFrame([(1, prose(rng, 30)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for given in (docs, clashing(docs) if name != "packed" else docs, docs.limit(0)):
        got = stage(spark, given, str(tmp_path))
        found = got.collect()
        if name != "packed":
            assert got.columns == given.columns
        if name == "quality_rules":
            assert {r.doc_id for r in found} <= {1, 2, 3, 6, 7, 8, 9, None}
        if name == "near_duplicates" and found:
            assert {r.doc_id for r in found} == {1, 4, 5, 6, 7, 8, None} and sum(r.doc_id is None for r in found) == 2
        if name == "repeated_passages" and found:
            kept = [r for r in found if r.doc_id in (2, 9)]
            assert all(r.text == "" for r in kept) and all(r.n_chars == len(r.text) for r in found if r.text is not None)
        if given is not docs and given.limit(1).count() == 0:
            assert not found


def test_decontamination_of_all_kinds(spark, docs, rows):
    bench = spark.createDataFrame([(1, " ".join(rows[0][1].split()[10:30])), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in same(lambda d: decontam.hits(d, bench), named(docs))}
    assert got[1].n_hit == 20 and got[4].n_words == 0 and got[6].n_hit == 0
