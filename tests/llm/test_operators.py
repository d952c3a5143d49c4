"""Every operator against brute force, round trips and the stated corner cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, components, decontam, jaccard, langid, packing, quality, queries, sharding, substrings, warc, wordpiece
from tessera.llm._util import needed, scratch

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in "the an on wher thion ent üb ça lo".split() for b in "ing er ly tion a o s t en ß".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): copies, near copies, shared and repeated passages, nulls, empty and long texts."""
    rng = random.Random(5)
    passage, out = prose(rng, 40), []
    base = prose(rng, 120)
    for _ in range(12):
        w = base.split()
        w[rng.randrange(120)] = "changed"
        out.append(" ".join(w))
    out += [base] * 9
    out += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 30) for _ in range(8)]
    out += [passage + passage, passage[:60] * 8, "a" * 700, "", None, None, " \n\t", "one two", "ONE two", "x", "é" * 150, prose(rng, 9000), "\n".join([prose(rng, 8)] * 9)]
    out += [prose(rng, rng.randrange(1, 90)) for _ in range(25)]
    rng.shuffle(out)
    return list(enumerate(out)) + [(3, out[3])]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_word_pieces(spark, docs, texts, empty):
    from tokenizers import models

    initial, continuing = wordpiece.sentencepiece_pieces(queries.vocabulary("piece_bpe_32k.model"))
    vocab = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *initial, *("##" + p for p in continuing)]))}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6)
    got = by_id(wordpiece.token_counts(docs.withColumn("n_words", F.lit("clash")), initial, continuing))
    for i, t in texts:
        words = re.findall(SPACE, t or "")
        pieces = [[x.value for x in model.tokenize(w)] for w in words]
        want = (len(words), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces))
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == want
    assert wordpiece.token_counts(empty, initial, continuing).count() == 0


def test_longest_match_automaton():
    rng = random.Random(1)
    for _ in range(60):
        initial, continuing = ({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(6)} for _ in range(2))
        match = wordpiece.LongestMatch(initial, continuing)
        for _ in range(40):
            word, at, n = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))), 0, 0
            while at < len(word):
                size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in (continuing if at else initial)), 0)
                if not size:
                    n = 0
                    break
                at, n = at + size, n + 1
            assert match.n_pieces(word) == n


def test_sharding(spark, docs, empty):
    rows = docs.withColumn("slot", F.lit("clash"))
    got = sharding.shuffle_shards(rows, 7, per_block=3).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert sharding.shuffle_shards(empty, 4).count() == 0


def test_communication_matrix():
    counts, total = np.array([5, 0, 9, 3, 4]), 0
    sizes, each = sharding.block_sizes(21, 4, 3)
    assert each == 2 and sizes.sum() == 21
    rows = [sharding.matrix_row(counts, sizes, p, 3) for p in range(5)]
    assert (np.sum(rows, 0) == sizes).all() and (np.sum(rows, 1) == counts).all()
    for seed in range(4000):
        total += sharding.matrix_row(np.array([6, 4]), np.array([5, 5]), 0, seed)[0]
    assert abs(total / 4000 - 3) < 0.08
    rng = np.random.default_rng(0)
    drawn = [sharding._hypergeometric(rng, 10**9, 10**9, 100) for _ in range(400)]
    assert abs(np.mean(drawn) - 50) < 1.5 and 3 < np.std(drawn) < 7


def test_hypergeometric_by_inversion(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(sharding, "LARGE", 0)
    for good, bad, take in ((6, 4, 5), (40, 3, 20), (0, 5, 3), (5, 0, 5)):
        got = np.bincount([sharding._hypergeometric(rng, good, bad, take) for _ in range(20_000)], minlength=take + 1) / 20_000
        want = [math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) for k in range(take + 1)]
        assert np.abs(got - want).max() < 0.015
    sizes = rng.integers(0, 60, 23)
    assert all((x := sharding._split(rng, sizes, 300)).sum() == 300 and (x <= sizes).all() for _ in range(50))
    monkeypatch.setattr(sharding, "LARGE", 10**9)
    draws = [sharding._hypergeometric(rng, 3 * 10**10, 7 * 10**10, 5 * 10**10) for _ in range(20)]
    sd = math.sqrt(5e10 * 0.3 * 0.7 * 0.5)
    assert abs(np.mean(draws) - 1.5e10) < 5 * sd / math.sqrt(20) and 0.4 * sd < np.std(draws) < 1.8 * sd


def test_sharding_query(spark, tmp_path):
    rows = [(1, "aé"), (1, "aé"), (2, None), (3, ""), (None, "x" * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_sharding(spark, str(tmp_path)).collect()
    want = [(i, len((t or "").encode()) * (t is not None) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert collections.Counter(tuple(r)[:3] for r in got) == collections.Counter(want)
    assert all(r.law == "rows" and r.grown_shard is None and r.slot == 0 for r in got) and len({r.shard for r in got}) == 5


def test_quality(spark, docs, texts, empty):
    got = by_id(quality.judged(docs.withColumn("kept", F.lit("clash"))))
    for i, t in texts:
        t = t or ""
        w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
        grams = collections.defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k:k + 3])].append(k)
        covered = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judged(docs).filter("kept").count() == sum(r.kept for r in quality.judged(docs).collect())
    assert quality.judged(empty).count() == 0


def _removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if (s := b[k:k + length]) in seen:
                m[k:k + length] = b"\1" * length
            seen.add(s)
        out[i] = (len(b), sum(m), len(re.findall(rb"\x01+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_repeats(spark, docs, texts, empty, length, monkeypatch):
    got, want = substrings.digests(docs, length).collect(), _removed(texts, length)
    assert len(got) == len(texts)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert substrings.digests(empty, length).count() == 0
    cut = substrings.deduplicated(docs.withColumn("extra", F.lit(1)), length)
    assert cut.columns == ["doc_id", "text", "extra"] and all(r.text is None or r.text.encode().decode() == r.text for r in cut.collect())


def test_repeats_in_parts(spark, monkeypatch):
    # Places, and so parts, as in texts of 16 MiB or more; the brute force knows no parts.
    monkeypatch.setattr(substrings, "WHOLE_BYTES", 2000)
    monkeypatch.setattr(substrings, "PART_BYTES", 512)
    rng = random.Random(11)
    once, passage = prose(rng, 3000), prose(rng, 200)
    rows = [(1, once), (2, prose(rng, 400) + passage + prose(rng, 333) + passage), (3, prose(rng, 70) + once[700:5000] + prose(rng, 300)), (4, passage[:150]), (5, "a" * 3000)]
    got, want = by_id(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"))), _removed(rows, 100)
    assert got[1].n_removed == 0
    assert all(tuple(got[i])[1:] == want[i] for i, _ in rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_repeats_of_hot_anchors(spark, texts, monkeypatch, hot):
    # Anchors with more distinct segments than an index takes go string by string.
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    line = prose(rng, 30)
    rows = [(i, prose(rng, 20) + line + prose(rng, 20)) for i in range(30)] + [(100 + i, t) for i, t in texts]
    got, want = by_id(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"))), _removed(rows, 100)
    assert all(tuple(got[i])[1:] == want[i] for i, _ in rows)


def test_repeats_seen_by_one_task():
    a = lambda *x: np.array(x, np.int64)
    part = (a(7, 7, 7, 8, 7), a(1, 1, 1, 2, 1), a(5, 3, 3, 3, 3), a(0, 0, 0, 0, 0), a(10, 40, 40, 45, 90), a(14, 44, 44, 50, 94))
    got = substrings._combined([part], 100).to_pylist()
    left = [tuple(r.values())[:6] for r in got if not r["done"]]
    assert left == [(7, 1, 3, 0, 40, 44), (8, 2, 3, 0, 45, 50)]
    assert [(r["doc_id"], r["first"], r["last"]) for r in got if r["done"]] == [(3, 90, 94), (5, 10, 14)]


def test_repeats_of_repeated_rows(spark):
    rng = random.Random(12)
    one, two, three, four = (prose(rng, 60) for _ in range(4))
    rows = [(3, one)] * 2 + [(None, two)] * 3 + [(5, one + three)] * 2 + [(7, two), (8, four + four), (8, four + four), (9, "short"), (9, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Rows with one doc_id and equal text are one document; a null doc_id is before all others.
    want = _removed([(-1 if i is None else i, t) for i, t in rows], 100)
    assert want[3][1] == want[-1][1] == 0 < want[5][1] and want[8][1] == len(four.encode())
    got = substrings.digests(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert all(tuple(r)[1:] == want[-1 if r.doc_id is None else r.doc_id] for r in got)
    cut = collections.Counter(map(tuple, substrings.deduplicated(docs).collect()))
    assert cut == {(3, one): 2, (None, two): 3, (5, three): 2, (8, four): 2, (9, "short"): 2}


def test_run_length_index():
    rng = random.Random(2)
    for _ in range(30):
        segments = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(8, 30))) for _ in range(5)]
        segments += [segments[0], segments[1][:10] + segments[2]]
        found = {(int(s), int(a)) for x, y in substrings.RunLengthIndex(segments, 8).marks() for s, a in zip(x, y)}
        want = {(i, k) for i, s in enumerate(segments) for k in range(len(s) - 7) if any(s[k:k + 8] in z for z in segments[:i])}
        assert {m for m in found} == want


def test_packing(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    rows = packing.pack(docs, path, window=64).collect()
    tok, pieces = Tokenizer.from_file(path), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        times = sum(1 for j, _ in texts if j == i)
        own = sorted(pieces[i], key=lambda r: (r.sequence_id, r.offset))
        assert b"".join(r.ids for r in own) == ids * times
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in places:
        assert 64 * s + o == at
        at += n
    whole = packing.sequences(spark.createDataFrame(rows), 64).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in whole] == list(range(-(-at // 64))) and all(len(r.ids) == 256 for r in whole)
    assert b"".join(r.ids for r in whole)[:4 * at] == b"".join(r.ids for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)))
    assert packing.pack(empty, path).count() == 0


def test_tokenizer_memo():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), packing.ByteBPE(open(path, encoding="utf-8").read())
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "é", "9", "!", " ", "\x1c", "\t ", "<|endoftext|>", "語"]) for _ in range(rng.randrange(12)))
        assert own.encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_decontamination(spark, docs, texts, empty, monkeypatch):
    rng = random.Random(4)
    some = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in texts]
    items = [(k, " ".join(w[5:25]).upper() if k % 2 else " ".join(w[2:6])) for k, w in enumerate(some) if len(w) > 40][:10] + [(98, None), (99, "!!"), (97, prose(rng, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    windows = collections.defaultdict(set)
    for k, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(str(k))
    for (i, _), w in zip(texts, some):
        hit, found = set(), set()
        for g, ids in windows.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j:j + len(g)]) == g:
                    hit.update(range(j, j + len(g)))
                    found |= ids
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    for block in (decontam.BLOCK_BYTES, 60):  # the second: many blocks
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        got = by_id(decontam.hits(docs, benchmark))
        assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256) == want[i] for i, r in got.items()) and len(got) == len(want)
    monkeypatch.setattr(decontam, "ROUND_BLOCKS", 2)
    got = decontam.hits(docs.withColumn("n_hit", F.lit("clash")), benchmark).collect()
    assert len(got) == len(texts) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    one, several = (collections.Counter(map(tuple, decontam.removed_passages(docs, benchmark).collect())) for _ in (monkeypatch.setattr(decontam, "ROUND_BLOCKS", n) for n in (10**6, 2)))
    assert one == several
    clean = decontam.removed_passages(docs, benchmark)
    for r in clean.collect():
        left = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER)))
        assert left == want[r.doc_id][0] - want[r.doc_id][1]
    assert decontam.hits(empty, benchmark).count() == 0 and decontam.hits(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_holds_one_round(spark, docs, texts, monkeypatch):
    """No more than ROUND_BLOCKS broadcasts are alive at once, and each is destroyed after its round."""
    from pyspark.core.broadcast import Broadcast
    live, most, made = set(), [], spark.sparkContext.broadcast

    def broadcast(value):
        got = made(value)
        live.add(id(got))
        most.append((len(live), len(value)))
        return got

    destroy = Broadcast.destroy
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (live.discard(id(self)), destroy(self, blocking)))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontam, "ROUND_BLOCKS", 2)
    benchmark = spark.createDataFrame([(k, " ".join((t or "").split()[:20])) for k, t in texts[:30]], "item_id long, text string")
    got = decontam.hits(docs, benchmark)
    assert len(most) > 6 and max(n for n, _ in most) == 2 and not live
    assert got.filter("n_hit > 0").count() > 5  # the result outlives the broadcasts


def test_block_of_the_benchmark_is_a_few_times_its_text():
    rng = random.Random(6)
    texts = [prose(rng, 40) for _ in range(300)] + ["".join(chr(97 + rng.randrange(26)) for _ in range(7)) + f" {k}" for k in range(2000)]
    items = [(f"i{k}", t.encode()) for k, t in enumerate(texts)] + [("same", texts[0].encode()), ("same", texts[0].encode())]
    block = decontam.Block(items, 10)
    assert block.nbytes < 8 * sum(len(t) for _, t in items)
    want = collections.defaultdict(set)
    for i, t in items:
        w = decontam.words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1):
            want[tuple(w[j:j + n])].add(i)
    got = {}
    for n, (first, offsets, listed) in block.windows.items():
        for k, at in enumerate(first.tolist()):
            window = tuple(block.vocabulary[int(x) - 1].as_py() for x in block.tokens[at:at + n])
            assert window not in got
            got[window] = {block.items[int(x)].as_py() for x in listed[offsets[k]:offsets[k + 1]]}
    assert got == want


@pytest.mark.parametrize("listed", [1 << 20, 3])
def test_items_are_listed_in_bounded_steps(listed, monkeypatch):
    monkeypatch.setattr(decontam, "LISTED", listed)
    monkeypatch.setattr(decontam, "SEARCHED", 2)
    block = decontam.Block([(f"i{k}", b"a b c d e f") for k in range(9)] + [("z", b"c d e g"), ("s", b"q")], 3)
    shard = decontam.Shard([b"x a b c d y c d e g", None, b"q Q", b"", b"d e f"])
    shard.search(block)
    nine = {f"i{k}" for k in range(9)}
    assert shard.spans() == [[(1, 5), (6, 10)], [], [(0, 2)], [], [(0, 3)]]
    assert shard.items == [nine | {"z"}, set(), {"s"}, set(), nine]


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = rng.integers(0, 4, rng.integers(1, 60))
        index = decontam.FMIndex(text, 3)
        patterns = rng.integers(1, 4, (20, 2))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [k for k in range(len(text) - 1) if (text[k:k + 2] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_warc(spark):
    big = "<p>" + "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 60 + "ü</p>"
    fake = "x" * 1200 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/b c", big), (5, "http://a", big), (3, None, big), (2, "u\r\nX: y", fake), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (None, "u", "z" * 2000), (5, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, scratch(spark)).collect()
    largest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(largest.get(b, -1), i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = largest.get(b)
        revisit = to is not None and to != i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None)] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert warc.round_trip(pages.limit(0), scratch(spark)).count() == 0


def test_warc_long_headers(spark):
    url = "data:text/html," + "a b" * 100_000
    rows = [(1, url, "x" * 500), (2, "u", "y" * 1500), (3, url + "!", "y" * 1500), (4, "u", "WARC/1.0\r\n" * 60_000), (5, url, None), (6, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch(spark)
    warc.write_warc(pages, path)
    read = {r.record_id: r for r in warc.read_warc(spark, path)[0].collect()}
    assert sorted(read) == [f"<urn:page:{i}>" for i, _, _ in rows]
    assert all(read[f"<urn:page:{i}>"].uri == u.replace(" ", "%20") for i, u, _ in rows)
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(pages, scratch(spark)).collect()} == {i: len(h or "") for i, _, h in rows}


def test_warc_candidates():
    # Magics that share a header's end: each has its own fields, the first of a name.
    data = b"X\r\nWARC/1.0\r\nWARC-Type: a\r\nNote: WARC/1.1\r\nWARC-Type: b\r\nWARC-Record-ID: i\r\nContent-Length: 2\r\n\r\nok\r\n\r\nWARC/1.0\r\n\r\n\r\n\r\nWARC/1.0\r\nopen"
    found = {r["at"]: r for r in warc._candidates("f", data, True)}
    one, two = data.index(b"WARC/1.0"), data.index(b"WARC/1.1")
    assert set(found) == {one, two} and [found[k]["record_type"] for k in (one, two)] == ["a", "b"]
    assert all(r["record_id"] == "i" and r["payload"] == b"" and data[r["next"]:].startswith(b"WARC/1.0") for r in found.values())


def test_warc_damage(spark):
    good = [{"file": "f", "at": a, "next": b} for a, b in ((0, 10), (10, 30), (30, 70), (12, 25), (25, 30), (80, 90))]
    edges = spark.createDataFrame([(x["file"], x["at"], x["next"]) for x in good], "file string, at long, next long")
    assert {r["at"] for r in warc.reached(edges).collect()} == {0, 10, 30}
    rng = random.Random(2)
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(40), rng.randrange(1, 20))))
        after, want, now = at + np.array([rng.randrange(1, 9) for _ in at]), set(), 0
        while now in at:
            want.add(now)
            now = int(after[np.searchsorted(at, now)])
        assert set(at[warc._jumped(at, after)].tolist()) == want


def test_warc_files_are_bounded(spark):
    rows = [(i, "u" * (70_000 if i == 3 else 200_000 if i == 8 else 5), chr(97 + i) * n) for i, n in enumerate([10, 3000, 3000, 90_000, 200, 50, 7, 40_000, 2000, 1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch(spark)
    warc.write_warc(pages, path, file_bytes=100_000, records_per_file=20, compression="none")
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert len(sizes) > 3 and sum(n > 100_000 for n in sizes) <= 2
    assert {r.page_id for r in warc.round_trip(pages, scratch(spark)).collect()} == set(range(10))
    big = pages.filter("page_id < 3").withColumn("html", F.when(F.col("page_id") == 1, F.repeat(F.concat(F.lit("0123456789abcde"), F.col("page_id").cast("string")), 4_500_000)).otherwise("x"))
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(big, scratch(spark)).collect()} == {0: 1, 1: 72_000_000, 2: 1}


def _links(texts, n=5):
    sets = collections.defaultdict(set)
    for i, t in texts:
        w = re.findall(SPACE, (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard(spark, docs, texts, empty):
    got, want = jaccard.classes(docs).collect(), _links(texts)
    assert len(got) == len(texts) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert jaccard.classes(empty).count() == 0


def _sets(rng, n):
    """Sets around a few centres, from equal to far apart: {id: set of numbers}."""
    out = {}
    for i in range(n):
        size = rng.choice((1, 2, 5, 9, 20, 40, 60, 75))
        centre = 1000 * rng.randrange(4)
        own = set(range(centre, centre + size))
        for x in rng.sample(sorted(own), rng.randrange(len(own) // 3 + 1)):
            own.discard(x)
            if rng.random() < 0.6:
                own.add(10**6 + rng.randrange(10**6))
        out[i] = own or {centre}
    return out


@pytest.mark.parametrize("percent", [80, 60])
def test_skipped_blocks_hold_no_link(spark, percent):
    rng = random.Random(percent)
    sets = _sets(rng, 160)
    rows, folds = [], []
    for i, own in sets.items():
        n = len(own)
        fold = jaccard.folded_sketch(np.array(sorted(own), np.uint64))
        folds.append((i, *fold))
        rows += [(t, i, (n << 32) + at) for at, t in enumerate(sorted(own)[: n - -(-percent * n // 100) + 1])]
    lists = spark.createDataFrame(rows, "token long, doc_id long, place long")
    lists = jaccard.mixed(lists, spark.createDataFrame([], "node long, component long"), percent)
    found = {(r.a, r.b) for r in jaccard.crossing(lists, spark.createDataFrame(folds, "doc_id long, f0 long, f1 long"), percent).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert want and want <= found


def test_answers_derived_from_a_hub(spark):
    rng, percent = random.Random(3), 80
    sets = _sets(rng, 90)

    def answer(a, b):
        x, z = sets[a], sets[b]
        return (a, b, len(x), len(z), len(x & z), 100 * len(x & z) >= percent * len(x | z))

    known = [answer(a, b) for a in sets for b in sets if a < b]
    ddl = "a long, b long, n_a long, n_b long, shared long, link boolean"
    answers = spark.createDataFrame(known, ddl)
    hubs = jaccard.hubs(answers).collect()
    assert hubs and not {h.a for h in hubs} & {h.hub for h in hubs}
    waits = [(h.a, b, h.hub, h.n_a, h.n_hub, h.same) for h in hubs for b in sets if h.a < b != h.hub]
    left, links = jaccard.derived(spark.createDataFrame(waits, "a long, b long, hub long, n_a long, n_hub long, same long"), answers, percent)
    truth = {k[:2]: k[5] for k in known}
    hub = {h.a: h.hub for h in hubs}
    opened, linked = {(r.a, r.b) for r in left.collect()}, {(r.u, r.v) for r in links.collect()}
    assert linked <= {k for k, v in truth.items() if v}
    for a, b, *_ in waits:  # what is neither open nor linked is no link, or joins through the hub
        assert (a, b) in opened | linked or not truth[a, b] or truth[min(hub[a], b), max(hub[a], b)]
    assert len(opened) < len(waits)


def test_needed_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.createDataFrame([(i,) for i in (0, 5, 1234, 2999)], "doc_id long")
    kept = {r.doc_id for r in needed(docs, ids).collect()}
    assert {0, 5, 1234, 2999} <= kept and len(kept) < 20


def test_sketch_bound():
    rng = np.random.default_rng(1)
    for n, m in ((300, 250), (600, 500), (40, 40)):
        common = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common[:min(n, 200)], rng.integers(0, 1 << 63, max(0, k - 200), dtype=np.uint64)])) for k in (n, m))
        assert jaccard.differing_bits(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(40) if k % 9] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)] + [(7, 7)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    alone = {x for x in up if not any(x in e and e[0] != e[1] for e in edges)}
    assert got == {x: root(x) for x in up if x not in alone}


def test_language(spark):
    rng = random.Random(8)
    kinds = {"de": "der die und nicht ein schön über straße".split(), "en": "the and of that with which through".split(), "fr": "le la des été où ça être dans".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randrange(8, 40))), k) for i, k in enumerate(rng.choices(sorted(kinds), k=300))]
    rows += [(900, None, "de"), (901, "", "de"), (902, "12 34 !", "en"), (903, "the and of", None), (904, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.identified(docs, langid.Trees(langid.training_sample(docs))))
    held = [i for i, _, k in rows if i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out and i < 900} == set(held)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en" and got[904].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled, langid.Trees(langid.training_sample(unlabelled))).collect()} == {"und"}


def _ppm(samples, text):
    """Bits of text by prediction with partial matching, said plainly."""
    seen = collections.defaultdict(collections.Counter)
    for t in samples:
        t = b"\n\n\n" + t
        for i in range(3, len(t)):
            for k in range(4):
                seen[t[i - k:i]][t[i]] += 1
    bits, t = 0.0, b"\n\n\n" + text
    for i in range(3, len(t)):
        for k in (3, 2, 1, 0):
            if found := seen.get(t[i - k:i]):
                whole = sum(found.values()) + len(found)
                if t[i] in found:
                    bits -= math.log2(found[t[i]] / whole)
                    break
                bits -= math.log2(len(found) / whole)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_code_lengths_against_plain_ppm(step, monkeypatch):
    monkeypatch.setattr(langid, "STEP", step)
    rng = random.Random(5)
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))).encode()
    samples = {"a": [word("abcé ") for _ in range(20)], "b": [word("bcd\n ") for _ in range(20)], "c": [word("xyzß") for _ in range(3)]}
    texts = [word("abcdé x\n?") for _ in range(60)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    trees = langid.Trees(samples)
    got = trees.lengths(np.frombuffer(b"".join(texts), np.uint8), starts)
    assert np.allclose(got, [[_ppm(samples[k], t) for k in trees.languages] for t in texts], rtol=1e-5)


def test_trees_of_many_languages_are_whole_and_sparse():
    """40 languages of 256 byte values: what tables of all symbols would need room for stays exact and small."""
    rng = np.random.default_rng(3)
    samples = {f"l{k:02d}": [rng.choice(256, 3000, p=rng.dirichlet(np.full(256, .2))).astype(np.uint8).tobytes() for _ in range(3)] for k in range(40)}
    trees = langid.Trees(samples)
    texts = [samples[k][0][100:160] + samples["l07"][1][:9] for k in list(samples)[::4]] + [bytes(range(256)), b"\xff"]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = trees.lengths(np.frombuffer(b"".join(texts), np.uint8), starts)
    assert np.allclose(got, [[_ppm(samples[k], t) for k in trees.languages] for t in texts], rtol=1e-5)
    assert [trees.languages[i] for i in got[:10].argmin(1)] == list(samples)[::4]
    size = sum(len(t) for own in samples.values() for t in own)
    assert sum(t.nbytes for t in trees.trees) < 64 * size
    longer = langid.Trees({k: v * 5 for k, v in samples.items()})  # repeats add no grams
    assert sum(t.nbytes for t in longer.trees) <= sum(t.nbytes for t in trees.trees) + 40 * 16 * 4 * 3


def test_language_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identified(empty, langid.Trees(langid.training_sample(empty))).count() == 0
    some = spark.createDataFrame([(1, "hello there", "en", "x")], "doc_id long, text string, lang string, score string")
    assert [r.lang_pred for r in langid.identified(some, langid.Trees({"en": [b"hello"], "de": [b"guten tag"]})).collect()] == ["en"]


def test_code_lengths_are_sums_of_single_texts():
    trees = langid.Trees({"a": [b"hello there"], "b": [b"guten tag ihr"]})
    some = [b"hello", b"x", b"tag", b"gutenhello", b"\xff\x00q"]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in some])])
    together = trees.lengths(np.frombuffer(b"".join(some), np.uint8), starts)
    for t, bits in zip(some, together):
        assert np.allclose(trees.lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], bits)
    assert (together > 0).all()


def test_chat_of_many_turns(spark):
    """Spans of a conversation of 40,000 turns, and of one to ten turns, by plain sums."""
    rng = random.Random(2)
    roles = ["user", "assistant", "assistant", "system"]
    rows = [(0, k, rng.choice(roles), "x" * rng.randrange(4) + "é<|&"[:rng.randrange(5)]) for k in range(40_000)]
    rows += [(n, k, rng.choice(roles), "y" * rng.randrange(9)) for n in range(1, 11) for k in range(n)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in range(11):
        own = [(r, t.replace("&", "&amp;").replace("<|", "&lt;|")) for c, _, r, t in rows if c == conv]
        parts, want, at = [], [], 0
        for k, (role, text) in enumerate(own):
            lead = chat.SEP if k and own[k - 1][0] == role else f"{chat.START}{role}\n"
            tail = "" if k + 1 < len(own) and own[k + 1][0] == role else f"{chat.END}\n"
            if role == "assistant":
                want.append((at + len(lead), len(text)))
            parts.append(lead + text + tail)
            at += len(parts[-1])
        assert got[conv].formatted == "".join(parts) and [tuple(x) for x in got[conv].loss_spans] == want


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok & &amp; &lt;| <|im_sep|>"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 3, "user", None), (2, 0, "system\n<|x", "s"), (2, 1, None, ""), (None, 0, "user", "n"), (3, 0, "assistant", "é\U0001F600")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns)
    got = {r.conv_id: r for r in chat.parse_chats(made).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss_texts == [x for _, r, x in own if r == "assistant"]
    assert got[1].formatted.count(chat.START) == 3 and got[1].formatted.count(chat.SEP) == 2
    assert chat.format_chats(turns.limit(0)).count() == 0
    assert chat.digest(chat.parse_chats(made)).filter("conv_id = 1").first().n_turns == 5
