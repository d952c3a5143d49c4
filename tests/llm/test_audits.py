"""Secrets, the filter audit and the divergence audit against plain versions, and their stated corner cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import credentials, divergence, filteraudit, queries

WORDS = "the of and house river mountain window garden table letter morning evening über naïve".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


# --- secrets -----------------------------------------------------------------------------------
PATTERNS = (
    ("assign", r"(?a:(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)))", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))


def plain_spans(text):
    out = []
    for i, (kind, pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(3)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = [None, "", "password", "secret: ab", 'TOKEN = "abcdef"', "paſſword=abcdef", "toKen=abcdef", "api_key='x/y+z=' apikey:abcdef", "password=token=abcdef secret",
            "über token: 0123456789abcdef01234567 " + "a" * 24, "password : \x20 ''abcdef", "AKIA" + "A" * 15, "xAKIA" + "B7" * 10 + "é", "a" * 23 + " " + "f" * 24, "token=\ntoken=abcdefg"]
    rows += [f"{prose(rng, 9)} token = \"{hexes(rng, 40)}\" {prose(rng, 4)}" for _ in range(60)]
    rows += [f"{prose(rng, 5)} {key()}. {prose(rng, 3)}" for _ in range(40)]
    rows += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(12, 20))) for _ in range(30)) for _ in range(40)]
    rows += [prose(rng, 30000) + f" secret={hexes(rng, 20)} " + "x" * 200_000]
    rows += [prose(rng, 3) + " ASIA" + key()[4:] + " " + prose(rng, 3), prose(rng, 3) + " " + hexes(rng, 22) + " " + prose(rng, 3)]
    rows = list(enumerate(rows))
    return rows + [rows[15], (None, rows[16][1])]


def test_secrets(spark, leaky):
    docs = spark.createDataFrame(leaky, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("kind", F.lit(1)).repartition(3)
    formats = credentials.Formats(credentials.examples(docs))
    assert [k for k, _, _ in formats.kinds] == ["like_assign", "like_access", "like_hex"]
    found = credentials.found(docs, formats)
    assert found.columns == ["doc_id", "text", "kind", "spans"]
    got = [(r.doc_id, r) for r in credentials.digest(found).collect()]
    text = dict(leaky)
    assert sorted((str(i) for i, _ in got)) == sorted(str(i) for i, _ in leaky)
    for i, r in got:
        want = plain_spans(text[i])
        spans = r.spans.split(",") if r.spans else []
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k[0]) for w in want) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(spans) and [s for s in spans if not s.startswith("like_")] == want
    added = {i: [s for s in r.spans.split(",") if s.startswith("like_")] for i, r in got}
    last = max(i for i, _ in leaky if i is not None)
    assert len(added[last]) == len(added[last - 1]) == 1 and added[last][0].startswith("like_") and added[last - 1][0].startswith("like_access")
    # Neither prose nor random letters; the third is a short key that the pattern leaves out.
    assert {i for i, v in added.items() if v} == {11, last - 1, last}


def test_secrets_without_examples(spark):
    docs = spark.createDataFrame([(1, "token=abcdefg0123")], "doc_id long, text string")
    for rows in (docs, docs.limit(0)):
        formats = credentials.Formats(credentials.examples(rows))
        assert not formats.kinds
        assert [r.n_assign for r in credentials.digest(credentials.found(rows, formats)).collect()] == [1] * rows.count()


def test_automata():
    rng = random.Random(2)
    values = ["AKIA" + "".join(rng.choice("ABCDEFGH") for _ in range(16)) for _ in range(300)]
    made = credentials.Automaton(values)
    near = np.mean([made.loglikelihood(v) / 21 for v in values])
    assert made.loglikelihood(values[0].lower()) / 21 < near - 1.5 and made.loglikelihood("A1" * 10) / 21 < near - 1
    # Words a+, a+a+, ... as long as a coin says: two states, and an odd number of letters is unlikely.
    loop = credentials.Automaton(["a+" * (1 + next(n for n in itertools.count() if rng.random() < 0.5)) for _ in range(500)])
    assert len(loop.next) - 1 <= 4
    assert loop.loglikelihood("a+a+") > loop.loglikelihood("a+a") + 3
    # Probabilities of all words up to three characters never exceed 1.
    total = sum(np.exp(loop.loglikelihood("".join(w))) for n in range(4) for w in itertools.product("a+", repeat=n))
    assert total <= 1 + 1e-9


# --- filter audit ------------------------------------------------------------------------------
def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = collections.defaultdict(list)
    for i, t, lang in docs:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, found in rows.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [any(x[0][g] for g in order[:step - 1]) for x in found]
                mine = [x for x, g in zip(found, gone) if not g and x[0][f]]
                out[part, "".join(order), step] = [
                    sum(not g and not x[0][f] for x, g in zip(found, gone)), len(mine), sum(g and x[0][f] for x, g in zip(found, gone)),
                    sum(x[0][f] and sum(x[0].values()) == 1 for x in found), sum(x[1] for x in mine), sum(x[2] for x in mine)]
        for f in "ABCDE":
            keys = [(part, "".join(o), o.index(f) + 1) for o in itertools.permutations("ABCDE")]
            whole = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(whole)
    return out


def test_filter_audit(spark):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (3, 150, 250, 400)] + ["A " * 210, "# " + prose(rng, 230), " ".join(map(str, range(220))), "$" + " ".join(map(str, range(300))), "ABC " + " ".join(f"w{i}" for i in range(240)),
                                                      "", None, "\n\t", "é" * 50, "x\x1fy " * 300, prose(rng, 40000)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(260)]
    docs += [docs[5], (docs[6][0], "other", "en"), (None, texts[2], "en"), (None, texts[2], "fr"), (-4, texts[3], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("words", F.lit("clash")).withColumn("fails", F.lit(1)).withColumn("part", F.lit("z")).repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filteraudit.audited(frame, said).collect()}
    assert got == plain_audit(docs, labels)
    assert filteraudit.audited(frame.limit(0), said).count() == 0
    assert filteraudit.audited(frame, said.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_bitmaps():
    codes = np.array([2, 0, 2, 2, 0] * 40 + [1])
    maps = filteraudit.Bitmaps(codes, 3)
    flags = np.arange(len(codes)) % 3 == 0
    assert maps.counts(maps.packed(flags)).tolist() == [int((flags & (codes == c)).sum()) for c in range(3)]
    assert maps.counts(~maps.packed(flags) & maps.packed(np.ones(len(codes), bool))).tolist() == [int((~flags & (codes == c)).sum()) for c in range(3)]


# --- divergence --------------------------------------------------------------------------------
def plain_divergence(docs, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    having, counts, groups = collections.Counter(), collections.defaultdict(collections.Counter), {}
    for text, lang, source in docs:
        key = (lang or "", source or "")
        groups.setdefault(key[0], set()).add(key[1])
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[key].update(words)
        having.update((key[0], w) for w in set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [w for (k, w), n in having.items() if k == lang and n >= 3]
        n_of = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        share = lambda n, whole: 1 + 10**9 * (n + 1) // (whole + len(kept))  # noqa: B023, E731
        p = {s: [share(counts[lang, s][w], n_of[s]) for w in kept] for s in sources}
        q = [share(sum(counts[lang, s][w] for s in sources), sum(n_of.values())) for w in kept]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode()) for o in sources - {s}]
            out |= {(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(pairs), 1)}
            terms = [(-f(a, b), w.encode()) for w, a, b in zip(kept, p[s], q) if counts[lang, s][w] and a > b]
            out |= {(lang, s, "term", w.decode(), -v, r) for r, (v, w) in enumerate(sorted(terms)[:top], 1)}
    return out


def test_divergence(spark):
    rng = random.Random(6)
    rare = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"]
    docs = [(prose(rng, rng.randrange(60)) + " " + " ".join(rng.sample(rare, 4)), rng.choice(["en", "en", "de", None]), rng.choice([f"s{i}" for i in range(7)] + [None, ""])) for _ in range(300)]
    docs += [("12 34", "fr", "a"), (None, "fr", "b"), ("A_B-c İK \x80é ABC", "en", "s1"), ("ABC abc Abc", "it", "solo"), docs[0], docs[0], (prose(rng, 20000), "de", "long")]
    frame = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = [tuple(r) for r in divergence.diverging(frame).collect()]
    assert len(set(got)) == len(got) and set(got) == plain_divergence(docs)
    few = {tuple(r) for r in divergence.diverging(frame, top=3).collect()}
    assert few == plain_divergence(docs, 3)
    assert divergence.diverging(frame.limit(0)).count() == 0


def test_divergence_in_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(prose(rng, 30) + " " + " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(5)), "en", f"s{i % 3}") for i in range(90)]
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 10)
    monkeypatch.setattr(divergence, "CELLS", 4)
    assert {tuple(r) for r in divergence.diverging(spark.createDataFrame(docs, "text string, lang string, source string")).collect()} == plain_divergence(docs)


def test_light_and_heavy_sums():
    """Both splits against plain sums, with sources far apart in size."""
    rng = np.random.default_rng(1)
    counts = np.where(rng.random((300, 12)) < rng.choice([0.05, 0.2, 0.9], (300, 1)), rng.integers(1, 50, (300, 12)) ** rng.integers(1, 4, (1, 12)), 0)
    counts = counts[counts.any(1)]
    wholes = counts.sum(0) + len(counts)
    p = [[1 + 10**9 * (int(c) + 1) // int(w) for c, w in zip(row, wholes)] for row in counts]
    want = np.array([[sum((r[g] - r[h]) ** 2 // r[h] for r in p) for h in range(12)] for g in range(12)])
    term, source = np.nonzero(counts)
    off = ~np.eye(12, dtype=bool)  # a source is not compared with itself
    assert (divergence.pair_sums(term, source, counts[term, source], wholes) == want)[off].all()
    sums = np.zeros((12, 12), np.int64)
    divergence.sparse(term, source, counts[term, source], wholes, sums)
    assert (sums == want)[off].all()
    big = np.array([9 * 10**14, 3])
    assert divergence.shares(big, np.array([10**15, 7])).tolist() == [1 + 10**9 * (9 * 10**14 + 1) // 10**15, 1 + 10**9 * 4 // 7]


def test_pieces_of_long_texts():
    rng = random.Random(9)
    for _ in range(50):
        text = "".join(rng.choice("ab É1 ") for _ in range(rng.randrange(60))).encode()
        whole = text.translate(divergence._LETTERS).split()
        for piece in (1, 2, 7, 100):
            assert [w for part in divergence.terms(text, piece) for w in part] == whole


def test_queries_are_registered():
    assert {"op11_secrets", "op12_filter_audit", "op13_divergence"} <= set(queries.QUERIES)
