"""Operators that count over the whole corpus: suffix tree scores, filter audit, collocations. All against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import collocations, filteraudit, grams, suffixtree
from tests.llm.edge import clashing, documents, empty, rows

WORD = r"[^\x20\x09-\x0D]+"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# Filter audit


def naive_audit(data, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in data:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = defaultdict(list)
    for d, text, lang in data:
        s = text or ""
        w = re.findall(WORD, s)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", s)) > 10 * len(s)}
        bad |= {"D": bool(re.search("[#$%&*|]", s)), "E": d is not None and first[s] < d}
        parts[lang or ""].append((frozenset(f for f in bad if bad[f]), d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        steps = {}
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fails = sum(f in x[0] for x in docs)
                unique = sum(x[0] == {f} for x in docs)
                steps[order, k] = (len(left), len(gone), fails - len(gone), unique, sum(x[1] for x in gone), sum(x[2] for x in gone))
        total = Counter()
        for (order, k), v in steps.items():
            total[order[k]] += v[1]
        out += [(part, "".join(order), k + 1, *v, total[order[k]]) for (order, k), v in steps.items()]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_against_brute_force(spark):
    more = [(300, "LOUD #1 " * 60, "en"), (301, "LOUD #1 " * 60, "en"), (299, "Two Words", ""), (302, " ".join(f"w{i}" for i in range(150)), None)]
    plain = documents(spark).select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    docs = clashing(plain)
    for name in ("part", "mask", "digest", "first", "good", "docs", "A", "E"):
        docs = docs.withColumn(name, F.lit("odd"))
    labels = [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 320, 2)] + [(20, 1, 1), (21, None, 1), (21, 1, None), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(d, None if q is None else int(q), None if t is None else int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    out = filteraudit.audit(filteraudit.failures(docs), clashing(table).withColumn("good", F.lit(0)).withColumn("mask", F.lit(0)))
    assert sorted(rows(out, *AUDIT)) == naive_audit(rows(plain, "doc_id", "text", "lang"), labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.failures(empty(spark)), labels).count() == 0
    out = filteraudit.audit(filteraudit.failures(documents(spark)), labels.limit(0))
    assert out.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_intervals_cover_every_order_once():
    for names in ("A", "ABC", "ABCDE"):
        at = {n: filteraudit.lehmer_rank("".join(p), names) for n, p in enumerate(permutations(names))}
        assert all(n == r for n, r in at.items())
        covered = Counter()
        for mask, step, begins, ends in filteraudit.removal_intervals(names):
            covered.update((mask, r) for r in range(begins, ends))
        assert covered == Counter({(mask, r): 1 for mask in range(1, 1 << len(names)) for r in range(len(at))})
    assert len(filteraudit.removal_intervals("ABCDE")) == 840


def test_audit_refuses_more_orders_than_it_can_list(spark):
    with pytest.raises(ValueError, match="at most seven"):
        filteraudit.audit(documents(spark), documents(spark), "ABCDEFGH")


# Collocations


def naive_collocations(data, least, top, share):
    count = defaultdict(Counter)
    for text, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                count[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                inner[p[:2]] = max(inner[p[:2]], a)
                inner[p[1:]] = max(inner[p[1:]], a)
        found = []
        for p, a in candidates.items():
            if len(p) == 2 and inner[p] and 100 * inner[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        for rank, (score, a, phrase, x, y, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, n, -score, k))
    return sorted(out)


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def phrase_rows(spark):
    more = [(400 + i, "es, en es de. de es! New York City, new york\ta b a b a b\nx", lang) for i in range(6) for lang in ("es", "en", None, "und")]
    return documents(spark).select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string")).cache()


@pytest.mark.parametrize("least,top,share,limit", [(10, 2000, 50, 1 << 22), (2, 40, 50, 3000), (3, 100, 90, 500)])
def test_collocations_against_brute_force(spark, monkeypatch, least, top, share, limit):
    plain = phrase_rows(spark)
    docs = clashing(plain)
    for name in ("phrase", "a", "tag", "words", "cuts", "salt", "slice"):
        docs = docs.withColumn(name, F.lit("odd"))
    whole = collocations.sliced
    monkeypatch.setattr(collocations, "sliced", lambda d, c, **kw: whole(d, c, limit, **kw))
    out = rows(collocations.collocations(docs, least, top, share), *PHRASES)
    assert sorted(out) == naive_collocations(rows(plain, "text", "lang"), least, top, share)


def test_paths_are_whole_and_told_once(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(50))
    data = [(i, f"own{i} {passage} tail{i}" if i % 2 else passage, "en") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(7)
    paths = collocations.compacted_paths(df)[0].collect()
    assert [(r.words, r.a) for r in paths] == [(passage.split(), 30)]


def test_scores_beyond_64_bits_are_exact(spark):
    a = 3 * 10**12
    df = spark.createDataFrame([(a, 10**13, 10**13 + 1), (a, a, a)], "a long, l long, r long")
    got = rows(df.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")), "s")
    assert sorted(got) == [(10**6 * a * a // (10**13 * (10**13 + 1)),), (10**6,)]


def test_no_collocations_in_an_empty_table(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(documents(spark).where("doc_id < 3")).count() == 0


# Suffix tree


def naive_scores(data, learn, depth, least, gain, strengths):
    texts = [(d, [*re.findall(WORD, lower(t or "")), ""]) for d, t in data]
    count = Counter()
    for (d, w), use in zip(texts, learn):
        if use:
            for n in range(1, depth + 2):
                count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, known = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    states = {}

    def chain(w, i, without):
        p, used = (count[w[i],] - without + 1) / (total - without + known + 1), 0
        for k in range(1, min(depth, i) + 1):
            s = tuple(w[i - k : i])
            if s in states:
                p, used = (count[*s, w[i]] - without + states[s] * p) / (count[s] - without + states[s]), k
        return p, used

    for k in range(1, depth + 1):
        sums = defaultdict(lambda: [0] * len(strengths))
        for (d, w), use in zip(texts, learn):
            for i in range(k, len(w)) if use else ():
                s = tuple(w[i - k : i])
                if count[s] >= least:
                    p, _ = chain(w, i, 1)
                    for j, t in enumerate(strengths):
                        q = (count[*s, w[i]] - 1 + t * p) / (count[s] - 1 + t)
                        sums[s][j] += round((math.log(q) - math.log(p)) * 2**20)
        states |= {s: strengths[v.index(max(v))] for s, v in sums.items() if max(v) >= round(gain * 2**20)}
    out = []
    for (d, w), use in zip(texts, learn):
        base = sum(math.log10((count[x,] + 1) / (total + known + 1)) for x in w)
        found = [chain(w, i, 0) for i in range(len(w))]
        out.append((d, use, len(w), sum(count[x,] > 0 for x in w), total, base, sum(math.log10(p) for p, _ in found), sum(u for _, u in found) / len(w)))
    return out, states, count, total, known


SCORED = ("doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_state")


def same(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2:4], round(r[5], 6), round(r[6], 6))) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("depth,least,limit", [(2, 4, 1 << 22), (3, 2, 2000), (1, 3, 500)])
def test_suffix_tree_scores_against_brute_force(spark, monkeypatch, depth, least, limit):
    docs = clashing(documents(spark)).withColumn("tag", F.lit("odd")).withColumn("slice", F.lit(1)).withColumn("trained", F.lit(0))
    whole = suffixtree.sliced
    monkeypatch.setattr(suffixtree, "sliced", lambda d, c, **kw: whole(d, c, **kw | {"limit": limit}))
    data = rows(docs, "doc_id", "text")
    learn = [d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in data]
    want, states, *_ = naive_scores(data, learn, depth, least, 2.0, (1.0, 8.0, 64.0, 512.0))
    assert {len(s) for s in states} == set(range(1, depth + 1))
    same(rows(suffixtree.score(docs, ~suffixtree.held_out(), depth, least), *SCORED), want)


def test_state_probabilities_sum_to_one(spark):
    data = [(i, t) for i, t in enumerate(["a b c", "e b d", "a b c d", "e b d c", "a b d"] * 8)]
    words = ["a", "b", "c", "d", "e", "zz"]
    asked = [(100 + i, f"a b {w}") for i, w in enumerate(words)] + [(99, "a b")]
    df = spark.createDataFrame(data + asked, "doc_id long, text string")
    out = {r.doc_id: r.score for r in suffixtree.score(df, F.col("doc_id") < 50).collect()}
    _, states, count, total, known = naive_scores(data + asked, [d < 50 for d, _ in data + asked], 2, 4, 2.0, (1.0, 8.0, 64.0, 512.0))
    assert ("a", "b") in states
    # The end follows each asked text: its probability behind the last word is taken off by hand.
    ends = naive_scores(data + asked, [d < 50 for d, _ in data + asked], 2, 4, 2.0, (1.0, 8.0, 64.0, 512.0))[0]
    assert {d: s for d, _, _, _, _, _, s, _ in ends} == pytest.approx(out)

    def after(context, w):
        p = (count[w,] + 1) / (total + known + 1)
        for s in (context[-1:], context):
            if s in states:
                p = (count[*s, w] + states[s] * p) / (count[s] + states[s])
        return p

    assert sum(after(("a", "b"), w) for w in [*words, ""]) == pytest.approx(1)


def test_suffix_tree_beats_its_root_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base, tree = suffixtree.score(docs, ~suffixtree.held_out()).where("not trained").agg(F.sum("base_score"), F.sum("score")).first()
    assert tree > base * 0.98


def test_scores_of_nothing_and_from_nothing(spark):
    assert suffixtree.score(empty(spark), F.lit(True)).count() == 0
    out = suffixtree.score(documents(spark), F.lit(False))
    assert out.agg(F.max("train_tokens"), F.max("n_known"), F.min("base_score"), F.min("score")).first() == (0, 0, 0.0, 0.0)


# Exchange of grams


def test_ranges_grow_with_the_input(spark):
    assert grams.ranges_for(0, spark) == 16
    assert grams.ranges_for(10**12, spark) == 10**12 // grams.RANGE_ENTRIES


def test_slices_survive_packing():
    words = pa.array([b"", "日本".encode(), b"x" * 300], pa.large_binary())
    hashes = np.array([5, 1 << 63, 0], np.uint64)
    s = grams.Slice(7, np.array([1, -5]), np.array([True, False]), np.array([0, 1]), ["en", "é"], np.array([2, 3]), np.array([0, 1, 2, 1, 0]), hashes, words)
    back = grams.Slice.of(dict(zip(grams.SLICES[1].names, s.row())))
    assert back.distinct.equals(words) and back.hashes.tolist() == hashes.tolist() and back.codes.tolist() == s.codes.tolist() and back.ids.tolist() == [1, -5] and back.has_id.tolist() == [True, False]
