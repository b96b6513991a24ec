"""Operators over whole tables: archive, search, joins, dedup, pages, pipeline, registered queries."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import catalog, components, htmltext, jaccard, packed, suffixdedup, topk, warc
from tests.compare import connection, differences
from tests.llm.edge import clashing, documents, empty, rows


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = connection(sf).execute(catalog.SQL[name]).fetchdf()
    assert differences(got[list(want.columns)], want) == ""


# Archive


def pages(spark):
    data = [(1, "http://a/x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c/\r\nWARC-Type: evil", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1"), (5, "u", "é\r\n\r\nWARC/1.1"), (6, "u", "x" * 300_000), (None, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "only here"), (None, None, "only here")]
    return clashing(spark.createDataFrame(data, "page_id long, url string, html string"))


def test_archive_round_trip(spark):
    records, payloads = warc.write_archive(pages(spark))
    every = warc.read_archive(records, payloads).collect()
    out = [r for r in every if r.record_id is not None]
    want = {r.page_id: (r.html or "").encode() for r in pages(spark).collect()}
    assert payloads.count() == 5
    assert sorted(r.record_id for r in out) == [1, 2, 3, 4, 5, 5, 6]
    assert sorted((r.record_type, r.refers_to or 0, bytes(r.payload).decode()) for r in every if r.record_id is None) == [
        ("response", 0, "only here"), ("response", 0, "only here"), ("revisit", 5, "é\r\n\r\nWARC/1.1")]
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in out}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    import base64

    for r in out:
        payload = bytes(r.payload)
        assert payload == want[r.record_id]
        assert r.stated_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        block = bytes(r.record).split(b"\r\n\r\n", 1)[1][:-4]
        length = int([x for x in bytes(r.record).split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert len(block) == length and block.endswith(payload if r.record_type == "response" else b"\r\n\r\n")


def test_archive_notices_altered_bytes(spark):
    records, payloads = warc.write_archive(pages(spark))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(records, payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))).select("payload").collect()
    assert warc.read_archive(*warc.write_archive(pages(spark).limit(0))).count() == 0


def test_archive_as_files(spark, tmp_path):
    archive = warc.read_archive(*warc.write_archive(pages(spark).coalesce(1)))
    warc.export_warc(archive, str(tmp_path / "w"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert len(written) == sum(len(r.record) for r in archive.collect())
    assert all(bytes(r.record) in written for r in archive.collect())


def test_payloads_are_shuffled_once_by_writing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(warc, "stage", lambda df, name, real=warc.stage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records, payloads = warc.write_archive(pages(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert payloads.columns == ["sha256", "n", "payload"] and records.count() == 10
    # The formatted tree has one line per operator; those that read the payload end in the table of distinct payloads.
    assert [p.count("Exchange") for p in plans if "first(payload" in p] == [1]
    assert sum(p.count("Exchange") for p in plans) <= 3


# Search


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(500)]
    data += [(500 + i, data[3][1]) for i in range(20)] + [(600, None), (601, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (602, [float("nan")] * 6), (604, [float("inf")] * 6), (605, []), (606, [1.0, 2.0]), (100, [-1.0] * 6), (None, [1.0] * 6)]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<double>")).withColumn("embedding", F.col("embedding").cast("array<float>"))
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, k=7, shard=64, block=3, levels=4)
    sound = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0 and q != 100:
            scored = sorted((-int(v @ w), i) for i, w in sound if i != q and len(w) == len(v))[:7]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    got = [r for r in rows(out, "query_id", "rank", "vec_id", "score") if r[0] != 100]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert len(rows(topk.top_k(df.where("vec_id < 4"), F.col("vec_id") == 0), "query_id")) == 3


# Near duplicates


def naive_classes(data):
    import re

    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    sets = []
    for doc, text in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(data):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and a is not None and data[j][0] is not None and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                x, y = sorted((find(a), find(data[j][0])))
                root[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(data, sets)), key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    docs = documents(spark)
    if block == 4:
        plain = jaccard.links_between
        monkeypatch.setattr(jaccard, "links_between", lambda o, p: plain(o, p, block))
        monkeypatch.setattr(jaccard, "_GROUP_TOKENS", 2000)
    out = rows(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert sorted(out, key=str) == naive_classes(rows(docs, "doc_id", "text"))


def test_rows_that_share_an_id_tie_their_texts_together(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    data = [(9, text("a")), (3, text("b")), (9, text("b")), (5, text("a")), (7, text("c")), (7, text("c"))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = rows(jaccard.near_duplicates(df), "doc_id", "component_id")
    assert sorted(out) == [(3, 3), (5, 3), (7, 7), (7, 7), (9, 3), (9, 3)]
    assert sorted(rows(jaccard.representatives(df), "doc_id")) == [(3,), (7,)]


def test_no_near_duplicates_in_an_empty_table(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    assert jaccard.near_duplicates(documents(spark).where("doc_id = 3")).collect()[0].component_id == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7), (300, 299), (299, 298), (298, 300)]
    out = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long")), "node", "component"))
    assert out == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 298: 298, 299: 298, 300: 298}
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_packed_numbers():
    for dtype in (np.uint8, np.uint32, np.int64, np.uint64):
        x = np.sort(np.random.default_rng(0).integers(0, 200, 1000)).astype(dtype)
        assert (packed.unpack(packed.pack(x), dtype) == x).all()
    assert len(packed.unpack(packed.pack(np.zeros(0, np.int64)), np.int64)) == 0
    big = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 99)).astype(np.uint64)
    assert (packed.unpack_sorted(packed.pack_sorted(big)) == big).all()


# Suffix dedup


def naive_removal(data, length):
    """data: (doc_id, text) by id; returns {doc_id: (bytes, removed, spans, digest)}."""
    seen, out = set(), {}
    for doc, text in data:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            else:
                seen.add(b[i : i + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,most", [(100, 50_000), (100, 3), (33, 50_000)])
def test_repeats_against_brute_force(spark, length, most):
    docs = documents(spark)
    out = rows(suffixdedup.digests(docs, length=length, most_contexts=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    data = sorted({r for r in rows(docs, "doc_id", "text") if r[0] is not None})
    want = naive_removal(data, length)
    assert len(out) == docs.count()
    for doc, *found in out:
        if doc is None:
            assert found[1:3] == [0, 0]
        else:
            assert tuple(found) == want[doc], doc


def test_repeats_over_many_slices(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5, F.hash("text"))
    out = rows(suffixdedup.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = naive_removal(sorted(rows(docs, "doc_id", "text")), 100)
    assert {d: tuple(x) for d, *x in out} == want
    texts = {r.doc_id: r.text for r in suffixdedup.cleaned_documents(clashing(docs)).collect()}
    assert sum(len(t.encode()) for t in texts.values()) == pytest.approx(sum(n - r for n, r, _, _ in want.values()), abs=300)


def test_repeats_of_an_empty_table(spark):
    assert suffixdedup.digests(empty(spark)).count() == 0
    assert suffixdedup.cleaned_documents(empty(spark)).columns == empty(spark).columns


def test_longest_previous_factors_on_random_strings():
    rng = np.random.default_rng(8)
    length, reach = 12, 6
    text = rng.integers(97, 99, 600).astype(np.uint8)
    at = np.arange(reach, 580)
    framed = np.concatenate((text, np.zeros(40, np.uint8)))
    contexts = framed[(at - reach)[:, None] + np.arange(reach + length)]
    grams = np.array([hash(text[a : a + 6].tobytes()) & 0xFFFFFFFF for a in at], np.uint64)
    hit = suffixdedup.repeated_strings(contexts, grams, at, np.minimum(at, reach), np.minimum(600 - at, length), length)
    s = text.tobytes()
    for i, a in enumerate(at.tolist()):
        for o in range(reach + 1):
            if a + length - o <= 600:
                assert hit[i, o] == any(s[b - o : b - o + length] == s[a - o : a - o + length] for b in range(reach, a)), (a, o)


def test_nearest_smaller():
    x = np.random.default_rng(1).integers(0, 30, 500)
    want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(500)]
    assert suffixdedup.nearest_smaller(x).tolist() == want


# Pages

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><script>var t="</p>";</script>
<h1>Title &amp; more</h1><p>One<br>two <b>bold</b>
text<p>Next<ul><li>a<li>b<ul><li>c</ul></ul><!-- gone --><div hidden>never</div><div style="display: none">nor</div>
<table><tr><th>Name<th>Count<tr><td>apple<td>3</table><ol start=3><li>x<li>y</ol><pre>
  keep   this
</pre>end"""

TEXT = """Title & more

One
two bold text

Next

- a
- b
  - c

Name   Count
apple  3

3. x
4. y

  keep   this

end"""


def test_layout():
    assert htmltext.html_to_text(PAGE) == TEXT


@pytest.mark.parametrize("page", ["<", "<p", "</", "<a href='", "<table><td>x</table>", "<li>x", "&#xZZ; &bogus; &amp", "<script>", "<!--", "</p></div>", "<div>" * 5000 + "deep", "a<b>c</i>d</b>e", "<table><table><tr><td>x", "\0<p\0>x"])
def test_broken_markup_is_read(page):
    assert isinstance(htmltext.html_to_text(page), str)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> holds", "so x=2 holds"),
        ("<math><semantics><mi>y</mi><annotation-xml><ci>z</ci></annotation-xml></semantics></math>", "y"),
        ("a<svg><title>t</title><desc>d</desc><defs><text>never</text></defs><g><text>North</text><text x=1>So<tspan>uth</tspan></text></g><path d='M0'/></svg>b", "a\nNorth\nSouth\nb"),
        ("<p>pick<select><option>red<option selected>blue</select>now", "pick\nred\nblue\nnow"),
        ("<select><optgroup label='Warm'><option>red</option></optgroup><optgroup label=Cold><option>blue</select>", "Warm\nred\nCold\nblue"),
        ("<object data=x.swf>instead <b>of it</b></object> end", "instead of it end"),
        ("<audio src=a>no audio</audio><video><p>no video</p></video>x<noscript>no script</noscript><datalist><option>o</datalist>", "x"),
        ("<svg><text hidden>no</text><text>yes</text></svg>", "yes"),
    ],
)
def test_text_that_browsers_show(page, text):
    assert htmltext.html_to_text(page) == text


def test_deep_text_is_kept():
    assert htmltext.html_to_text("<div>" * 5000 + "deep") == "deep"


def test_every_visible_word_of_a_page_is_kept(spark, sf):
    import re

    for html, text in rows(htmltext.extract(spark.read.parquet(f"{sf}/pages.parquet")), "html", "text"):
        import html as entities

        body = re.sub(r"(?s)<!--.*?-->|<head.*?</head>|<script.*?</script>|<style.*?</style>", "", html)
        assert entities.unescape(re.sub(r"<[^>]*>", " ", body)).split() == text.replace("\n- ", "\n").removeprefix("- ").split()


def test_pages_edges(spark):
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000)], "page_id long, html string"))
    assert sorted(rows(htmltext.extract(df), "page_id", "text")) == [(1, ""), (2, ""), (3, "x" * 200_000)]
    assert htmltext.extract(df.limit(0)).count() == 0


# Pipeline


def test_pipeline_stages(spark, sf):
    docs = documents(spark, extra=False).unionByName(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000))
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, docs, sf), "test")
        assert out.columns == docs.columns
        kept[name] = out
        before = defaultdict(int)
        for r in rows(docs, "doc_id"):
            before[r] += 1
        assert all(before[r] for r in rows(out, "doc_id"))
        docs = out
    classes = naive_classes(rows(kept["language identification"], "doc_id", "text"))
    assert sorted(r[0] for r in rows(kept["near duplicates"], "doc_id") if r[0] is not None) == sorted({c for d, n, c in classes if d == c and d is not None})
    data = sorted(rows(kept["near duplicates"].where("doc_id is not null"), "doc_id", "text"))
    want = naive_removal(data, 100)
    for doc, text, n_chars in rows(kept["suffix-array dedup"].where("doc_id is not null"), "doc_id", "text", "n_chars"):
        assert len(text.encode()) <= want[doc][0] - want[doc][1] and len(text) == n_chars
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.agg(F.count_distinct("doc_id")).first()[0] == docs.where("doc_id is not null").count()


def test_pipeline_of_an_empty_table(spark):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, ""), "none")
    assert docs.count() == 0
