"""Operators on single texts: packing, language identification, pieces, host rules, url rules."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import hostrules, langid, packing, pieces, urlfilter
from tests.llm.edge import clashing, documents, empty, rows

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("capacity,piece,windows", [(4096, 1024, 64), (64, 16, 4), (64, 64, 2)])
def test_pieces_of_packing_hold_every_token_once(spark, capacity, piece, windows):
    docs = documents(spark)
    out = packing.pack(docs, WORDS, capacity=capacity, piece=piece, windows=windows, slack=2, with_ids=True).collect()
    library = Tokenizer.from_file(WORDS)
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.select("doc_id", "text").collect())
    by_doc = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
    # Rows of one id are told apart only by their tokens, so ids with one row are checked piece by piece.
    for (doc, ids), times in want.items():
        if sum(n for (d, _), n in want.items() if d == doc) == 1:
            own = sorted(by_doc[doc], key=lambda r: r.start)
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
            assert tuple(i for r in own for i in r.ids) == ids and {r.doc_tokens for r in own} == {len(ids)}
    assert sum(r.length for r in out) == sum(len(i) * n for (_, i), n in want.items())
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert sum(r.length for r in own) <= capacity


def test_units_of_accented_words_are_shared():
    words, library = packing.WordTokens(WORDS), Tokenizer.from_file(WORDS)
    texts = ["été, Été. ÉTÉ", "été; l'été-ÇA", "×été ÷été Été×,", "T\u00dfÿ*** ÿ$$$ Ê\u0301."]
    ids, at = words.encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {u.decode() for u in words.known} >= {"été", ",", ".", ";", "'été", "-ça", "***", "$$$"} and not {"été,", "Été.", "ÉTÉ"} & {u.decode() for u in words.known}


def test_packing_is_dense_and_takes_empty_tables(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of it "), (F.col("id") % 97).cast("int")).alias("text")).coalesce(1)
    total, sequences = packing.pack(docs, WORDS).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert total / (4096 * sequences) > 0.96
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_few_groups_need_another_window():
    lengths = np.random.default_rng(1).lognormal(5.5, 1.2, 20_000).astype(np.int64) + 1
    document, start, length, group = packing.cut(lengths, 0, 4096, 256, 64 * (4096 - 12))
    assert np.array_equal(np.bincount(document, length, len(lengths)), lengths) and length.max() <= 4096
    whole = range(group.max())
    sizes = [len(packing.balanced(length[group == g].tolist(), 4096)) for g in whole]
    assert len(sizes) > 20 and sum(n > 64 for n in sizes) <= 0.1 * len(sizes)


@given(st.lists(st.integers(1, 9000), max_size=40), st.integers(0, 999))
@settings(max_examples=80, deadline=None)
def test_cut_keeps_every_token_once(lengths, held):
    n = np.array(lengths, np.int64)
    document, start, length, group = packing.cut(n, held, 512, 100, 1000)
    for i, total in enumerate(lengths):
        own = sorted(zip(start[document == i].tolist(), length[document == i].tolist()))
        assert [s for s, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) == total
    rest = group >= 0
    filled = np.bincount(group[rest], length[rest]) if rest.any() else np.zeros(1)
    assert (filled + np.eye(len(filled))[0] * held)[:-1].tolist() == [1000] * (len(filled) - 1)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_differencing_splits_everything_within_capacity(sizes):
    parts = packing.balanced(sizes, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 100 for p in parts)


def test_differencing_known_partition():
    assert [s for s, _ in packing.differencing([8, 7, 6, 5, 4], 2)] == [16, 14]
    assert sorted(s for s, _ in packing.differencing([5, 5, 4, 4, 3, 3], 3)) == [8, 8, 8]


def test_piece_ids_equal_the_library(spark):
    docs = documents(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in pieces.encode(docs, PIECES).select("text", "ids", "decoded").collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert pieces.encode(empty(spark), PIECES).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab \n▁.,é", max_size=60), st.just(""), st.text("a", min_size=50, max_size=300)), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_piece_ids_of_any_text(model, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at = model[0].encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model[1].encode(t) for t in texts]


def test_single_merges_give_the_same(model):
    own, library = model
    for text in ("▁antidisestablishment", "▁aaaaaaa", "▁Donaudampfschiff"):
        assert own._one_by_one(own.of_char[[ord(c) for c in text]].tolist()) == library.encode(text[1:])


def naive_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated))


def test_measures(spark, sf):
    for docs in (documents(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        for r in hostrules.measure(docs).select("text", *hostrules.MEASURES).collect():
            assert tuple(r)[1:] == naive_measures(r.text)
    assert hostrules.judge(empty(spark)).count() == 0


def test_a_bad_host_goes_and_clean_ones_stay(spark):
    fine = "all of these words differ from each other and from those in any other sentence number"
    rows_ = [(i, f"{fine} {i}", f"good{i % 7}") for i in range(70)]
    rows_ += [(100 + i, "bad" if i < 18 else f"{fine} {i}", "awful") for i in range(20)]
    rows_ += [(200, "bad", "small"), (201, f"{fine} 201", "small"), (300, f"{fine} 300", None), (301, None, None)]
    out = {r.doc_id: r.kept for r in hostrules.judge(clashing(spark.createDataFrame(rows_, "doc_id long, text string, source string"))).collect()}
    assert all(out[i] for i in range(70)) and not any(out[100 + i] for i in range(20))
    assert out[201] and not out[200]  # one bad document does not condemn a small host
    assert out[300] and not out[301]


def test_beta_prior():
    a, b = hostrules.beta_prior(0.2, 0.04, 10 * 0.01, 10)
    assert a / (a + b) == pytest.approx(0.2) and a + b == pytest.approx(0.16 / (0.04 - 0.16 * 0.01) - 1)
    assert sum(hostrules.beta_prior(0.2, 0.0, 1.0, 10)) == pytest.approx(1e4)
    assert hostrules.beta_prior(None, None, None, 0) == (1.0, 1.0)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", langid.held_out())
    fitted = langid.fit(docs.where("not held_out"), per_language=60)
    out = langid.predict(docs, fitted).where("held_out").select("lang", "lang_pred", "score", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert np.mean([r.rejected for r in out]) < 0.02 and all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark, sf):
    fitted = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), per_language=60)
    out = langid.predict(documents(spark), fitted)
    assert out.count() == documents(spark).count()
    for text, lang, score, rejected in rows(out, "text", "lang_pred", "score", "rejected"):
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score, rejected) == ("und", 0.0, True)
        else:
            assert lang in {"de", "en", "es", "fr"}
    assert langid.predict(empty(spark), fitted).count() == 0
    untaught = langid.fit(documents(spark).where("lang = 'none'"))
    assert {r.lang_pred for r in langid.predict(documents(spark), untaught).collect()} == {"und"}
    strange = spark.createDataFrame([(1, "日本語の文章"), (2, "русский текст и ещё слова")], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(strange, fitted).collect())


UNLEARNED = [
    "La mattina del giorno dopo il vecchio pescatore si alzò presto e preparò la barca per uscire in mare, mentre il sole cominciava appena a illuminare le case.",
    "De volgende ochtend stond de oude visser vroeg op en maakte zijn boot klaar om de zee op te gaan, terwijl de zon net begon te schijnen over de huizen.",
    "Następnego ranka stary rybak wstał wcześnie i przygotował łódź do wypłynięcia w morze, podczas gdy słońce dopiero zaczynało oświetlać domy we wsi.",
    "Seuraavana aamuna vanha kalastaja nousi aikaisin ja valmisteli veneensä lähteäkseen merelle, kun aurinko vasta alkoi valaista kylän taloja.",
]


def test_unlearned_languages_and_letters_at_random_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(0)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (30, 100, 400, 2000) for _ in range(5)]
    # A row of two letters per language must not loosen the limits.
    odd = docs.select("lang").distinct().select(F.lit(-1).cast("long").alias("doc_id"), F.lit("qx").alias("text"), "lang")
    fitted = langid.fit(docs.select("doc_id", "text", "lang").unionByName(odd), per_language=1000)
    strange = spark.createDataFrame(list(enumerate(UNLEARNED + noise)), "doc_id long, text string")
    assert [r.text for r in langid.predict(strange, fitted).where("not rejected").collect()] == []
    # Short clean excerpts of held-out documents stay.
    clean = docs.where(langid.held_out() & (F.length("text") > 600)).select("doc_id", "lang", F.explode(F.array(*[F.substring_index("text", " ", n) for n in (3, 6, 12, 30)])).alias("text"))
    fitted = langid.fit(docs.where(~langid.held_out()), per_language=1000)
    out = langid.predict(clean, fitted).select("rejected").collect()
    assert len(out) > 100 and np.mean([r.rejected for r in out]) < 0.04


def test_odd_rows_make_no_centroid():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(200, 40))) + 3 * (np.arange(40) < 20)
    x[:3] = np.eye(40)[[20, 25, 30]]
    members = langid.spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    assert sum(map(len, members)) == 200 and min(map(len, members)) >= 10
    assert [len(m) for m in langid.spherical_kmeans(np.eye(3)[:1], 4)] == [1]


URLS = [
    ("https://a.example.net/en/1", "example.net/en/", "allow"),
    ("https://example.net/en", "net/", "block"),
    ("http://EXAMPLE.Net/en/?x", "example.net/en/", "allow"),
    ("http://notexample.net/en/", "net/", "block"),
    ("http://m.example.com/de/x#y", "example.com/de/", "block"),
    ("http://m.example.com/fr/", None, "allow"),
    ("http://x.org/fr/1", "org/fr/", "allow"),
    ("http://net", None, "allow"),
    ("no scheme", None, "allow"),
    (None, None, "allow"),
    ("", None, "allow"),
]


def test_url_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    df = clashing(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "page_id long, url string"))
    out = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert out == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(URLS)}
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(df, rules, max_rules=3)


@given(
    st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(["a", "b.a", "c.b.a", "a.b"]), st.sampled_from(["", "/", "/x", "/x/", "/x/y", "/y"])), max_size=8),
    st.sampled_from(["a", "b.a", "c.b.a", "d.c.b.a", "xa", "a.b", ""]),
    st.sampled_from(["", "/", "/x", "/xx", "/x/", "/x/y", "/x/yy/z", "/y/x"]),
)
@settings(max_examples=300, deadline=None)
def test_trie_finds_the_longest_rule(rules, host, path):
    fitting = [(h.count("."), len(p), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    want = max(fitting)[3:] if fitting else None
    assert urlfilter.RuleTrie(rules).find(host, path) == want


def test_language_sample_is_bounded_when_ids_and_texts_repeat(spark):
    """A third of the rows without id, a third with one id, and many copies of one text."""
    rows_ = [(None, f"haus und hof {i}x {'abcdefgh'[i % 8]}{i}", "de") for i in range(1500)]
    rows_ += [(7, f"the house is {i}y {'stuvwxyz'[i % 8]}{i}", "en") for i in range(1500)]
    rows_ += [(i, "la maison est grande", "fr") for i in range(900)] + [(1, "la maison", "fr")] * 900
    model = langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string").repartition(5), per_language=50)
    assert set(model.languages) == {"de", "en", "fr"} and len(model.centroids) <= 12
    asked = spark.createDataFrame([(1, "das haus und der hof"), (2, "the house is"), (3, "la maison")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(asked, model).orderBy("doc_id").collect()] == ["de", "en", "fr"]
    from tapeloom.plans import stage

    samples = [p for paths in stage._staged.values() for p in paths if "langid-sample" in p]
    drawn = {r["lang"]: r["count"] for r in spark.read.parquet(samples[-1]).groupBy("lang").count().collect()}
    assert drawn["de"] == drawn["en"] == drawn["fr"] == 50
