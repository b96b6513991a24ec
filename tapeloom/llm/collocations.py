"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are word pairs, edges are word triples: an edge leads from its first pair to its second, and its weight is how often
the triple occurs. Only edges are counted in the texts. What flows out of a pair, plus the pieces that end in it, is the
pair's own count; what flows out of a word (over its pairs), plus the pieces that end in it, is the word's.
Slices of texts build their part of the graph, and edge, pair and word weights of all slices are added up in hash
ranges (``grams``), per language, since the language is part of every hash.

With the totals back, a slice compacts unary paths in place: an edge whose weight equals those of both its pairs
carries all that enters and leaves them, so the pairs occur only together and each occurrence shows the whole
path. The slice that owns a path's first edge writes it as one row; a pair on such an edge lies in a triple of the same count and is
no phrase of its own. What is left are a few wide rows, expanded into candidates by SQL functions.

Scores are exact: products are decimals of 38 digits, enough for counts up to 10^16. The best of a language are chosen among
the best of each of many salts, so no language is sorted in one task. Grams are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words; a null language is ``und``; rows that share an id, or have none, count one
by one; equal texts count each; an empty table gives an empty result; a text longer than a slice is handled alone; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.batches import offsets, ranges
from tapeloom.llm.grams import SENT, Answers, Slice, _schemas, added_up, all_tokens, asked, at_least, per_answered_slice, per_slice, ranges_for, sliced
from tapeloom.llm.words import Words, mixed, windows, words
from tapeloom.plans.stage import stage

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _ENDS.copy()
_BLANK[[0x20, 0x09]] = True

PATHS = _schemas("lang:string words:strings a:long singles:longs head:long tail:long")


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """Lower-cased words, counted per piece that has any, and the text of every such piece."""
    w = words(raw, at, lower=True, blank=_BLANK)
    if not len(w.starts):
        return Words(w.codes, w.distinct, np.zeros(0, np.int64), w.starts), np.zeros(0, np.int64)
    text = w.text
    mark = np.cumsum(_ENDS[raw])[w.starts]
    first = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))))
    return Words(w.codes, w.distinct, np.diff(np.append(first, len(text))), w.starts), text[first]


class Graph:
    """A slice's part of the graph: sorted distinct hashes, weights and a place of every word, pair and triple."""

    def __init__(self, s: Slice):
        with np.errstate(over="ignore"):
            values = mixed(s.hashes[s.codes] + np.repeat(s.tag_hashes()[s.tag], s.counts)) if len(s.codes) else np.zeros(0, np.uint64)
        ends = offsets(s.counts)[1:]
        self.pair_at = self._by_place(values, s.counts, 2)
        self.triples, self.triple_place = windows(values, s.counts, 3)
        self.hash = {1: windows(values, s.counts, 1)[0], 2: self.pair_at}
        self.keys, self.place, self.weights = {}, {}, {}
        self.keys[3], index, self.weights[3] = np.unique(self.triples, return_index=True, return_counts=True)
        self.place[3] = self.triple_place[index]
        flow = self.weights[3]
        for n, longer in ((2, 3), (1, 2)):
            last = ends[s.counts >= n] - n  # where pieces end in this gram
            at = np.concatenate((self.place[longer], last)).astype(np.int64)
            weight = np.concatenate((flow, np.ones(len(last), np.int64)))
            self.keys[n], index, inverse = np.unique(self.hash[n][at], return_index=True, return_inverse=True)
            self.place[n] = at[index]
            flow = self.weights[n] = np.bincount(inverse, weight, len(index)).astype(np.int64)

    @staticmethod
    def _by_place(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        found, first = windows(values, counts, size)
        out[first] = found
        return out

    def totals(self, answers: Answers, n: int, places: np.ndarray) -> np.ndarray:
        """The overall counts of the words or pairs that begin at ``places``."""
        return answers.totals(n)[np.searchsorted(self.keys[n], self.hash[n][places])] if len(places) else np.zeros(0, np.int64)


def _paths(least: int):
    def make(s: Slice, answers: Answers) -> list[tuple]:
        if not len(s.codes):
            return []
        g = Graph(s)
        a3 = answers.totals(3)
        heavy = np.flatnonzero(a3 >= least)
        lone = np.zeros(len(a3), bool)  # edges that carry all of both their pairs
        at = g.place[3][heavy]
        heads, tails = g.totals(answers, 2, at), g.totals(answers, 2, at + 1)
        lone[heavy] = (a3[heavy] == heads) & (a3[heavy] == tails)
        lone_at = np.zeros(len(s.codes) + 1, bool)  # by place of the edge; the last entry stands before the first word
        inverse = np.searchsorted(g.keys[3], g.triples)
        lone_at[g.triple_place] = lone[inverse]
        after = np.flatnonzero(~lone_at)  # the next place without such an edge ends a path
        begun = lone & lone_at[g.place[3] - 1]  # has a predecessor on its path
        mine = np.flatnonzero(answers.owned(3) & (a3 >= least) & ~begun)
        head, tail = g.totals(answers, 2, g.place[3][mine]), g.totals(answers, 2, g.place[3][mine] + 1)
        start = g.place[3][mine]
        stop = np.where(lone[mine], after[np.minimum(np.searchsorted(after, start), len(after) - 1)] + 2, start + 3)
        a2, own2 = answers.totals(2), answers.owned(2)
        pair = np.flatnonzero(own2 & (a2 >= least) & ~lone_at[g.place[2]] & ~lone_at[g.place[2] - 1])
        start = np.concatenate((start, g.place[2][pair]))
        stop = np.concatenate((stop, g.place[2][pair] + 2))
        count = np.concatenate((a3[mine], a2[pair]))
        head, tail = np.concatenate((head, a2[pair])), np.concatenate((tail, a2[pair]))
        tag = s.tag[np.searchsorted(offsets(s.counts), start, side="right") - 1]
        length = stop - start
        at = ranges(start, length)
        cut = offsets(length)
        used, inverse = np.unique(s.codes[at], return_inverse=True)
        spelled = s.distinct.take(pa.array(used)).cast(pa.large_string()).take(pa.array(inverse)).to_pylist()
        singles = g.totals(answers, 1, at).tolist()
        return [
            (s.tags[lang], spelled[i:j], n, singles[i:j], h, t)
            for i, j, n, h, t, lang in zip(cut.tolist(), cut[1:].tolist(), count.tolist(), head.tolist(), tail.tolist(), tag.tolist())
        ]

    return make


def compacted_paths(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(paths, sizes): unary paths, other triples and pairs with at least ``least`` occurrences; and n, all words of a language.

    A path of more than three words has one count a for all its pairs and triples; a triple's own pairs have
    counts head and tail; singles are the counts of the words.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("tag"))
    staged = sliced(source, pieces)
    buckets = ranges_for(all_tokens(staged), docs.sparkSession)

    def send(s: Slice) -> list[tuple]:
        g = Graph(s)
        return [row for n in (1, 2, 3) for row in asked(n, s.number, g.keys[n], g.weights[n], buckets)]

    answers = added_up(per_slice(staged, send, SENT), at_least(least), "graph", owners=True)
    paths = stage(per_answered_slice(staged, answers, _paths(least), PATHS), "paths")
    sizes = staged.select(F.explode(F.arrays_zip("tags", "tag_words")).alias("t")).groupBy(F.col("t.tags").alias("lang")).agg(F.sum("t.tag_words").alias("n"))
    return paths, sizes


def _score(a: Column, l: Column, r: Column) -> Column:
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1_000_000)) * wide(a) * wide(a), wide(l) * wide(r)).cast("long")


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score, cut.

    A phrase inside a longer one that has at least ``share`` percent of its occurrences is left out.
    """
    spark = docs.sparkSession
    paths, sizes = compacted_paths(docs, least, doc_id, text, lang)
    size = F.size("words")
    spelled = lambda i, j: F.array_join(F.slice("words", i, j - i), " ")
    single = lambda i: F.element_at("singles", i)
    at = F.explode(F.sequence(F.lit(1), size - 2)).alias("i")
    longer = paths.where(size > 2).select("*", at)
    i, plain = F.col("i"), F.size("words") == 3
    triples = longer.select(
        "lang", "a",
        spelled(i, i + 3).alias("phrase"), spelled(i, i + 2).alias("first_pair"), spelled(i + 1, i + 3).alias("last_pair"),
        F.array(
            F.struct(F.lit(1).alias("cut"), single(i).alias("l"), F.when(plain, F.col("tail")).otherwise(F.col("a")).alias("r")),
            F.struct(F.lit(2).alias("cut"), F.when(plain, F.col("head")).otherwise(F.col("a")).alias("l"), single(i + 2).alias("r")),
        ).alias("cuts"),
    )
    over = triples.select("lang", F.explode(F.array("first_pair", "last_pair")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    pairs = paths.where(size == 2).select("lang", "a", spelled(F.lit(1), F.lit(3)).alias("phrase"), F.array(F.struct(F.lit(1).alias("cut"), single(1).alias("l"), single(2).alias("r"))).alias("cuts"))
    kept = pairs.join(over, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    found = triples.select("lang", "phrase", "a", "cuts").unionByName(kept.select("lang", "phrase", "a", "cuts"))
    scored = F.transform("cuts", lambda c: F.struct(_score(F.col("a"), c["l"], c["r"]).alias("score"), c["cut"].alias("cut"), c["l"].alias("l"), c["r"].alias("r")))
    found = found.withColumn("best", F.array_min(scored)).select("lang", "phrase", "a", "best.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
