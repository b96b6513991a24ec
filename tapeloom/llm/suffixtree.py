"""Scoring texts by a probabilistic suffix tree over words.

A state of the tree is a context, the words just before a token, of 1 to ``depth`` words. What follows it in the
training texts is compared with what follows its suffix (the next shorter state): a context that occurs at least
``least`` times becomes a state if the divergence of the two distributions, summed over its occurrences, is at least
``gain`` nats. Every occurrence is taken out of the counts before it is compared, since words seen once would
otherwise make any rare context look different from its suffix.

Next-token distributions are smoothed. The root adds one to every count, one more token standing for all unknown ones. A state mixes
its counts with the distribution of the next shorter state, as if that one had been seen ``strength`` times; of the
given strengths each state has the one with the largest divergence. So every state's probabilities sum to one over the
known tokens and the unknown one. A token is scored by the state that is the longest suffix of its text up to it;
the text's end is a token.

The tree grows from its root, one exchange of ``grams`` per length. Slices of texts ask for the training counts of
the words and pairs they hold; then for longer grams, only behind contexts frequent enough to be states; and with each
they send their share of the divergence of the contexts one word shorter, as whole numbers (2^-20 nats), so
that no result depends on the order of sums. The words that follow a context are never put together:
they are terms of a sum. So a frequent context is one number per slice, and what is gathered are
the grams of all training texts. Scoring a text needs what came back to its slice, so texts are not joined with the tree.

Grams are told apart by 64-bit hashes.

Defined cases: a null or empty text is its end alone; A-Z is lowered; rows that share an id, or have none, are texts of their own
(rows without id are learned from); repeated texts count each; if nothing is learned from, every token's probability is
that of an unknown one, 1; an empty table gives an empty result; a text longer than a slice is handled alone; columns other than the
id, the text and the training condition are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.batches import offsets
from tapeloom.llm.grams import SENT, Answers, Slice, _schemas, added_up, all_tokens, asked, per_answered_slice, per_slice, ranges_for, sliced
from tapeloom.llm.words import Words, mixed, windows, words

_SLICE = 6 << 20  # larger than the usual slice: fewer pairs are asked for twice
_UNIT = 1 << 20  # parts of a nat
_GAIN = 100  # kinds of grams are 1, 2, ...; kinds of divergences are these and the context's length
SCORES = _schemas("doc_id:long trained:boolean n_tokens:long n_known:long train_tokens:long base_score:double score:double mean_state:double")


def ended(raw: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """Lower-cased words of every text and its end, the empty word."""
    w = words(raw, at, lower=True)
    n = len(w.counts)
    end = len(w.distinct)
    last = np.cumsum(w.counts)
    codes = np.insert(w.codes, last, end) if n else w.codes
    distinct = pa.concat_arrays([w.distinct.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
    return Words(codes, distinct, w.counts + 1, w.starts), np.arange(n)


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """The texts not to learn from; rows without id are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


class Positions:
    """The tokens of a slice, and what is known of them after some of the exchanges."""

    def __init__(self, s: Slice, least: int):
        self.slice, self.least = s, least
        self.values = mixed(s.hashes[s.codes]) if len(s.codes) else np.zeros(0, np.uint64)
        self.learned = np.repeat(np.array([t == "learn" for t in s.tags], bool)[s.tag], s.counts)
        self.before = np.arange(len(s.codes)) - np.repeat(offsets(s.counts)[:-1], s.counts)  # tokens of the same text before this one
        self.hashes: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}

    def gram(self, n: int) -> np.ndarray:
        """Hash of the n tokens that end at each position, 0 where there are fewer."""
        if n not in self.hashes:
            found, first = windows(self.values, self.slice.counts, n)
            out = np.zeros(len(self.values), np.uint64)
            out[first + n - 1] = found
            self.hashes[n] = out
        return self.hashes[n]

    def open(self, k: int) -> np.ndarray:
        """Whether the k tokens before a position occur often enough to be a state; counts of k-grams must be known."""
        often = np.zeros(len(self.values), bool)
        often[1:] = self.counts[k][:-1] >= self.least
        return often & (self.before >= k)

    def wanted(self, n: int) -> np.ndarray:
        """Positions whose n-gram counts matter."""
        if n == 1:
            return np.ones(len(self.values), bool)
        return self.before >= 1 if n == 2 else self.open(n - 1)

    def know(self, answers: Answers, upto: int) -> None:
        for n in range(1, upto + 1):
            at = np.flatnonzero(self.wanted(n))
            keys, inverse = np.unique(self.gram(n)[at], return_inverse=True)
            self.counts[n] = np.zeros(len(self.values), np.int64)
            if len(at):
                self.counts[n][at] = answers.totals(n)[inverse]

    def ask(self, n: int, buckets: int) -> list[tuple]:
        at = np.flatnonzero(self.wanted(n))
        keys, inverse = np.unique(self.gram(n)[at], return_inverse=True)
        return asked(n, self.slice.number, keys, np.bincount(inverse, self.learned[at], len(keys)).astype(np.int64), buckets)

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions behind contexts of k tokens that may be states, the contexts' distinct hashes, and which one each position has."""
        at = np.flatnonzero(self.open(k))
        return at, *np.unique(self.gram(k)[at - 1], return_inverse=True)

    def root(self, without: int, tokens: int, known: int) -> np.ndarray:
        return (self.counts[1] - without + 1) / (tokens - without + known + 1)

    def smoothed(self, k: int, at: np.ndarray, p: np.ndarray, strength, without: int) -> np.ndarray:
        """Probabilities behind contexts of k tokens, from those of the next shorter state; ``without`` takes the token's own occurrence off."""
        return (self.counts[k + 1][at] - without + strength * p[at]) / (self.counts[k][at - 1] - without + strength)

    def deepen(self, answers: Answers, k: int, p: np.ndarray, strengths: tuple[float, ...], without: int) -> np.ndarray:
        """Let the states of k tokens change ``p``; returns the positions they have."""
        at, keys, inverse = self.contexts(k)
        if not len(at):
            return at
        chosen = answers.totals(_GAIN + k)[inverse]  # 0, or the number of a strength from 1
        stays = chosen > 0
        at = at[stays]
        p[at] = self.smoothed(k, at, p, np.array(strengths)[chosen[stays] - 1], without)
        return at

    def ask_gains(self, answers: Answers, k: int, strengths: tuple[float, ...], tokens: int, known: int, buckets: int) -> list[tuple]:
        p = np.where(self.learned, self.root(1, tokens, known), 1.0)
        for shorter in range(1, k):
            self.deepen(answers, shorter, p, strengths, 1)
        at, keys, inverse = self.contexts(k)
        at, context = at[self.learned[at]], inverse[self.learned[at]]
        sums = np.zeros((len(strengths), len(keys)), np.int64)
        for j, strength in enumerate(strengths):
            gained = np.log(self.smoothed(k, at, p, strength, 1)) - np.log(p[at])
            np.add.at(sums[j], context, np.rint(gained * _UNIT).astype(np.int64))
        return asked(_GAIN + k, self.slice.number, keys, sums, buckets)

    def scores(self, answers: Answers, depth: int, strengths: tuple[float, ...], tokens: int, known: int) -> list[tuple]:
        unigram = self.root(0, tokens, known)
        p = unigram.copy()
        state = np.zeros(len(p), np.int64)
        for k in range(1, depth + 1):
            state[self.deepen(answers, k, p, strengths, 0)] = k
        s = self.slice
        text = np.repeat(np.arange(len(s.counts)), s.counts)
        total = lambda x: np.bincount(text, x, len(s.counts))
        n_known = total(self.counts[1] > 0).astype(np.int64).tolist()
        return [
            (i if has else None, s.tags[t] == "learn", n, a, tokens, b, c, d)
            for i, has, t, n, a, b, c, d in zip(
                s.ids.tolist(), s.has_id.tolist(), s.tag.tolist(), s.counts.tolist(), n_known,
                total(np.log10(unigram)).tolist(), total(np.log10(p)).tolist(), (total(state) / s.counts).tolist(),
            )
        ]


def score(
    docs: DataFrame,
    learn: Column,
    depth: int = 2,
    least: int = 4,
    gain: float = 2.0,
    strengths: tuple[float, ...] = (1.0, 8.0, 64.0, 512.0),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per text: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score and mean_state.

    ``score`` is the tree's log10 probability of the text, ``base_score`` the root's alone, ``mean_state`` the mean length of the
    states used. The tree is learned from the rows that ``learn`` holds for.
    """
    spark = docs.sparkSession
    tag = F.when(learn, F.lit("learn")).otherwise(F.lit("score")).alias("tag")
    staged = sliced(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), tag), ended, limit=_SLICE, spelled=False)
    buckets = ranges_for(all_tokens(staged), spark)
    parts = F.explode(F.arrays_zip("tags", "tag_words")).alias("t")
    tokens = staged.select(parts).where(F.col("t.tags") == "learn").agg(F.coalesce(F.sum("t.tag_words"), F.lit(0))).first()[0]

    def first(s: Slice) -> list[tuple]:
        p = Positions(s, least)
        return p.ask(1, buckets) + p.ask(2, buckets)

    def settle(kind: int, sums: np.ndarray) -> np.ndarray:
        """Counts as they are; of divergences, the number of the strength with the largest one if it is large enough."""
        return sums[0] if kind < _GAIN else np.where(sums.max(axis=0) >= round(gain * _UNIT), sums.argmax(axis=0) + 1, 0)

    answers = added_up(per_slice(staged, first, SENT), settle, "grams")
    known = answers.where("kind = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    for k in range(1, depth + 1):

        def grow(s: Slice, back: Answers, k: int = k) -> list[tuple]:
            p = Positions(s, least)
            p.know(back, k + 1)
            return p.ask_gains(back, k, strengths, tokens, known, buckets) + (p.ask(k + 2, buckets) if k < depth else [])

        answers = answers.unionByName(added_up(per_answered_slice(staged, answers, grow, SENT), settle, "grams"))

    def finish(s: Slice, back: Answers) -> list[tuple]:
        p = Positions(s, least)
        p.know(back, depth + 1)
        return p.scores(back, depth, strengths, tokens, known)

    return per_answered_slice(staged, answers, finish, SCORES)
