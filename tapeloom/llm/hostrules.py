"""Quality rules with host-level verdicts.

Each document is measured (words, symbols, repeated lines and word windows) and tested by document rules.
Failures are counted per host; every rule's failure rate is shrunk towards the mean of all hosts with a
beta prior whose two parameters are fitted to the hosts' rates by moments, so a host with two bad
documents is not condemned while one with thousands is. A host whose shrunk rate exceeds ``host_limit``
for any rule is rejected, and with it all its documents.

Counting per host is a map-side combined hash aggregate; the join back carries one narrow row per host.
Word windows within a document are compared by 64-bit hashes.

Defined cases: a null text has no words; a null host is a host of its own; repeated rows count as
separate documents; columns with the names of results are replaced, all others stay, whatever their names; a very
long text is measured alone; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.batches import add_columns, offsets, unused
from tapeloom.llm.words import SPACE, encoded, joined, totals, windows, words
from tapeloom.plans.stage import stage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    newline = raw == 10
    n_lines = totals(newline, at) + 1
    line_at = offsets(n_lines)
    starts = np.zeros(line_at[-1], np.int64)
    starts[line_at[:-1]] = at[:-1]
    inner = np.ones(len(starts), bool)
    inner[line_at[:-1]] = False
    starts[inner] = np.flatnonzero(newline) + 1
    kept = offsets(~newline)
    with_word = totals(~SPACE[raw], np.append(starts, len(raw))) > 0
    codes, _ = encoded(raw[~newline], np.append(kept[starts], kept[-1]))
    text = np.repeat(np.arange(len(n_lines)), n_lines)[with_word]
    distinct = np.unique(text * (codes.max(initial=0) + 1) + codes[with_word]) // (codes.max(initial=0) + 1)
    return np.bincount(text, minlength=len(n_lines)) - np.bincount(distinct, minlength=len(n_lines))


def _repeated_windows(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    text = np.repeat(np.arange(len(counts)), counts)
    keys, first = windows(codes.astype(np.uint64), counts, size)
    if len(keys) == 0:
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        keys = keys ^ (text[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + size, -1)
    return np.bincount(text, np.cumsum(edge[:-1]) > 0, minlength=len(counts)).astype(np.int64)


def measure(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Add the five counts of ``MEASURES`` for every whole text."""

    def make():
        def counts(part):
            raw, at = joined(part.column(text))
            w = words(raw, at)
            solid = ~SPACE[raw] & ((raw & 0xC0) != 0x80)
            found = (w.counts, totals(solid, at), totals(_SYMBOL[raw], at), _repeated_lines(raw, at), _repeated_windows(w.codes, w.counts, window))
            return [pa.array(x, pa.int64()) for x in found]

        return counts

    return add_columns(docs, text, T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]), make)


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def document_rules() -> dict[str, Column]:
    """Rules counted per host: too short or repetitive, full of symbols, mostly repeated lines."""
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": F.col("n_dup_lines") * 20 > F.col("n_words"),
    }


def host_verdicts(measured: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """One row per host: n, failures and shrunk rate of each rule, rejected."""
    rules = document_rules()
    # A sum over a row subset is null when nothing was added, so every rule counts 0 or 1.
    counted = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(f"{r}_fails") for r, c in rules.items()]
    )
    hosts = stage(counted, "hosts")
    moments = hosts.agg(
        F.count("*").alias("k"),
        F.sum(1.0 / F.col("n")).alias("inverse"),
        *[m.alias(f"{r}_{s}") for r in rules for s, m in (("mean", F.avg(F.col(f"{r}_fails") / F.col("n"))), ("var", F.var_pop(F.col(f"{r}_fails") / F.col("n"))))],
    ).first()
    out, bad = hosts, F.lit(False)
    for r in rules:
        a, b = beta_prior(moments[f"{r}_mean"], moments[f"{r}_var"], moments["inverse"], moments["k"])
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_fails") + a) / (F.col("n") + a + b))
        bad = bad | (F.col(f"{r}_rate") > host_limit)
    return out.withColumn("rejected", bad)


def beta_prior(mean: float | None, variance: float | None, inverse: float | None, k: int) -> tuple[float, float]:
    """Parameters by moments; the variance that sampling alone would give is taken off first.

    Hosts that all fail (or all pass) leave the mean at a border, where any strength gives the same
    rates; rates that vary no more than sampling allows give a strong prior (10 000 documents).
    """
    if not k:
        return 1.0, 1.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    spread = mean * (1 - mean)
    between = variance - spread * inverse / k
    strength = min(max(spread / between - 1, 1.0), 1e4) if between > 0 else 1e4
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Add the measures, base_failed and kept (neither the document nor its host is rejected).

    Every text is measured once; the measured documents are staged, without their texts unless ``keep_text``.
    """
    kept_columns = docs.columns if keep_text else [c for c in docs.columns if c != text]
    measured = stage(measure(docs, text).select(*[c for c in kept_columns if c not in MEASURES], *MEASURES), "measures")
    bad, name = (unused(c, measured.columns) for c in ("rejected_host", "rejected"))
    rejected = host_verdicts(measured.select(F.col(host).alias("h"), *MEASURES), "h", host_limit).where("rejected")
    rejected = rejected.select(F.col("host").alias(bad), F.lit(True).alias(name))
    both = measured.withColumn("base_failed", base_failed()).join(rejected, F.col(host).eqNullSafe(F.col(bad)), "left")
    return both.withColumn("kept", ~F.col("base_failed") & F.col(name).isNull()).drop(bad, name)
