"""What filters remove in every order of applying them, by Lehmer-rank difference arrays.

A document is known by the set of filters it fails, its mask. Under an order of n filters it is removed at the
first step whose filter lies in the mask. All orders that share a prefix of k filters have neighbouring
lexicographic ranks, an interval of (n - k)! ranks that starts at the prefix's Lehmer rank. So a mask is removed at
step k exactly on the intervals of those prefixes of k filters whose last one, and no earlier one, lies in it.

Documents are counted per (part, mask), and every count is added where such an interval begins and taken
off where it ends. A running sum over the ranks then gives what each order removes at each step, without
applying any order to any document. What follows is arithmetic on these totals: a filter's redundant failures
are all its failures less those it removed, what is kept is the part less all that was removed so far.

Texts are read once, by SQL functions; what leaves that pass is one narrow row per document. Whether an equal
text stands at a smaller id is settled by the least id per SHA-256 of the text, a map-side combined
aggregate; the smallest of a group of copies are then found by an equality join on the id, so a group of copies is never
dealt to one task. The tables after the counting have at most 2^n rows per part.

Defined cases: a null text is empty; a null part is the empty string (and one with the part of that name); rows without id
never fail the copy filter and are nobody's copy; rows that share an id count one by one, are not copies of each
other, and share their labels (a document has a label if any of its label rows has it); a document without
labels is neither good nor toxic; an empty table gives an empty result. Long texts are one array of words in one row. Of the
input's columns only the four named ones are read, so further columns clash with nothing.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.plans.stage import stage

COPY = "E"
COUNTS = ("docs", "good", "toxic")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on one text and its words: short, repetitive, upper case, symbols."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * upper > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, and a boolean column per filter, copies included."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    split = base.withColumn("words", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    tests = text_filters(F.col("text"), F.col("words"))
    narrow = stage(split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(name) for name, c in tests.items()]), "failures")
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    told = narrow.join(firsts, ["doc_id", "digest"], "left")
    return told.select("doc_id", "part", *tests, (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias(COPY))


def lehmer_rank(order: str, names: str) -> int:
    """Lexicographic rank of the first permutation of ``names`` that begins with ``order``."""
    left, rank = list(names), 0
    for i, name in enumerate(order):
        digit = left.index(name)
        rank += digit * factorial(len(names) - 1 - i)
        left.pop(digit)
    return rank


def removal_intervals(names: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) for every run of orders under which the mask is removed at the step.

    The rows follow from the number of filters alone: 840 for five.
    """
    out = []
    for k in range(1, len(names) + 1):
        for prefix in permutations(names, k):
            begin = lehmer_rank("".join(prefix), names)
            earlier = {names.index(f) for f in prefix[:-1]}
            last = names.index(prefix[-1])
            for mask in range(1 << len(names)):
                if mask >> last & 1 and not any(mask >> i & 1 for i in earlier):
                    out.append((mask, k, begin, begin + factorial(len(names) - k)))
    return out


def audit(failed: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``failed`` has doc_id, part and one boolean column per letter of ``names`` (at most seven, since n! orders are listed);
    ``labels`` has doc_id, quality and toxic.
    """
    if len(names) > 7:
        raise ValueError(f"{len(names)} filters have {factorial(len(names))} orders; at most seven filters can be audited")
    spark = failed.sparkSession
    told = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(names)), F.lit(0))
    rows = failed.select("doc_id", "part", mask.alias("mask")).join(told, "doc_id", "left")
    counts = stage(
        rows.groupBy("part", "mask").agg(
            F.count("*").alias("docs"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")]
        ),
        "masks",
    )

    intervals = spark.createDataFrame(removal_intervals(names), "mask int, step int, begins int, ends int")
    ends = F.explode(F.array(F.struct(F.col("begins").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("ends").alias("rank"), F.lit(-1).alias("sign")))).alias("e")
    edges = counts.join(F.broadcast(intervals), "mask").select("part", "step", *COUNTS, ends)
    steps = edges.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(F.col("e.sign") * F.col(c)).alias(c) for c in COUNTS])

    orders = ["".join(p) for p in permutations(names)]
    grid = counts.groupBy("part").agg(F.sum("docs").alias("total"))
    grid = grid.select("part", "total", F.posexplode(F.array(*map(F.lit, orders))).alias("rank", "filter_order"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = grid.join(steps, ["part", "step", "rank"], "left").select(
        "part", "total", "rank", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
        *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in COUNTS],
    )

    letters = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(names)])).alias("f")
    hit = F.col("mask").bitwiseAND(F.col("f.bit")) != 0
    filters = counts.select("part", "mask", "docs", letters).groupBy("part", F.col("f.filter").alias("filter")).agg(
        F.sum(F.when(hit, F.col("docs")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == F.col("f.bit"), F.col("docs")).otherwise(0)).alias("unique_fails"),
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    of_filter = Window.partitionBy("part", "filter")
    return removed.join(filters, ["part", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("docs").over(so_far)).alias("kept"),
        F.col("docs").alias("removed"),
        (F.col("fails") - F.col("docs")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(of_filter).alias("shapley"),
    )
