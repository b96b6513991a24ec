"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams (one to three letters, lower case, anything else a
word border), weighted by square root of the count and inverse document frequency, and normalised. Each
language has several centroids from spherical k-means; the nearest by cosine gives the language, and a
text is rejected if its cosine is under the language's limit for texts of its length. The limits come from
excerpts of the sample rows, since short texts have small cosines: for each power of two of letters, a low
quantile of the cosines that excerpts have with centroids made without their own row.

The model is fitted on a bounded sample of labelled rows: at most ``per_language`` different rows of each language,
drawn by a hash of id and text over the whole table, however often ids or texts repeat. Prediction reads whole texts and is one scan without
a shuffle; the broadcast model has ``centroids`` vectors per language and at most ``max_languages``
languages.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; equal distances
go to the language first in order; without labelled rows everything is ``und``; result columns replace
columns of the same name, all others stay; rows without id are learned from like others; long texts are read alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.batches import add_columns, strings
from tapeloom.plans.stage import stage

BUCKETS = 4096
CLASSES = 14  # of text lengths: 1, 2-3, 4-7, ... letters, the last without end
_EXCERPTS = 2
_LEAST = 20  # excerpts that a limit of its own takes
_ROWS = 256
_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """Which code points are letters, made once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams per text, and how many letters each text has."""
    lowered = [t.lower() for t in texts]
    at = np.cumsum([0] + [len(t) + 1 for t in lowered])
    points = np.frombuffer("".join(t + " " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    letter = is_letter()[points]
    n_letters = np.bincount(text, letter, minlength=len(texts)).astype(np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first border after a word
    c = np.where(letter, points, 32)[kept].astype(np.uint32)
    text = text[kept]
    out = np.zeros((len(texts), BUCKETS), np.float32)
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint32)
        for n in range(1, 4):
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
            inside = text[: len(h)] == text[n - 1 :]
            bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.int64)
            flat += np.bincount((text[: len(h)] * BUCKETS + bucket)[inside], minlength=len(flat)).astype(np.float32)
    return out, n_letters


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.sqrt(counts) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of every centroid
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray  # of every centroid and length class: cosine below which a text is rejected


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    centroids: int = 4,
    quantile: float = 0.01,
    slack: float = 0.95,
    max_languages: int = 500,
) -> Model:
    """Fit on at most ``per_language`` different rows of every language, drawn by a hash of id and text.

    Centroids are found by one task per language, and only they, document frequencies and limits reach the
    driver. A text is rejected if its cosine is under ``slack`` times the ``quantile`` of the cosines of excerpts as
    long as it, taken from the sample rows of its language.
    """
    spark = labelled.sparkSession
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text, F.lit("langid")).alias("draw"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("count")).orderBy("lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros((0, CLASSES)))
    # Twice the share that is needed, copies counted once; then the first ``per_language`` of them.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_language / max(1, r["count"])))])
    near = usable.where(F.pmod("draw", F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    single = near.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 40)), "draw"))
    sampled = stage(single.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth"), "langid-sample")

    fields = T.StructType([T.StructField("bucket", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def make():
        def sparse(part):
            rows = [ngram_counts([t])[0][0] for t in strings(part.column("text")).to_pylist()]
            where = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            return [pa.array([w.tobytes() for w in where], pa.binary()), pa.array([r[w].tobytes() for r, w in zip(rows, where)], pa.binary())]

        return sparse

    vectors_ = stage(add_columns(sampled, "text", fields, make).select("lang", "draw", "bucket", "times").where(F.length("bucket") > 0), "langid-vectors")
    held = T.StructType([T.StructField("size", T.LongType()), T.StructField("held", T.BinaryType())])

    def frequencies(batches):
        """Documents of a task, and how many of them have each n-gram."""
        size, total = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column("bucket").to_pylist():
                total[np.frombuffer(b, np.uint16)] += 1
                size += 1
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["size", "held"])

    parts = vectors_.mapInArrow(frequencies, held).collect()
    n_rows = sum(r["size"] for r in parts)
    idf = (np.log((1 + n_rows) / (1 + sum((np.frombuffer(r["held"], np.int64) for r in parts), np.zeros(BUCKETS, np.int64)))) + 1).astype(np.float32)

    def clusters(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw")
        found = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (b, t) in enumerate(zip(rows["bucket"], rows["times"])):
            found[i, np.frombuffer(b, np.uint16)] = np.frombuffer(t, np.float32)
        members = spherical_kmeans(vectors(found, idf), centroids)
        return pd.DataFrame({"lang": key[0], "n": range(len(members)), "sums": [m.sum(axis=0).astype(np.float32).tobytes() for m in members]})

    fitted = vectors_.groupBy("lang").applyInPandas(clusters, "lang string, n int, sums binary").orderBy("lang", "n").collect()
    names = [r["lang"] for r in fitted]
    sums = np.array([np.frombuffer(r["sums"], np.float32) for r in fitted], np.float32).reshape(-1, BUCKETS)
    centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return Model(names, idf, centres, length_limits(sampled, names, idf, sums, quantile, slack))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, tries: int = 8) -> list[np.ndarray]:
    """Members of up to ``k`` clusters. Starts are drawn from the half of the rows nearest to the mean of all, and clusters
    of less than a twentieth of the rows are dissolved, so single odd rows make no centroid. Of several tries that with
    most clusters is taken, then the one with the largest cosines."""
    near = x @ x.sum(axis=0)
    typical = np.flatnonzero(near >= np.quantile(near, 0.5))
    least = max(2, len(x) / 20)
    rng = np.random.default_rng(0)
    found = []
    for _ in range(tries):
        centres = x[rng.permutation(typical)[:k]]
        while True:
            for _ in range(rounds):
                own = (x @ centres.T).argmax(axis=1)
                sums = np.array([x[own == j].sum(axis=0) for j in range(len(centres)) if (own == j).any()])
                centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
            cosine = x @ centres.T
            own = cosine.argmax(axis=1)
            sizes = np.bincount(own, minlength=len(centres))
            if len(centres) == 1 or sizes.min() >= least:
                break
            centres = np.delete(centres, sizes.argmin(), axis=0)
        found.append((len(centres), float(cosine.max(axis=1).sum()), own))
    clusters, _, own = max(found, key=lambda f: f[:2])
    return [x[own == j] for j in range(clusters)]


def length_class(n_letters: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n_letters, 1)).astype(int), 0, CLASSES - 1)


def excerpts(text: str) -> list[str]:
    """The text, and runs of its words with 1, 2, 4, ... letters at least, at places that depend on the text alone."""
    words = text.split()
    at = np.cumsum([0] + [sum(map(str.isalpha, w)) for w in words])
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    out = [text]
    for size in (1 << c for c in range(CLASSES)):
        last = int(np.searchsorted(at, at[-1] - size, "right"))  # starts with enough letters after them
        for start in rng.integers(0, last, _EXCERPTS) if last else ():
            out.append(" ".join(words[start : np.searchsorted(at, at[start] + size)]))
    return out


def length_limits(sampled: DataFrame, names: list[str], idf: np.ndarray, sums: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """Limits by centroid and length class. A class of which a language has too few excerpts takes those of all
    languages; limits do not fall as texts get longer."""
    held = sampled.sparkSession.sparkContext.broadcast((np.array(names), idf, sums))
    fields = T.StructType([T.StructField("classes", T.ArrayType(T.IntegerType())), T.StructField("cosines", T.ArrayType(T.FloatType()))])

    def make():
        names, idf, sums = held.value
        norms = np.linalg.norm(sums, axis=1)

        def one(text, language):
            counts, n_letters = ngram_counts(excerpts(text))
            x = vectors(counts, idf)
            cosine = x @ (sums / norms[:, None]).T
            own = np.flatnonzero(names == language)
            if not n_letters[0] or not len(own):
                return [], []
            j = own[cosine[0, own].argmax()]
            rest = sums[j] - x[0]
            norm = np.linalg.norm(rest)
            cosine[:, j] = x @ rest / norm if norm > 1e-3 else -1  # without the row itself
            mine = cosine[:, own].max(axis=1)
            # Only what would be given to this language: mixed-in text of another is not typical of it.
            kept = (mine > 0) & (mine >= cosine.max(axis=1)) & (n_letters > 0)
            return length_class(n_letters[kept]).tolist(), mine[kept].tolist()

        def all_rows(part):
            found = [one(*r) for r in zip(strings(part.column("text")).to_pylist(), strings(part.column("lang")).to_pylist())]
            return [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]

        return all_rows

    each = add_columns(sampled, "text", fields, make).select("lang", F.explode(F.arrays_zip("classes", "cosines")).alias("e"))
    measured = stage(each.select("lang", F.col("e.classes").alias("class"), F.col("e.cosines").cast("double").alias("cosine")), "langid-cosines")
    low = F.percentile("cosine", F.lit(quantile)).alias("low")
    own = {(r["lang"], r["class"]): (r["n"], r["low"]) for r in measured.groupBy("lang", "class").agg(F.count("*").alias("n"), low).collect()}
    pooled = {r["class"]: r["low"] for r in measured.groupBy("class").agg(low).collect()}
    limits = []
    for name in names:
        chosen = [own[name, k][1] if own.get((name, k), (0,))[0] >= _LEAST else pooled.get(k, 0.0) for k in range(CLASSES)]
        limits.append(np.maximum.accumulate([slack * v for v in chosen]))
    return np.array(limits).reshape(-1, CLASSES)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred (``und`` without letters), score (cosine, 0 to 1) and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def make():
        m = held.value

        def one(texts):
            counts, n_letters = ngram_counts(texts)
            if not m.languages:
                return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            cosine = vectors(counts, m.idf) @ m.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64)
            usable = n_letters > 0
            names = [m.languages[j] if u else "und" for j, u in zip(best, usable)]
            return names, np.where(usable, score, 0.0), ~usable | (score < m.limits[best, length_class(n_letters)])

        def all_rows(part):
            texts = strings(part.column(text)).to_pylist()
            found = [one(texts[i : i + _ROWS]) for i in range(0, len(texts), _ROWS)]
            names = [n for f in found for n in f[0]]
            return [pa.array(names), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))]

        return all_rows

    return add_columns(docs, text, fields, make)


def held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the ids, by checksum; rows without id are not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
