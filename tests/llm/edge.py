"""Small tables with the cases that every operator defines, and plain versions of the operators."""

import random

CLASH = "n long, node long, tag long, token string, host string, path string, rule string, kept string, z string, digest string, bucket int, rank int, _rejected int, _bad_host string, _i long, _t long, _tag long, _kept string, _nth int, _found string, "
CLASH += "rejected string, rejected_host string, lost_id long, lost_tag long, kept_text string, text_tag long, rep long, nth int, found string"


def documents(spark, extra=True):
    """Nulls, empty and long texts, ties, exact and near copies, a passage that many documents share, odd columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(words(60))
    base = words(300)
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "word", "en", "a"), (4, "word", "en", "b"), (5, "Word  ", None, "b")]
    rows += [(None, "no id here " * 30, "en", None), (None, None, None, None)]
    rows += [(10, "x" * 5000, "de", "a"), (11, "x" * 333, "de", "a"), (12, "ab" * 700, "de", "a"), (13, "ñandú — 日本語 \U0001f600 <|endoftext|> <s> ▁▁ a", "es", "c")]
    rows += [(20 + i, " ".join(base), "en", "hot") for i in range(5)] + [(20, " ".join(base), "en", "hot")]
    for i in range(30):
        near = list(base)
        for _ in range(i // 3):
            near[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((40 + i, " ".join(near), "en", "hot"))
    for i in range(30):
        own = words(20 + 3 * i)
        at = rng.randrange(len(own))
        rows.append((100 + i, " ".join(own[:at] + [passage] + own[at:]), "fr" if i % 2 else "en", "c"))
    rows.append((200, " ".join(words(20_000)), "en", "c"))
    rows.append((201, "line one\nline one\n\n\nline two\nline one\r\n", "en", "c"))
    rows.append((-7, " ".join(base[:250]), "en", "c"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], schema)
    return clashing(df) if extra else df


def clashing(df):
    from pyspark.sql import functions as F

    for c in CLASH.split(", "):
        name, kind = c.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind) if kind != "string" else F.lit("odd"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
