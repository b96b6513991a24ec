"""Near duplicates by Jaccard similarity of word shingles, with adaptive multi-match prefixes.

Texts become sets of 64-bit hashes of five-word shingles. With shingles in one global order, two sets of
similarity 0.75 share at least l shingles among their first ``size - ceil(0.75 size) + l`` ones, for every l.
The join uses this twice:

1. In hash order, with l about an eighth of the size, a text whose prefix shares too few shingles with any
   prefix of the corpus cannot have a partner. Prefixes travel packed, one row per slice of texts and hash
   range; all other texts end here.
2. Copies (equal sets) are put together. The remaining sets are ordered by how many sets hold a
   shingle, rarest first. Each text picks the l with the least estimated cost (the length of the lists its
   prefix meets, and the verifications that l matches leave). The smallest-hashed text of a list is its pivot and is
   compared with the others of the list, in groups salted by size: l shared prefix shingles first, then the
   whole sets. Lists whose other texts are already in one class are done. Texts of lists that are not are
   put into families, and all pairs of a family are compared, block of texts against block of texts. So no
   pair of different classes that shares l prefix shingles stays unseen, and no list is expanded into pairs.

Classes are the connected components of the links. Shingles are compared by 64-bit hashes.

Defined cases: A-Z is lowered, words are separated by space and \\t to \\r; a text with fewer words than a shingle
has its whole word sequence as one; a text without words (or a null one) has no shingles and links with
nothing, not even its like; rows without id link with nothing and get no component; rows that share an id
are one node; further columns are ignored, whatever their names; a very long text is hashed alone; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeloom.llm.batches import give_back, slices, unused
from tapeloom.llm.components import components
from tapeloom.llm.packed import bucket_cuts, compressed_texts, dealt, n_buckets, pack, pack_sorted, plain_text, text_runs, unpack, unpack_sorted
from tapeloom.llm.words import hashes, joined, mixed, windows, words
from tapeloom.plans.stage import stage

NO_ID = -(1 << 63)
_BITS = 48
_GROUP_TOKENS = 4_000_000
_SLICE, _RUN = 4 << 20, 1 << 20
_MOST = 255  # list lengths are told apart up to here


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; texts are read in runs of about a megabyte."""
    out, first = [], 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _RUN, side="right")) - 1)
        out += _sets_of_run(raw[at[first] : at[last]], at[first : last + 1] - at[first], size)
        first = last
    return out


def _sets_of_run(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    w = words(raw, at, lower=True)
    codes = hashes(w.distinct)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    keys, first = windows(codes, w.counts, size)
    ends = np.cumsum(w.counts)
    parts = np.split(keys, np.searchsorted(first, ends[:-1])) if len(ends) else []
    out = []
    for i, part in enumerate(parts):
        n = int(w.counts[i])
        if 0 < n < size:
            own = codes[ends[i] - n : ends[i]]
            out.append(mixed(np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=n)], np.uint64)))
        else:
            out.append(np.unique(part))
    return out


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def least_overlap(n, percent: int):
    """Shared shingles that a partner of a set of n must have."""
    return -(-percent * n // 100)


def _binaries(names: str) -> list[T.StructField]:
    return [T.StructField(c, T.BinaryType()) for c in names.split()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """The result of one group; what the group held goes back to the system."""
    out = pa.Table.from_batches([_batch(rows, schema)], schema)
    give_back()
    return out


def _slice_numbers() -> Iterator[int]:
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1


_SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("slice", T.LongType()), *_binaries("a b c")])
_BACK = T.StructType([T.StructField("slice", T.LongType()), T.StructField("bucket", T.IntegerType()), *_binaries("a b c")])
_DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("alive", T.BooleanType())])


def measured_docs(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, buckets: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, and alive: whether the text can have a partner at all."""
    sent, back, out = to_arrow_schema(_SENT), to_arrow_schema(_BACK), to_arrow_schema(_DOCS)

    def extra(n):
        return 1 + n // 8

    def send(batches):
        numbers = _slice_numbers()
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                number = next(numbers)
                ids = np.asarray(part.column("doc_id").fill_null(NO_ID))
                sets = shingle_sets(*joined(part.column("text")), size)
                n = np.array([len(s) for s in sets], np.int64)
                prefix = np.where(ids == NO_ID, 0, np.minimum(n, n - least_overlap(n, percent) + extra(n)))
                tokens = np.concatenate([s[:p] for s, p in zip(sets, prefix)]) >> np.uint64(64 - _BITS)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), prefix)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                cuts = bucket_cuts(tokens, buckets, _BITS)
                digests = b"".join(_digest(s) for s in sets)
                rows = [(number % buckets, number, pack(ids), pack(n), digests)]
                rows += [(b, number, pack_sorted(tokens[i:j]), pack(owner[i:j]), None) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                yield _batch(rows, sent)
            give_back()

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        done = [(r["slice"], r["bucket"], r["a"], r["b"], r["c"]) for r in rows if r["c"] is not None]
        rows = [r for r in rows if r["c"] is None]
        if rows:
            tokens = [unpack_sorted(r["a"]) for r in rows]
            every = np.sort(np.concatenate(tokens))
            shared = np.unique(every[1:][every[1:] == every[:-1]])
            for r, own in zip(rows, tokens):
                owner = unpack(r["b"], np.uint32)
                hit = np.zeros(len(own), bool)
                if len(shared):
                    hit = shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own
                if hit.any():
                    done.append((r["slice"], r["bucket"], pack(np.bincount(owner[hit]).astype(np.uint32)), None, None))
        return _table(done, back)

    def decide(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = next(r for r in rows if r["c"] is not None)
        ids, n = unpack(base["a"], np.int64), unpack(base["b"], np.int64)
        shared = np.zeros(len(ids), np.int64)
        for r in rows:
            if r["c"] is None:
                counts = unpack(r["a"], np.uint32)
                shared[: len(counts)] += counts
        digests = [base["c"][16 * i : 16 * i + 16] for i in range(len(ids))]
        alive = (n > 0) & (shared >= extra(least_overlap(n, percent)))
        return pa.table([pa.array(ids), pa.array(n), pa.array(digests, pa.binary()), pa.array(alive)], schema=out)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = stage(dealt(source.mapInArrow(send, _SENT), buckets).groupBy("bucket").applyInArrow(count, _BACK), "prefixes")
    return stage(counted.groupBy("slice").applyInArrow(decide, _DOCS), "measured")


_SETS = T.StructType([T.StructField("slice", T.LongType()), *_binaries("digests lengths tokens")])
_ORDERED = T.StructType(
    [*_binaries("digest"), *(T.StructField(c, T.LongType()) for c in ("n", "matches", "prefix")), *_binaries("tokens")]
)


def _choose(ranks: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """The number of matches l and the prefix length with the least estimated cost; ``ranks`` are list lengths in prefix order."""
    base = n - least_overlap(n, percent)
    read = np.cumsum(ranks - 1, dtype=np.int64)
    best = None
    l = 1
    while l <= 1 + n // 8:
        p = min(n, base + l)
        met = int(read[p - 1])
        cost = met + met / l * (1 + n / 16)
        if best is None or cost < best[0]:
            best = (cost, l, p)
        l *= 2
    return best[1], best[2]


def ordered_sets(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str, size: int, percent: int, buckets: int) -> DataFrame:
    """One row per chosen (doc_id, digest): node (a hash of the digest), the set's shingles that other chosen sets share, rarest first, with l and the prefix they allow."""
    sets, sent, back, out = (to_arrow_schema(x) for x in (_SETS, _SENT, _BACK, _ORDERED))

    def collect(batches):
        numbers = _slice_numbers()
        for batch in batches:
            for part in text_runs(batch, rows=300):
                texts = [plain_text(z) for z in part.column("z").to_pylist()]
                at = np.cumsum([0] + [len(t) for t in texts])
                found = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at, size)
                digests = [_digest(s) for s in found]
                # An id may stand for several texts, of which only some represent their class.
                own = [i for i, (a, b) in enumerate(zip(digests, part.column("digest").to_pylist())) if a == b]
                if own:
                    lengths = pack(np.array([len(found[i]) for i in own], np.int64))
                    tokens = np.concatenate([found[i] for i in own]).tobytes()
                    yield _batch([(next(numbers), b"".join(digests[i] for i in own), lengths, tokens)], sets)
            give_back()

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tokens, times = np.unique(np.frombuffer(r["tokens"], np.uint64), return_counts=True)
                cuts = bucket_cuts(tokens, buckets, 64)
                yield _batch(
                    [(b, r["slice"], pack_sorted(tokens[i:j]), pack(times[i:j].astype(np.uint32)), None) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i], sent
                )

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens = [unpack_sorted(r["a"]) for r in rows]
        every, place = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.minimum(np.bincount(place, np.concatenate([unpack(r["b"], np.uint32) for r in rows])), _MOST).astype(np.uint8)
        cuts = np.cumsum([len(t) for t in tokens])[:-1]
        return _table([(r["slice"], r["bucket"], pack(total[p]), None, None) for r, p in zip(rows, np.split(place, cuts))], back)

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = [unpack(r["a"], np.uint8) for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])]
        rows = []
        for r in left.to_pylist():
            lengths, tokens = unpack(r["lengths"], np.int64), np.frombuffer(r["tokens"], np.uint64)
            digests = [r["digests"][16 * i : 16 * i + 16] for i in range(len(lengths))]
            _, place = np.unique(tokens, return_inverse=True)
            ranks = np.concatenate(answers)[place].astype(np.int64)
            ends = np.cumsum(lengths)
            for digest, n, end in zip(digests, lengths.tolist(), ends.tolist()):
                own, rank = tokens[end - n : end], ranks[end - n : end]
                rarest = np.lexsort((own, rank))
                l, p = _choose(rank[rarest], n, percent)
                alone = int((rank == 1).sum())  # those come first and meet nobody
                rows.append((digest, n, l, max(0, p - alone), own[rarest[alone:]].tobytes()))
        return _table(rows, out)

    texts = compressed_texts(docs, doc_id, text)
    # The chosen grow with the table, so they are never broadcast, however few they are.
    wanted = chosen.select(F.col("doc_id").alias("rep"), "digest").hint("merge")
    kept = texts.join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "digest", "z").distinct()
    stored = stage(kept.mapInArrow(collect, _SETS), "sets")
    answers = dealt(stored.select("slice", "tokens").mapInArrow(send, _SENT), buckets).groupBy("bucket").applyInArrow(count, _BACK)
    return stage(stored.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(order, _ORDERED).withColumn("node", F.xxhash64("digest")), "ordered")


_POSTING = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])
_LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def postings(ordered: DataFrame) -> DataFrame:
    """token, node, n for every shingle of a prefix."""
    schema = to_arrow_schema(_POSTING)

    def run(batches):
        for batch in batches:
            prefix, n, node = (np.asarray(batch.column(c)) for c in ("prefix", "n", "node"))
            tokens = [np.frombuffer(t, np.int64)[:p] for t, p in zip(batch.column("tokens").to_pylist(), prefix)]
            counts = [len(t) for t in tokens]
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(node, counts)), pa.array(np.repeat(n, counts))], schema=schema)

    return ordered.mapInArrow(run, _POSTING)


def _overlaps(tokens: list[np.ndarray], mine: np.ndarray, prefix: np.ndarray, own_prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared shingles of each set with ``mine``, in the prefixes and in all."""
    counts = np.array([len(t) for t in tokens], np.int64)
    order = np.argsort(mine)
    flat = np.concatenate(tokens)
    place = np.minimum(np.searchsorted(mine, flat, sorter=order), len(mine) - 1)
    hit = mine[order[place]] == flat
    owner = np.repeat(np.arange(len(tokens)), counts)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    early = hit & (within < prefix[owner]) & (order[place] < own_prefix)
    return np.bincount(owner, early, minlength=len(tokens)), np.bincount(owner, hit, minlength=len(tokens))


def _with_pivot(percent: int):
    schema = to_arrow_schema(_LINK)

    def run(table: pa.Table) -> pa.Table:
        is_pivot = np.asarray(table.column("is_pivot"))
        node, n, l, prefix = (np.asarray(table.column(c)) for c in ("node", "n", "matches", "prefix"))
        tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        links = []
        others = np.flatnonzero(~is_pivot)
        for p in np.flatnonzero(is_pivot):
            if not len(others) or not len(tokens[p]):
                continue
            early, shared = _overlaps([tokens[i] for i in others], tokens[p], prefix[others], prefix[p])
            near = (early >= np.minimum(l[others], l[p])) & (100 * shared >= percent * (n[others] + n[p] - shared))
            links += [(int(node[p]), int(node[i])) for i in others[near]]
        return _table(links, schema)

    return run


def _in_block(percent: int):
    schema = to_arrow_schema(_LINK)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        i, j = key[1].as_py(), key[2].as_py()
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        rows.sort(key=lambda r: r["node"])
        for r in rows:
            root[find(r["node"])] = find(("label", r["label"]))
        left = [k for k, r in enumerate(rows) if r["own"] == i]
        right = [k for k, r in enumerate(rows) if r["own"] == j]
        tokens = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
        n = np.array([r["n"] for r in rows], np.int64)
        links = []
        for a in left:
            me = find(rows[a]["node"])
            others = np.array([b for b in right if (i != j or b > a) and find(rows[b]["node"]) != me], np.int64)
            others = others[(100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a]))] if len(others) else others
            if not len(others) or not len(tokens[a]):
                continue
            _, shared = _overlaps([tokens[b] for b in others], tokens[a], np.zeros(len(others)), 0)
            for b in others[100 * shared >= percent * (n[others] + n[a] - shared)].tolist():
                x, y = find(rows[a]["node"]), find(rows[b]["node"])
                if x != y:
                    root[x] = y
                    links.append((rows[a]["node"], rows[b]["node"]))
        return _table(links, schema)

    return run


def links_between(ordered: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links that connect all classes of the sets in ``ordered``."""
    prio = F.xxhash64("node")
    lists = stage(postings(ordered).withColumn("prio", prio), "postings")
    pivots = lists.groupBy("token").agg(F.min("prio").alias("pivot"), F.count("*").alias("m")).where("m > 1").select(F.col("token").alias("t"), "pivot")
    listed = stage(lists.join(pivots, F.col("token") == F.col("t")).drop("t"), "listed")
    pairs = stage(listed.groupBy("pivot", "node", "n").agg(F.max(F.col("prio") == F.col("pivot")).alias("is_pivot")), "pairs")
    parts = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / _GROUP_TOKENS).cast("int").alias("parts")).withColumnRenamed("pivot", "p")
    salted = pairs.join(parts, F.col("pivot") == F.col("p"))
    salt = F.when(F.col("is_pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.hash("node"), F.col("parts"))))
    asked = salted.select("pivot", "is_pivot", F.col("node").alias("who"), F.explode(salt).alias("salt"))
    fetched = asked.join(ordered, F.col("who") == F.col("node"))
    first = stage(fetched.groupBy("pivot", "salt").applyInArrow(_with_pivot(percent), _LINK), "links")

    # Lists whose remaining texts (all but the pivot) do not carry one label yet.
    hop = first.groupBy(F.col("v").alias("linked")).agg(F.min(F.xxhash64("u")).alias("to"))
    labelled = (
        listed.where("prio <> pivot")
        .join(hop, F.col("node") == F.col("linked"), "left")
        .select("token", "node", F.coalesce("to", "prio").alias("label"))
    )
    labelled = stage(labelled, "labelled")
    open_lists = labelled.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("node").alias("head")).where("a <> b")
    members = stage(labelled.join(open_lists.select(F.col("token").alias("t"), "head"), F.col("token") == F.col("t")).select("head", "node", "label").distinct(), "open")
    family = stage(components(members.select(F.col("head").alias("u"), F.col("node").alias("v"))), "families")
    sizes = family.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")).withColumnRenamed("component", "c")
    labels = members.groupBy(F.col("node").alias("who")).agg(F.min("label").alias("label"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    chunked = family.join(sizes, F.col("component") == F.col("c")).select("component", "node", "chunks", own.alias("own"))
    chunked = chunked.join(labels, F.col("node") == F.col("who")).drop("who")
    spread = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = spread.select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", F.col("node").alias("member")
    )
    blocks = placed.join(ordered.select("node", "n", "tokens"), F.col("member") == F.col("node"))
    second = blocks.groupBy("component", "i", "j").applyInArrow(_in_block(percent), _LINK)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id reachable by links of ``percent`` or more."""
    buckets = n_buckets(docs, text)
    known = measured_docs(docs, doc_id, text, size, percent, buckets)
    classes = stage(known.where("alive").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    ordered = ordered_sets(docs, classes.select(F.col("rep").alias("doc_id"), "digest"), doc_id, text, size, percent, buckets)
    of_node = classes.select(F.xxhash64("digest").alias("node"), "rep")
    found = links_between(ordered, percent)
    for end in ("u", "v"):
        found = found.join(of_node.withColumnRenamed("rep", f"{end}_rep"), F.col(end) == F.col("node")).drop("node")
    found = found.select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v"))
    # Rows that share an id but not a text are one node: they tie their classes together.
    members = known.where("alive").select("doc_id", "digest").join(classes.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    joined_ = stage(components(found.unionByName(copies)), "components")
    out = known.join(joined_, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id") != NO_ID, F.coalesce("component", "doc_id"))
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row of each class: that of the smallest id (of rows that share it, the one whose text has the smallest hash).

    Rows without id stay, and so do those without words. Other columns stay.
    """
    found = near_duplicates(docs, doc_id, text, size, percent)
    rep, nth = unused("rep", docs.columns), unused("nth", docs.columns)
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias(rep)).distinct()
    kept = docs.join(chosen, F.col(doc_id) == F.col(rep), "left_semi")
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    one = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return one.unionByName(docs.where(F.col(doc_id).isNull())).select(docs.columns)
