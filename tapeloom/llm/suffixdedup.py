"""Removal of repeated byte strings by longest-previous-factor arrays over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document with a smaller id,
or earlier in the same one). The strings of a whole corpus fit into no single suffix array, so suffixes
are brought together by content:

1. Among all grams of half that length, a string's smallest-hashed one is its anchor. Equal strings have equal
   anchors at equal places. A task hashes each anchor's gram and its context (every string around the anchor
   lies in it) and sends both, packed, to a hash range. There an anchor whose context occurred
   earlier is settled: its whole context repeats. An anchor whose gram stands in several contexts is
   asked for.
2. The contexts asked for are dealt by gram and sorted into suffix order. For each distance o between a string's
   start and its anchor, the strings are put in the order of the o bytes before the anchor and the
   suffix at it. Previous and next smaller positions in that order are the earlier strings with the longest
   common prefix; where that reaches ``length``, the string is a repeat.
3. A gram with more contexts than ``most_contexts`` is dealt in salted parts. What a part leaves standing meets the
   other parts as (hash of the string, smallest position) rows.
4. The strings' bytes are merged per document and taken out of its text.

Contexts and strings of different parts are compared by 96 and 128 bits of hash, strings within a part by their bytes.

Defined cases: a null text is empty; texts shorter than ``length`` keep everything; rows without id are compared with
nothing; rows that share an id are one document seen several times (a string counts as earlier if it starts
at a smaller offset), and repeated rows get equal results; an empty table gives an empty result; further columns stay
or are ignored, whatever their names; a very long text is handled alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeloom.llm.batches import add_columns, give_back, slices, unused
from tapeloom.llm.jaccard import _batch, _slice_numbers, _table
from tapeloom.llm.packed import bucket_cuts, dealt, n_buckets, pack, pack_all, pack_sorted, plain_text, text_runs, unpack, unpack_all, unpack_sorted
from tapeloom.llm.words import joined, mixed
from tapeloom.plans.stage import stage

_BITS = 48
_SLICE, _CHUNK = 4 << 20, 1 << 19
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes that begin at each offset (8 to 128; the last ones run past the end)."""
    x = raw.astype(np.uint64)
    for s in (1, 2, 4):
        y = x.copy()
        y[:-s] |= x[s:] << np.uint64(8 * s)
        x = y
    with np.errstate(over="ignore"):
        x, size, turn = mixed(x), 8, 0
        while size < k:
            step = min(size, k - size)
            y = x * _FACTORS[3]
            y[:-step] += x[step:] * _FACTORS[turn % 3]
            x, size, turn = mixed(y), size + step, turn + 1
    return x


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of the ``width`` values that begin at each place."""
    size, y = 1, x.copy()
    while size < width:
        step = min(size, width - size)
        z = y.copy()
        z[:-step] = pick(y[:-step], y[step:])
        y, size = z, size + step
    return y


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all anchors, their gram hashes and context hashes."""
    k = (length + 1) // 2
    reach = length - k
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = gram_hashes(raw, k)
    place = np.arange(len(raw))
    sizes = np.diff(at)
    start, end = np.repeat(at[:-1], sizes), np.repeat(at[1:], sizes)
    whole = place + k <= end
    least = sliding(np.where(whole, grams, _TOP), reach + 1, np.minimum)
    least[place + length > end] = 0
    most = sliding(least[::-1], reach + 1, np.maximum)[::-1]
    found = np.flatnonzero((most == grams) & whole & (grams != 0))
    start, end = start[found], end[found]
    inner = (found - reach >= start) & (found + length <= end)
    context = np.zeros(len(found), np.uint64)
    a = found[inner]
    with np.errstate(over="ignore"):
        context[inner] = mixed(mixed(grams[a - reach] * _FACTORS[0] + grams[a]) * _FACTORS[1] + grams[a + reach])
    data = raw.tobytes()
    for i in np.flatnonzero(~inner).tolist():
        a, s, e = int(found[i]), int(start[i]), int(end[i])
        left = max(s, a - reach)
        context[i] = xxhash.xxh3_64_intdigest(data[left : min(e, a + length)], seed=a - left + 1)
    return found, grams[found], context


def _binary(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.BinaryType()) for c in names]


_SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("slice", T.LongType()), *_binary("docs", "local", "grams", "rest")])
_BACK = T.StructType([T.StructField("slice", T.LongType()), *_binary("docs", "local", "settled", "asked")])
_MARKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.LongType()), *_binary("settled", "asked")])
_ASKED = (np.uint32, np.uint32, np.uint32)  # document of the slice, offset, parts


def _tagged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"))


def marks(source: DataFrame, length: int, most_contexts: int, buckets: int) -> DataFrame:
    """Per document: offsets of anchors whose context is a repeat, and of those to be asked for (with the parts of their gram)."""
    sent, back, out = (to_arrow_schema(x) for x in (_SENT, _BACK, _MARKS))

    def send(batches):
        numbers = _slice_numbers()
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                number = next(numbers)
                part = part.take(pa.array(np.argsort(np.asarray(part.column("doc_id")), kind="stable")))
                raw, at = joined(part.column("text"))
                found, first = [], 0
                while first < len(at) - 1:
                    last = max(first + 1, int(np.searchsorted(at, at[first] + _CHUNK, side="right")) - 1)
                    a, g, c = anchors(raw[at[first] : at[last]], at[first : last + 1] - at[first], length)
                    found.append((a + at[first], g, c))
                    first = last
                a, g, c = (np.concatenate(x) for x in zip(*found))
                doc = np.searchsorted(at, a, side="right") - 1
                offset = (a - at[doc]).astype(np.uint32)
                # A context that an earlier place of the slice has is settled here.
                with np.errstate(over="ignore"):
                    both = mixed(g ^ (c * _FACTORS[0]))
                ids = np.asarray(part.column("doc_id"))
                owner = ids[doc]
                # Places stand by document and offset already, unless rows share an id.
                by_both = np.argsort(both, kind="stable") if (np.diff(ids) > 0).all() else np.lexsort((offset, owner, both))
                new = np.ones(len(a), bool)
                new[1:] = both[by_both[1:]] != both[by_both[:-1]]
                head = by_both[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(a) else by_both
                again = np.zeros(len(a), bool)
                again[by_both] = (owner[by_both] != owner[head]) | (offset[by_both] != offset[head])
                local = pack_all([doc[again].astype(np.uint32), offset[again]])
                rows = [(number % buckets, number, pack_all([ids, np.asarray(part.column("tag"))]), local, None, None)]
                keep = np.flatnonzero(~again)
                keep = keep[np.argsort(g[keep], kind="stable")]
                g, c, doc, offset = g[keep] >> np.uint64(64 - _BITS), c[keep] >> np.uint64(64 - _BITS), doc[keep].astype(np.uint32), offset[keep]
                cuts = bucket_cuts(g, buckets, _BITS)
                for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if j > i:
                        rows.append((b, number, pack(ids), None, pack_sorted(g[i:j]), pack_all([c[i:j], doc[i:j], offset[i:j]])))
                yield _batch(rows, sent)
            give_back()

    def match(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        done = [(r["slice"], r["docs"], r["local"], None, None) for r in rows if r["local"] is not None]
        rows = [r for r in rows if r["local"] is None]
        if rows:
            grams = [unpack_sorted(r["grams"]) for r in rows]
            rest = [unpack_all(r["rest"], [np.uint64, np.uint32, np.uint32]) for r in rows]
            cuts = np.cumsum([len(g) for g in grams])[:-1]
            g, c = np.concatenate(grams), np.concatenate([x[0] for x in rest])
            ids = np.concatenate([unpack(r["docs"], np.int64)[x[1]] for r, x in zip(rows, rest)])
            offset = np.concatenate([x[2] for x in rest])
            # Only grams that occur again are looked at.
            _, place, times = np.unique(g, return_inverse=True, return_counts=True)
            several = np.flatnonzero(times[place] > 1)
            order = several[np.lexsort((offset[several], ids[several], c[several], g[several]))]
            new_gram = np.ones(len(order), bool)
            new_gram[1:] = g[order[1:]] != g[order[:-1]]
            new_context = new_gram.copy()
            new_context[1:] |= c[order[1:]] != c[order[:-1]]
            head = np.flatnonzero(new_context)[np.cumsum(new_context) - 1] if len(order) else order
            is_first = (ids[order] == ids[order[head]]) & (offset[order] == offset[order[head]])
            group = np.cumsum(new_gram) - 1
            contexts = np.bincount(group, new_context).astype(np.int64)
            settled, parts = np.zeros(len(g), bool), np.zeros(len(g), np.uint32)
            settled[order] = ~is_first
            parts[order] = np.where(is_first & (contexts[group] > 1), -(-contexts[group] // most_contexts), 0)
            for r, x, s, p in zip(rows, rest, np.split(settled, cuts), np.split(parts, cuts)):
                if s.any() or p.any():
                    asked = p > 0
                    done.append((r["slice"], None, None, pack_all([x[1][s], x[2][s]]), pack_all([x[1][asked], x[2][asked], p[asked]])))
        return _table(done, back)

    def collect(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = next(r for r in rows if r["docs"] is not None)
        ids, tags = unpack_all(base["docs"], [np.int64, np.int64])
        settled = [unpack_all(r[c], [np.uint32, np.uint32]) for r in rows for c in ("local", "settled") if r[c] is not None]
        asked = [unpack_all(r["asked"], list(_ASKED)) for r in rows if r["asked"] is not None] or [[np.zeros(0, np.uint32)] * 3]
        s_doc, s_at = (np.concatenate(x) for x in zip(*settled))
        a_doc, a_at, a_parts = (np.concatenate(x) for x in zip(*asked))
        s_order, a_order = np.argsort(s_doc, kind="stable"), np.argsort(a_doc, kind="stable")
        s_cut = np.searchsorted(s_doc[s_order], np.arange(len(ids) + 1))
        a_cut = np.searchsorted(a_doc[a_order], np.arange(len(ids) + 1))
        done = []
        for i in np.flatnonzero((np.diff(s_cut) > 0) | (np.diff(a_cut) > 0)).tolist():
            s, a = s_order[s_cut[i] : s_cut[i + 1]], a_order[a_cut[i] : a_cut[i + 1]]
            done.append((int(ids[i]), int(tags[i]), pack(np.sort(s_at[s])), pack_all([a_at[a], a_parts[a]]) if len(a) else None))
        return _table(done, out)

    matched = stage(dealt(source.mapInArrow(send, _SENT), buckets, 4).groupBy("bucket").applyInArrow(match, _BACK), "anchors")
    return stage(matched.groupBy("slice").applyInArrow(collect, _MARKS).distinct(), "marks")


_CONTEXTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("salt", T.IntegerType()), *_binary("data", "contexts")])
_FIELDS = (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32)  # gram, doc_id, tag, offset, left, right, parts
_FOUND = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "tag", "low", "high")] + [T.StructField(c, T.LongType()) for c in ("one", "two")]
)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each place, or -1, by pointer jumping."""
    extended = np.append(values, np.iinfo(values.dtype).min)  # index -1 is smaller than all
    found = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(extended[found] >= values)
    while len(open_):
        found[open_] = found[found[open_]]
        open_ = open_[extended[found[open_]] >= values[open_]]
    return found


def _ordered(bytes_: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of rows of bytes within equal grams, and the common prefix of each with the one before it (-1 at a new gram)."""
    n, width = bytes_.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = bytes_
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], grams))
    common = np.full(n, -1, np.int64)
    if n > 1:
        differs = bytes_[order[1:]] != bytes_[order[:-1]]
        common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        common[1:][grams[order[1:]] != grams[order[:-1]]] = -1
    return order, common


def repeated_strings(
    contexts: np.ndarray, grams: np.ndarray, position: np.ndarray, left: np.ndarray, right: np.ndarray, length: int
) -> np.ndarray:
    """Which strings around the anchors have a longest previous factor of ``length``.

    ``contexts`` holds, per anchor, the bytes before it and the ``length`` bytes from it on; ``left`` and ``right``
    say how many of them exist. ``position`` orders the anchors. Result: rows by anchor, columns by the
    distance o from a string's start to the anchor.
    """
    n = len(grams)
    reach = contexts.shape[1] - length
    out = np.zeros((n, reach + 1), bool)
    if n < 2:
        return out
    r_order, r_common = _ordered(contexts[:, reach:], grams)
    l_order, l_common = _ordered(contexts[:, :reach][:, ::-1], grams)
    r_rank = np.empty(n, np.int64)
    r_rank[r_order] = np.arange(n)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        r_class[r_order] = np.cumsum(r_common < length - o)
        l_class[l_order] = np.cumsum(l_common < o)
        there = np.flatnonzero((left >= o) & (right >= length - o))
        there = there[np.argsort(l_class[there] * n + r_rank[there])]
        same = np.zeros(len(there) + 1, bool)
        same[1:-1] = (l_class[there[1:]] == l_class[there[:-1]]) & (r_class[there[1:]] == r_class[there[:-1]])
        in_run = same[:-1] | same[1:]
        run = np.cumsum(~same[:-1])[in_run]
        members = there[in_run]
        if not len(members):
            continue
        p = position[members]
        before = nearest_smaller(p)
        after = len(p) - 1 - nearest_smaller(p[::-1])[::-1]
        run_ = np.append(run, (-1, -1))  # -1 and len(p) stand for no neighbour
        out[members, o] = (run_[before] == run) | (run_[np.minimum(after, len(p))] == run)
    return out


def removed_strings(source_z: DataFrame, marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc_id, tag, low, high: byte ranges that strings found by the suffix orders cover."""
    k = (length + 1) // 2
    reach = length - k
    schema, found = to_arrow_schema(_CONTEXTS), to_arrow_schema(_FOUND)

    def cut_out(batches):
        for batch in batches:
            for part in text_runs(batch):
                rows = part.to_pylist()
                meta = [[] for _ in _FIELDS]
                pieces = []
                for r in rows:
                    text = np.frombuffer(plain_text(r["z"]), np.uint8)
                    offset, parts = unpack_all(r["asked"], [np.uint32, np.uint32])
                    at = offset.astype(np.int64)
                    framed = np.zeros(len(text) + reach + length, np.uint8)
                    framed[reach : reach + len(text)] = text
                    own = framed[at[:, None] + np.arange(reach + length)]
                    pieces.append(own)
                    gram = gram_hashes(np.append(text, np.zeros(8, np.uint8)), k)[at]
                    same = np.ones(len(at), np.int64)
                    values = (gram, same * r["doc_id"], same * r["tag"], offset, np.minimum(at, reach), np.minimum(len(text) - at, length), parts)
                    for m, v, t in zip(meta, values, _FIELDS):
                        m.append(v.astype(t))
                contexts, meta = np.concatenate(pieces), [np.concatenate(m) for m in meta]
                salt = meta[1].astype(np.uint64) % meta[6]
                key = (meta[0] % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((meta[0], salt, key))
                edge = np.flatnonzero(np.diff(key[order]) | (np.diff(salt[order].astype(np.int64)) != 0)) + 1
                for part in np.split(order, edge):
                    own = [m[part] for m in meta]
                    yield _batch([(int(key[part[0]]), int(salt[part[0]]), pack_all(own), pack(np.ascontiguousarray(contexts[part]).reshape(-1)))], schema)
            give_back()

    def search(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        data = [unpack_all(r["data"], list(_FIELDS)) for r in rows]
        gram, doc, tag, offset, left, right, parts = (np.concatenate(x) for x in zip(*data))
        contexts = np.concatenate([unpack(r["contexts"], np.uint8).reshape(-1, reach + length) for r in rows])
        _, position = np.unique(np.rec.fromarrays([doc, offset]), return_inverse=True)
        hit = repeated_strings(contexts, gram, position.astype(np.int64), left.astype(np.int64), right.astype(np.int64), length)
        some = np.flatnonzero(hit.any(axis=1))
        o_low, o_high = hit[some].argmax(axis=1), reach - hit[some][:, ::-1].argmax(axis=1)
        at = offset[some].astype(np.int64)
        # Strings around one anchor overlap, so their union is one range.
        columns = [doc[some], tag[some], at - o_high, at - o_low + length, np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)]
        cells = [columns]
        split = np.flatnonzero(parts > 1)
        if len(split):
            for o in range(reach + 1):
                s = split[~hit[split, o] & (left[split] >= o) & (right[split] >= length - o)]
                keys = [xxhash.xxh3_128_intdigest(c) for c in (contexts[i, reach - o : reach - o + length].tobytes() for i in s)]
                one = np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64).astype(np.int64)
                two = np.array([x >> 64 for x in keys], np.uint64).astype(np.int64) | 1
                low = offset[s].astype(np.int64) - o
                cells.append([doc[s], tag[s], low, low + length, one, two])
        out = pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*cells)], schema=found)
        give_back()
        return out

    asked = marked.where("asked is not null").select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "asked")
    texts = source_z.join(asked, (F.col("doc_id") == F.col("i")) & (F.col("tag") == F.col("t"))).select("doc_id", "tag", "z", "asked")
    spread = dealt(texts.mapInArrow(cut_out, _CONTEXTS), buckets, 4, ("bucket", "salt")).groupBy("bucket", "salt")
    ranges = stage(spread.applyInArrow(search, _FOUND), "strings")
    single = ranges.where("two = 0").select("doc_id", "tag", "low", "high")
    # Strings that the parts of a split gram left standing: all but the first of each go.
    open_ = ranges.where("two <> 0")
    first = open_.groupBy("one", "two").agg(F.min(F.struct("doc_id", "low")).alias("first"), F.count("*").alias("m")).where("m > 1")
    first = first.select(F.col("one").alias("a"), F.col("two").alias("b"), "first")
    later = open_.join(first, (F.col("one") == F.col("a")) & (F.col("two") == F.col("b"))).where(F.struct("doc_id", "low") > F.col("first"))
    return single.unionByName(later.select("doc_id", "tag", "low", "high"))


_KEPT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "tag", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
)


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, not touching ranges."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    return low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]


def lost_ranges(size: int, settled: bytes | None, ranges: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint byte ranges that a text of ``size`` bytes loses, from settled anchors and the ranges of found strings."""
    reach = length - (length + 1) // 2
    anchors = unpack(settled, np.uint32).astype(np.int64) if settled is not None else np.zeros(0, np.int64)
    low, high = np.maximum(anchors - reach, 0), np.minimum(anchors + length, size)
    whole = high - low >= length
    given = np.array([(x["low"], x["high"]) for x in ranges or []], np.int64).reshape(-1, 2)
    low, high = np.concatenate((low[whole], given[:, 0])), np.concatenate((high[whole], given[:, 1]))
    return _merged(low, high) if len(low) else (low, high)


def without(text: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    edges = [0, *np.stack((low, high), axis=1).reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _losses(source_z: DataFrame, marked: DataFrame, length: int, buckets: int) -> DataFrame:
    """i, t (id and hash of the text, one row of each), settled and ranges of documents that may lose something."""
    ranges = removed_strings(source_z, marked, length, buckets)
    per_doc = ranges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    every = marked.select("doc_id", "tag", "settled").join(per_doc, ["doc_id", "tag"], "full")
    return every.select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "settled", "ranges")


def cleaned(source_z: DataFrame, named: DataFrame, length: int) -> DataFrame:
    """Results for the documents that lose something."""
    schema = to_arrow_schema(_KEPT)

    def take_out(batches):
        for batch in batches:
            for part in text_runs(batch):
                rows = []
                for r in part.to_pylist():
                    text = plain_text(r["z"])
                    low, high = lost_ranges(len(text), r["settled"], r["ranges"], length)
                    if len(low):
                        kept = without(text, low, high)
                        rows.append((r["doc_id"], r["tag"], len(text) - len(kept), len(low), hashlib.sha256(kept).hexdigest()))
                yield _batch(rows, schema)
            give_back()

    texts = source_z.join(named, (F.col("doc_id") == F.col("i")) & (F.col("tag") == F.col("t"))).select("doc_id", "tag", "z", "settled", "ranges")
    return texts.mapInArrow(take_out, _KEPT)


def _packed_texts(source: DataFrame) -> DataFrame:
    import zstandard

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.LongType()), *_binary("z")])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                z = [packer.compress(t.encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(z, pa.binary())], names=["doc_id", "tag", "z"])

    return source.mapInArrow(run, schema)


def _found(docs: DataFrame, doc_id: str, text: str, length: int, most_contexts: int) -> tuple[DataFrame, DataFrame]:
    if not 16 <= length <= 256:
        raise ValueError(f"strings of {length} bytes are asked for; 16 to 256 are possible")
    source = _tagged(docs, doc_id, text)
    buckets = n_buckets(docs, text, 4)
    marked = marks(source, length, most_contexts, buckets)
    source_z = _packed_texts(source)
    return source_z, _losses(source_z, marked, length, buckets)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, most_contexts: int = 50_000) -> DataFrame:
    """doc_id, tag (a hash of the text), n_removed, n_spans and kept_sha256 of documents that lose bytes."""
    source_z, named = _found(docs, doc_id, text, length, most_contexts)
    # A repeated row would be joined with every copy of itself: one copy is enough.
    return cleaned(source_z, named, length).dropDuplicates(["doc_id", "tag"])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, most_contexts: int = 50_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    lost = remove_repeats(docs, doc_id, text, length, most_contexts).select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "n_removed", "n_spans", "kept_sha256")
    both = every.join(lost, (F.col("doc_id") == F.col("i")) & (F.col("tag") == F.col("t")), "left")
    return both.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def cleaned_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, most_contexts: int = 50_000) -> DataFrame:
    """The documents with repeated bytes taken out of the text; characters that a removal cuts apart go too. Other columns stay.

    Each row's own text is cut where it stands, so texts travel once, to their ranges.
    """
    _, named = _found(docs, doc_id, text, length, most_contexts)
    i, t, tag, settled, ranges, kept = (unused(c, docs.columns) for c in ("lost_id", "lost_tag", "text_tag", "settled", "ranges", "kept_text"))
    named = named.select(F.col("i").alias(i), F.col("t").alias(t), F.col("settled").alias(settled), F.col("ranges").alias(ranges))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = docs.withColumn(tag, F.xxhash64(body)).join(named, (F.col(doc_id) == F.col(i)) & (F.col(tag) == F.col(t)), "left").drop(i, t, tag)

    def make():
        def one(body: str | None, anchors: bytes | None, found: list[dict] | None) -> str | None:
            if body is None or (anchors is None and found is None):
                return body
            raw = body.encode()
            return without(raw, *lost_ranges(len(raw), anchors, found, length)).decode("utf-8", "ignore")

        return lambda part: [pa.array([one(*r) for r in zip(*(part.column(c).to_pylist() for c in (text, settled, ranges)))], pa.string())]

    out = add_columns(both, text, T.StructType([T.StructField(kept, T.StringType())]), make)
    return out.withColumn(text, F.col(kept)).select(docs.columns)
