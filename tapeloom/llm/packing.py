"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised whole. Full windows are cut off long documents; what remains is cut into pieces
of at most ``piece`` tokens (small ones, so that few windows come out too large). Pieces are gathered, within
a task, into groups of ``windows`` windows less a small slack, and each group is split by multiway differencing: partial partitions are merged, largest
against smallest, by descending imbalance, which gives near-equal windows. If a window exceeds the
capacity, the window count of the group rises by one and the group is split anew.

Nothing is shuffled: a task's memory is one slice of texts and one group. Sequence ids are the task's
number and a count, so a task that is run again gives the same ids for the same rows.

Defined cases: a null or empty text is its end token alone; repeated rows are packed once each; an empty
table gives no rows; other columns are ignored, whatever their names; a text longer than a slice is tokenised alone.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeloom.llm.batches import give_back, offsets, ranges, slices, strings
from tapeloom.llm.words import LOWER, encoded, joined

_CACHE_UNITS, _SLICE = 350_000, 2 << 20
_SIGN = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def differencing(sizes: list[int], m: int) -> list[tuple[int, list[int]]]:
    """Split sizes into m sets; returns (sum, indexes) of the sets that are not empty, largest sum first."""
    if m <= 1:
        return [(sum(sizes), list(range(len(sizes))))]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        overlap = max(0, len(a) + len(b) - m)
        cut = len(a) - overlap
        merged = a[:cut] + b[: len(b) - overlap]
        for i in range(overlap):
            x, y = a[cut + i], b[len(b) - 1 - i]
            merged.append((x[0] + y[0], x[1] + y[1]))
        merged.sort(key=lambda part: -part[0])
        imbalance = merged[0][0] - (merged[-1][0] if len(merged) == m else 0)
        heapq.heappush(heap, (-imbalance, made, merged))
        made += 1
    return heap[0][2]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes per window, no window over the capacity."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, m)
        if parts[0][0] <= capacity:
            return [sorted(members) for _, members in parts]
        m += 1


class WordTokens:
    """Token ids of texts by a tokenizer that drops white space: each distinct unit is encoded once and kept while it is in use.

    A unit stands between spaces or line ends; an ASCII sign after a letter below U+0100 begins a unit (the
    tokenizer parts them anyway) and such letters are lowered (it lowers all text anyway). Texts with ``<|`` may hold
    special tokens, so they are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        units = [u.decode() for u in new]
        for u in units:
            (plain if _PLAIN(u) else other).append(u)
        parts, lengths = [], []
        for i in range(0, len(plain), 512):
            chunk = plain[i : i + 512]
            ids = self._whole([" ".join(chunk)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(chunk):
                each = self._whole(chunk)
                ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            parts.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        each = self._whole(other)
        parts += each
        lengths.append(np.array([len(e) for e in each], np.int64))
        self.known.update(zip([u.encode() for u in plain + other], range(len(self.known), len(self.known) + len(units))))
        self.ids = np.concatenate([self.ids, *parts])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(lengths))])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])

    def _keep_the_most_used(self) -> None:
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: _CACHE_UNITS // 2])
        units = list(self.known)
        lengths = np.diff(self.at)[kept]
        self.ids = self.ids[ranges(self.at[kept], lengths)]
        self.at, self.uses = offsets(lengths), self.uses[kept] // 2
        self.known = {units[i]: n for n, i in enumerate(kept.tolist())}

    def _known(self, units: list[bytes]) -> np.ndarray:
        """Numbers of the units that are kept, -1 for others."""
        return np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset of every text."""
        raw, at = joined(column)
        lower = LOWER[raw]
        solid = (raw != 0x20) & (raw != 0x0A)
        begins = solid.copy()
        letter = (lower >= 97) & (lower <= 122)
        # U+00C0 to U+00FF, two bytes each: letters but for the signs of multiplication and division.
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        value = raw[second]
        letter[second] = (value != 0x97) & (value != 0xB7)
        lower[second] += np.where((value < 0x9F) & (value != 0x97), np.uint8(0x20), np.uint8(0))
        begins[1:] &= ~solid[:-1] | (_SIGN[raw[1:]] & letter[:-1])
        starts = at[:-1][at[:-1] < at[1:]]
        begins[starts] = solid[starts]
        place = np.flatnonzero(begins)
        before = np.cumsum(solid, dtype=np.uint32 if len(raw) < 1 << 32 else np.int64)[place].astype(np.int64)
        kept = lower[solid]
        codes, distinct = encoded(kept, np.append(before - 1, len(kept)))
        units = distinct.to_pylist()
        own = self._known(units)
        new = np.flatnonzero(own < 0)
        if len(self.known) + len(new) > _CACHE_UNITS:
            self._keep_the_most_used()
            own = self._known(units)
            new = np.flatnonzero(own < 0)
        if len(new):
            learnt = [units[i] for i in new.tolist()]
            self._learn(learnt)
            own[new] = self._known(learnt)
        self.uses[own] += 1
        wanted = own[codes]
        lengths = np.diff(self.at)[wanted]
        ids = self.ids[ranges(self.at[wanted], lengths)]
        per_text = np.diff(offsets(lengths)[np.searchsorted(place, at)])
        special = np.asarray(pc.match_substring(strings(column), "<|"))
        if special.any():
            texts = strings(column)
            pieces = np.split(ids, np.cumsum(per_text)[:-1])
            for i in np.flatnonzero(special):
                pieces[i] = self._whole([texts[int(i)].as_py()])[0]
            ids, per_text = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return ids, offsets(per_text)


def cut(lengths: np.ndarray, held: int, capacity: int, piece: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, group) of the pieces of documents of ``lengths`` tokens.

    Full windows come first and have group -1. What is left of the documents is one stream, cut at the documents' ends, every
    ``piece`` tokens of a document, and wherever a group of ``room`` tokens is full; ``held`` tokens are in group 0 already.
    """
    full = lengths // capacity
    document = np.repeat(np.arange(len(lengths)), full)
    start = (ranges(np.zeros(len(full), np.int64), full)) * capacity
    rest = lengths - full * capacity
    begins = held + offsets(rest)  # in the stream
    pieces = -(-rest // piece)
    inner = np.repeat(begins[:-1], pieces) + ranges(np.zeros(len(pieces), np.int64), pieces) * piece
    cuts = np.unique(np.concatenate((inner, np.arange(room, begins[-1], room))))
    cuts = cuts[cuts >= held]
    ends = np.append(cuts[1:], begins[-1])[: len(cuts)]
    owner = np.searchsorted(begins, cuts, side="right") - 1
    return (
        np.concatenate((document, owner)),
        np.concatenate((start, full[owner] * capacity + cuts - begins[owner])),
        np.concatenate((np.full(len(start), capacity), ends - cuts)),
        np.concatenate((np.full(len(start), -1), cuts // room)),
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
    piece: int = 256,
    windows: int = 64,
    slack: int = 12,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    room = windows * (capacity - slack)

    def run(batches):
        words = WordTokens(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        waiting: pa.Table | None = None  # pieces of the open group
        numbers = pa.schema([arrow.field(i) for i in range(5)] + ([arrow.field("ids")] if with_ids else []))

        def placed(pieces: pa.Table, sets: list[list[int]]) -> pa.RecordBatch:
            """Pieces in the windows that ``sets`` of their indexes name."""
            nonlocal sequence
            sizes = np.array([len(s) for s in sets])
            order = np.concatenate([np.asarray(s, np.int64) for s in sets])
            out = pieces.take(pa.array(order)).combine_chunks()
            ends = offsets(np.asarray(out.column("length")))[:-1]
            first = np.repeat(ends[offsets(sizes)[:-1]], sizes)
            columns = [out.column(n).combine_chunks() for n in numbers.names[:5]]
            columns += [pa.array(np.repeat(sequence + np.arange(len(sets)), sizes)), pa.array(ends - first)]
            columns += [out.column("ids").combine_chunks()] if with_ids else []
            sequence += len(sets)
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

        def close(pieces: pa.Table) -> pa.RecordBatch:
            return placed(pieces, balanced(np.asarray(pieces.column("length")).tolist(), capacity))

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                ids, at = words.encode(part.column("text"))
                flat = np.insert(ids, at[1:], end_id).astype("<u4", copy=False)
                at = at + np.arange(len(at))
                del ids
                held = sum(waiting.column("length").to_pylist()) if waiting is not None else 0
                doc, start, length, group = cut(np.diff(at), held, capacity, piece, room)
                begin = at[doc] + start
                view = memoryview(flat).cast("B")
                sums = [zlib.crc32(view[i:j]) for i, j in zip((4 * begin).tolist(), (4 * (begin + length)).tolist())]
                found = [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.diff(at)[doc])]
                if with_ids:
                    values = pa.array(flat[ranges(begin, length)].astype(np.int64))
                    found.append(pa.ListArray.from_arrays(pa.array(offsets(length).astype(np.int32)), values))
                pieces = pa.Table.from_arrays(found, schema=numbers)
                whole = int((group < 0).sum())
                if whole:
                    yield placed(pieces.slice(0, whole), [[i] for i in range(whole)])
                last = (held + int(length[whole:].sum())) // room  # the group that stays open
                for g in range(last + 1):
                    i, j = whole + np.searchsorted(group[whole:], [g, g + 1])
                    mine = pieces.slice(i, j - i)
                    waiting = mine if waiting is None else pa.concat_tables([waiting, mine])
                    if g < last:
                        yield close(waiting)
                        waiting = None
            give_back()
        if waiting is not None and len(waiting):
            yield close(waiting)
        del words
        give_back()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
