"""Counts of word grams over all texts, and their way back to the texts.

Texts are cut into slices of a few megabytes, staged as codes of the slice's distinct words. A slice sends the
64-bit hashes of its distinct grams, sorted and packed, with their weights: one row per (kind of gram, hash range).
The task of a range adds the weights of equal hashes up and answers every slice in the order it asked. A gram
that a third of all texts hold is one entry per slice, and a range holds a bounded number of entries: the
number of ranges grows with the tokens of the input.

Slices are staged bucketed by their number, so that answers travel to slices and slices never travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.batches import give_back, offsets, slices
from tapeloom.llm.packed import bucket_cuts, pack, pack_sorted, unpack, unpack_sorted
from tapeloom.llm.words import Words, hashes, joined
from tapeloom.plans.stage import stage, stage_bucketed

SLICE = 4 << 20
RANGE_ENTRIES = 1_000_000


def _schemas(spec: str) -> tuple[str, pa.Schema]:
    """A DDL schema and the same for Arrow."""
    pairs = [c.split(":") for c in spec.split()]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "strings": pa.list_(pa.string()), "longs": pa.list_(pa.int64()), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    ddl = {"strings": "array<string>", "longs": "array<long>"}
    return ", ".join(f"{n} {ddl.get(k, k)}" for n, k in pairs), pa.schema([(n, kinds[k]) for n, k in pairs])


SLICES = _schemas("slice:long ids:binary has_id:binary tag:binary tags:strings tag_words:longs counts:binary codes:binary hashes:binary lengths:binary letters:binary tokens:long")
SENT = _schemas("kind:int bucket:int slice:long keys:binary weights:binary")
BACK = _schemas("kind:int slice:long bucket:int totals:binary owned:binary distinct:long")


def table(columns: dict | list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    if isinstance(columns, list):
        columns = dict(zip(schema.names, zip(*columns) if columns else [()] * len(schema)))
    return pa.RecordBatch.from_arrays([pa.array(list(columns[n]), t) for n, t in zip(schema.names, schema.types)], schema=schema)


@dataclass
class Slice:
    number: int
    ids: np.ndarray
    has_id: np.ndarray
    tag: np.ndarray  # per unit (a text, or a piece of one), an index into tags
    tags: list[str]
    counts: np.ndarray  # words per unit
    codes: np.ndarray  # of every word
    hashes: np.ndarray  # of the distinct words
    distinct: pa.LargeBinaryArray | None  # the distinct words, where they are wanted

    def row(self) -> tuple:
        lengths = letters = None
        if self.distinct is not None:
            lengths = pack(np.asarray(pc.binary_length(self.distinct)).astype(np.uint32))
            letters = zstandard.ZstdCompressor(level=1).compress(b"".join(self.distinct.to_pylist()))
        of_tag = np.bincount(self.tag, self.counts, len(self.tags)).astype(np.int64)
        return (
            self.number, pack(self.ids), pack(self.has_id), pack(self.tag.astype(np.uint32)), self.tags, of_tag.tolist(), pack(self.counts.astype(np.uint32)),
            pack(self.codes.astype(np.uint32)), self.hashes.tobytes(), lengths, letters, len(self.codes),
        )

    @classmethod
    def of(cls, row: dict) -> Slice:
        distinct = None
        if row["letters"] is not None:
            at = offsets(unpack(row["lengths"], np.uint32))
            letters = zstandard.ZstdDecompressor().decompress(row["letters"])
            distinct = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)])
        signed = {n: unpack(row[n], np.uint32).astype(np.int64) for n in ("tag", "counts", "codes")}
        return cls(row["slice"], unpack(row["ids"], np.int64), unpack(row["has_id"], np.bool_), signed["tag"], row["tags"], signed["counts"], signed["codes"], np.frombuffer(row["hashes"], np.uint64), distinct)

    def tag_hashes(self) -> np.ndarray:
        """Seeded apart from the words' hashes, since a tag may be spelled like a word."""
        return np.array([xxhash.xxh3_64_intdigest(t, seed=1) for t in self.tags], np.uint64)


Cut = Callable[[np.ndarray, np.ndarray], tuple[Words, np.ndarray]]


def sliced(docs: DataFrame, cut: Cut, limit: int = SLICE, spelled: bool = True) -> DataFrame:
    """Stage the rows of ``docs`` (doc_id long, text string, tag string) as slices.

    ``cut`` finds the words of joined texts: Words whose counts are per unit, and the text of every unit. A text
    longer than ``limit`` bytes is a slice of its own. Words are kept as hashes, and ``spelled`` out if wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", limit):
                w, text = cut(*joined(part.column("text")))
                ids = part.column("doc_id")
                tag = part.column("tag").dictionary_encode()
                coded = np.asarray(tag.indices).astype(np.int64)
                found = Slice(number, np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), coded[text], tag.dictionary.to_pylist(), w.counts, w.codes, hashes(w.distinct), w.distinct if spelled else None)
                yield table([found.row()], SLICES[1])
                number += 1
            give_back()

    return stage_bucketed(docs.mapInArrow(run, SLICES[0]), "slices", "slice")


def ranges_for(tokens: int, spark, entries: int = RANGE_ENTRIES) -> int:
    """Hash ranges for grams of so many tokens: a range holds at most about ``entries`` of them, however large the input."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // entries))


def asked(kind: int, number: int, keys: np.ndarray, weights: np.ndarray, buckets: int) -> list[tuple]:
    """Rows to send for sorted distinct keys; a key may have several weights (one row of ``weights`` each)."""
    cuts = bucket_cuts(keys, buckets, 64)
    weights = np.atleast_2d(weights).astype(np.int64)
    return [(kind, b, number, pack_sorted(keys[i:j]), pack(weights[:, i:j].ravel())) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]


Settle = Callable[[int, np.ndarray], np.ndarray]


def at_least(least: int) -> Settle:
    """Answer with the totals, 0 for smaller ones."""
    return lambda kind, sums: np.where(sums[0] >= least, sums[0], 0)


def added_up(sent: DataFrame, settle: Settle, name: str, owners: bool = False) -> DataFrame:
    """Answers for all that was asked, in the order of each sender's keys.

    ``settle`` makes one number of a kind's keys from the totals of their weights (a row per weight). With ``owners`` the
    first slice that sent a key learns that it owns it. ``distinct`` counts a range's keys with a positive first total.
    """

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["slice"])
        kind, keys = rows[0]["kind"], [unpack_sorted(r["keys"]) for r in rows]
        at = offsets(np.array([len(k) for k in keys]))
        every = np.concatenate(keys)
        weights = np.concatenate([unpack(r["weights"], np.int64).reshape(-1, len(k)) for r, k in zip(rows, keys)], axis=1)
        del keys
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        sums = np.add.reduceat(weights[:, order], first, axis=1)
        distinct = int((sums[0] > 0).sum())
        answers = np.empty(len(every), np.int64)
        answers[order] = np.repeat(settle(kind, sums), np.diff(np.append(first, len(every))))
        owned = np.zeros(len(every), bool)
        owned[order[first]] = True
        out = [
            (kind, r["slice"], r["bucket"], pack(answers[i:j]), np.packbits(owned[i:j]).tobytes() if owners else None, 0 if n else distinct)
            for n, (r, i, j) in enumerate(zip(rows, at, at[1:]))
        ]
        result = pa.Table.from_batches([table(out, BACK[1])])
        del every, weights, order, answers, sums
        give_back()
        return result

    return stage(sent.groupBy("kind", "bucket").applyInArrow(merge, BACK[0]), name)


class Answers:
    """What came back to one slice."""

    def __init__(self, rows: pa.Table):
        own: dict[int, list[dict]] = {}
        for r in rows.to_pylist():
            own.setdefault(r["kind"], []).append(r)
        self._totals, self._owned = {}, {}
        for kind, parts in own.items():
            parts.sort(key=lambda r: r["bucket"])
            totals = [unpack(r["totals"], np.int64) for r in parts]
            self._totals[kind] = np.concatenate(totals)
            if parts[0]["owned"] is not None:
                bits = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=len(t)) for r, t in zip(parts, totals)]
                self._owned[kind] = np.concatenate(bits).astype(bool)

    def totals(self, kind: int) -> np.ndarray:
        return self._totals.get(kind, np.zeros(0, np.int64))

    def owned(self, kind: int) -> np.ndarray:
        return self._owned.get(kind, np.zeros(0, bool))


def per_slice(staged: DataFrame, make: Callable[[Slice], list[tuple]], schema: tuple[str, pa.Schema]) -> DataFrame:
    """Rows made from every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield table(make(Slice.of(row)), schema[1])
                give_back()

    return staged.mapInArrow(run, schema[0])


def per_answered_slice(staged: DataFrame, answers: DataFrame, make: Callable[[Slice, Answers], list[tuple]], schema: tuple[str, pa.Schema]) -> DataFrame:
    """Rows made from every slice and what came back to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [r for row in left.to_pylist() for r in make(Slice.of(row), Answers(right))]
        result = pa.Table.from_batches([table(out, schema[1])])
        give_back()
        return result

    return staged.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema[0])


def all_tokens(staged: DataFrame) -> int:
    return staged.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
