"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A slice of texts is normalised by the model and cut wherever no vocabulary piece holds the two
neighbouring characters, so no merge can cross a cut. Distinct units are encoded once: all their
characters stand in one flat array of symbols. In each round every unit finds the lowest rank among its
adjacent pairs (segmented minimum), merges all places of that rank from the left, and the arrays are
compacted; units without a pair leave. Should a merge open a pair of lower rank than the round's, the
order of single merges could matter: such a unit is encoded anew one merge at a time.

Characters outside the vocabulary become byte pieces (or the unknown piece). Defined cases: a null or
empty text has no ids and decodes to the empty text; repeated rows, extra columns and empty tables need
nothing special; columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.batches import add_columns, offsets, ranges, strings
from tapeloom.llm.words import encoded, joined

_NONE = np.iinfo(np.int32).max
_SPACE = "▁"


class PieceModel:
    """A BPE model's pair table and the cuts it allows; loaded once per task."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError("models with unused pieces are not supported")
        self.size = size
        piece = {lib.id_to_piece(i): i for i in normal}
        scores = sorted({lib.get_score(i) for i in normal}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        # A symbol is a piece, or size + code point for a character that is no piece.
        symbol = lambda s: piece.get(s, size + ord(s) if len(s) == 1 else -1)
        self.of_char = np.arange(0x110000, dtype=np.int64) + size
        pairs = {}
        inner = set()
        for text, i in piece.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
            inner.update(zip(text, text[1:]))
            for cut in range(1, len(text)):
                a, b = symbol(text[:cut]), symbol(text[cut:])
                if a >= 0 and b >= 0:
                    pairs[a << 32 | b] = (rank[lib.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64).reshape(-1, 2).T
        self.fallback: dict[int, list[int]] = {}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not lib.is_byte(i) for i in self.bytes):
            self.bytes = []
        # Cuts between two ASCII characters, and before a space mark that follows anything else.
        self.cut = np.zeros(1 << 16, bool)
        for a in range(128):
            for b in range(128):
                self.cut[a << 8 | b] = (chr(a), chr(b)) not in inner
        self.cut_at_space = all(a == _SPACE for a, b in inner if b == _SPACE)

    def _look_up(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of the pairs that begin at ``at``."""
        rank, merged = np.full(len(at), _NONE, np.int64), np.zeros(len(at), np.int64)
        inside = np.flatnonzero(at + 1 < len(sym))
        inside = inside[unit[at[inside]] == unit[at[inside] + 1]]
        key = sym[at[inside]] << 32 | sym[at[inside] + 1]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        rank[inside[hit]] = self.ranks[place[hit]]
        merged[inside[hit]] = self.merged[place[hit]]
        return rank, merged

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """A unit's symbols with one merge at a time."""
        while len(sym) > 1:
            a = np.array(sym, np.int64)
            rank, merged = self._look_up(a, np.zeros(len(a), np.int64), np.arange(len(a)))
            i = int(rank.argmin())
            if rank[i] == _NONE:
                break
            sym[i : i + 2] = [int(merged[i])]
        return sym

    def merge(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units in a row, and how many each has."""
        first = self.of_char[points]
        first_at = offsets(lengths)
        sym, unit = first.copy(), np.repeat(np.arange(len(lengths)), lengths)
        rank, merged = self._look_up(sym, unit, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        unsafe = np.zeros(len(lengths), bool)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = least < _NONE
            if not live.all():
                done.append((unit[~live], sym[~live]))
                sym, unit, rank, merged, least = (x[live] for x in (sym, unit, rank, merged, least))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            # In a run of overlapping places every second one is taken, from the left.
            begins = np.concatenate(([True], np.diff(at) != 1))
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = merged[at]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            now = at - np.arange(len(at))
            sym, unit, rank, merged, least = (x[kept] for x in (sym, unit, rank, merged, least))
            touched = np.unique(np.concatenate((now, now[now > 0] - 1)))
            rank[touched], merged[touched] = self._look_up(sym, unit, touched)
            unsafe[unit[touched[rank[touched] < least[touched]]]] = True
        units = np.concatenate([u for u, _ in done]) if done else np.zeros(0, np.int64)
        out = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(units, kind="stable")
        out, counts = out[order], np.bincount(units, minlength=len(lengths))
        if unsafe.any():
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(unsafe):
                parts[i] = np.array(self._one_by_one(first[first_at[i] : first_at[i + 1]].tolist()), np.int64)
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, counts

    def _plain_ids(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: characters outside the vocabulary become byte pieces or the unknown piece."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, counts
        ids = [[self.bytes[b] for b in chr(c - self.size).encode()] if self.bytes else [self.library.unk_id()] for c in sym[odd].tolist()]
        width = np.ones(len(sym), np.int64)
        width[odd] = [len(i) for i in ids]
        out = np.repeat(sym, width)
        out[ranges(offsets(width)[odd], width[odd])] = np.concatenate(ids)
        return out, np.diff(offsets(width)[offsets(counts)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset of every text."""
        texts = [self.library.normalize(t) for t in strings(column).to_pylist()]
        raw, at = joined(pa.array(texts, pa.large_string()))
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        begins = np.zeros(len(raw), bool)
        begins[1:] = self.cut[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        if self.cut_at_space:
            mark = np.zeros(len(raw), bool)
            mark[:-2] = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
            after = np.zeros(len(raw), bool)
            after[3:] = mark[:-3]
            begins |= mark & ~after
        begins[at[:-1][at[:-1] < at[1:]]] = True
        place = np.flatnonzero(begins)
        per_text = np.diff(np.searchsorted(place, at))
        codes, distinct = encoded(raw, np.append(place, len(raw)))
        units = distinct.cast(pa.large_string()).to_pylist()
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sym, counts = self._plain_ids(*self.merge(points, np.fromiter(map(len, units), np.int64, len(units))))
        lengths = counts[codes]
        ids = sym[ranges(offsets(counts)[codes], lengths)]
        return ids, offsets(np.diff(offsets(lengths)[offsets(per_text)]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add ``ids``, the array of piece ids of the whole text, and ``decoded``, the text they stand for."""
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def make():
        m = PieceModel(model)

        def both(part):
            ids, at = m.encode(part.column(text))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            return [lists, pa.array([m.decode(x.tolist()) for x in np.split(ids, at[1:-1])] if len(at) > 1 else [], pa.string())]

        return both

    return add_columns(docs, text, fields, make)


def encode_digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, without moving the ids out of the task."""
    fields = T.StructType(
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def make():
        m = PieceModel(model)
        decimal = [str(i) for i in range(m.size)]

        def digests(part):
            ids, at = m.encode(part.column(text))
            n, a, b = [], [], []
            for i in range(len(at) - 1):
                own = ids[at[i] : at[i + 1]].tolist()
                n.append(len(own))
                a.append(hashlib.sha256(",".join([decimal[x] for x in own]).encode()).hexdigest())
                b.append(hashlib.sha256(m.decode(own).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return digests

    return add_columns(docs, text, fields, make)
