"""Byte-level BPE: ranked merges over the bytes of distinct pieces; decoding joins the tokens' bytes."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pieces that a task remembers; more only means that some are merged again.
REMEMBERED = 1 << 17
#: Longest piece that is remembered, in characters.
REMEMBERED_LENGTH = 256
#: Bytes of text that a round trip takes at once.
SLICE_BYTES = 1 << 21
_LONG, _NONE = 64, 1 << 30


def read_ranks(path: str, most: int = 1 << 18) -> dict[bytes, int]:
    """Token bytes to rank, from a local rank file of the driver; ``most`` bounds what is broadcast later."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if len(ranks) > most:
        raise ValueError(f"{path} has {len(ranks)} ranks; the limit is {most}")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold the merges over the bytes of ``piece``: always the pair of the lowest rank, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > _LONG:
        return _merge_long(piece, ranks)
    get = ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < _NONE:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], _NONE)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As :func:`merge`, with the pairs in a heap, so that a piece of n bytes takes n log n steps."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if i < n else n
        if end[i] < 0 or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], end[j] = stop, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Pieces:
    """Pieces (text) to their ids; what a task has merged, it remembers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}
        split = ((a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None)
        pairs = np.fromiter(chain.from_iterable(split), np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.merged = np.r_[keys[order], np.int64(1) << 62], np.r_[pairs[order, 2], _NONE].astype(np.int32)
        self.first = np.full(1 << 16, _NONE, np.int32)
        for a in range(256):
            for b in range(256):
                self.first[a << 8 | b] = ranks.get(bytes([a, b]), _NONE)
        self.single = np.array([ranks[bytes([x])] for x in range(256)], np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, ``_NONE`` where they do not merge; -1 stands for no token."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], _NONE).astype(np.int32)

    def _fold(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of up to ``width`` bytes, all folded together: one merge of every open piece at a time."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < n[:, None], self.single[raw], -1).astype(np.int32)
        rank = self.first[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        rank[column[1:] >= n[:, None]] = _NONE
        done, open_rows = ids.copy(), np.arange(len(pieces))
        while len(open_rows):
            at = rank.argmin(1)
            least = rank[np.arange(len(at)), at]
            going = least < _NONE
            if not going.all():
                done[open_rows[~going]] = ids[~going]
                open_rows, ids, rank, at, least = open_rows[going], ids[going], rank[going], at[going], least[going]
                if not len(open_rows):
                    break
            rows = np.arange(len(at))
            n[open_rows] -= 1
            later = column > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=later[:, :-1])
            ids[:, -1] = -1
            ids[rows, at] = least
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=later[:, :-2])
            rank[:, -1] = _NONE
            after = np.where(at + 1 < width, ids[rows, np.minimum(at + 1, width - 1)], -1)
            inner = at < width - 1
            rank[rows[inner], at[inner]] = self._pairs(least, after)[inner]
            first = at > 0
            rank[rows[first], at[first] - 1] = self._pairs(ids[rows[first], at[first] - 1], least[first])
        flat, size = done.tobytes(), 4 * width
        return [flat[k * size : k * size + 4 * m] for k, m in enumerate(n.tolist())]

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not known yet."""
        fresh = [x for x in pieces if x not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(pieces)
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for text in fresh:
            data = text.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.known[text] = array("i", [whole]).tobytes()
            elif len(data) <= _LONG:
                by_width.setdefault(-(-len(data) // 4) * 4, []).append((text, data))
            else:
                self.known[text] = array("i", merge(data, self.ranks)).tobytes()
        for width, some in by_width.items():
            for at in range(0, len(some), 10_000):
                part = some[at : at + 10_000]
                self.known.update(zip((x for x, _ in part), self._fold([x for _, x in part], width), strict=True))

    def encode(self, texts: Iterable[str | None], split: Callable[[str], list[str]]) -> Iterator[bytes]:
        """Ids of each text as the bytes of an int32 array; texts are taken in lots of about a million characters."""
        lot, size = [], 0
        for text in texts:
            lot.append(split(text) if text else [])
            size += len(text or "")
            if size >= 1_000_000:
                yield from self._lot(lot)
                lot, size = [], 0
        yield from self._lot(lot)

    def _lot(self, lot: list[list[str]]) -> list[bytes]:
        self.learn(set(chain.from_iterable(lot)))
        get = self.known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in lot]
        if any(len(x) > REMEMBERED_LENGTH for pieces in lot for x in pieces):
            for x in {x for pieces in lot for x in pieces if len(x) > REMEMBERED_LENGTH}:
                del self.known[x]
        return out


@lru_cache(maxsize=2)
def _pieces(ranks: Broadcast) -> Pieces:
    return Pieces(ranks.value)


@lru_cache(maxsize=2)
def _tokens(ranks: Broadcast) -> list[bytes]:
    out = [b""] * (max(ranks.value.values()) + 1)
    for token, rank in ranks.value.items():
        out[rank] = token
    return out


@lru_cache(maxsize=4)
def _split(pattern: str) -> Callable[[str], list[str]]:
    return regex.compile(pattern).findall


class Codec:
    """Encoding and decoding as column expressions; the ranks (a bounded table) are broadcast once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = spark.sparkContext.broadcast(ranks), pattern

    def encode(self, text: Column | str) -> Column:
        """Ids of a text as array<int>: each match of the pattern by itself; null and empty texts have none."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def encoded(column: pa.Array) -> pa.Array:
            return _encoded(ranks, pattern, column)

        return encoded(text)

    def lengths(self, text: Column | str) -> Column:
        """How many ids :meth:`encode` gives."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("long")
        def counted(column: pa.Array) -> pa.Array:
            return pa.array([len(x) // 4 for x in _pieces(ranks).encode(_each(column), _split(pattern))], pa.int64())

        return counted(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that ids stand for; null gives null, an unknown id fails the task."""
        ranks = self.ranks

        @F.arrow_udf("binary")
        def decoded(column: pa.Array) -> pa.Array:
            return _decoded(ranks, column)

        return decoded(ids)

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, ids, decoded)`` per row of ``docs (doc_id, text)``: :meth:`encode` and :meth:`decode` in one pass.

        Each text is encoded once, and a task holds the ids and bytes of a slice of its batch (:data:`SLICE_BYTES`), not of all of it.
        """
        ranks, pattern = self.ranks, self.pattern

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(batch):
                    ids = _encoded(ranks, pattern, part["text"])
                    yield pa.RecordBatch.from_arrays([part["doc_id"], ids, _decoded(ranks, ids)], names=["doc_id", "ids", "decoded"])

        rows = docs.select("doc_id", "text")
        schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
        return rows.mapInArrow(coded, schema)


def _encoded(ranks: Broadcast, pattern: str, column: pa.Array) -> pa.Array:
    parts = list(_pieces(ranks).encode(_each(column), _split(pattern)))
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _decoded(ranks: Broadcast, column: pa.Array) -> pa.Array:
    tokens = _tokens(ranks)
    return pa.array([None if x is None else b"".join(map(tokens.__getitem__, x)) for x in _lists(column)], pa.binary())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where another :data:`SLICE_BYTES` of text are full; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1
    for a, b in pairwise([0, *cuts.tolist(), len(batch)]):
        if a < b:
            yield batch.slice(a, b - a)


def _each(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), 500):
        yield from column.slice(at, 500).to_pylist()


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else None


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs (doc_id, text)``; other columns are ignored.

    Null and empty texts have no ids: both digests are those of the empty string. Repeated rows give repeated rows.
    """
    return codec.round_trip(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
