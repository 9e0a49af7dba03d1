"""Language-model scores by a Katz backoff bigram model with Good-Turing discounts.

Counts are gathered from training texts, kept in tables partitioned by history, and looked up for every token of every text.
``p(w|h) = d_r r / c(h)`` for a pair seen r times, else ``a(h) p(w)``, where ``p(w) = (c(w) + 1) / (N + V + 1)`` backs off to counts of single tokens, the
unknown word included, and ``a(h)`` makes the probabilities after ``h`` add up to exactly one.

Texts travel as chunks of packed numbers: a chunk asks each word bucket for its words' numbers and counts, then sends its distinct pairs, with the
documents they occur in, to pair buckets, which hold all of a history (or a hash share of a very frequent one) and return sums per document.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import texts
from auditlake.llm.stages import stage

#: Counts up to this one get a Good-Turing discount.
TOP = 5
_END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))  # no word holds a space
_BEGIN = 0  # number of the history at a text's start; words are numbered from 1


@dataclass(frozen=True)
class Settings:
    folds: int = 7
    held_out: int = 2
    #: Counts above TOP, and those whose Good-Turing discount is not between the last one and 1, lose this much.
    tail_discount: float = 0.5
    chunk_tokens: int = 1_000_000
    #: Bytes of text per word bucket and per pair bucket; a pair bucket is worked off in parts of so many pairs.
    word_bucket: int = 25_000_000
    pair_bucket: int = 15_000_000
    pair_part: int = 400_000
    #: A history is split over one pair bucket more for each so many occurrences.
    split_history: int = 1 << 19


def pack(numbers: np.ndarray, delta: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; ``delta`` suits ascending ones."""
    numbers = np.ascontiguousarray(numbers, np.int64)
    if delta and len(numbers):
        numbers = np.diff(numbers, prepend=np.int64(0))
    numbers = (numbers << 1) ^ (numbers >> 63)
    raw = numbers.view(np.uint8).reshape(-1, 8)
    width = 8
    while width and not (len(raw) and raw[:, width - 1].any()):
        width -= 1
    planes = raw[:, :width].T.tobytes()
    return struct.pack("<QBB", len(raw), width, delta) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    n, width, delta = struct.unpack_from("<QBB", data)
    raw = np.zeros((n, 8), np.uint8)
    if n * width:
        raw[:, :width] = np.frombuffer(pa.decompress(data[10:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    numbers = raw.reshape(-1).view(np.uint64)
    numbers = ((numbers >> np.uint64(1)).view(np.int64)) ^ -(numbers & np.uint64(1)).view(np.int64)
    return np.cumsum(numbers) if delta else numbers


def _giving_back(step: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``step``, with the memory of its arrays returned to the system after each group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = step(part)
        texts.give_back()
        return out

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; ascends with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


_CHUNKS = "chunk long, bucket int, a binary, b binary, c binary, d binary"


def _chunks(docs: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """Bucket -1: a chunk's tokens as places in its vocabulary, its ids, lengths and training flags; others: words and training counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number = texts.WordKeys(), 0
        part = TaskContext.get().partitionId() << 24
        ids, lists, size = [], [], 0

        def rows() -> pa.RecordBatch:
            learnt = np.array([x is not None and zlib.crc32(str(x).encode()) % s.folds != s.held_out for x in ids])
            order = np.argsort(~learnt, kind="stable")  # training texts first
            n = np.fromiter((len(lists[i]) for i in order), np.int64, len(order))
            words, places = np.unique(np.concatenate([lists[i] for i in order]), return_inverse=True)
            counts = np.bincount(places[: n[: learnt.sum()].sum()], minlength=len(words))
            known = [ids[i] is not None for i in order]
            out = [(part | number, -1, pack(places), pack(np.array([ids[i] or 0 for i in order])), pack(n), pack(np.array([*known, learnt.sum()])))]
            of = _bucket(words, buckets)
            ends = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                lo, hi = ends[b], ends[b + 1]
                out.append((part | number, b, pack(words[lo:hi].view(np.int64), True), pack(counts[lo:hi]), None, None))
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "bucket", "a", "b", "c", "d"])

        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                for doc, text in zip(batch["doc_id"].to_pylist(), texts.utf8(batch["text"]), strict=True):
                    ids.append(doc)
                    lists.append(np.append(keys.of(text), _END))
                    size += len(lists[-1])
                    if size >= s.chunk_tokens:
                        yield rows()
                        number, ids, lists, size = number + 1, [], [], 0
        if ids:
            yield rows()
        keys.clear()
        lists.clear()
        texts.give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _CHUNKS)


def _numbered(words: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket the words' numbers (a) and training counts (b); chunk -1 has the bucket's totals."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        bucket = int(part["bucket"].iloc[0])
        keys = [unpack(x).view(np.uint64) for x in part["a"]]
        met, places = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(places, np.concatenate([unpack(x) for x in part["b"]]), len(met)).astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        out = [(-1, bucket, b"", b"", int(counts.sum()), int((counts > 0).sum()))]
        for chunk, lo, hi in zip(part["chunk"], ends, ends[1:], strict=False):
            own = places[lo:hi]
            out.append((chunk, bucket, pack(own * buckets + bucket + 1, True), pack(counts[own]), 0, 0))
        return pd.DataFrame(out, columns=["chunk", "bucket", "a", "b", "tokens", "distinct"])

    return words.groupBy("bucket").applyInPandas(_giving_back(count), "chunk long, bucket int, a binary, b binary, tokens long, distinct long")


_PAIRS = "chunk long, bucket int, docs int, learnt int, " + ", ".join(f"p{i} binary" for i in range(7))


def _pairs(chunks: DataFrame, numbered: DataFrame, buckets: int, total: int, s: Settings) -> DataFrame:
    """A chunk's distinct pairs with the documents they occur in, by pair bucket; docs = 0: what is known of each document."""

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket")
        head, words = part.iloc[0], part.iloc[1:]
        number, count = (np.concatenate([unpack(x) for x in words[c]]) for c in "ab")
        ids, n, flags = (unpack(head[c]) for c in "bcd")
        places = unpack(head["a"]).astype(np.int32)
        known, learnt, docs, chunk = flags[:-1], int(flags[-1]), len(n), head["chunk"]
        starts = np.cumsum(n) - n
        base = np.add.reduceat(np.log10((count + 1) / total)[places], starts)
        facts = [ids, known, n, np.add.reduceat((count > 0)[places].astype(np.int32), starts), base.view(np.int64)]
        out = [(chunk, int(chunk % buckets), 0, learnt, *[pack(x) for x in facts], b"", b"")]
        del words, part, base, facts
        # words by rank of their numbers, the begin before all; as many histories at a start as texts that end
        by = np.argsort(number)
        ranked, seen = np.r_[_BEGIN, number[by]], np.r_[count[places[n[0] - 1]], count[by]]
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(1, len(by) + 1)
        places = rank[places]
        key = np.roll(places, 1).astype(np.int64)
        key[starts] = 0
        key *= len(ranked)
        key += places
        del places
        order = np.argsort(key, kind="stable")  # documents stay in order
        key, doc = key[order], np.repeat(np.arange(docs, dtype=np.int32), n)[order]
        new = np.r_[True, np.diff(key) != 0]
        post = np.flatnonzero(new | np.r_[True, np.diff(doc) != 0])
        times, doc = np.diff(np.r_[post, len(order)]), doc[post]
        at = np.flatnonzero(new)
        one, two = np.divmod(key[at], len(ranked))
        one, two, c1, c2 = ranked[one], ranked[two], seen[one], seen[two]
        del key, order
        owner = np.cumsum(new[post]) - 1  # a posting's pair
        many = np.bincount(owner, minlength=len(at))
        share = texts.mix(two.view(np.uint64)) % (np.uint64(1) + c1.view(np.uint64) // np.uint64(s.split_history))
        bucket = (texts.mix(texts.mix(one.view(np.uint64)) + share) % np.uint64(buckets)).astype(np.int64)
        order, posts = np.argsort(bucket, kind="stable"), np.argsort(bucket[owner], kind="stable")
        ends, post_ends = (np.searchsorted(x, np.arange(buckets + 1)) for x in (bucket[order], bucket[owner][posts]))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            k, p = order[ends[b] : ends[b + 1]], posts[post_ends[b] : post_ends[b + 1]]
            columns = [pack(one[k], True), pack(two[k], True), pack(c1[k], True), pack(c2[k]), pack(many[k]), pack(doc[p], True), pack(times[p])]
            out.append((chunk, b, docs, learnt, *columns))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _PAIRS.split(", ")])

    both = chunks.where("bucket = -1").unionByName(numbered.where("chunk >= 0").select("chunk", "bucket", "a", "b"), allowMissingColumns=True)
    return both.groupBy("chunk").applyInPandas(_giving_back(pair), _PAIRS)


_FOUND = {
    "kind": "int", "chunk": "long", "doc": "int", "history": "long", "times": "long", "s": "double", **{f"n{i}": "long" for i in range(1, TOP + 2)},
    "big": "double", "low": "double", "doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "base_score": "double",
}
_COUNTS, _SUMS, _HISTORY, _UNSEEN, _FACTS = range(5)


_KINDS = {"int": (np.int32, pa.int32()), "long": (np.int64, pa.int64()), "double": (np.float64, pa.float64()), "boolean": (bool, pa.bool_())}


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    """Rows of a kind; columns that are not given are 0."""
    columns["kind"] = kind
    kinds = [(columns.get(name, 0), *_KINDS[t]) for name, t in _FOUND.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(x, own), n), arrow) for x, own, arrow in kinds], names=list(_FOUND))


@dataclass
class _Lot:
    """A chunk's pairs in a bucket, packed, and the sums of the documents that hold them."""

    chunk: int
    docs: int
    learnt: int
    packed: list[bytes]

    def __post_init__(self) -> None:
        self.size = struct.unpack_from("<Q", self.packed[0])[0]
        self.met = np.unique(unpack(self.packed[5]))
        self.sums = np.zeros((TOP + 1, len(self.met)))  # of logarithms, and how many pairs seen 1 to TOP times

    def part(self, number: int, parts: int) -> tuple[np.ndarray, ...]:
        """Histories, words and their counts of the pairs of a part; owner, document (a place in ``met``) and number of its postings."""
        one, two, c1, c2, many, doc, times = map(unpack, self.packed)
        doc = np.searchsorted(self.met, doc).astype(np.int32)
        owner = np.repeat(np.arange(len(one), dtype=np.int32), many)
        if parts > 1:
            mine = texts.mix(one.view(np.uint64) + np.uint64(1)) % np.uint64(parts) == number
            place, posts = (np.cumsum(mine) - 1).astype(np.int32), mine[owner]
            one, two, c1, c2 = one[mine], two[mine], c1[mine], c2[mine]
            owner, doc, times = place[owner[posts]], doc[posts], times[posts]
        return one, two, c1, c2, owner, doc, times.astype(np.int32)


def _looked_up(lots: list[_Lot], part: int, parts: int, total: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """Counts of counts, histories and unseen pairs of a part; adds to the lots' sums."""
    read = [x.part(part, parts) for x in lots]
    one, two, c1, c2 = (np.concatenate([x[i] for x in read]) for i in range(4))
    ends = np.cumsum([0, *(len(x[0]) for x in read)])
    read = [x[4:] for x in read]
    if not len(one):
        return
    order = np.lexsort((two, one))
    new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]
    pair = np.empty(len(order), np.int32)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    one, c1, c2 = one[first], c1[first], c2[first]
    del order, two, first, new
    r = np.zeros(len(one), np.int64)
    for lot, lo, (owner, doc, times) in zip(lots, ends, read, strict=False):
        learnt = lot.met[doc] < lot.learnt
        r += np.bincount(pair[lo + owner[learnt]], times[learnt], len(r)).astype(np.int64)
    counts = np.bincount(r[r <= TOP + 1], minlength=TOP + 2)
    yield _rows(_COUNTS, 1, **{f"n{i}": counts[i] for i in range(1, TOP + 2)})
    seen, small = r > 0, r <= TOP
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(seen, np.log10(np.where(small, r, r - s.tail_discount)) - np.log10(c1), np.log10((c2 + 1) / total))
    asked = np.zeros(len(one), bool)
    for lot, lo, (owner, doc, times) in zip(lots, ends, read, strict=False):
        owner = pair[lo + owner]
        lot.sums[0] += np.bincount(doc, times * value[owner], len(lot.met))
        for i in range(1, TOP + 1):
            here = r[owner] == i
            lot.sums[i] += np.bincount(doc[here], times[here], len(lot.met))
        here = (r[owner] == 0) & (c1[owner] > 0)
        if here.any():
            asked[owner[here]] = True
            yield _rows(_UNSEEN, here.sum(), chunk=lot.chunk, doc=lot.met[doc[here]], history=one[owner[here]], times=times[here])
    # histories that unseen pairs back off from, or of which this is only a share
    wanted = (np.isin(one, one[asked]) | (c1 >= s.split_history)) & seen
    histories, at = np.unique(one[wanted], return_inverse=True)
    if len(histories):
        rr, n = r[wanted], len(histories)
        masses = {f"n{i}": np.bincount(at[rr == i], minlength=n) for i in range(1, TOP + 1)}
        big = np.bincount(at, np.where(rr > TOP, rr - s.tail_discount, 0.0), n)
        times = np.zeros(n, np.int64)
        times[at] = c1[wanted]
        yield _rows(_HISTORY, n, history=histories, times=times, big=big, low=np.bincount(at, c2[wanted] + 1.0, n), **masses)


def _found(pairs: DataFrame, total: int, s: Settings) -> DataFrame:
    """Counts of counts, sums per document, histories with their seen mass, and occurrences of unseen pairs."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = []
        for batch in batches:
            for row in batch.to_pylist():
                packed = [row[f"p{i}"] for i in range(7)]
                if row["docs"]:
                    lots.append(_Lot(row["chunk"], row["docs"], row["learnt"], packed))
                    continue
                ids, known, n, n_known, base = map(unpack, packed[:5])
                i = np.arange(len(ids))
                yield _rows(
                    _FACTS, len(ids), chunk=row["chunk"], doc=i, doc_id=ids, held_out=i >= row["learnt"], n_tokens=n, n_known=n_known,
                    base_score=base.view(np.float64), times=known,
                )
        parts = sum(x.size for x in lots) // s.pair_part + 1
        for part in range(parts if lots else 0):
            yield from _looked_up(lots, part, parts, total, s)
            texts.give_back()
        for x in lots:
            yield _rows(_SUMS, len(x.met), chunk=x.chunk, doc=x.met, s=x.sums[0], **{f"n{i}": x.sums[i].astype(np.int64) for i in range(1, TOP + 1)})
        lots.clear()
        texts.give_back()

    return pairs.groupBy("bucket").applyInArrow(look_up, ", ".join(f"{k} {v}" for k, v in _FOUND.items()))


def discounts(counts: list[int], tail: float) -> list[float]:
    """Discount factors of counts 1 to TOP from the number of pairs seen 1 to TOP + 1 times (Good-Turing, as Katz has it)."""
    n = [0, *counts]
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if (out[-1] if out else 0) < d < 1 else 1 - tail / r)
    return out


def scored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs (doc_id, text)``.

    Tokens are the words and one end; null and empty texts are an end alone. Rows without id are never learnt from and count as held out. Repeated
    rows are documents of their own. ``score`` is the text's log10 probability; after a history without training count it is that of the token alone. Other
    columns are ignored; an empty table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    word_buckets, pair_buckets = -(-size // s.word_bucket) or 1, -(-size // s.pair_bucket) or 1
    chunks = stage(_chunks(docs, word_buckets, s), "chunks")
    numbered = stage(_numbered(chunks.where("bucket >= 0").select("chunk", "bucket", "a", "b"), word_buckets), "words")
    sums = numbered.where("chunk = -1").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (x or 0 for x in sums)
    total = tokens + distinct + 1
    found = stage(_found(_pairs(chunks, numbered, pair_buckets, total, s), total, s), "found")
    row = found.where(F.col("kind") == _COUNTS).agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(1, TOP + 2)]).first()
    d = discounts(list(row), s.tail_discount)
    seen = sum((F.col(f"n{i}") * (i * d[i - 1]) for i in range(1, TOP + 1)), F.col("big"))
    backoff = found.where(F.col("kind") == _HISTORY).groupBy("history").agg(
        F.max("times").alias("c"), F.sum(seen).alias("seen"), F.sum("low").alias("low")
    ).select("history", F.log10((1 - F.col("seen") / F.col("c")) / (1 - F.col("low") / total)).alias("backoff"))
    unseen = found.where(F.col("kind") == _UNSEEN).select("chunk", "doc", "history", "times").join(backoff, "history", "left")
    unseen = unseen.select("chunk", "doc", (F.col("times") * F.coalesce("backoff", F.lit(0.0))).alias("s"))
    known = found.where(F.col("kind") == _SUMS)
    known = known.select("chunk", "doc", sum((F.col(f"n{i}") * math.log10(d[i - 1]) for i in range(1, TOP + 1)), F.col("s")).alias("s"))
    score = known.union(unseen).groupBy("chunk", "doc").agg(F.sum("s").alias("score"))
    facts = found.where(F.col("kind") == _FACTS).join(score, ["chunk", "doc"], "left")
    return facts.select(
        F.when(F.col("times") == 1, F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", F.coalesce("score", F.lit(0.0)).alias("score"),
    )
