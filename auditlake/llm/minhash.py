"""Near-duplicate documents by MinHash, with odd sketches to judge the candidates.

Each document's set of word shingles gets MinHash samples. Runs of samples (bands) put likely partners in one bucket. The samples
are also folded into an odd sketch: sample ``(i, minimum)`` flips one bit, so the XOR of two sketches counts the samples in
which they differ, which is precise at high similarity. Pairs of a bucket whose sketches allow the similarity asked for hold families
together; within a family, pairs whose sketches allow it are confirmed on the full sets, the likeliest first, unless
their documents are already linked through others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.llm import texts
from auditlake.llm.stages import components, stage


@dataclass(frozen=True)
class Settings:
    #: Words of a shingle.
    width: int = 5
    #: Two documents are linked if 100 * common >= percent * united shingles.
    percent: int = 80
    #: A pair at the threshold meets in no bucket with probability (1 - 0.8^rows)^bands: 5e-7.
    bands: int = 48
    rows: int = 6
    sketch_bits: int = 1024
    #: Sketches that differ more than those of this similarity do in the mean are no candidates: 5 standard deviations below 0.8.
    gate: float = 0.65
    #: Documents of a bucket or family are compared in blocks of this size.
    block: int = 256
    seed: int = 3

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        return int(self.sketch_bits / 2 * (1 - math.exp(-4 * self.samples * (1 - self.gate) / self.sketch_bits)))


@lru_cache(maxsize=4)
def _factors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(s.seed).integers(0, 1 << 32, (2, s.samples, 1), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def minima(items: np.ndarray, s: Settings) -> np.ndarray:
    """The samples of a set: for each hash function the smallest value of the set's items."""
    times, plus = _factors(s)
    short = (items >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(s.samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, short.shape[1], 512):
        np.minimum(out, (short[:, at : at + 512] * times + plus).min(1), out=out)
    return out


def bands(samples: np.ndarray, s: Settings) -> np.ndarray:
    """Bucket keys (rows x bands) of samples (rows x samples); the last six bits are the band's number."""
    parts = samples.astype(np.uint64).reshape(len(samples), s.bands, s.rows)
    number = np.arange(s.bands, dtype=np.uint64)
    out = np.broadcast_to(number, parts.shape[:2])
    for i in range(s.rows):
        out = texts.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return ((out << np.uint64(6)) | number).view(np.int64)


def sketches(samples: np.ndarray, s: Settings) -> np.ndarray:
    """Parity bitmaps (rows x bytes): each sample flips one bit."""
    number = np.arange(s.samples, dtype=np.uint64) << np.uint64(32)
    bit = (texts.mix(texts.mix(samples.astype(np.uint64) | number)) % np.uint64(s.sketch_bits)).astype(np.int64)
    flat = np.bincount((bit + np.arange(len(bit))[:, None] * s.sketch_bits).ravel(), minlength=len(bit) * s.sketch_bits) & 1
    return np.packbits(flat.reshape(len(bit), s.sketch_bits).astype(np.uint8), axis=1)


_SIGNED = "doc_id long, body long, n_shingles long, low long, high long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Per row: a hash of the text, the set's size, a 128-bit fingerprint of the set, bucket keys and odd sketch (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = texts.WordKeys()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                sizes, low, high, mins, places = [], [], [], [], []
                for i, text in enumerate(texts.utf8(batch["text"])):
                    items = texts.shingles(keys.of(text), s.width)
                    sizes.append(len(items))
                    low.append(int(items.sum(dtype=np.uint64).view(np.int64)))
                    high.append(int(np.bitwise_xor.reduce(texts.mix(items + np.uint64(1))).view(np.int64)) if len(items) else 0)
                    if len(items):
                        mins.append(minima(items, s))
                        places.append(i)
                found, maps = [None] * len(batch), [None] * len(batch)
                if mins:
                    rows = np.stack(mins)
                    for i, keyed, drawn in zip(places, bands(rows, s), sketches(rows, s), strict=True):
                        found[i], maps[i] = keyed, drawn.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), batch["body"], pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                     pa.array(found, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    names=["doc_id", "body", "n_shingles", "low", "high", "bands", "sketch"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("body")).mapInArrow(sign, _SIGNED)


def _apart(maps: np.ndarray) -> np.ndarray:
    """Bits in which each two sketches differ."""
    out = np.empty((len(maps), len(maps)), np.int32)
    for i in range(len(maps)):
        out[i] = np.bitwise_count(maps ^ maps[i]).sum(1, dtype=np.int32)
    return out


def _cells(rows: pd.DataFrame, by: list[str]) -> Iterator[tuple[int, int]]:
    key = rows[by].to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1), len(rows)]
    yield from ((lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi - lo > 1)


def _dealt(cells: DataFrame, by: list[str], rows_per_group: int) -> DataFrame:
    """``cells`` with a group number: rows alike in ``by`` together, so many rows to a group in the mean."""
    groups = max(1, cells.count() // rows_per_group)
    return cells.withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(groups)))


def _find(root: dict[int, int], x: int) -> int:
    while (up := root.setdefault(x, x)) != x:
        root[x] = x = root.setdefault(up, up)
    return x


def _relatives(cells: DataFrame, s: Settings) -> DataFrame:
    """``(a, b)``: stars over what the sketches allow to link within the cells; ``comp`` says what is together already.

    The cells of a bucket's first document (at most one for each band and block) are one task's, and rows that the task has joined
    in one cell are not compared again in the next, so many buckets of one family cost little more than one, and give one star.
    """

    def relate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "i", "j", "rep"], kind="stable")
        maps, rep = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1), rows["rep"].tolist()
        root: dict[int, int] = {}

        def join(x: int, y: int) -> None:
            x, y = _find(root, x), _find(root, y)
            root[max(x, y)] = min(x, y)

        comp = rows["comp"].tolist()
        for x, y in zip(rep, comp, strict=True):
            join(x, y)
        for lo, hi in _cells(rows, ["bucket", "i", "j"]):
            if hi - lo == 2:
                if np.bitwise_count(maps[lo] ^ maps[lo + 1]).sum() <= s.most_bits:
                    join(rep[lo], rep[lo + 1])
                continue
            part = np.array([_find(root, x) for x in rep[lo:hi]])
            for x in range(hi - lo):
                others = np.flatnonzero(part[x + 1 :] != part[x]) + x + 1
                if not len(others):
                    continue
                near = others[np.bitwise_count(maps[lo + others] ^ maps[lo + x]).sum(1, dtype=np.int32) <= s.most_bits]
                if len(near):
                    met = np.unique(np.append(part[near], part[x]))
                    part[np.isin(part, met)] = met[0]
                    for y in met.tolist():
                        join(int(met[0]), y)
        known = dict(zip(rep, comp, strict=True))
        out = np.array([(min(x, r), max(x, r)) for x in known if (r := _find(root, x)) not in (x, known[x])], np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    dealt = _dealt(cells, ["first", "i", "j"], 16_384)
    return dealt.groupBy("deal").applyInPandas(relate, "a long, b long")


def _links(cells: DataFrame, s: Settings) -> DataFrame:
    """``(a, b)``: links, confirmed on the full sets, that join the components within each cell of a family."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["family", "i", "j", "rep", "body"], kind="stable")
        maps, rep, comp = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1), rows["rep"].to_numpy(), rows["comp"].to_numpy()
        bodies, keys, found = rows["text"].to_numpy(), texts.WordKeys(), []
        for lo, hi in _cells(rows, ["family", "i", "j"]):
            parts, at = np.unique(comp[lo:hi], return_inverse=True)
            root = list(range(len(parts)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            apart = _apart(maps[lo:hi])
            a, b = np.nonzero(np.triu((apart <= s.most_bits) & (at[:, None] != at[None, :])))
            order = np.argsort(apart[a, b], kind="stable")
            sets: dict[int, np.ndarray] = {}
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                u, v = find(at[x]), find(at[y])
                if u == v:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = texts.shingles(keys.of(bodies[lo + k].encode()), s.width)
                one, two = sets[x], sets[y]
                if 100 * min(len(one), len(two)) < s.percent * max(len(one), len(two)):
                    continue
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= s.percent * (len(one) + len(two) - common):
                    root[max(u, v)] = min(u, v)
                    found.append((rep[lo + x], rep[lo + y]))
        out = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    dealt = _dealt(cells, ["family", "i", "j"], 2048)
    return dealt.groupBy("deal").applyInPandas(link, "a long, b long")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.greatest(F.col(blocks), F.lit(1))).cast("int")


def _ring(rows: DataFrame) -> DataFrame:
    """Rows in cells ``(i, j)``: each block with the next one, the last with the first."""
    block = _block("blocks")
    cells = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.array(block, F.pmod(block - 1, "blocks")))
    return rows.withColumn("i", F.explode(cells)).withColumn("j", F.lit(-1)).drop("blocks")


def _rest(rows: DataFrame, by: str, s: Settings) -> DataFrame:
    """Where the rows alike in ``by`` are still in several components: the blocks outside the largest one, each with every block, in cells ``(i, j)``."""
    parts = rows.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("n"))
    torn = parts.groupBy(by).agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n")).where("n > most")
    torn = torn.select(by, "largest", F.ceil((F.col("n") - F.col("most")) / s.block).cast("int").alias("rest"), F.ceil(F.col("most") / s.block).cast("int").alias("big"))
    inside = F.col("comp") == F.col("largest")
    out = rows.join(torn, by).withColumn("block", F.when(inside, F.col("rest") + _block("big")).otherwise(_block("rest")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("big") - 1))))
    out = out.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return out.drop("block", "other", "largest", "rest", "big")


def _families(nodes: DataFrame, s: Settings) -> DataFrame:
    """``(rep, family)`` of the documents that their sketches relate to others of their buckets."""
    maps = nodes.select("rep", "sketch")
    met = nodes.select(F.explode("bands").alias("bucket"), "rep")
    full = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).where("n > 1")
    # a power of two: the blocks of a family's buckets then hold the same documents
    full = full.select("bucket", "first", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / s.block, F.lit(1.0))))).cast("int").alias("blocks"))
    met = stage(met.join(full, "bucket"), "met")
    hits = stage(_ring(met).withColumn("comp", F.col("rep")), "hits")
    related = stage(_relatives(hits.join(maps, "rep"), s), "related")
    # then, where a bucket of several blocks fell apart, all that lies outside its largest component with all of the bucket
    large = met.where("blocks > 2").drop("blocks")
    if large.isEmpty():
        return components(related).withColumnsRenamed({"id": "rep", "component_id": "family"})
    large = large.join(components(related).withColumnsRenamed({"id": "rep", "component_id": "comp"}), "rep", "left")
    large = stage(large.withColumn("comp", F.coalesce("comp", "rep")), "large")
    more = stage(_relatives(stage(_rest(large, "bucket", s), "hits").join(maps, "rep"), s), "related")
    return components(related.union(more)).withColumnsRenamed({"id": "rep", "component_id": "family"})


#: Bits of the filter that spares most texts the shuffle: 64 to a row, so 131072 rows at most are broadcast.
_FILTER_BITS = 1 << 23


def _likely(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``: a bitmap of hashes, of one size whatever the input."""
    place = F.pmod(F.xxhash64(*key), F.lit(_FILTER_BITS))
    bits = wanted.select(place.alias("place"))
    bits = bits.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    kept = rows.withColumn("place", place).withColumn("word", F.shiftright("place", 6)).join(F.broadcast(bits), "word")
    return kept.where(F.expr("shiftright(bits, cast(place & 63 as int)) & 1 = 1")).drop("word", "place", "bits")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest id reachable by links; ``kept`` says that it is the row's own. Null and empty texts have no
    shingles and no links. An id is one document: rows that repeat it, with the same text or another, share their links. Rows without id are
    not compared: their component is null and they are kept. Other columns are ignored; an empty table gives no rows.
    """
    key = ["low", "high", "n_shingles"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(signatures(docs, s), "signed")
    # copies of a set are one node, named by its smallest id and by its text there
    nodes = signed.where("doc_id is not null and n_shingles > 0").groupBy(*key)
    nodes = nodes.agg(F.min(F.struct("doc_id", "body")).alias("x"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    nodes = stage(nodes.select(*key, F.col("x.doc_id").alias("rep"), "x.body", "bands", "sketch"), "nodes")
    ids = stage(signed.select("doc_id", *key).join(nodes.select(*key, "rep"), key, "left").select("doc_id", "n_shingles", "rep"), "ids")
    # an id with several texts joins their classes
    several = ids.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    several = ids.join(several.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    families = stage(_families(nodes, s), "families")
    sizes = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("blocks"))
    wanted = stage(nodes.select("rep", "body", "sketch").join(families, "rep"), "wanted")
    bodies = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("body"), "text")
    bodies = _likely(bodies, wanted, ["rep", "body"]).join(wanted, ["rep", "body"])
    bodies = stage(bodies.dropDuplicates(["rep", "body"]), "bodies")
    # first each block of a family with the next one; then, where a family fell apart, all that lies outside its
    # largest component with all of the family
    first = _ring(bodies.join(sizes, "family").withColumn("comp", F.col("rep")))
    links = stage(_links(stage(first, "cells"), s), "links")
    named = components(links).withColumnsRenamed({"id": "rep", "component_id": "comp"})
    members = families.join(named, "rep", "left").select("rep", "family", F.coalesce("comp", "rep").alias("comp"))
    cells = _rest(bodies.drop("family").join(stage(members, "members"), "rep"), "family", s)
    links = links.union(stage(_links(stage(cells, "cells"), s), "links")).union(several)
    named = components(links)
    out = ids.join(named, ids["rep"] == named["id"], "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document of each group; rows without id stay.

    Of the rows that repeat an id the one with the smallest hash of its text stays.
    """
    dropped = near_duplicates(docs, s).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    # the row travels as one value, so no column of it can clash
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.where("id is not null").join(dropped, "id", "left_anti")
    left = left.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("body"))).where("n = 1")
    return left.select("row.*").union(rows.where("id is null").select("row.*"))
