"""Local outlier factor (Breunig et al., 2000) on nearest neighbours.

By default the neighbours come from :mod:`auditlake.operators.neighbour_graph`, whose work per row is bounded.  On request
they are exact: points are cut into blocks around pivots (Lu et al., 2012: kNN joins by pivot partitioning).  A point
first finds neighbours in its own block; by the triangle inequality only blocks that can hold a
closer point are visited after that.  Visits go to tiles: near blocks packed to a bounded number of rows, however
small the blocks, so a point is sent once per tile and not once per block.  Queries against one tile are
spread over several tasks, and each visit returns at most k rows.  No pair table is ever written,
and the result equals the all-pairs answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditlake.operators.neighbour_graph import GraphSettings, closest, distances, matrix, neighbour_graph
from auditlake.session import materialize

BLOCK_ROWS = 4096
#: rows that a visit meets at once, and about as many queries
TILE_ROWS = 8192
_MAX_PIVOTS = 512
#: rows that a task compares with all pivots at once
_SLICE_ROWS = 1024


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _SLICE_ROWS):
            yield batch.slice(at, _SLICE_ROWS)


def blocked(vectors: DataFrame, n_rows: int, block_rows: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Vectors with their cell and its part, and the cells' pivots.

    Pivots are rows with the smallest hashes; their number is bounded.  A cell with more rows than a
    block is split by hash, so a cell that attracts a third of the points becomes many blocks.
    """
    id_type = dict(vectors.dtypes)["provider_id"]
    n_pivots = int(min(_MAX_PIVOTS, max(1, -(-n_rows // block_rows))))
    pivots = np.stack([
        np.asarray(r["x"]) for r in
        vectors.orderBy(F.xxhash64("provider_id", F.lit(seed)), "provider_id").limit(n_pivots).collect()
    ])

    def assign(batches):
        for part in _slices(batches):
            d = distances(matrix(part), pivots)
            cell, to_pivot = pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))
            yield part.append_column("cell", cell).append_column("to_pivot", to_pivot)

    placed = materialize(
        vectors.select("provider_id", "x").mapInArrow(assign, f"provider_id {id_type}, x array<double>, cell int, to_pivot double")
    )
    splits = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("provider_id", F.lit(seed + 1)), F.col("parts")).cast("int")
    return materialize(placed.join(splits, "cell").withColumn("part", part)), pivots


def _tiles(centres: np.ndarray, sizes: np.ndarray, tile_rows: int) -> list[tuple[int, int]]:
    """(first tile, number of tiles) of every cell: small cells share a tile with near ones, a large one has several."""
    from_first = distances(centres[:1], centres)[0]
    out, tile, filled = [(0, 0)] * len(sizes), -1, tile_rows
    for cell in np.argsort(from_first, kind="stable"):
        n = int(sizes[cell])
        if n > tile_rows:
            parts = -(-n // tile_rows)
            out[cell], tile, filled = (tile + 1, parts), tile + parts, tile_rows
            continue
        if filled + n > tile_rows:
            tile, filled = tile + 1, 0
        out[cell], filled = (tile, 1), filled + n
    return out


def nearest_neighbours(
    vectors: DataFrame, n_rows: int, k: int, seed: int, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(provider_id, neighbour_id, distance, place) for the exact k nearest neighbours of every row.

    A row visits every tile that can hold a nearer one, so the work may grow with the square of the rows; the rows sent
    are at most ``2 * n_rows ** 2 / tile_rows``, and a task holds two tiles.
    """
    id_type = dict(vectors.dtypes)["provider_id"]
    schema = f"provider_id {id_type}, neighbour_id {id_type}, distance double"

    def inside(block: pa.Table) -> pa.Table:
        return closest(block, block, k)

    order = Window.partitionBy("provider_id").orderBy("distance", "neighbour_id")
    if n_rows <= block_rows:
        whole = vectors.select("provider_id", "x").withColumn("cell", F.lit(0))
        found = whole.groupBy("cell").applyInArrow(inside, schema)
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    rows, pivots = blocked(vectors, n_rows, block_rows, seed)
    own = rows.select("cell", "part", "provider_id", "x").groupBy("cell", "part").applyInArrow(inside, schema)
    bounds = own.groupBy("provider_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    # a row per cell, at most _MAX_PIVOTS
    known = rows.groupBy("cell").agg(F.max("to_pivot").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()
    radius, centres = known["radius"].to_numpy(), pivots[known["cell"].to_numpy()]
    tiles = _tiles(centres, known["n"].to_numpy(), tile_rows)
    held = np.zeros((len(tiles), max(first + n for first, n in tiles)), np.float32)
    for cell, (first, n) in enumerate(tiles):
        held[cell, first:first + n] = 1.0

    def visits(batches):
        for batch in _slices(batches):
            bound = batch["bound"].fill_null(np.inf).to_numpy(zero_copy_only=False)
            floor = distances(matrix(batch), centres) - radius[None, :]
            # a hair of slack keeps rounding from hiding a cell that just touches the bound
            reachable = floor <= bound[:, None] * (1 + 1e-9) + 1e-9
            asked = reachable.astype(np.float32) @ held > 0
            for tile in np.flatnonzero(asked.any(axis=0)):
                part = batch.select(["provider_id", "x"]).filter(pa.array(asked[:, tile]))
                yield part.append_column("tile", pa.array(np.full(len(part), tile, np.int32)))

    lanes = -(-n_rows // tile_rows)
    lane = F.pmod(F.xxhash64("provider_id", F.lit(seed + 2)), F.lit(lanes)).cast("int")
    queries = rows.select("provider_id", "x").join(bounds, "provider_id", "left").mapInArrow(
        visits, f"provider_id {id_type}, x array<double>, tile int"
    ).withColumn("lane", lane)
    placed = vectors.sparkSession.createDataFrame(
        [(int(cell), first, n) for cell, (first, n) in zip(known["cell"], tiles, strict=True)], "cell int, first int, tiles int"
    )
    drawn = F.pmod(F.xxhash64("provider_id", F.lit(seed + 3)), F.col("tiles")).cast("int")
    targets = rows.join(F.broadcast(placed), "cell").select(
        "provider_id", "x", (F.col("first") + drawn).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    )
    # both sides come from the same rows: new columns keep them apart
    targets = targets.select(*[F.col(c).alias(c) for c in targets.columns])
    id_arrow = to_arrow_type(vectors.schema["provider_id"].dataType)
    nothing = pa.table({
        "provider_id": pa.array([], id_arrow), "neighbour_id": pa.array([], id_arrow),
        "distance": pa.array([], pa.float64()),
    })

    def visit(asking: pa.Table, tile: pa.Table) -> pa.Table:
        if not len(asking) or not len(tile):
            return nothing
        return closest(asking, tile, k)

    found = queries.groupBy("tile", "lane").cogroup(targets.groupBy("tile", "lane")).applyInArrow(visit, schema)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def local_outlier_factor(
    vectors: DataFrame, n_rows: int, k: int, seed: int = 42, block_rows: int = BLOCK_ROWS, exact: bool = False,
    graph: GraphSettings | None = None,
) -> DataFrame:
    """provider_id and its outlier factor (1 is typical, larger is more isolated)."""
    k = max(1, min(k, n_rows - 1))
    if exact:
        near = materialize(nearest_neighbours(vectors, n_rows, k, seed, block_rows))
    else:
        near = neighbour_graph(vectors, k, graph or GraphSettings(seed=seed))
    reach = near.groupBy("provider_id").agg(F.max("distance").alias("reach"))
    density = (
        near.join(reach.select(F.col("provider_id").alias("neighbour_id"), "reach"), "neighbour_id")
        .groupBy("provider_id")
        .agg((1.0 / (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("density"))
    )
    around = (
        near.join(density.select(F.col("provider_id").alias("neighbour_id"), F.col("density").alias("d")), "neighbour_id")
        .groupBy("provider_id")
        .agg(F.avg("d").alias("around"))
    )
    return around.join(density, "provider_id").select(
        "provider_id", (F.col("around") / F.col("density")).alias("lof")
    )
