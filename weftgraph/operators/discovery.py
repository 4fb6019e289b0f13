"""Set-wise discovery over the nodes of a stage: shared values, similar
vectors and near places.

Each gives ``edges``: ``from < to`` with the evidence.  None of them crosses
all nodes with all: equal values are a grouping, nearness an equi-join on the
cells of a grid, similarity an equi-join on the cells of a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, vectors
from ..sources.staging import small, staged

AXES = 3
TILE = 1024  # places of a tile; vectors that are scored against as many others at once
TILES = 32  # tiles of vectors of one cell, about, so that a vector is sent a bounded number of times
TILE_MOST = 65_536  # vectors of a tile that one Python worker holds
TESTED = 2_000_000  # pairs of places that a task tests, about
PARTS_MOST = 2_000
SEED = 20240229


def stars(rows: DataFrame, key: str = "value") -> DataFrame:
    """``from, to, value``: every further id of an equal value, from the least id.

    Linear in the rows of a group.  Repeated ids of a value count once.
    """
    least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("from"))
    met = rows.select("id", key).distinct().join(least, key)
    return met.filter("id <> `from`").select("from", F.col("id").alias("to"), F.col(key).alias("value"))


@dataclass
class Near:
    """Near places before their ids are paired: ``ids, ids2, one, distance``, each two places of two tiles once.

    Where ``one``, both are the same ids of one place.  What is written and
    shuffled are tiles, so ids at one place cost no row a pair before ``pairs``.
    """

    met: DataFrame

    def pairs(self) -> DataFrame:
        """``from, to, distance``, each pair once."""
        flat = self.met.select("ids2", "one", "distance", F.explode("ids").alias("x")).select("x", "one", "distance", F.explode("ids2").alias("y"))
        flat = flat.filter(~F.col("one") | (F.col("x") < F.col("y")))
        return flat.select(F.least("x", "y").alias("from"), F.greatest("x", "y").alias("to"), "distance")

    def nodes(self) -> DataFrame:
        """``id`` of what has a pair."""
        return self.met.filter(~F.col("one") | (F.size("ids") > 1)).select(F.explode(F.array_union("ids", "ids2")).alias("id")).distinct()


def near(places: DataFrame, metres: float, strict: bool) -> Near:
    """Places (id, lat, lon) within ``metres`` of each other; ids must differ.

    Cells of the grid are cut into tiles of about TILE ids, in which the ids
    of one place are one list; tiles of neighbouring cells are paired, and a
    distance is computed once for two places, not for two ids.
    """
    rows = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("id").isNotNull())
    rows = staged(rows.select("id", "lat", "lon", geo.cube(F.col("lat"), F.col("lon"), metres).alias("cell")), "places")
    many = staged(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("k")), "cells")
    own = rows.join(F.broadcast(many) if small(many, 100_000) else many, "cell")
    own = own.groupBy("cell", F.pmod(F.xxhash64("id"), F.col("k")).alias("number"), "lat", "lon").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    held = F.collect_list(F.struct("lat", "lon", "ids")).alias("places")
    tiles = own.groupBy("cell", "number").agg(held, F.sum(F.size("ids")).alias("size"))
    tiles = staged(tiles.select(F.struct("cell.x", "cell.y", "cell.z", "number").alias("tile"), "places", "size"), "tiles")
    cell = F.struct("tile.x", "tile.y", "tile.z")
    away = tiles.select(F.col("tile").alias("a"), F.col("size").alias("n"), F.explode(geo.around(cell)).alias("cell"))
    ends = tiles.select(F.col("tile").alias("b"), F.col("size").alias("m"), cell.alias("cell"))
    pairs = staged(away.join(ends, "cell").filter("a <= b").select("a", "b", "n", "m"), "pairs")
    tested = pairs.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    left = tiles.select(F.col("tile").alias("a"), F.col("places").alias("p"))
    right = tiles.select(F.col("tile").alias("b"), F.col("places").alias("q"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").repartition(int(min(PARTS_MOST, 1 + tested // TESTED)), "a", "b")
    met = met.select("a", "b", "q", F.explode("p").alias("p")).select("a", "b", "p", F.explode("q").alias("q"))
    first, other = F.get("p.ids", F.lit(0)), F.get("q.ids", F.lit(0))
    met = met.filter((F.col("a") < F.col("b")) | (first <= other))
    met = met.select(F.col("p.ids").alias("ids"), F.col("q.ids").alias("ids2"), (first == other).alias("one"), geo.haversine(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon")).alias("distance"))
    return Near(met.filter(F.col("distance") < metres if strict else F.col("distance") <= metres))


def near_pairs(places: DataFrame, metres: float, strict: bool) -> DataFrame:
    """``from, to, distance`` of places (id, lat, lon) within ``metres`` of each other."""
    return near(places, metres, strict).pairs()


def _directions(dim: int) -> list[list[float]]:
    """AXES orthonormal directions, the same in every run."""
    import numpy as np

    q, _ = np.linalg.qr(np.random.RandomState(SEED).normal(size=(dim, min(AXES, dim))))
    return q.T.tolist()


def similar_pairs(rows: DataFrame, threshold: float, metric: str, dim: int, strict: bool) -> DataFrame:
    """``from, to, score`` of vectors (id, v) whose score reaches ``threshold``.

    A score bounds the distance of two vectors (of their directions, for the
    cosine; by the greatest norm, for the dot product), and a projection
    shortens no distance by making it longer, so such vectors lie in the same
    or in neighbouring cells of a grid over a few projections.  Cells are cut
    into about TILES tiles, so what is sent grows with the vectors and not with
    their square; only tiles are paired by cell, and each pair of tiles is
    scored by matrix products, the pairs that may reach the threshold then
    exactly.  Nothing is lost.  Zero vectors have cosine 0 with all
    and pair with all only where the threshold allows that.
    """
    rows = rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = rows.select("id", F.col("v").alias("raw"), vectors.doubles(F.col("v")).alias("v"), vectors.squared_norm(F.col("v")).alias("q"))
    base, radius = rows.withColumn("p", F.col("v")), None
    if metric == "cosine":
        base = rows.withColumn("p", F.when(F.col("q") > 0, F.transform("v", lambda x: x / F.sqrt("q"))).otherwise(F.col("v")))
        if threshold > 0:
            base = base.filter("q > 0")
            radius = math.sqrt(max(0.0, 2 - 2 * min(1.0, threshold)))
        # at 0 or below, zero vectors are at distance 1 of every direction and others at most sqrt(2 - 2s)
        else:
            radius = max(1.0, math.sqrt(2 - 2 * max(-1.0, threshold)))
    elif metric == "l2":
        if threshold > 0:
            return rows.select(F.col("id").alias("from"), F.col("id").alias("to"), F.col("q").alias("score")).filter(F.lit(False))
        radius = -threshold
    else:
        most = rows.agg(F.max("q")).first()[0] or 0.0
        radius = math.sqrt(max(0.0, 2 * most - 2 * threshold))
    width = max(radius, 1e-6) * (1 + 1e-6) + 1e-7
    axes = [F.floor(vectors._sum(F.zip_with("p", F.array(*[F.lit(x) for x in d]), lambda a, b: a * b)) / F.lit(width)).cast("long") for d in _directions(dim)]
    cells = base.select("id", "raw", F.array(*axes).alias("cell"))
    shifts = [[]]
    for _ in axes:
        shifts = [[*s, d] for s in shifts for d in (-1, 0, 1)]
    moved = F.array(*[F.array(*[F.get("cell", F.lit(i)) + d for i, d in enumerate(s)]) for s in shifts])
    most = min(TILE_MOST, max(TILE, -(-rows.count() // TILES)))
    own, tiles = _tiled(cells, most)
    away = tiles.select(F.col("tile").alias("a"), F.explode(moved).alias("cell"))
    pairs = away.join(tiles.select(F.col("tile").alias("b"), "cell"), "cell").filter("a <= b").select("a", "b").distinct()
    pairs = staged(pairs.withColumn("pair", F.monotonically_increasing_id()), "tiles")
    sides = pairs.select("pair", F.col("a").alias("tile"), F.lit(0).alias("side")).unionAll(pairs.filter("a <> b").select("pair", "b", F.lit(1)))
    count = pairs.count()
    parts = max(1, min(PARTS_MOST, count, count * most * most // (10 * TESTED)))
    sent = own.join(sides, "tile").select("pair", "side", "id", "raw").repartition(parts, "pair").sortWithinPartitions("pair", "side")
    kind = rows.schema["id"].dataType.simpleString()
    return sent.mapInArrow(_scorer(threshold, metric, strict), f"`from` {kind}, `to` {kind}, score double")


def _tiled(cells: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, raw, tile) of the vectors and (tile, cell) of the tiles of about ``most`` vectors."""
    many = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("k"))
    many = staged(many, "cells")
    number = F.pmod(F.xxhash64("id"), F.col("k"))
    own = cells.join(F.broadcast(many) if small(many, 100_000) else many, "cell").select("id", "raw", "cell", F.concat_ws(" ", F.array_join(F.transform("cell", lambda x: x.cast("string")), " "), number.cast("string")).alias("tile"))
    own = staged(own, "vectors")
    return own.select("id", "raw", "tile"), own.select("tile", "cell").distinct()


def _scorer(threshold: float, metric: str, strict: bool):
    """All pairs of two tiles that reach the threshold, by matrix products and exact scores of what may.

    Rows (pair, side, id, raw) come by pair; a tile paired with itself has one
    side.  Answers leave block by block, so many of them need no memory.
    """

    def block(i, x, p, j, y, q, alone):
        import numpy as np

        dots = x @ y.T
        if metric == "l2":
            total = p[:, None] + q[None, :]
            rough = -np.sqrt(np.maximum(total - 2 * dots, 0))
            slack = 1e-6 * (1 + np.sqrt(total))  # what cancels out may be as large as the root of a rounding
        elif metric == "cosine":
            norms = np.sqrt(p)[:, None] * np.sqrt(q)[None, :]
            rough = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
            slack = 1e-9
        else:
            rough, slack = dots, 1e-9 * (1 + p[:, None] + q[None, :])
        may = rough >= threshold - slack
        may &= i[:, None] < j[None, :] if alone else i[:, None] != j[None, :]
        r, c = np.nonzero(may)
        for at in range(0, len(r), TILE * 64):  # whole vectors are gathered for some pairs at a time
            s, d = r[at : at + TILE * 64], c[at : at + TILE * 64]
            if metric == "l2":
                score = -np.sqrt(((x[s] - y[d]) ** 2).sum(axis=1))
            else:
                score = (x[s] * y[d]).sum(axis=1)
                if metric == "cosine":
                    size = np.sqrt(p[s]) * np.sqrt(q[d])
                    score = np.clip(np.divide(score, size, out=np.zeros_like(score), where=size > 0), -1.0, 1.0)
            ok = score > threshold if strict else score >= threshold
            yield np.minimum(i[s], j[d])[ok], np.maximum(i[s], j[d])[ok], score[ok]

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        def answers(rows):
            table = pa.Table.from_batches(rows)
            side, ids = table["side"].to_numpy(), table["id"].to_numpy()
            raw = table["raw"].combine_chunks()
            v = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            q = (v * v).sum(axis=1)
            first = int((side == 0).sum())
            alone = first == len(ids)
            for a in range(0, first, TILE):
                end = min(a + TILE, first)
                for b in range(0 if alone else first, len(ids), TILE):
                    for lo, hi, score in block(ids[a:end], v[a:end], q[a:end], ids[b : b + TILE], v[b : b + TILE], q[b : b + TILE], alone):
                        if len(lo):
                            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(score)], names=["from", "to", "score"])

        held, current = [], None
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            edges = [0, *(np.nonzero(np.diff(pair))[0] + 1).tolist(), len(pair)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if held and pair[lo] != current:
                    yield from answers(held)
                    held = []
                current = pair[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from answers(held)

    return scored


def text_matches(df: DataFrame, fields: list[str], op: str, needle: str) -> Column:
    """Whether any of ``fields`` of a row passes a text test (null fields do not)."""
    from .predicates import text_test

    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(text_test(F.col(f), op, needle), F.lit(False))
    return out
