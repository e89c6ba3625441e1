"""Nearest county of every point (J4): a tree of boxes for few sites, blocks along a curve for many.

Sites that fit into a broadcast (counted first) are halved across the wider side until few are left; every half knows
its tight box. A point goes down to the nearest leaf, and then only into boxes no farther than what it has found, or
than what some other box promises: each side of a tight box touches a site. Positions are looked up in Arrow batches.

More sites than that are range-partitioned along a Hilbert curve into blocks. The tree then holds the boxes of the
blocks. A point meets the sites of its nearest block; only points whose nearest site there is farther than the box of
another block go on to that block. Sites never meet all points, and blocks that many points ask for are
searched by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.operators.joins import is_small, lookup_join
from harvestlens.session import cut

TREE_SITES = 200_000  # sites of the broadcast tree, at most
BOX = 4  # sites of a leaf, at most
PAIRS = 2_000_000  # points x boxes held at once, about
BLOCK_SITES = 20_000  # sites of a block along the curve, about
MAX_BLOCKS = 65_536  # blocks, at most (their boxes are broadcast, 2 MB); with more sites blocks grow
BLOCK_POINTS = 100_000  # points that one task looks up in a block, about
SLACK = 1 + 1e-9  # boxes may be this much farther than the bound, so that rounding loses no tie
CURVE_BITS = 16


class BoxTree:
    """Boxes (or sites, which are boxes without extent) in a complete binary tree; ties take the lowest number."""

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None):
        high = low if high is None else high
        n = len(low)
        depth = max(0, math.ceil(math.log2(n / BOX)))
        order, middle = np.arange(n), (low + high) / 2
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(depth + 1):
            border = (n * np.arange((1 << level) + 1)) >> level
            lows = np.minimum.reduceat(low[order], border[:-1])
            highs = np.maximum.reduceat(high[order], border[:-1])
            self.levels.append((lows, highs))
            node = np.repeat(np.arange(1 << level), np.diff(border))
            if level < depth:
                order = order[np.lexsort((middle[order, (highs - lows).argmax(axis=1)[node]], node))]
            else:
                order = order[np.lexsort((order, node))]
        # Leaves side by side; the last row stands for "no site" and is infinitely far.
        places = np.arange(np.diff(border).max())
        self.leaves = np.where(places < np.diff(border)[:, None], order[np.minimum(border[:-1, None] + places, n - 1)], n)
        self.low = np.vstack([low, np.full((1, 2), np.inf)])
        self.high = np.vstack([high, np.full((1, 2), np.inf)])
        self.checked = self.compared = 0

    @staticmethod
    def _distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(low - points, points - high), 0) ** 2).sum(axis=-1)

    @staticmethod
    def _promise(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No tight box has its nearest site farther away than this."""
        a, b = (points - low) ** 2, (points - high) ** 2
        near, far = np.minimum(a, b), np.maximum(a, b)
        return np.minimum(near[:, 0] + far[:, 1], far[:, 0] + near[:, 1])

    def _in_leaves(self, points: np.ndarray, rows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the boxes in one leaf for each of ``rows``."""
        boxes = self.leaves[leaves]
        self.compared += boxes.size
        return boxes, self._distance(points[rows][:, None], self.low[boxes], self.high[boxes])

    def _home(self, points: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The leaf below the nearer child of every level, and for each level the other child with its distance."""
        home, passed = np.zeros(len(points), int), []
        for low, high in self.levels[1:]:
            left, right = 2 * home, 2 * home + 1
            to_left, to_right = (self._distance(points, low[n], high[n]) for n in (left, right))
            self.checked += 2 * len(points)
            home, other = np.where(to_right < to_left, (right, left), (left, right))
            passed.append((other, np.maximum(to_left, to_right)))
        return home, passed

    def _reach(self, points: np.ndarray, bound: np.ndarray, passed: list | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Points and leaves no farther apart than ``bound``; None if there are too many to hold at once.

        With ``passed`` boxes the search starts from them, and lowers the bound to what boxes promise.
        """
        rows, nodes = np.arange(0 if passed else len(points)), np.zeros(0 if passed else len(points), int)
        for level, (low, high) in enumerate(self.levels):
            if level:
                if 2 * len(rows) > PAIRS and len(points) > 1:
                    return None
                rows, nodes = np.repeat(rows, 2), (2 * nodes[:, None] + np.arange(2)).ravel()
            at, lows, highs = points[rows], low[nodes], high[nodes]
            self.checked += len(rows)
            if passed:
                np.minimum.at(bound, rows, self._promise(at, lows, highs))
            keep = self._distance(at, lows, highs) <= bound[rows] * SLACK
            rows, nodes = rows[keep], nodes[keep]
            if passed and level:
                other, away = passed[level - 1]
                more = np.flatnonzero(away <= bound * SLACK)
                rows, nodes = np.concatenate([rows, more]), np.concatenate([nodes, other[more]])
        return rows, nodes

    def within(self, points: np.ndarray, bound: np.ndarray, passed: list | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """(point, box, squared distance) of boxes no farther than ``bound``, in parts of bounded size.

        ``passed`` says that all other boxes have been looked at; then those found may be the nearest only.
        """
        waiting = [np.arange(len(points))] if len(points) else []
        while waiting:
            part = waiting.pop()
            met = self._reach(points[part], bound[part], passed and [(n[part], d[part]) for n, d in passed])
            if met is None:
                waiting += [part[len(part) // 2:], part[:len(part) // 2]]
                continue
            rows = part[met[0]]
            boxes, d = self._in_leaves(points, rows, met[1])
            row, place = np.nonzero((d <= bound[rows][:, None] * SLACK) & (boxes < len(self.low) - 1))
            yield rows[row], boxes[row, place], d[row, place]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest box of each point."""
        home, passed = self._home(points)
        every = np.arange(len(points))
        boxes, d = self._in_leaves(points, every, home)
        place = d.argmin(axis=1)  # boxes of a leaf are in order
        found, best = boxes[every, place], d[every, place]
        if passed:
            for rows, boxes, d in self.within(points, best.copy(), passed):
                order = np.lexsort((boxes, d, rows))
                rows, boxes, d = rows[order], boxes[order], d[order]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                rows, boxes, d = rows[first], boxes[first], d[first]
                better = (d < best[rows]) | (d == best[rows]) & (boxes < found[rows])
                found[rows[better]], best[rows[better]] = boxes[better], d[better]
        return found, best


def _tree_of(sites: pd.DataFrame) -> tuple[BoxTree, np.ndarray]:
    """The tree and the keys of ``sites``, numbered by key."""
    sites = sites.sort_values("__key")
    return BoxTree(sites[["lat", "lon"]].to_numpy(float)), sites["__key"].to_numpy(dtype=object)


def _from_tree(places: DataFrame, sites: DataFrame) -> DataFrame:
    """(plat, plon, key) by a tree that every task has."""
    kind = sites.schema["__key"].dataType.simpleString()
    tree = places.sparkSession.sparkContext.broadcast(_tree_of(sites.toPandas()))  # at most TREE_SITES rows

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes, names = tree.value
        for batch in batches:
            yield batch.assign(key=names[boxes.nearest(batch[["plat", "plon"]].to_numpy(float))[0]])

    return places.mapInPandas(look_up, f"plat double, plon double, key {kind}")


def curve_position(row: Column, column: Column) -> Column:
    """Place of a cell on the Hilbert curve through 2^16 x 2^16 cells."""
    size = 1 << CURVE_BITS

    def step(state: Column, bit: Column) -> Column:
        half = F.lit(size / 2) / F.pow(F.lit(2.0), bit)
        half = half.cast("long")
        x, y = state["x"], state["y"]
        right, upper = x.bitwiseAND(half) > 0, y.bitwiseAND(half) > 0
        quarter = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        turned = ~upper & right
        tx, ty = F.when(turned, size - 1 - x).otherwise(x), F.when(turned, size - 1 - y).otherwise(y)
        return F.struct(F.when(upper, x).otherwise(ty).alias("x"), F.when(upper, y).otherwise(tx).alias("y"),
                        (state["d"] * 4 + quarter).cast("long").alias("d"))

    start = F.struct(row.cast("long").alias("x"), column.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(CURVE_BITS - 1)), start, step, lambda s: s["d"])


def _blocks(sites: DataFrame, block_sites: int) -> DataFrame:
    """Sites with the number of their block, as a written table."""
    e = sites.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]).first()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(e["n"] / block_sites)))

    def cell(c: str) -> Column:
        width = (e[f"max_{c}"] - e[f"min_{c}"]) or 1.0
        return F.floor((F.col(c) - e[f"min_{c}"]) / width * ((1 << CURVE_BITS) - 1))

    # Positions are distinct and part of the order, so that sites of one cell can be parted, too.
    return cut(sites.repartitionByRange(blocks, curve_position(cell("lat"), cell("lon")), "lat", "lon").withColumn(
        "block", F.spark_partition_id()))


def _met(asked: DataFrame, blocked: DataFrame, kind: str) -> DataFrame:
    """(plat, plon, block, d2, key): the nearest site of the asked block for every (plat, plon, block)."""
    asked = cut(asked)
    slices = F.broadcast(cut(asked.groupBy("block").agg(  # at most MAX_BLOCKS rows
        F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("slices"))))
    points = asked.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("plat", "plon"), F.col("slices")).cast("int"))
    sites = blocked.join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def search(points: pd.DataFrame, sites: pd.DataFrame) -> pd.DataFrame:
        tree, names = _tree_of(sites)
        found, d2 = tree.nearest(points[["plat", "plon"]].to_numpy(float))
        return points[["plat", "plon", "block"]].assign(d2=d2, key=names[found])

    return points.select("block", "slice", "plat", "plon").groupBy("block", "slice").cogroup(
        sites.select("block", "slice", "lat", "lon", "__key").groupBy("block", "slice")).applyInPandas(
            lambda p, s: search(p, s) if len(p) else pd.DataFrame(columns=["plat", "plon", "block", "d2", "key"]),
            f"plat double, plon double, block int, d2 double, key {kind}")


def _from_blocks(places: DataFrame, sites: DataFrame, block_sites: int) -> DataFrame:
    """(plat, plon, key) where both sides may be large."""
    kind = sites.schema["__key"].dataType.simpleString()
    blocked = _blocks(sites, block_sites)
    held = blocked.groupBy("block").agg(
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"),
    ).orderBy("block").toPandas()  # at most MAX_BLOCKS rows
    tree = places.sparkSession.sparkContext.broadcast((
        BoxTree(held[["south", "west"]].to_numpy(float), held[["north", "east"]].to_numpy(float)), held["block"].to_numpy()))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes, names = tree.value
        for batch in batches:
            yield batch.assign(block=names[boxes.nearest(batch[["plat", "plon"]].to_numpy(float))[0]])

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes, names = tree.value
        for batch in batches:
            place, own = batch[["plat", "plon"]].to_numpy(float), batch["block"].to_numpy()
            for rows, found, _ in boxes.within(place, batch["d2"].to_numpy(float)):
                away = names[found] != own[rows]
                yield pd.DataFrame({"plat": place[rows[away], 0], "plon": place[rows[away], 1], "block": names[found[away]]})

    asked = "plat double, plon double, block int"
    first = cut(_met(places.mapInPandas(home, asked), blocked, kind))
    second = _met(first.select("plat", "plon", "block", "d2").mapInPandas(others, asked), blocked, kind)
    return first.unionByName(second).groupBy("plat", "plon").agg(
        F.min(F.struct("d2", "key")).alias("best")).select("plat", "plon", "best.key")


def _known(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))


def nearest(points: DataFrame, sites: DataFrame, *, site_key: str = "fips", lat: str = "lat", lon: str = "lon",
            out: str | None = None, tree_sites: int = TREE_SITES, block_sites: int = BLOCK_SITES) -> DataFrame:
    """Points with the key of the closest site in squared degrees; equal distance takes the lowest key.

    ``sites`` has ``site_key``, lat and lon. Points without a position (null or NaN) get null. Points at the same
    position are looked up once. More than ``tree_sites`` sites are not broadcast but cut into blocks; the
    result is the same.
    """
    out = out or site_key
    # Copies of a position collapse first: only the lowest key there can win.
    sites = cut(sites.where(_known("lat") & _known("lon")).groupBy(
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).agg(F.min(site_key).alias("__key")))
    if sites.isEmpty():
        return points.withColumn(out, F.lit(None).cast(sites.schema["__key"].dataType))
    places = points.where(_known(lat) & _known(lon)).select(
        F.col(lat).cast("double").alias("plat"), F.col(lon).cast("double").alias("plon")).distinct()
    found = _from_tree(places, sites) if is_small(sites, tree_sites) else _from_blocks(places, sites, block_sites)
    found = found.select(F.col("plat").alias(lat), F.col("plon").alias(lon), F.col("key").alias(out))
    return lookup_join(points, cut(found), [lat, lon], "left")
