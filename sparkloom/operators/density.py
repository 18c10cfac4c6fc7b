"""DBSCAN by dense cells.

Space is cut into cells whose diagonal is eps, so all points of a cell are near each other: a cell with ``min_points`` points
is core as a whole, and all core points of a cell are in one cluster. No pairs are made inside a cell. The clusters are
the components of a graph of cells.

Between cells, points are first looked at as boxes (the real extent of what lies in a part of a cell, with its number of points). A
box that is near or far as a whole needs no pairs. For points of cells that are not dense (fewer than ``min_points`` each) what
is left of their neighbours' boxes is compared point by point. Whether two core cells touch is asked of ever smaller boxes, of which
only those stay that are neither near nor far; a box of one place is one or the other, so this ends, without a pair of points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.operators.order import numbered
from sparkloom.plans.storage import materialise, release

#: A cell's boxes are its parts of 1 / 2 ** DEPTH of its sides.
DEPTH = 3


class Steps:
    """The cells of points (id, z0, z1, ...; none null) and what follows from them."""

    def __init__(self, points: DataFrame, dims: int, eps: float, min_points: int):
        self.dims, self.square, self.least = dims, eps * eps, min_points
        self.side = eps / math.sqrt(dims) * (1 - 1e-9)
        self.z, self.lo, self.hi = ([f"{c}{i}" for i in range(dims)] for c in ("z", "lo", "hi"))
        cell = F.array(*[F.floor(F.col(c) / self.side) for c in self.z])
        self.points = materialise(points.select("id", *self.z, cell.alias("cell")), "points")
        self.boxes = materialise(self._boxes(self.points, DEPTH), "boxes")
        whole = self.boxes.groupBy("cell").agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in self.lo], *[F.max(c).alias(c) for c in self.hi])
        self.cells = materialise(whole.withColumn("dense", F.col("n") >= min_points), "cells")
        self.reach = materialise(self._reach(eps + self.side), "reach")

    def _part(self, depth: int) -> Column:
        """Where in its cell a point lies, in steps of 1 / 2 ** depth of the side."""
        step = self.side / 2**depth
        return F.array(*[F.floor((F.col(c) - F.get("cell", i) * self.side) / step) for i, c in enumerate(self.z)])

    def _boxes(self, points: DataFrame, depth: int) -> DataFrame:
        parts = points.withColumn("part", self._part(depth)).groupBy("cell", "part")
        return parts.agg(F.count(F.lit(1)).alias("n"), *[F.min(z).alias(c) for z, c in zip(self.z, self.lo)], *[F.max(z).alias(c) for z, c in zip(self.z, self.hi)])

    def _apart(self, a: Sequence[tuple[Column, Column]], b: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
        """The least and the largest squared distance of two boxes, given as (lo, hi) of each axis."""
        least, most = F.lit(0.0), F.lit(0.0)
        for (al, ah), (bl, bh) in zip(a, b):
            gap = F.greatest(bl - ah, al - bh, F.lit(0.0))
            far = F.greatest(bh - al, ah - bl)
            least, most = least + gap * gap, most + far * far
        return least, most

    def _sides(self, prefix: str = "") -> list[tuple[Column, Column]]:
        return [(F.col(prefix + lo), F.col(prefix + hi)) for lo, hi in zip(self.lo, self.hi)]

    def _reach(self, width: float) -> DataFrame:
        """(cell, other) of all cells that have points within eps of each other, as far as their boxes say, both ways; few for each cell, as they lie around it."""
        near = [F.floor(F.col(c) / width) for c in self.lo]
        steps = F.array(*[F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=self.dims)])
        mine = self.cells.select("cell", *self.lo, *self.hi, F.array(*near).alias("g"))
        other = mine.select(F.col("cell").alias("other"), *[F.col(c).alias(f"o_{c}") for c in (*self.lo, *self.hi)], "g", F.explode(steps).alias("s"))
        other = other.withColumn("g", F.zip_with("g", "s", lambda x, y: x + y)).drop("s")
        least, _ = self._apart(self._sides(), self._sides("o_"))
        return mine.join(other, "g").where((F.col("cell") != F.col("other")) & (least <= self.square)).select("cell", "other")

    def sparse(self) -> DataFrame:
        """The points of cells that are not dense."""
        return self.points.join(self.cells.where("not dense").select("cell", F.col("n").alias("own")), "cell")

    def _met(self, few: DataFrame, boxes: DataFrame) -> DataFrame:
        """few (id, z, cell) with the boxes of the cells around them, and how far these are."""
        other = boxes.select(F.col("cell").alias("other"), "part", *[c for c in boxes.columns if c not in ("cell", "part")])
        least, most = self._apart([(F.col(c), F.col(c)) for c in self.z], self._sides())
        met = few.join(self.reach, "cell").join(other, "other").withColumns({"least": least, "most": most})
        return met.where(F.col("least") <= self.square)

    def pairs(self, few: DataFrame, boxes: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
        """(id, near): few's points and points around them in boxes that are neither near nor far as a whole."""
        open_ = self._met(few, self.boxes if boxes is None else boxes).where(F.col("most") > self.square).select("id", *self.z, "other", "part")
        held = self.points if points is None else points
        there = held.withColumn("part", self._part(DEPTH)).select(F.col("id").alias("near"), *[F.col(c).alias(f"o_{c}") for c in self.z], F.col("cell").alias("other"), "part")
        distance, _ = self._apart([(F.col(c), F.col(c)) for c in self.z], [(F.col(f"o_{c}"), F.col(f"o_{c}")) for c in self.z])
        return open_.join(there, ["other", "part"]).where(distance <= self.square).select("id", "near", "other")

    def core(self) -> DataFrame:
        """The core points (id, z, cell): those with min_points points within eps, themselves included."""
        few = self.sparse()
        whole = self._met(few, self.boxes).where(F.col("most") <= self.square).select("id", "n")
        found = whole.union(self.pairs(few).select("id", F.lit(1).cast("long"))).groupBy("id").agg(F.sum("n").alias("more"))
        alone = few.join(found, "id", "left").where(F.col("own") + F.coalesce("more", F.lit(0)) >= self.least)
        dense = self.points.join(self.cells.where("dense").select("cell"), "cell", "left_semi")
        return dense.select("id", *self.z, "cell").union(alone.select("id", *self.z, "cell"))

    def touching(self, core: DataFrame) -> DataFrame:
        """(cell, other) of cells of which a core point of one lies within eps of one of the other."""
        named = lambda prefix, boxes: boxes.select(F.col("cell").alias(f"{prefix}cell"), F.col("part").alias(f"{prefix}part"), *[F.col(c).alias(prefix + c) for c in (*self.lo, *self.hi)])
        up = lambda part: F.transform(part, lambda x: F.floor(x / 2))
        left, done, depth = None, [], 0
        while True:
            boxes = self._boxes(core, depth) if left is None else self._boxes(core.join(left.select(F.explode(F.array("a_cell", "b_cell")).alias("cell")).distinct(), "cell", "left_semi"), depth)
            boxes = materialise(boxes, "core")
            a, b = named("a_", boxes), named("b_", boxes)
            if left is None:
                met = self.reach.where(F.col("cell") < F.col("other")).select(F.col("cell").alias("a_cell"), F.col("other").alias("b_cell")).join(a, "a_cell").join(b, "b_cell")
            else:
                a, b = a.withColumn("up", up(F.col("a_part"))), b.withColumn("up", up(F.col("b_part")))
                met = left.withColumnsRenamed({"a_part": "a_up", "b_part": "b_up"}).join(a.withColumnRenamed("up", "a_up"), ["a_cell", "a_up"]).join(b.withColumnRenamed("up", "b_up"), ["b_cell", "b_up"])
            least, most = self._apart(self._sides("a_"), self._sides("b_"))
            judged = materialise(met.where(least <= self.square).select("a_cell", "b_cell", "a_part", "b_part", (most <= self.square).alias("near")), "judged", instead_of=(boxes,))
            done.append(judged.where("near").select("a_cell", "b_cell").distinct())
            left = judged.join(done[-1], ["a_cell", "b_cell"], "left_anti")
            if left.isEmpty():
                break
            depth += 1
        found = done[0]
        for more in done[1:]:
            found = found.union(more)
        return found.select(F.col("a_cell").alias("cell"), F.col("b_cell").alias("other"))


def dbscan(df: DataFrame, inputs: Sequence[str], key: str, eps: float, min_points: int) -> DataFrame:
    """key and cluster (0, 1, ... in order of the least key of their core points): a border point joins the least cluster near it; -1 for noise.

    inputs are numbers without nulls, key is unique.
    """
    steps = Steps(df.select(F.col(key).alias("id"), *[F.col(c).alias(f"z{i}") for i, c in enumerate(inputs)]), len(inputs), eps, min_points)
    core = materialise(steps.core(), "core")
    own = core.groupBy("cell").agg(F.min("id").alias("first"))  # one row for each cell
    edges = steps.touching(core).select(F.col("cell").alias("u"), F.col("other").alias("v")).union(own.select(F.col("cell").alias("u"), F.col("cell").alias("v")))
    groups = connected_components(edges).join(own, F.col("node") == F.col("cell")).select("cell", "component", "first")
    roots = groups.groupBy("component").agg(F.min("first").alias("root"))
    order = numbered(roots, ["root"], "place").select("component", (F.col("place") - 1).cast("int").alias("cluster"))
    label = materialise(groups.join(order, "component").select("cell", "cluster"), "labels")
    rest = materialise(steps.points.join(core.select("id"), "id", "left_anti"), "rest")
    boxes = materialise(steps._boxes(core, DEPTH), "boxes")
    inside = rest.join(label, "cell").select("id", "cluster")
    whole = steps._met(rest, boxes).where(F.col("most") <= steps.square).select("id", "other")
    around = whole.union(steps.pairs(rest, boxes, core).select("id", "other")).join(label.select(F.col("cell").alias("other"), "cluster"), "other").select("id", "cluster")
    border = inside.union(around).groupBy("id").agg(F.min("cluster").alias("cluster"))
    said = core.join(label, "cell").select("id", "cluster").union(rest.select("id").join(border, "id", "left").select("id", F.coalesce("cluster", F.lit(-1))))
    out = materialise(said.select(F.col("id").alias(key), "cluster"), "clusters")
    release(steps.points, steps.boxes, steps.cells, steps.reach, core, label, rest, boxes)
    return out
