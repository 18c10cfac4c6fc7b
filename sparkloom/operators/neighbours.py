"""Exact nearest neighbours by a partition of space into boxes and bounds on distances.

The points are dealt to boxes by halving a bounded sample of them again and again; the real extent and number of points of
each box (at most ``BOXES`` rows) are the only thing sent to all tasks, whatever the sample was. A query gets a radius
within which ``k`` points lie for certain, from the boxes that lie close as a whole and from a look at one block of its own
box. Then it is compared with those boxes only that its ball meets; the nearest of what they give are the answer.
Any partition gives the same answer; a good one keeps most pairs apart.

Where a query meets many boxes (in many dimensions nearly all), a row for each of them would be a shuffle that grows with the
square of the input. So neighbouring boxes are written together as groups, queries likewise, a group a row; a task reads some
groups of either side and pairs those that meet. Points and queries are shuffled a fixed number of times, what goes on from a
task is k rows of a query at most for each group of points, few after its first ones.

Equal points count once with their ``k`` least keys, and equal queries are asked once, so neither a point nor a query that a
third of all rows share makes a box or a task heavy. Distances of a pack of queries and a block of points are one table in
numpy: a matrix product with a bound on its error says which pairs may lie within the radius, only those are worked out axis by axis.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.storage import materialise

#: Boxes at most, and points of a box as wished for; points that the halving is planned on, at most.
BOXES, BOX_ROWS, SAMPLE = 4096, 512, 65_536
BLOCK, PACK = 1024, 128
#: Numbers in a group of points or queries at most, files of all groups of a side at most; queries and points of one table of distances.
GROUP, FILES, TABLE = 2**19, 512, (1024, 2048)


@dataclass
class Boxes:
    """Where space is halved (the axis and the place of each inner node of a full tree), and what each box really holds."""

    axis: np.ndarray
    place: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray

    def home(self, x: np.ndarray) -> np.ndarray:
        """The box of each row of x."""
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.axis) + 1))):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] > self.place[at])
        return at - len(self.axis)

    def reach(self, x: np.ndarray, of: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest squared distance of each row of x to each box (or those of ``of``)."""
        los, his = self.lo[of], self.hi[of]
        least, most = np.zeros((len(x), len(los))), np.zeros((len(x), len(los)))
        for j in range(x.shape[1]):
            c = x[:, j : j + 1]
            below, above = los[:, j] - c, c - his[:, j]
            least += np.square(np.maximum(np.maximum(below, above), 0))
            most += np.square(np.maximum(np.abs(below), np.abs(above)))
        return least, most


def halved(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and places of a full tree of 2 ** levels boxes: each node halves its rows at the median of their widest axis."""
    axis, place, held = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1), {0: sample}
    for node in range(2**levels - 1):
        rows = held.pop(node)
        if len(rows):
            axis[node] = int(np.argmax(np.ptp(rows, axis=0)))
            place[node] = float(np.median(rows[:, axis[node]]))
        right = rows[:, axis[node]] > place[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return axis, place


def _whole(c: pa.ChunkedArray | np.ndarray) -> pa.Array:
    """A column as the one list of a row."""
    items = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)
    return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)


def _matrix(batch: pa.RecordBatch, dims: int, prefix: str = "x") -> np.ndarray:
    return np.column_stack([batch.column(f"{prefix}{i}").to_numpy(zero_copy_only=False) for i in range(dims)]).astype(float)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, added axis by axis in order."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += np.square(q[:, j : j + 1] - x[:, j])
    return out


def _packed(df: DataFrame, by: str, key: str, columns: Sequence[str], size: int, counts: DataFrame | None = None) -> DataFrame:
    """Rows of a box as lists of about ``size``: dealt by a hash of the key to as many lists as the box needs."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n")) if counts is None else counts
    dealt = df.join(counts, by).withColumn("__part", F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / size)))
    return dealt.groupBy(by, "__part").agg(F.collect_list(F.struct(*columns)).alias("rows")).select(by, F.col("__part").alias("part"), F.col("rows"))


def _within(q: np.ndarray, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and squared distance (as ``_distances`` has it) of the pairs within the radius of the row of q."""
    mid = (x.min(axis=0) + x.max(axis=0)) / 2
    a, b = q - mid, x - mid
    aa, bb = np.square(a).sum(axis=1)[:, None], np.square(b).sum(axis=1)
    slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (aa + bb.max())
    who, where = np.nonzero(~(aa - 2 * (a @ b.T) + bb > radius[:, None] + slack))
    d = np.zeros(len(who))
    for j in range(q.shape[1]):
        d += np.square(q[who, j] - x[where, j])
    near = d <= radius[who]
    return who[near], where[near], d[near]


def _first(who: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (d, rank) of each who, in order."""
    order = np.lexsort((rank, d, who))
    starts = np.flatnonzero(np.diff(who[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < k]


def _dealt(df: DataFrame, boxes: Sequence[int], size: Sequence[int], most: int, key: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """df with the group of each row, and (box, its first group, its groups): neighbouring boxes share a group of ``most`` rows, a larger box has several."""
    plan, group, held = [], 0, 0
    for b, n in zip(boxes, size):
        if held and held + n > most:
            group, held = group + 1, 0
        parts = -(-int(n) // most)
        plan.append((int(b), group, parts))
        group, held = (group, held + n) if parts == 1 else (group + parts, 0)
    at = F.broadcast(df.sparkSession.createDataFrame(plan, "box long, __first long, __parts long"))  # at most BOXES rows
    grouped = df.join(at, "box").withColumn("group", F.col("__first") + F.pmod(F.xxhash64(key), F.col("__parts"))).drop("__first", "__parts")
    return grouped.repartitionByRange(min(FILES, group + 1), "group"), plan


def k_nearest(points: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """query, near: for each row of queries (query, x0, x1, ...) the k nearest of points (key, x0, x1, ...) as an array of (d, key), nearest first, of ties the least key.

    d is the squared distance. Coordinates are numbers, none of them null; with fewer than k points all are near.
    """
    at = [f"x{i}" for i in range(dims)]
    found = search(points, queries, dims, k)
    answers = found.select(F.col("qid"), "near")
    return queries.select("query", *at).withColumn("qid", F.struct(*at)).join(answers, "qid").select("query", "near")


def search(points: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """qid (the coordinates), near and n_pairs (distances that were worked out) of each distinct query."""
    at = [f"x{i}" for i in range(dims)]
    first = F.row_number().over(Window.partitionBy(*at).orderBy("key"))
    kept = materialise(points.withColumn("__r", first).where(F.col("__r") <= k).select(*at, "key"), "points")
    n = kept.count()
    levels = int(np.clip(np.ceil(np.log2(max(n, 1) / BOX_ROWS)), 0, np.log2(BOXES)))
    sample = np.array([list(r) for r in kept.orderBy(F.xxhash64(*at, "key")).select(*at).limit(SAMPLE).collect()], float).reshape(-1, dims)
    axis, place = halved(sample, levels)
    boxes = Boxes(axis, place, *(np.zeros((0, dims)),) * 2, np.zeros(0))
    spark = points.sparkSession

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("box", pa.array(boxes.home(_matrix(b, dims))))

    columns = ", ".join(f"{c} double" for c in at)
    placed = materialise(kept.mapInArrow(boxed, f"{columns}, key {dict(kept.dtypes)['key']}, box long"), "boxed", instead_of=(kept,))
    extent = placed.groupBy("box").agg(F.count(F.lit(1)).alias("n"), *[F.min(c) for c in at], *[F.max(c) for c in at]).collect()  # at most BOXES rows
    lo, hi, size = np.full((2**levels, dims), np.inf), np.full((2**levels, dims), -np.inf), np.zeros(2**levels, np.int64)
    for r in extent:
        size[r[0]], lo[r[0]], hi[r[0]] = r[1], r[2 : 2 + dims], r[2 + dims :]
    some = size > 0
    held = spark.sparkContext.broadcast(Boxes(axis, place, lo[some], hi[some], size[some]))
    names = np.flatnonzero(some)
    kind = dict(placed.dtypes)["key"]
    asked = queries.select(*at).distinct()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The home of each query, and a radius from the boxes: the least within which boxes of k points lie as a whole."""
        for b in batches:
            for lo in range(0, b.num_rows, PACK):
                part = b.slice(lo, PACK)
                x = _matrix(part, dims)
                _, most = held.value.reach(x)
                order = np.argsort(most, axis=1)
                enough = np.cumsum(held.value.n[order], axis=1) >= min(k, int(held.value.n.sum()))
                radius = np.take_along_axis(most, order, 1)[np.arange(len(x)), enough.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.home(x)), pa.array(radius)], [*part.schema.names, "box", "radius"])

    if not n:
        return asked.select(F.struct(*at).alias("qid"), F.array().cast(f"array<struct<d:double,key:{kind}>>").alias("near"), F.lit(0).cast("long").alias("n_pairs"))
    homes = materialise(asked.mapInArrow(bounded, f"{columns}, box long, radius double").withColumn("id", F.monotonically_increasing_id()), "queries")
    counts = F.broadcast(spark.createDataFrame([(int(b), int(size[b])) for b in names], "box long, __n long"))  # at most BOXES rows

    def kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A radius from the distances to one block of the query's own box."""
        for b in batches:
            for i in range(b.num_rows):
                q, p = b.column("asked")[i].values, b.column("rows")[i].values
                d = _distances(*(np.column_stack([v.field(c).to_numpy() for c in at]) for v in (q, p)))
                r = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
                yield pa.RecordBatch.from_arrays([q.field("id"), pa.array(r)], ["id", "radius"])

    look = _packed(homes, "box", "id", [*at, "id"], PACK).select("box", F.col("rows").alias("asked"))
    block = _packed(placed, "box", "key", at, max(BLOCK, k), counts).where("part = 0").select("box", "rows")
    tight = look.join(block, "box").select("asked", "rows").mapInArrow(kth, "id long, radius double")
    radii = tight.union(homes.select("id", "radius")).groupBy("id").agg(F.min("radius").alias("radius"))  # a home may have no block of its own
    known = materialise(homes.drop("radius").join(radii, "id"), "radii")

    rows = max(BOX_ROWS, GROUP // dims)
    per = lambda n: int(np.clip(-(-n // 16), BOX_ROWS, rows))  # noqa: E731  some groups on small input too, for all cores
    grouped, plan = _dealt(placed, names, size[names], per(int(size.sum())), "key")
    asking = known.groupBy("box").count().orderBy("box").collect()  # at most 2 * BOXES rows
    packs, _ = _dealt(known, [r[0] for r in asking], [r[1] for r in asking], per(sum(r[1] for r in asking)), "id")
    whose = [range(first, first + parts) for _, first, parts in plan]  # groups of each of the boxes

    def points_of(t: pa.Table) -> pa.Table:
        """A group of points as one row: coordinates, keys, boxes and ranks of the keys, by box and key."""
        t = t.sort_by("key").append_column("rank", pa.array(np.arange(t.num_rows))).sort_by([("box", "ascending"), ("rank", "ascending")])
        x = np.column_stack([t.column(c).to_numpy() for c in at]).astype(float)
        return pa.table({"group": t.column("group")[:1], "x": pa.array([x.tobytes()], pa.binary()), **{c: _whole(t.column(c)) for c in ("key", "box", "rank")}})

    def queries_of(t: pa.Table) -> pa.Table:
        """A group of queries as one row, with the groups of points that their balls meet."""
        t = t.sort_by("box")
        x, radius = np.column_stack([t.column(c).to_numpy() for c in at]).astype(float), t.column("radius").to_numpy()
        met = np.zeros(len(names), bool)
        for lo in range(0, len(x), PACK):
            met |= (held.value.reach(x[lo : lo + PACK])[0] <= radius[lo : lo + PACK, None] * (1 + 1e-9)).any(axis=0)
        meets = sorted({g for b in np.flatnonzero(met) for g in whose[b]})
        return pa.table({"meets": pa.array([meets], pa.list_(pa.int64())), "asked": pa.array([x.tobytes()], pa.binary()), "id": _whole(t.column("id")), "radius": _whole(radius)})

    blocks = materialise(grouped.groupBy("group").applyInArrow(points_of, f"group long, x binary, key array<{kind}>, box array<long>, rank array<long>"), "points", instead_of=(placed,))
    asks = materialise(packs.groupBy("group").applyInArrow(queries_of, "meets array<long>, asked binary, id array<long>, radius array<double>"), "asks", instead_of=(known,))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of a group of points for each query of a group, if they can be among those of all points."""
        seen: dict[int, tuple] = {}  # ids, radii and pairs of the groups of queries after the groups of points that this task has had
        for b in batches:
            for i in range(b.num_rows):
                q, x = (np.frombuffer(b.column(c)[i].as_buffer(), float).reshape(-1, dims) for c in ("asked", "x"))
                ids, box, rank = (b.column(c)[i].values.to_numpy() for c in ("id", "box", "rank"))
                _, radius, pairs = seen.setdefault(int(ids[0]), (ids, b.column("radius")[i].values.to_numpy() * (1 + 1e-9), np.zeros(len(ids), np.int64)))
                edges = np.append(np.flatnonzero(np.diff(box, prepend=-1)), len(box))
                of = np.searchsorted(names, box[edges[:-1]])
                for lo in range(0, len(q), TABLE[0]):
                    part, r = q[lo : lo + TABLE[0]], radius[lo : lo + TABLE[0]]
                    meets, got = held.value.reach(part, of)[0] <= r[:, None], []
                    for j in range(len(of)):
                        if len(some_q := np.flatnonzero(meets[:, j])):
                            for start in range(edges[j], edges[j + 1], TABLE[1]):
                                block = x[start : min(start + TABLE[1], edges[j + 1])]
                                who, where, d = _within(part[some_q], block, r[some_q])
                                pairs[lo + some_q] += len(block)
                                got.append((some_q[who], where + start, d))
                    if not got:
                        continue
                    who, where, d = (np.concatenate(c) for c in zip(*got))
                    best = _first(who, d, rank[where], k)
                    who, where, d = who[best], where[best], d[best]
                    last = np.bincount(who, minlength=len(part)) == k
                    ends = np.flatnonzero(np.diff(who, append=-1))
                    ends = ends[last[who[ends]]]
                    r[who[ends]] = np.minimum(r[who[ends]], d[ends] * (1 + 1e-9))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + who]), pa.array(d), b.column("key")[i].values.take(pa.array(where)), pa.array(np.zeros(len(who), np.int64))], ["id", "d", "key", "n_pairs"])
                keys = b.column("key").type.value_type
        for ids, _, pairs in seen.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.float64()), pa.nulls(len(ids), keys), pa.array(pairs)], ["id", "d", "key", "n_pairs"])

    # no key: a task for some groups of either side, read from the tables as they are
    pairs = asks.join(blocks.hint("shuffle_replicate_nl"), F.array_contains("meets", F.col("group"))).select("asked", "id", "radius", "x", "key", "box", "rank")
    found = pairs.mapInArrow(nearest, f"id long, d double, key {kind}, n_pairs long")
    near = F.slice(F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "key")))), 1, k).alias("near")
    answers = found.groupBy("id").agg(near, F.sum("n_pairs").alias("n_pairs"))
    return materialise(answers.join(homes, "id").select(F.struct(*at).alias("qid"), "near", "n_pairs"), "nearest", instead_of=(homes, blocks, asks))
