"""Exact nearest neighbours within classes, through metric partitions.

Equal points of a class are one point with its smallest ids. A tree of median cuts, made from
a sample, puts points that lie together into one leaf; points in the order of the leaves are
packed into blocks of bounded size, whatever share of them one class or leaf holds, and a
block's points into cells of at most ``cell_rows``. Blocks are what moves between tasks, so
that small cells cost no more rows of a table. A point first searches its own block, which
gives it a reach; it is then sent to the blocks alone that may have something within it.

By the triangle inequality a cell or block has nothing within reach r of a point whose
distance to some centre lies more than r outside the range of its points' distances to that
centre; ranges of two blocks rule out the whole pair before any point moves. So the number
of features plays no part, only how the points lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import write_out

CENTRES = 32
SAMPLE_ROWS = 4_000  # points the tree and centres are made from, and
SAMPLE_SHARE, SAMPLE_MOST = 200, 50_000  # one of so many of large tables; the result doesn't depend on them
LEAF_SAMPLES = 8
BLOCK_ROWS = 2_000  # points of a block of small cells
BLOCKS_A_TASK = 2
ASKED_ROWS = 256  # points compared at once
OTHERS_A_ROW = 2_000  # blocks that one row lists
LANES = 64  # a class's blocks meet in as many joins of their own
SLACK = 1e-9  # of a distance: more than rounding can amount to


def _centres(sample: np.ndarray) -> np.ndarray:
    """Points of the sample, each as far as possible from those before."""
    chosen, near = [], np.full(len(sample), np.inf)
    while len(chosen) < min(CENTRES, len(sample)):
        chosen.append(sample[int(near.argmax())])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances, feature by feature: memory doesn't grow with the width."""
    d = np.zeros((len(points), len(others)))
    for j in range(points.shape[1]):
        d += (points[:, j, None] - others[None, :, j]) ** 2
    return d


def _matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def distinct_points(points: DataFrame, most: int) -> DataFrame:
    """(_c, _v, ids): each point of a class once, with its ``most`` smallest ids."""
    order = Window.partitionBy("_c", "_v").orderBy("_id")
    lowest = points.select("_c", "_v", "_id", F.row_number().over(order).alias("_n")).where(F.col("_n") <= most)
    return lowest.groupBy("_c", "_v").agg(F.sort_array(F.collect_list("_id")).alias("ids"))


class _Tree:
    """Median cuts of the widest feature, in heap order, all leaves at the same depth."""

    def __init__(self, sample: np.ndarray):
        self.depth = max(0, (len(sample) // LEAF_SAMPLES).bit_length() - 1)
        self.feature, self.cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
        parts = {0: sample}
        for node in range(2**self.depth - 1):
            mine = parts.pop(node)
            if len(mine):
                f = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
                self.feature[node], self.cut[node] = f, np.median(mine[:, f])
            left = mine[:, self.feature[node]] <= self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = mine[left], mine[~left]

    def leaf(self, values: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(values), np.int64), np.arange(len(values))
        for _ in range(self.depth):
            node = 2 * node + 1 + (values[row, self.feature[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _cell_order(values: np.ndarray, most: int) -> tuple[np.ndarray, list[int]]:
    """The points in an order in which cells of at most ``most`` lie together, and their sizes."""
    order, sizes, open_ = [], [], [np.arange(len(values))]
    while open_:
        mine = open_.pop()
        if len(mine) <= most:
            order.append(mine)
            sizes.append(len(mine))
            continue
        part = values[mine]
        f = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        by = np.argsort(part[:, f], kind="stable")
        open_ += [mine[by[len(by) // 2 :]], mine[by[: len(by) // 2]]]
    return np.concatenate(order), sizes


def _lists(values: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def blocks_of(distinct: DataFrame, width: int, cell_rows: int) -> tuple[DataFrame, np.ndarray]:
    """(block, _c, ids, v, cells, lo, hi), the points packed in the order of the tree's leaves with
    the sizes of their cells, and the centres that ``lo`` and ``hi`` are distances to."""
    rows = min(SAMPLE_MOST, max(SAMPLE_ROWS, distinct.count() // SAMPLE_SHARE))
    found = distinct.select("_v").orderBy(F.xxhash64("_v")).limit(rows).toArrow()
    sample = _matrix(found.column("_v"), width)
    sample = sample[np.isfinite(sample).all(axis=1)]
    centres = _centres(sample[:SAMPLE_ROWS]) if len(sample) else np.zeros((1, width))
    tree, most = _Tree(sample), max(cell_rows, BLOCK_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("_v"), width)
            leaf = tree.leaf(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf, pa.int32()), pa.array(np.sqrt(_distances(values, centres[:1])[:, 0]))],
                [*batch.schema.names, "leaf", "ring"],
            )

    kinds = dict(distinct.dtypes)
    placed = distinct.select("_c", "_v", "ids").mapInArrow(place, f"_c {kinds['_c']}, _v array<double>, ids {kinds['ids']}, leaf int, ring double")
    ordered = placed.repartitionByRange("_c", "leaf", "ring", F.xxhash64("_v")).sortWithinPartitions("_c", "leaf", "ring", "_v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, at = 0, None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            values = _matrix(t.column("_v"), width)
            order, sizes = _cell_order(values, cell_rows)
            ids, v = (t.column(c).combine_chunks().take(pa.array(order)) for c in ("ids", "_v"))
            dist = np.sqrt(_distances(values, centres))
            ends = [_lists(pa.array(f.reduce(dist, axis=0)), [len(centres)]) for f in (np.fmin, np.fmax)]
            return pa.RecordBatch.from_arrays(
                [t.column("_c").combine_chunks().slice(0, 1), _lists(ids, [len(ids)]), _lists(v.flatten(), [len(v) * width]),
                 _lists(pa.array(sizes, pa.int32()), [len(sizes)]), *ends], ["_c", "ids", "v", "cells", "lo", "hi"],
            )

        for batch in batches:
            start = 0
            for k, key in enumerate(batch.column("_c").to_pylist()):
                if rows and (key != at or rows >= most):
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    yield block()
                    held.clear()
                    rows, start = 0, k
                rows, at = rows + 1, key
            held.append(batch.slice(start))
        if rows:
            yield block()

    kind = f"_c {kinds['_c']}, ids array<{kinds['ids']}>, v array<double>, cells array<int>, lo array<double>, hi array<double>"
    return write_out(ordered.mapInArrow(pack, kind).withColumn("block", F.monotonically_increasing_id()), "blocks"), centres


class _Block:
    """A block's points in a task. ``names`` lists all ids, ``ranks`` their order."""

    def __init__(self, row: pa.RecordBatch, width: int, centres: np.ndarray):
        self.lists = row.column("ids").flatten()
        self.names, self.kept = self.lists.flatten(), row.column("v").flatten()
        self.v = self.kept.to_numpy(zero_copy_only=False).reshape(-1, width)
        self.dist = np.sqrt(_distances(self.v, centres))
        self.cells = row.column("cells").flatten().to_numpy()
        starts = np.cumsum(self.cells) - self.cells
        self.lo, self.hi = np.fmin.reduceat(self.dist, starts), np.fmax.reduceat(self.dist, starts)
        self.several = np.diff(self.lists.offsets.to_numpy())
        self.first = np.cumsum(self.several) - self.several
        names = self.names.to_pylist()
        self.ranks = np.empty(len(names), np.int64)
        self.ranks[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))

    def first_reach(self, k: int) -> np.ndarray:
        """Squared distances within which each point has k ids, from a few points beside it."""
        out, step = np.full(len(self.v), np.inf), 4 * k
        for at in range(0, len(self.v), step):
            part = slice(at, at + step)
            d = np.repeat(_distances(self.v[part], self.v[part]), self.several[part], axis=1)
            if d.shape[1] >= k:
                out[part] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return np.where(np.isnan(out), np.inf, out)

    def nearest(self, v: np.ndarray, dist: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(asking point, squared distance, id) of the first k ids within the squared reach, by
        point, distance and id, and with how many points each was compared."""
        got, compared = [], np.zeros(len(v), np.int64)
        for at in range(0, len(v), ASKED_ROWS):
            part = slice(at, at + ASKED_ROWS)
            hits = within(dist[part], reach[part], self.lo, self.hi)
            i, j = np.nonzero(np.repeat(hits, self.cells, axis=1))
            compared[part] = hits @ self.cells
            mine, d = v[part], np.zeros(len(i))
            for f in range(v.shape[1]):
                d += (mine[i, f] - self.v[j, f]) ** 2
            near = np.flatnonzero(d <= reach[part][i])
            i, j, d = i[near], j[near], d[near]
            several = self.several[j]
            name = np.repeat(self.first[j] - np.cumsum(several) + several, several) + np.arange(several.sum())
            i, d = np.repeat(i, several), np.repeat(d, several)
            order = np.lexsort((self.ranks[name], d, i))
            i, d, name = i[order], d[order], name[order]
            leading = np.arange(len(i)) - np.searchsorted(i, i) < k
            got.append((i[leading] + at, d[leading], name[leading]))
        return *(np.concatenate(x) for x in zip(*got)), compared

    def entries(self, d: np.ndarray, name: np.ndarray) -> pa.StructArray:
        """What ``nearest`` found as Arrow structs of d, id and v."""
        width, place = self.v.shape[1], np.searchsorted(self.first, name, "right") - 1
        v = _lists(pa.array(self.v[place].ravel()), np.full(len(place), width))
        return pa.StructArray.from_arrays([pa.array(d), self.names.take(pa.array(name)), v], ["d", "id", "v"])


def within(dist: np.ndarray, reach: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(point, range): whether a range of distances to centres may hold something within the squared reach."""
    out = np.ones((len(dist), len(lo)), bool)
    r = np.sqrt(reach)
    for c in range(dist.shape[1]):
        spare = r * (1 + SLACK) + SLACK * dist[:, c]
        out &= ((dist[:, c] - spare)[:, None] <= hi[None, :, c]) & ((dist[:, c] + spare)[:, None] >= lo[None, :, c])
    return out


def _own(width: int, k: int, centres: np.ndarray):
    """Every point's nearest of its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = _Block(row, width, centres)
                n = len(own.v)
                i, d, name, compared = own.nearest(own.v, own.dist, own.first_reach(k), k)
                counts = np.bincount(i, minlength=n)
                reach, full = np.full(n, np.inf), counts >= k
                reach[full] = d[np.cumsum(counts)[full] - 1]
                reach[np.isnan(own.dist).any(axis=1)] = 0.0  # near to nothing
                points = pa.StructArray.from_arrays(
                    [_lists(own.kept, np.full(n, width)), _lists(own.entries(d, name), counts), pa.array(compared)], ["v", "near", "compared"]
                )
                yield pa.RecordBatch.from_arrays(
                    [row.column("block"), row.column("_c"), _lists(points, [n]), _lists(pa.array(reach), [n]), pa.array([float(np.sqrt(reach.max()))])],
                    ["block", "_c", "points", "reach", "most"],
                )

    return run


def block_pairs(blocks: DataFrame, most: DataFrame) -> DataFrame:
    """(block, other, olo, ohi): the blocks of its class that may hold a neighbour of one of a block's points."""
    left = blocks.select("block", "_c", "lo", "hi").join(most, "block").withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(LANES)))
    right = blocks.select(
        F.col("block").alias("other"), F.col("_c").alias("_k"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint"))).alias("on"),
    )
    both = left.join(right, (F.col("_c") == F.col("_k")) & (F.col("lane") == F.col("on"))).where("block <> other")
    apart = F.greatest(
        F.array_max(F.zip_with("olo", "hi", lambda x, y: x - y)), F.array_max(F.zip_with("lo", "ohi", lambda x, y: x - y)), F.lit(0.0)
    )
    spare = SLACK * (F.col("most") + F.array_max("hi") + F.array_max("ohi"))
    return both.where(apart <= F.col("most") + spare).select("block", "other", "olo", "ohi")


def _asks(width: int, centres: np.ndarray):
    """A block's points for each other block that may have something within their reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                v = row.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                reach, dist = row.column("reach").flatten().to_numpy(), np.sqrt(_distances(v, centres))
                others = row.column("others").flatten()
                lo, hi = (_matrix(others.field(c), len(centres)) for c in ("olo", "ohi"))
                for to, hits in zip(others.field("other").to_pylist(), within(dist, reach, lo, hi).T):
                    place = np.flatnonzero(hits)
                    if len(place):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([to]), row.column("block"), _lists(pa.array(place), [len(place)]),
                             _lists(pa.array(v[place].ravel()), [len(place) * width]), _lists(pa.array(reach[place]), [len(place)])],
                            ["other", "block", "place", "v", "reach"],
                        )

    return run


def _answers(width: int, k: int, centres: np.ndarray, schema: pa.Schema):
    def run(asked: pa.Table, body: pa.Table) -> pa.Table:
        out = []
        if len(body):
            other = _Block(body.combine_chunks().to_batches()[0].slice(0, 1), width, centres)
            for row in asked.select(["block", "place", "v", "reach"]).to_batches():
                for at in range(row.num_rows):
                    one = row.slice(at, 1)
                    place, flat, reach = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("place", "v", "reach"))
                    v = flat.reshape(-1, width)
                    i, d, name, compared = other.nearest(v, np.sqrt(_distances(v, centres)), reach, k)
                    counts = np.bincount(i, minlength=len(v))
                    columns = [pa.array(np.full(len(v), one.column("block")[0].as_py())), pa.array(place), _lists(other.entries(d, name), counts), pa.array(compared)]
                    out.append(pa.Table.from_arrays(columns, ["block", "place", "near", "compared"]).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def nearest_lists(points: DataFrame, width: int, k: int, cell_rows: int) -> DataFrame:
    """(_c, _v, near, compared): for each distinct point the k + 1 nearest (d, id, v) of its
    class, its own ids among them, and with how many points it was compared."""
    distinct = write_out(distinct_points(points, k + 1), "distinct")
    blocks, centres = blocks_of(distinct, width, cell_rows)
    kinds = dict(blocks.dtypes)
    kind = kinds["ids"][len("array<array<") : -len(">>")]
    near = f"array<struct<d: double, id: {kind}, v: array<double>>>"
    parts = max(1, -(-blocks.count() // BLOCKS_A_TASK))
    body = blocks.select("block", "_c", "ids", "v", "cells")
    own = write_out(
        body.repartition(parts, "block").mapInArrow(
            _own(width, k + 1, centres),
            f"block bigint, _c {kinds['_c']}, points array<struct<v: array<double>, near: {near}, compared: bigint>>, reach array<double>, most double",
        ), "own",
    )
    pairs = block_pairs(blocks, own.select("block", "most")).withColumn("_part", F.pmod(F.xxhash64("other"), F.lit(-(-parts * BLOCKS_A_TASK // OTHERS_A_ROW))))
    listed = pairs.groupBy("block", "_part").agg(F.collect_list(F.struct("other", "olo", "ohi")).alias("others"))
    asking = listed.join(own.select("block", "reach"), "block").join(blocks.select("block", "v"), "block")
    asks = asking.repartition(parts, "block", "_part").select("block", "v", "reach", "others").mapInArrow(
        _asks(width, centres), "other bigint, block bigint, place array<bigint>, v array<double>, reach array<double>"
    )
    asks = write_out(asks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(parts))), "asks")
    asked = asks.select(F.col("other").alias("x"), F.col("lane").alias("y")).distinct().join(body.withColumnRenamed("block", "x"), "x")
    ids = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([
        ("block", pa.int64()), ("place", pa.int64()),
        ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", ids), ("v", pa.list_(pa.float64()))]))), ("compared", pa.int64()),
    ])
    answers = (
        asks.repartition(parts, "other", "lane").groupBy("other", "lane").cogroup(asked.repartition(parts, "x", "y").groupBy("x", "y"))
        .applyInArrow(_answers(width, k + 1, centres, schema), f"block bigint, place bigint, near {near}, compared bigint")
    )
    at_home = own.select("block", "_c", F.posexplode("points").alias("place", "p")).select(
        "block", F.col("place").cast("bigint").alias("place"), "_c", F.col("p.v").alias("_v"), F.col("p.near").alias("near"), F.col("p.compared").alias("compared")
    )
    every = at_home.unionByName(answers, allowMissingColumns=True)
    # A point lies in one block, so what the blocks give can be put together as it is.
    return every.groupBy("block", "place").agg(
        F.max("_c").alias("_c"), F.max("_v").alias("_v"),
        F.array_distinct(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)).alias("near"), F.sum("compared").alias("compared"),
    ).select("_c", "_v", "near", "compared")
