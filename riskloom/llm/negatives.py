"""Hard negatives through angular triangle filtering.

1. Every vector is scaled to integers and stored with its norm and its angles to a few
   reference directions. Vectors lie in the cell of their nearest direction; sorted by cell
   and angle they are packed into blocks of bounded bytes, as are the anchors.
2. The angle between two vectors lies between ``|s - t|`` and ``min(s + t, 2 pi - s - t)``
   for their angles s, t to a direction. Over all directions that gives an interval of
   cosines, and times the norms, widened by all rounding, bounds of the score. The same
   bounds over the ranges of two blocks drop pairs of blocks before any vector moves.
3. Positives: the block nearest to an anchor block gives each anchor a first least score.
   In what is left, only vectors of the label whose upper bound reaches the least score so
   far are scored.
4. Negatives: only vectors of another label whose bounds overlap the window of one of the
   anchor's positives are scored.

Scores are exact: in doubles while the norms rule out anything above 2^53, in unbounded
integers beyond. Anchors meet all other rows in blocks; a label, cell or vector that holds
most rows is spread over as many blocks as its rows fill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_out

_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Mine:
    """``anchors_every``: ids that it divides are anchors. ``negative_low`` and
    ``negative_high``: percent of the positive's score. The directions come from a sample of
    ``sample`` vectors; blocks hold up to ``block_rows`` vectors and ``block_bytes``."""

    anchors_every: int = 50
    positives: int = 5
    negatives: int = 3
    scale: int = 256
    negative_low: int = 50
    negative_high: int = 95
    directions: int = 8
    sample: int = 2000
    block_rows: int = 2048
    anchor_rows: int = 256
    block_bytes: int = 2 << 20
    blocks_a_task: int = 16


def _record(dim: int, directions: int) -> np.dtype:
    return np.dtype(
        [("row", "<i8"), ("id", "<i8"), ("none", "?"), ("label", "<i8"), ("norm", "<f8"), ("angles", "<f8", (directions,)), ("v", "<f8", (dim,))]
    )


def _slack(dim: int) -> float:
    """More than an angle can be off by rounding: an arc cosine near 1 is off by the root."""
    return 4 * math.sqrt((dim + 1) * 2.3e-16) + 1e-9


def _directions(sample: list[tuple[int, list[float]]], mine: Mine) -> dict[int, np.ndarray]:
    """Per dimension: unit vectors of the sample, each as far as possible from those before."""
    out = {}
    for dim in {d for d, _ in sample}:
        own = [x for d, x in sample if d == dim]
        v = np.floor(mine.scale * np.array(own, float).reshape(len(own), dim))
        norm = np.sqrt((v * v).sum(axis=1))
        v = v[norm > 0] / norm[norm > 0, None]
        chosen, near = [], np.full(len(v), -np.inf)
        while len(v) and len(chosen) < mine.directions:
            k = int(near.argmin())
            chosen.append(v[k])
            near = np.maximum(near, v @ v[k])
        out[dim] = np.array(chosen).reshape(len(chosen), dim)
    return out


def _filled(known: dict[int, np.ndarray], dim: int, mine: Mine) -> np.ndarray:
    """The directions of a dimension; where the sample gives fewer, seeded ones are added."""
    have = known.get(dim, np.empty((0, dim)))
    more = np.random.default_rng(dim).standard_normal((mine.directions - len(have), dim))
    more /= np.maximum(np.sqrt((more * more).sum(axis=1, keepdims=True)), 1e-300)
    return np.concatenate([have, more])


_PLACED = "dim int, cell int, angle double, id bigint, data binary"


def _place(known: dict[int, np.ndarray], mine: Mine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = dict[int, np.ndarray]()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column("v")
                dims = np.array([len(x) for x in vectors])
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    directions = cache.setdefault(dim, _filled(known, dim, mine))
                    v = np.floor(mine.scale * part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim))
                    out = np.zeros(len(v), _record(dim, mine.directions))
                    out["v"], out["norm"] = v, np.sqrt((v * v).sum(axis=1))
                    cosine = (v / np.maximum(out["norm"], 1e-300)[:, None]) @ directions.T
                    out["angles"] = np.arccos(np.clip(cosine, -1, 1))
                    out["row"], out["label"] = part.column("row").to_numpy(), part.column("label").to_numpy()
                    out["none"] = part.column("id").is_null().to_numpy(zero_copy_only=False)
                    out["id"] = part.column("id").fill_null(_NONE).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(v), dim, np.int32)), pa.array(out["angles"].argmin(axis=1).astype(np.int32)),
                            pa.array(out["angles"].min(axis=1)), part.column("id"), pa.array([r.tobytes() for r in out], pa.binary()),
                        ],
                        ["dim", "cell", "angle", "id", "data"],
                    )

    return run


_BLOCK = "dim int, n bigint, lo array<double>, hi array<double>, small double, large double, data binary"


def _pack(mine: Mine, most: int):
    """Sorted rows as blocks of one cell each."""

    def block(dim: int, rows: list[bytes]) -> dict:
        data = b"".join(rows)
        r = np.frombuffer(data, _record(dim, mine.directions))
        lo, hi = r["angles"].min(axis=0), r["angles"].max(axis=0)
        return {"dim": dim, "n": len(r), "lo": lo, "hi": hi, "small": r["norm"].min(), "large": r["norm"].max(), "data": data}

    schema = pa.schema(
        [("dim", pa.int32()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("small", pa.float64()), ("large", pa.float64()), ("data", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for dim, cell, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "cell", "data"))):
                if rows and ((dim, cell) != at or len(rows) >= most or len(rows) * len(data) >= mine.block_bytes):
                    yield pa.RecordBatch.from_pylist([block(at[0], rows)], schema)
                    rows = []
                at = dim, cell
                rows.append(data)
        if rows:
            yield pa.RecordBatch.from_pylist([block(at[0], rows)], schema)

    return run


def _blocks(placed: DataFrame, mine: Mine, most: int, name: str) -> DataFrame:
    order = ["dim", "cell", "angle", F.xxhash64("data")]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions("dim", "cell", "angle").select("dim", "cell", "data")
    return write_out(ranged.mapInArrow(_pack(mine, most), _BLOCK).withColumn(name, F.monotonically_increasing_id()), f"mine-{name}")


def _bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all rows of ``a`` with all rows of ``b``."""
    dim = a.dtype["v"].shape[0]
    least, most = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for k in range(a.dtype["angles"].shape[0]):
        s, t = a["angles"][:, k, None], b["angles"][None, :, k]
        np.maximum(least, np.abs(s - t), out=least)
        total = s + t
        np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
    norm = a["norm"][:, None] * b["norm"][None, :]
    spare = 1 + 1e-9 * norm
    low = norm * np.cos(np.clip(most + _slack(dim), 0, np.pi)) - spare
    return low, norm * np.cos(np.clip(least - _slack(dim), 0, np.pi)) + spare


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``b``."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if a["norm"].max() * b["norm"].max() < 2**53:
        return (a["v"] @ b["v"].T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a["v"]], [[int(x) for x in row] for row in b["v"]]
    top = np.iinfo(np.int64).max
    return np.array([[max(-top, min(top, sum(x * y for x, y in zip(p, q)))) for q in whole[1]] for p in whole[0]], np.int64)


def _best(k: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indexes of the first k by score from the top, then id, then row."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]]


class _Top:
    """The first k rows that one list has seen."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.row = k, *(np.empty(0, np.int64) for _ in range(3))

    def least(self) -> int | None:
        """What a score must reach to get in."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.row, rows)))
        at = _best(self.k, score, ids, rows)
        self.score, self.id, self.row = score[at], ids[at], rows[at]


def _scored(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of a, rows of b, their scores) where ``mask`` asks for any."""
    left, right = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(left):
        return
    found, place = _scores(a[left], b[right]), np.full(len(b), -1)
    place[right] = np.arange(len(right))
    for x, k in enumerate(left.tolist()):
        at = np.flatnonzero(mask[k])
        yield k, at, found[x, place[at]]


def _positive_mask(a: np.ndarray, b: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Vectors of the anchor's label, not itself, whose bound reaches its least score."""
    mask = (a["label"][:, None] == b["label"][None, :]) & (a["row"][:, None] != b["row"][None, :])
    _, high = _bounds(a, b)
    return mask & (high >= floors[:, None])


def _floors(mine: Mine):
    """From each anchor block beside its nearest block: what a positive must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = _record(r["dim"], mine.directions)
                a, b = np.frombuffer(r["data"], kind), np.frombuffer(r["other"], kind)
                floors = np.full(len(a), -np.inf)
                for k, at, score in _scored(a, b, _positive_mask(a, b, floors)):
                    if len(at) >= mine.positives:
                        floors[k] = np.partition(score, len(score) - mine.positives)[len(score) - mine.positives]
                yield pa.RecordBatch.from_pylist([{"a": r["a"], "floors": floors.tobytes(), "least": floors.min()}])

    return run


_POSITIVE = "a bigint, place int, row bigint, id bigint, score bigint"


def _positives(mine: Mine):
    """A group: one anchor block, and some of the blocks that it meets."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {c: [] for c in ("a", "place", "row", "id", "score")}
        for own in anchors.to_pylist():
            kind = _record(own["dim"], mine.directions)
            a, floors = np.frombuffer(own["data"], kind), np.frombuffer(own["floors"]).copy()
            tops = [_Top(mine.positives) for _ in a]
            for data in blocks.column("data"):
                b = np.frombuffer(data.as_py(), kind)
                for k, at, score in _scored(a, b, _positive_mask(a, b, floors)):
                    tops[k].add(score, b["id"][at], b["row"][at])
                    if (least := tops[k].least()) is not None:
                        floors[k] = max(floors[k], least)
            for k, top in enumerate(tops):
                out["a"] += [own["a"]] * len(top.id)
                out["place"] += [k] * len(top.id)
                out["row"] += top.row.tolist()
                out["id"] += [None if x == _NONE else x for x in top.id.tolist()]
                out["score"] += top.score.tolist()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds)})

    return run


_NEGATIVE = "a bigint, place int, k int, anchor_id bigint, positive_id bigint, positive_score bigint, row bigint, negative_id bigint, negative_score bigint"


def _negatives(mine: Mine):
    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        for own in anchors.to_pylist():
            kind = _record(own["dim"], mine.directions)
            a, by = np.frombuffer(own["data"], kind), {}
            for p in own["positives"]:
                if p["score"] >= 0:  # a window of a negative score is empty
                    by.setdefault(p["place"], []).append((p, _Top(mine.negatives)))
            for data in blocks.column("data"):
                b = np.frombuffer(data.as_py(), kind)
                low, high = _bounds(a, b)
                mask = np.zeros(low.shape, bool)
                for k, wanted in by.items():
                    for p, top in wanted:
                        floor = max(mine.negative_low * p["score"] / 100 - 1, -np.inf if top.least() is None else top.least())
                        mask[k] |= (high[k] >= floor) & (low[k] <= mine.negative_high * p["score"] / 100 + 1)
                mask &= a["label"][:, None] != b["label"][None, :]
                for k, at, score in _scored(a, b, mask):
                    for p, top in by[k]:
                        # In Python integers where hundredfold scores could leave 64 bits.
                        exact = score.astype(object) if p["score"] > 2**55 else score
                        fits = (mine.negative_low * p["score"] <= 100 * exact) & (100 * exact <= mine.negative_high * p["score"])
                        fits = np.flatnonzero(fits.astype(bool))
                        top.add(score[fits], b["id"][at[fits]], b["row"][at[fits]])
            for k, wanted in by.items():
                for p, top in wanted:
                    for score, other, row in zip(top.score.tolist(), top.id.tolist(), top.row.tolist()):
                        rows.append(
                            {
                                "a": own["a"], "place": k, "k": p["k"], "anchor_id": int(a["id"][k]), "positive_id": p["id"],
                                "positive_score": p["score"], "row": row, "negative_id": None if other == _NONE else other, "negative_score": score,
                            }
                        )
        kinds = [("a", pa.int64()), ("place", pa.int32()), ("k", pa.int32())]
        kinds += [(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "row", "negative_id", "negative_score")]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    return run


def _pairs(anchors: DataFrame, blocks: DataFrame, lanes: int = 64) -> DataFrame:
    """(a, b, gap, low, high): summaries of the blocks that could meet, with bounds of the angle's
    least value and of the scores. Blocks go to every lane, an anchor block to one of them."""
    summary = ["dim", "lo", "hi", "small", "large"]

    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key), *[F.col(c).alias(c if c == "dim" else f"{key}_{c}") for c in summary])

    left = named(anchors, "a").withColumn("lane", F.pmod(F.xxhash64("a"), F.lit(lanes)))
    right = named(blocks, "b").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = left.join(right.withColumn("lane", F.col("lane").cast("bigint")), ["dim", "lane"])

    def over(fold, x: str, y: str, of) -> Column:
        return fold(F.zip_with(x, y, of))

    slack = 4 * F.sqrt((F.col("dim") + 1) * 2.3e-16) + 1e-9
    gap = F.greatest(
        F.lit(0.0), over(F.array_max, "a_lo", "b_hi", lambda x, y: x - y) - slack, over(F.array_max, "b_lo", "a_hi", lambda x, y: x - y) - slack
    )
    far = F.least(
        F.lit(math.pi), over(F.array_min, "a_hi", "b_hi", lambda x, y: x + y) + slack,
        over(F.array_min, "a_lo", "b_lo", lambda x, y: 2 * math.pi - x - y) + slack,
    )
    spare = 1 + 1e-9 * F.col("a_large") * F.col("b_large")

    def end(angle: str, up: bool) -> Column:
        near, wide = F.col("a_small") * F.col("b_small"), F.col("a_large") * F.col("b_large")
        return F.when((F.cos(angle) >= 0) == F.lit(up), F.cos(angle) * wide).otherwise(F.cos(angle) * near)

    both = both.select("a", "b", gap.alias("gap"), far.alias("far"), "a_small", "a_large", "b_small", "b_large")
    return both.select("a", "b", "gap", (end("far", False) - spare).alias("low"), (end("gap", True) + spare).alias("high"))


def _meet(pairs: DataFrame, anchors: DataFrame, blocks: DataFrame, mine: Mine, count: int, task, schema: str) -> DataFrame:
    """Each anchor block with the blocks of its pairs, some of them a group."""
    parts = max(1, -(-count // mine.blocks_a_task))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part"))
    left = dealt.select("a", "part").distinct().join(anchors, "a")
    right = dealt.join(blocks.select("b", "data"), "b").select(F.col("a").alias("x"), F.col("part").alias("y"), "data")
    return left.groupBy("a", "part").cogroup(right.groupBy("x", "y")).applyInArrow(task, schema)


def mine_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", mine: Mine = Mine()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector, or a null, infinite or undefined component, take no
    part, nor do those with a component above 1e150 in size, whose square is none. Rows of
    other lengths than the anchor's are not compared with it; vectors may be empty or zero.
    Every row counts for itself, repeated rows and ids included; equal scores come by id,
    rows without an id last. Scores beyond 64 bits are held at their ends. An empty table
    gives an empty table. Other columns of ``vectors`` are not read, whatever their names.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    sample = rows.select(F.size("v").alias("dim"), "v").orderBy(F.xxhash64("v", "id")).limit(mine.sample).collect()
    known = _directions([(r.dim, r.v) for r in sample], mine)
    placed = write_out(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_place(known, mine), _PLACED), "mine-rows")
    blocks = _blocks(placed.drop("id"), mine, mine.block_rows, "b")
    anchors = _blocks(placed.where(F.col("id") % mine.anchors_every == 0).drop("id"), mine, mine.anchor_rows, "a")
    count = blocks.count()
    pairs = write_out(_pairs(anchors, blocks), "mine-pairs")

    nearest = pairs.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("n")).select("a", "n.b")
    beside = nearest.join(blocks.select("b", F.col("data").alias("other")), "b").join(anchors.select("a", "dim", "data"), "a")
    floors = write_out(beside.select("a", "dim", "data", "other").mapInArrow(_floors(mine), "a bigint, floors binary, least double"), "mine-floors")
    own = anchors.select("a", "dim", "data").join(floors.select("a", "floors"), "a")
    reach = pairs.join(floors.select("a", "least"), "a").where("high >= least")
    found = _meet(reach, own, blocks, mine, count, _positives(mine), _POSITIVE)
    order = Window.partitionBy("a", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= mine.positives)
    found = write_out(found, "mine-positives")

    each = found.groupBy("a").agg(
        F.collect_list(F.struct("place", "k", "id", "score")).alias("positives"),
        (F.min(F.when(F.col("score") >= 0, F.col("score"))) * (mine.negative_low / 100) - 1).alias("least"),
        (F.max("score") * (mine.negative_high / 100) + 1).alias("most"),
    )
    own = anchors.select("a", "dim", "data").join(each.select("a", "positives"), "a")
    reach = pairs.join(each.select("a", "least", "most"), "a").where("high >= least and low <= most")
    mined = _meet(reach, own, blocks, mine, count, _negatives(mine), _NEGATIVE)
    order = Window.partitionBy("a", "place", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "row")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mine.negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """Labels moved to the next one where ``every`` divides the id."""
    moved = F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col))
    return vectors.withColumn(label_col, moved)
