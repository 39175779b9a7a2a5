"""Near-duplicate vectors through a pivot-permutation index.

1. Vectors become unit vectors in double precision; equal vectors of a group form a class,
   and from here on only its first member works.
2. A bounded sample of classes gives the reference points. Each class is described by its
   nearest reference points in order, its permutation, cut after ``prefix`` places.
3. Inverted lists hold, for each group and reference point, the classes that name it. A
   list is dealt over blocks, so a task sees two blocks, never a whole list.
4. In a pair of blocks, two classes are candidates if they share at least ``shared``
   reference points, counted from the permutations; the list of their first shared point
   alone handles them. Candidates are verified by their cosine.
5. Tasks return for each class how many vectors it links with, and links that span each
   linked set, so their output grows with the members of a block, not with its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import write_out
from .graph import components


@dataclass(frozen=True)
class Pivots:
    """``points``: reference points; by default 2 * sqrt(classes), at least 64, at most ``most_points``."""

    cosine: float = 0.98
    points: int | None = None
    most_points: int = 4096
    prefix: int = 8
    shared: int = 3
    block_rows: int = 1024


def unit(values: list | None) -> np.ndarray | None:
    """The unit vector in double precision; None for null, empty, zero, null or non-finite parts."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, float)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()  # squares of very large or small parts stay in range
    return x / np.sqrt(x @ x)


def _units(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([None if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u in units], pa.binary()),
                    pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                ],
                ["id", "grp", "print", "unit"],
            )

    return vectors.mapInArrow(run, "id bigint, grp string, print binary, unit binary")


def permutations(classes: DataFrame, points: np.ndarray, how: Pivots) -> DataFrame:
    """``classes`` (grp, id, n, unit) with ``near``: the numbers of the nearest points, nearest first.

    Points of another length than a vector's are no points for it."""
    shared = classes.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for raw in batch.column(3):
                u = np.frombuffer(raw.as_py())
                fit = [k for k, p in enumerate(shared.value) if len(p) == len(u)]
                far = np.stack([shared.value[k] for k in fit]) @ u if fit else np.empty(0)
                near.append([fit[k] for k in np.argsort(-far, kind="stable")[: how.prefix]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    return classes.select("grp", "id", "n", "unit").mapInArrow(run, "grp string, id bigint, n bigint, unit binary, near array<int>")


def _link_task(how: Pivots):
    least = how.shared

    def link(rows: list[dict]) -> tuple[list, list, list]:
        a = [r for r in rows if r["block"] == r["i"]]
        b = a if rows[0]["i"] == rows[0]["j"] else [r for r in rows if r["block"] == r["j"]]
        if not a or not b:
            return [], [], []
        point = rows[0]["point"]
        ids = sorted({p for r in rows for p in r["near"]})
        at = {p: k for k, p in enumerate(ids)}

        def matrix(side: list[dict]) -> tuple[np.ndarray, np.ndarray]:
            named = np.zeros((len(side), len(ids)), np.float32)
            for k, r in enumerate(side):
                named[k, [at[p] for p in r["near"]]] = 1
            return named, np.stack([np.frombuffer(r["unit"]) for r in side])

        (named_a, unit_a), (named_b, unit_b) = matrix(a), matrix(b)
        before = at[point]
        common = named_a @ named_b.T
        # Lists as short as ``shared`` need all of their points.
        need = np.minimum(least, np.minimum(named_a.sum(axis=1)[:, None], named_b.sum(axis=1)[None, :]))
        chosen = (common >= need) & (named_a[:, :before] @ named_b[:, :before].T == 0)
        if b is a:
            chosen = np.triu(chosen, 1)
        x, y = np.nonzero(chosen)
        linked = np.concatenate(
            [
                np.einsum("ij,ij->i", unit_a[x[k : k + 65536]], unit_b[y[k : k + 65536]]) >= how.cosine
                for k in range(0, len(x), 65536)
            ] or [np.empty(0, bool)]
        )
        x, y = x[linked], y[linked]
        weight_a, weight_b = (np.array([r["n"] for r in side]) for side in (a, b))
        degree: dict[int, int] = {}
        for side, own, other, weight in ((a, x, y, weight_b), (b, y, x, weight_a)):
            for k, w in enumerate(np.bincount(own, weight[other], len(side)).astype(np.int64).tolist()):
                if w:
                    degree[side[k]["id"]] = degree.get(side[k]["id"], 0) + w
        top: dict[int, int] = {}

        def root(v: int) -> int:
            while top.setdefault(v, v) != v:
                top[v] = v = top[top[v]]
            return v

        spanning = []
        for k, m in zip(x.tolist(), y.tolist()):
            p, q = root(a[k]["id"]), root(b[m]["id"])
            if p != q:
                top[p] = q
                spanning.append((a[k]["id"], b[m]["id"]))
        pairs = [(v, None, w) for v, w in degree.items()] + [(v, u, None) for v, u in spanning]
        return tuple(map(list, zip(*pairs))) if pairs else ([], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in link(group)], ["a", "b", "w"])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["grp"], r["point"], r["i"], r["j"])
                if key != at and len(group) > 1:
                    yield done()
                if key != at:
                    group, at = [], key
                group.append(r)
        if len(group) > 1:
            yield done()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", how: Pivots = Pivots()) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of ``vectors``.

    Only vectors of one group and one length are compared. Null, empty and zero vectors,
    vectors with null or non-finite parts and those without a group link with nothing and
    are their own component. Rows that repeat an id with an equal vector count once. Rows
    without an id have a null component and are kept. An empty table gives an empty result.
    """
    vec = F.col(vec_col)
    group = F.concat_ws("/", F.size(vec), F.col(group_col).cast("string"))
    signed = write_out(
        _units(
            vectors.select(
                F.col(id_col).cast("bigint").alias("id"), F.when(F.col(group_col).isNotNull(), group).alias("grp"), vec.cast("array<double>").alias("v")
            )
        ),
        "units",
    )
    usable = signed.where("print is not null and grp is not null and id is not null")
    classes = write_out(
        usable.select("grp", "print", "id", "unit").dropDuplicates(["grp", "print", "id"]).groupBy("grp", "print")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit")),
        "classes",
    )
    count = how.points or min(how.most_points, max(64, math.ceil(2 * math.sqrt(classes.count()))))
    sample = classes.orderBy(F.xxhash64("print"), "grp").select("unit").limit(count).collect()  # at most most_points
    rows = permutations(classes, np.empty(0) if not sample else [np.frombuffer(r["unit"]) for r in sample], how)
    rows = write_out(rows, "permutations")
    lists = rows.select("grp", F.explode("near").alias("point")).groupBy("grp", "point").agg(F.count("*").alias("size"))
    lists = lists.where("size > 1").withColumn("parts", F.ceil(F.col("size") / how.block_rows).cast("int")).drop("size")
    member = rows.select("*", F.explode("near").alias("point")).join(lists, ["grp", "point"])
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    member = member.withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int")).select("*", other).select(
        "grp", "point", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "unit", "near"
    )
    keys = ["grp", "point", "i", "j"]
    found = member.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_task(how), "a bigint, b bigint, w bigint")
    found = write_out(found, "found")
    same_id = (
        usable.groupBy("id").agg(F.min(F.xxhash64("grp", "print")).alias("p"), F.max(F.xxhash64("grp", "print")).alias("q"))
        .where("p <> q").select(F.col("id").alias("a")).join(usable.select(F.col("id").alias("a"), "grp", "print"), "a")
        .join(classes.select("grp", "print", F.col("id").alias("b")), ["grp", "print"]).select("a", "b")
    )
    linked = components(found.where("b is not null").select("a", "b").unionByName(same_id))
    degree = found.where("w is not null").groupBy(F.col("a").alias("first")).agg(F.sum("w").alias("w"))
    facts = (
        classes.select("grp", "print", F.col("id").alias("first"), "n").join(degree, "first", "left")
        .join(linked.select(F.col("id").alias("first"), "component"), "first", "left")
        .select(
            "grp", "print", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("links"), F.coalesce("component", "first").alias("component")
        )
    )
    mark = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = signed.select("id", "grp", "print").join(facts, ["grp", "print"], "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("links")).alias("links"), mark.alias("component_id")).select(
        "id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
