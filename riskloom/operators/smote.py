"""SMOTE: growing the smaller classes with points between near neighbours (Chawla et al. 2002).

The neighbours are exact, in any number of features, and no class is compared pair by pair:
see ``metric``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import quoted
from ..functions.scalars import hash_key, unit
from ..session import write_out
from .lookup import attach_local, local_table
from .metric import nearest_lists
from .split import SEED, class_sizes, mark_lowest

# Fixed value: neighbours a synthetic point may lean towards.
NEIGHBOURS = 5
CELL_ROWS = 2_000  # points of a cell
BLOCK_ROWS = 4_096  # synthetic rows made from one input row of a stage


def _with_number(df: DataFrame, values: dict, name: str) -> DataFrame:
    """Add a number that each class has."""
    kinds = T.StructType([df.schema["_c"], T.StructField(name, T.LongType())])
    return attach_local(df, local_table(df.sparkSession, list(values.items()), kinds), ["_c"])


def nearest_in_class(points: DataFrame, width: int, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(_c, _id, _v, near): every point with its k nearest neighbours of the same class, never
    itself; equally near ones come by id.

    ``points`` holds class ``_c``, a unique ``_id`` (bigint or text) and feature array ``_v``.
    """
    points = write_out(points.select("_c", "_id", "_v"), "points")
    lists = nearest_lists(points, width, k, cell_rows).select(F.col("_c").alias("_k"), F.col("_v").alias("_w"), "near")
    joined = points.join(lists, (F.col("_c") == F.col("_k")) & (F.col("_v") == F.col("_w")))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("_id")), 1, k)
    return joined.select("_c", "_id", "_v", others.alias("near"))


def smote(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    id_col: str,
    neighbours: int = NEIGHBOURS,
    seed: int = SEED,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The rows plus synthetic ones that bring every class to the size of the largest.

    Columns: ``id_col`` (null on synthetic rows), the features and the target. Classes
    draw on their rows evenly; which of the k neighbours and how far along is hashed
    from the row id, so a re-run gives the same points. Unchanged if some class has
    fewer than two rows.
    """
    rows = df.select(
        quoted(id_col), *[quoted(c).cast("double").alias(c) for c in features], quoted(target)
    )
    sizes = class_sizes(rows, target)
    most = max(sizes.values(), default=0)
    short = {c: n for c, n in sizes.items() if n < most}
    if not short or min(sizes.values()) < 2:
        return rows
    k = min(neighbours, min(sizes.values()) - 1)
    whole = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    points = rows.filter(quoted(target).isin(list(short))).select(
        quoted(target).alias("_c"), quoted(id_col).cast("bigint" if whole else "string").alias("_id"),
        F.array(*[quoted(c) for c in features]).alias("_v"),
    )
    near = nearest_in_class(points, len(features), k, cell_rows)
    need = {c: most - n for c, n in short.items()}
    draws = _drawn(near, short, need, seed)
    which = F.pmod(hash_key(F.concat_ws("|", "_id", "_draw"), f"{seed}|neighbour"), F.size("near")) + 1
    along = unit(F.concat_ws("|", "_id", "_draw"), f"{seed}|along")
    towards = F.element_at("near", which.cast("int"))["v"]
    made = draws.select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
        *[(F.col("_v")[i] + along * (towards[i] - F.col("_v")[i])).alias(c) for i, c in enumerate(features)],
        F.col("_c").alias(target),
    )
    return rows.unionByName(made)


def _drawn(near: DataFrame, short: dict, need: dict, seed: int) -> DataFrame:
    """Each row as often as its class needs, numbered by ``_draw``: all rows of a class equally
    often, those of the lowest hash once more. A row drawn very often is multiplied in two steps."""
    near = _with_number(near, {c: need[c] // short[c] for c in need}, "_base")
    extra = {c: need[c] % short[c] for c in need}
    marked = mark_lowest(near, "_id", "_c", extra, short, seed, "_extra")
    times = marked.withColumn("_times", (F.col("_base") + F.col("_extra")).cast("bigint")).filter("_times > 0")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / BLOCK_ROWS))
    spread = times.withColumn("_block", F.explode(blocks))
    if max(need[c] // short[c] for c in need) > BLOCK_ROWS:
        spread = spread.repartition("_id", "_block")
    first = F.col("_block") * BLOCK_ROWS
    last = F.least(first + BLOCK_ROWS, F.col("_times")) - 1
    return spread.withColumn("_draw", F.explode(F.sequence(first, last)))
