"""Synthetic water samples whose every value is a function of the row id.

Nothing is drawn from a sequence, so rows can be made in any order on any executor, a
re-run gives the same table, and another engine can compute it too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import CORE_NUMERIC
from ..functions.scalars import hash_key, unit
from ..operators.quantiles import rank_cuts

# Distributions of the sample columns, outlier and missing shares, seed.
SEED = 42
ROWS = 1_000
OUTLIER_SHARE = 0.05
MISSING_SHARE = 0.05
COUNT_MEAN = 50
COUNT_OUTLIER_MEAN = 200
NORMAL = {
    "Particle_Size_um": (100.0, 30.0), "Microplastic_Size_mm_midpoint": (2.5, 1.5), "Density_midpoint": (1.0, 0.1),
    "pH": (7.0, 0.5), "Temperature_C": (20.0, 5.0),
}
UNIFORM = {"Risk_Score": (0.0, 100.0)}
OUTLIERS = {"Risk_Score": (150.0, 200.0), "Microplastic_Size_mm_midpoint": (10.0, 20.0), "Density_midpoint": (1.5, 2.0)}
CHOICES = {
    "Polymer_Type": ["PE", "PP", "PS", "PET", "PVC", "Nylon"],
    "Water_Source": ["River", "Lake", "Ocean", "Groundwater", "Tap"],
    "Risk_Level": ["Low", "Medium", "High", "Critical"],
    "Risk_Type": ["Type_A", "Type_B", "Type_C"],
    "Location": ["Urban", "Rural", "Industrial", "Coastal"],
    "Season": ["Winter", "Spring", "Summer", "Fall"],
    "Author": ["Author_A", "Author_B", "Author_C"],
    "Source": ["Source_1", "Source_2", "Source_3"],
}
SHARES = {"Risk_Level": [0.3, 0.35, 0.25, 0.1], "Risk_Type": [0.5, 0.3, 0.2]}
ORDER = [
    "Sample_ID", "MP_Count_per_L", "Particle_Size_um", "Microplastic_Size_mm_midpoint", "Density_midpoint",
    "Polymer_Type", "Water_Source", "pH", "Temperature_C", "Risk_Score", "Risk_Level", "Risk_Type", "Location",
    "Season", "Author", "Source",
]


def _draw(name: str, seed: int, use: str = "value") -> Column:
    return unit(F.col("_id"), f"{seed}|{name}|{use}")


def _normal(name: str, seed: int, mean: float, std: float) -> Column:
    """Box-Muller on two hashed uniforms."""
    radius = F.sqrt(-2 * F.log(1 - _draw(name, seed, "radius")))
    return mean + std * radius * F.cos(2 * math.pi * _draw(name, seed, "angle"))


def _poisson(u: Column, mean: int) -> Column:
    """Inverse distribution function: how many steps of the cumulative table lie at or below u."""
    steps, total, k = [], 0.0, 0
    while total < 1 - 1e-12:
        total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        steps.append(total)
        k += 1
    table = F.array(*[F.lit(s) for s in steps])
    return F.size(F.filter(table, lambda s: s <= u)).cast("double")


def _choice(name: str, seed: int) -> Column:
    values = CHOICES[name]
    shares = SHARES.get(name, [1 / len(values)] * len(values))
    u, total, pick = _draw(name, seed), 0.0, None
    for value, share in zip(values[:-1], shares):
        total += share
        pick = F.when(u < total, value) if pick is None else pick.when(u < total, value)
    return pick.otherwise(values[-1])


def sample_for(ids: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """A sample row for every id: exactly 5 % outliers per core column, 5 % missing by chance."""
    rows = ids.select(F.col(id_col).cast("bigint").alias("_id"))
    n = rows.count()
    spread = int(n * OUTLIER_SHARE)
    rows = _with_outlier_flags(rows, spread, n, seed)
    value: dict[str, Column] = {"Sample_ID": F.concat(F.lit("MP_"), F.lpad(F.col("_id").cast("string"), 4, "0"))}
    value["Sample_ID"] = F.when(F.col("_id") > 9999, F.concat(F.lit("MP_"), F.col("_id").cast("string"))).otherwise(value["Sample_ID"])
    value["MP_Count_per_L"] = _poisson(_draw("MP_Count_per_L", seed), COUNT_MEAN)
    value |= {c: _normal(c, seed, *p) for c, p in NORMAL.items()}
    value |= {c: lo + (hi - lo) * _draw(c, seed) for c, (lo, hi) in UNIFORM.items()}
    value |= {c: _choice(c, seed) for c in CHOICES}
    far = {c: lo + (hi - lo) * _draw(c, seed, "outlier") for c, (lo, hi) in OUTLIERS.items()}
    far["MP_Count_per_L"] = _poisson(_draw("MP_Count_per_L", seed, "outlier"), COUNT_OUTLIER_MEAN)
    for c in CORE_NUMERIC:
        value[c] = F.when(F.col(f"_far_{c}"), far[c]).otherwise(value[c])
    for c in [*NORMAL, *UNIFORM, "MP_Count_per_L"]:
        value[c] = F.when(_draw(c, seed, "missing") >= MISSING_SHARE, value[c])
    return rows.select(*[value[c].alias(c) for c in ORDER])


def _with_outlier_flags(rows: DataFrame, count: int, n: int, seed: int) -> DataFrame:
    """A flag per core column on exactly ``count`` rows, those of the lowest hash."""
    if count == 0:
        return rows.withColumns({f"_far_{c}": F.lit(False) for c in CORE_NUMERIC})

    def pick(c: str) -> Column:
        return hash_key(F.col("_id"), f"{seed}|{c}|pick")

    picks = [F.struct(F.lit(c).alias("_column"), pick(c).alias("_pick")) for c in CORE_NUMERIC]
    edges = rank_cuts(
        rows.select("_id", F.inline(F.array(*picks))), "_column", "_pick", "_id",
        {c: [count] for c in CORE_NUMERIC}, {c: n for c in CORE_NUMERIC},
    )
    return rows.withColumns(
        {
            f"_far_{c}": F.struct(pick(c).alias("k"), F.col("_id").alias("t"))
            <= F.struct(F.lit(edges[c][0][0]).alias("k"), F.lit(edges[c][0][1]).alias("t"))
            for c in CORE_NUMERIC
        }
    )


def generate_sample(spark: SparkSession, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    return sample_for(spark.range(rows), "id", seed)
