"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import write_out


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (id, up) with ``up <= id`` to the top; each pass halves what is left of a path."""
    while True:
        parents = write_out(parents, "parents")
        above = parents.select(F.col("id").alias("up"), F.col("up").alias("top"))
        stepped = parents.join(above, "up", "left").select("id", "up", F.coalesce("top", "up").alias("top"))
        if stepped.where("top <> up").isEmpty():
            return parents
        parents = stepped.select("id", F.col("top").alias("up"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that can be reached, for every id that has a link.

    Each round points every vertex at its smallest neighbour, follows those pointers to
    their roots and replaces the links by links between roots, until none is left. A
    vertex with very many links is only grouped (map-side minimum) and the large side of
    a join. Links with a null end and loops count for nothing; an empty table gives an
    empty result. Every round is a written table, so lineage stays short.
    """
    edges = links.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x <> y")
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    found = None
    while True:
        edges = write_out(edges, "links")
        if edges.isEmpty():
            break
        roots = _roots(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("up")))
        if found is None:
            found = roots.select("id", F.col("up").alias("component"))
        else:
            over = roots.select(F.col("id").alias("component"), "up")
            found = found.join(over, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        left, right = (roots.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in ("x", "y"))
        edges = (
            edges.join(left, "x").join(right, "y").where("x_up <> y_up")
            .select(F.col("x_up").alias("x"), F.col("y_up").alias("y")).distinct()
        )
    if found is None:
        return edges.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return write_out(found, "components")
