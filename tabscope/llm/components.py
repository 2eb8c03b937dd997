"""Connected components of links between numbers, by alternating large and small stars.

Rows of links stay distributed: each round is two windows by vertex, in three shuffles, written to the shared folder, until
one aggregation finds nothing but stars. The driver sees only whether it did. Where a vertex has more edges than one task
should hold, aggregations and joins stand in for the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import join_groups, written


#: Edges of one vertex that a task gets in any case: two numbers each.
HUB = 20_000


def _large_star(edges: DataFrame, n_edges: int, degree: int) -> DataFrame:
    """Link the larger neighbours of each vertex to the smallest of it and its neighbours.

    If some vertex has many edges, as the centre of a star has, the vertices with a large share of all edges are broadcast,
    and their edges stay where they are.
    """
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("k"))
    larger = both.where("v > u")
    met = join_groups(larger, least, "u", "k", n_edges) if degree > HUB else larger.join(least, "u")
    return met.selectExpr("v AS u", "m AS v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them; u > v in all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
    return others.unionByName(least.selectExpr("u", "m AS v")).where("u <> v").distinct()


def _stars(edges: DataFrame, n_edges: int, degree: int) -> DataFrame:
    """Large stars, then small stars; u > v in all edges.

    Every exchange costs the driver a thread, a job and plans of their own, so ordinary vertices take a window each instead of
    an aggregation joined to its own input.
    """
    if degree > HUB:
        return _small_star(_large_star(edges, n_edges, degree))
    vertex = Window.partitionBy("u")
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
    large = both.withColumn("m", F.least(F.min("v").over(vertex), F.col("u"))).where("v > u").selectExpr("v AS u", "m AS v")
    large = large.repartition("u").distinct()  # neither this nor the window moves the rows again
    # Of the distinct edges of a vertex one leads to its smallest neighbour and stays.
    small = large.withColumn("m", F.min("v").over(vertex))
    return small.selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").distinct()


def _look(edges: DataFrame) -> tuple[int, int, bool]:
    """The edges, the most of one vertex, and whether one has two smaller neighbours, or a smaller and a larger one; u > v."""
    ends = edges.select(F.explode(F.expr("array(struct(u AS id, 1 AS down), struct(v AS id, 0 AS down))")).alias("end"))
    counts = ends.groupBy("end.id").agg(F.sum("end.down").alias("down"), F.min("end.down").alias("least"),
                                           F.count(F.lit(1)).alias("k"))
    seen = counts.agg(F.sum("down").alias("n"), F.max("k").alias("k"), F.max(F.expr("down > 1 OR down = 1 AND least = 0")).alias("more")).head()
    return seen.n or 0, seen.k or 0, bool(seen.more)


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every end of the links (a, b): the smallest number that links reach from it."""
    edges = written(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct())
    n_edges, degree, more = _look(edges)
    while more:
        edges = written(_stars(edges, n_edges, degree))
        n_edges, degree, more = _look(edges)
    tops = edges.selectExpr("v AS id", "v AS component_id").distinct()
    return edges.selectExpr("u AS id", "v AS component_id").unionByName(tops)
