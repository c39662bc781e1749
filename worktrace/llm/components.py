"""Connected components of a graph given by its links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrace.llm.store import forget, keep


def _two_way(links: DataFrame) -> DataFrame:
    return links.unionAll(links.selectExpr("v AS u", "u AS v"))


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star operation (Kiveris et al., "Connected Components in MapReduce and Beyond"): hang the larger (or
    smaller) neighbours of each node, and the node, on the least of its neighbourhood. The least one is found
    by an aggregate with partial sums, written and joined back, so a hub's links may be split over tasks."""
    arcs = links.selectExpr("greatest(u, v) AS u", "least(u, v) AS v") if small else _two_way(links)
    least = keep(arcs.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), "least")
    arcs = arcs.join(least, "u")
    if small:
        out = arcs.selectExpr("v AS u", "m AS v").unionAll(least.selectExpr("u", "m AS v"))
    else:
        out = arcs.where("v > u").selectExpr("v AS u", "m AS v")
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (id, component) for each node with a link: component is the least id reachable.

    Alternates large and small stars until every node hangs on its component's least node; the number of
    rounds grows with the logarithm of the largest component's width. Each round is written to the shared
    folder. Links with a null end and links of a node with itself are ignored.
    """
    held = keep(links.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "links")
    while True:
        after = keep(_star(_star(held, small=False), small=True), "links")
        # done when no node is both a leaf and a centre, and no leaf has two centres
        loose = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionAll(after.select("u").join(after.selectExpr("v AS u"), "u", "left_semi")).limit(1).count()
        forget(held)
        held = after
        if not loose:
            return held.selectExpr("u AS id", "v AS component").unionAll(held.selectExpr("v AS id", "v AS component").distinct())
