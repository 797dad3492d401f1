"""Checks over step graphs given as tables, any number of graphs at once.

Steps are rows (graph, step, ...), edges rows (graph, step, next_step).  Paths are
doubled, so a graph of n steps takes log2(n) joins; pairs stay below the square of
its steps, which `sources.dag.MAX_STEPS` bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskframe.session import scratch_dir

PAIR = ("graph", "step", "reached")


def _closure(edges: DataFrame, pick, name: str) -> DataFrame:
    """All pairs joined by a path, with the length `pick` keeps."""
    spark, folder = edges.sparkSession, scratch_dir(edges.sparkSession, f"graph-{name}")

    def stored(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    paths = stored(
        edges.filter("graph is not null and step is not null and next_step is not null")
        .select("graph", "step", F.col("next_step").alias("reached")).distinct()
        .withColumn(name, F.lit(1).cast("bigint")), 0)
    rounds, found = 0, None
    while True:
        seen = paths.agg(F.count("*").alias("n"), F.sum(name).alias("s")).first()
        if seen == found:
            return paths
        found = seen
        first = paths.select("graph", "step", F.col("reached").alias("mid"), F.col(name).alias("a"))
        second = paths.select("graph", F.col("step").alias("mid"), "reached", F.col(name).alias("b"))
        longer = first.join(second, ["graph", "mid"]).select(*PAIR, (F.col("a") + F.col("b")).alias(name))
        rounds += 1
        paths = stored(paths.unionByName(longer).groupBy(*PAIR).agg(pick(name).alias(name)), rounds)


def reachability(edges: DataFrame) -> DataFrame:
    """Pairs (graph, step, reached) with `distance`, the fewest edges between them.

    A step on a cycle reaches itself.  Edges with a null are left out; repeated
    edges count once.
    """
    return _closure(edges, F.min, "distance")


def refused_graphs(steps: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Faults as rows (graph, step, reason); a graph without any is sound.

    `reach` is the reachability of the edges.  Reasons: cycle (the step reaches
    itself), unknown_next and unknown_join (the step names one without a row),
    no_queue, repeated_step.
    """
    known = steps.select("graph", F.col("step").alias("target")).distinct()

    def lacking(pairs: DataFrame, reason: str) -> DataFrame:
        return (pairs.filter("target is not null").join(known, ["graph", "target"], "left_anti")
                .select("graph", "step", F.lit(reason).alias("reason")))

    faults = [
        reach.filter("step = reached").select("graph", "step", F.lit("cycle").alias("reason")),
        lacking(edges.select("graph", "step", F.col("next_step").alias("target")), "unknown_next"),
        lacking(steps.select("graph", "step", F.col("join_to").alias("target")), "unknown_join"),
        steps.filter("queue is null or queue = ''").select("graph", "step", F.lit("no_queue").alias("reason")),
        steps.groupBy("graph", "step").count().filter("count > 1").select(
            "graph", "step", F.lit("repeated_step").alias("reason"))]
    out = faults[0]
    for more in faults[1:]:
        out = out.unionByName(more)
    return out.distinct()


def step_levels(steps: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """The level of every step of a graph without cycles: the most edges on a path to it."""
    cyclic = reach.filter("step = reached").select("graph").distinct()
    longest = _closure(edges.join(cyclic, "graph", "left_anti"), F.max, "level")
    deepest = longest.groupBy("graph", F.col("reached").alias("step")).agg(F.max("level").alias("level"))
    return (
        steps.select("graph", "step").distinct().join(cyclic, "graph", "left_anti")
        .join(deepest, ["graph", "step"], "left")
        .select("graph", "step", F.coalesce("level", F.lit(0).cast("bigint")).alias("level")))
