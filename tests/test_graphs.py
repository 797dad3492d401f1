"""Step graphs from tables and ancestry of tasks."""

import pytest
from pyspark.sql import functions as F

from taskframe.operators import graphs
from taskframe.operators.lineage import lineage
from taskframe.sources.dag import Dag

TASK = "job_id string, step string, task_id string, parent_step string, parent_task_id string"
STEP = "step string, queue string, filetype string, join_to string, hooks_path string, extensions array<string>"


def found(df):
    return {(r.job_id, r.step, r.task_id): (r.root_step, r.root_task_id, r.depth, r.subtree) for r in df.collect()}


def test_lineage_of_chains_stars_and_cycles(spark):
    chain = [("j", "A", f"S{i}", "A" if i else None, f"S{i - 1}" if i else None) for i in range(37)]
    star = [("k", "B", "S0", None, None)] + [("k", "B", f"S{i}", "B", "S0") for i in range(1, 500)]
    ring = [("r", "A", "S0", "A", "S1"), ("r", "A", "S1", "A", "S0"), ("r", "A", "S2", "A", "S1"), ("r", "A", "S3", "A", "S3")]
    # Of another job, without a parent that exists, and without a key.
    other = [("o", "A", "S1", "A", "S0"), ("o", None, "S5", "A", "S1"), ("o", "C", "S6", None, "S1")]
    got = found(lineage(spark.createDataFrame(chain + star + ring + other, TASK)))
    assert all(got["j", "A", f"S{i}"] == ("A", "S0", i, 37 - i) for i in range(37))
    assert got["k", "B", "S0"] == ("B", "S0", 0, 500) and got["k", "B", "S7"] == ("B", "S0", 1, 1)
    assert {got["r", "A", f"S{i}"] for i in range(4)} == {(None, None, None, None)}
    assert got["o", "A", "S1"] == ("A", "S1", 0, 1) and got["o", "C", "S6"] == ("C", "S6", 0, 1)
    assert got["o", None, "S5"] == (None, "S5", 0, 1)


def test_lineage_of_nothing(spark):
    assert lineage(spark.createDataFrame([], TASK)).count() == 0


def test_paths_cycles_and_levels(spark):
    edges = spark.createDataFrame(
        [("g", "A", "B"), ("g", "B", "C"), ("g", "A", "C"), ("g", "A", "B"), ("h", "A", "B"), ("h", "B", "A"), ("g", None, "A")],
        "graph string, step string, next_step string")
    steps = spark.createDataFrame(
        [("g", "A", "q", None), ("g", "B", "", "Z"), ("g", "C", "q", "A"), ("h", "A", "q", None), ("h", "A", "q", None)],
        "graph string, step string, queue string, join_to string")
    reach = graphs.reachability(edges)
    assert {tuple(r) for r in reach.select(*graphs.PAIR, "distance").collect()} == {
        ("g", "A", "B", 1), ("g", "A", "C", 1), ("g", "B", "C", 1),
        ("h", "A", "B", 1), ("h", "B", "A", 1), ("h", "A", "A", 2), ("h", "B", "B", 2)}
    assert {tuple(r) for r in graphs.refused_graphs(steps, edges, reach).collect()} == {
        ("g", "B", "unknown_join"), ("g", "B", "no_queue"), ("h", "A", "cycle"), ("h", "B", "cycle"),
        ("h", "A", "unknown_next"), ("h", "A", "repeated_step")}
    assert {tuple(r) for r in graphs.step_levels(steps, edges, reach).collect()} == {
        ("g", "A", 0), ("g", "B", 1), ("g", "C", 2)}


def test_graph_from_tables(spark):
    given = Dag.default()
    steps = given.step_table(spark).withColumn("hooks_path", F.concat(F.lit("hooks/"), F.lower("step")))
    read = Dag.from_tables(steps, given.edge_table(spark))
    assert {s: d.get("next") for s, d in read.steps.items()} == {s: d.get("next") for s, d in given.steps.items()}
    one = spark.range(1).select(
        read.hooks_path(F.lit("STITCH")).alias("h"), read.join_step(F.lit("VIDEO_GENERATION")).alias("j"),
        read.allows_extension(F.lit("AVATAR"), F.lit(".png")).alias("yes"),
        read.allows_extension(F.lit("AVATAR"), F.lit(".mp4")).alias("no")).first()
    assert tuple(one) == ("hooks/stitch", "STITCH", True, False)


@pytest.mark.parametrize("rows, links, fault", [
    (["A", "A"], [], "of its own"), (["A"], [("A", 0, "B")], "unknown"), (["A"], [("B", 0, "A")], "unknown"),
    (["A", "B"], [("A", 0, "B"), ("B", 0, "A")], "cycle")])
def test_unsound_graphs_are_refused(spark, rows, links, fault):
    steps = spark.createDataFrame([(r, "q", None, None, None, None) for r in rows], STEP)
    edges = spark.createDataFrame(links, "step string, pos int, next_step string")
    with pytest.raises(ValueError, match=fault):
        Dag.from_tables(steps, edges)
