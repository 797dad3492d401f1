"""Work that must not grow faster than its input."""

from pyspark.sql import functions as F

from taskframe.operators import fanout, queues, ranking, runs
from taskframe.plans.streams import landed
from taskframe.session import scratch_dir

KEY = "job_id string, step string, task_id string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_positions_number_rows_in_one_window(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.lit(1).alias("a"), F.col("id").alias("b"))
    got = ranking.positions(df, "k", ["a", "b"], "pos")
    assert plan(got).count("row_number") == 1
    assert {(r.k, r.b): r.pos for r in got.collect()} == {(i % 7, i): i // 7 for i in range(100)}


def test_positions_of_hot_groups_with_nulls(spark):
    rows = [(k, a, b) for k in (None, 1, 2) for a in (None, 0, 1) for b in range(20 if k != 2 else 2)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = ranking.positions(df, "k", ["a", "b"], "pos", hot_rows=10).collect()
    want = {}
    for k in (None, 1, 2):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r: i for i, r in enumerate(mine)}
    assert {(r.k, r.a, r.b): r.pos for r in got} == want and len(got) == len(rows)


def test_siblings_cost_nothing_unused(spark):
    children = spark.createDataFrame(
        [("j", "A", "S0", 0), ("j", "A", "S0", 1), ("j", "A", "S1", 0), (None, "A", "S0", 0), ("j", None, "S0", 0)],
        f"{KEY}, child_pos int")
    counted = fanout.with_siblings(children)
    assert sorted((r.task_id, r.child_pos, r.siblings) for r in counted.collect()) == [("S0", 0, 2), ("S0", 1, 2), ("S1", 0, 1)]
    assert "Join" not in plan(counted.select("task_id"))


def test_input_uris_join_once(spark, monkeypatch):
    monkeypatch.setattr(fanout, "FIRST_URIS", 3)
    children = spark.createDataFrame([("j", "A", "S0", i) for i in (*range(8), None)] + [("j", "A", "S1", 5)], f"{KEY}, child_pos int")
    uris = spark.createDataFrame([("j", "A", "S0", i, f"u{i}") for i in range(6)], f"{KEY}, uri_pos int, uri string")
    with_uris = fanout.with_input_uris(children, uris)
    assert {(r.task_id, r.child_pos): r.written_uri for r in with_uris.collect()} == {
        **{("S0", i): f"u{min(i, 5)}" for i in range(8)}, ("S0", None): "u5", ("S1", 5): None}
    # Only children beyond the first URIs are joined where the URIs are not asked for.
    assert plan(with_uris.select("task_id")).count("Join") <= 1


def test_outbox_rows_are_computed_once(spark):
    rows = spark.createDataFrame([("q", "{}"), ("q", "x" * 9), ("q.fifo", "{}")], "queue string, body string")
    checked = queues.checked_outbox(rows, max_bytes=5)
    assert [r.problem for r in checked.collect()] == [None, "body_too_large", "fifo_without_group"]


def test_parts_of_user_code_are_not_joined(spark):
    rows = spark.createDataFrame([("m", "j", "A", "S0"), ("n", "j", "A", "S0")], f"message_id string, {KEY}")
    work = runs.one_per_task(rows)
    assert work.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r.message_id for r in work.collect()] == ["m"]


def test_batches_of_many_files(spark):
    """48 files in 4 batches, not 48."""
    sizes = []
    stream = landed(spark, spark.range(96).repartition(4), records_per_file=2, batches=4)
    stream.writeStream.foreachBatch(lambda df, n: sizes.append(df.count())).option(
        "checkpointLocation", scratch_dir(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 96 and len(sizes) == 4
