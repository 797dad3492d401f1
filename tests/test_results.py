"""Writers show whole runs only; percentiles are exact at any number of values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskframe.operators import percentiles, results
from taskframe.operators.percentiles import grouped_percentile
from taskframe.session import scratch_dir
from taskframe.sources import commits
from taskframe.sources.dag import Dag

ITEM = ("job_id string, step string, task_id string, step_prefix string, shape string, list_pos int, list_size int, "
        "file_pos int, file_name string, kind string, content binary")


def items(spark, texts, names=("result.json",)):
    rows = [("j", "ANALYSIS", f"S{i}", "s3://work/u/j/ANALYSIS/", "files", None, None, 0, names[i % len(names)], "json", t)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ITEM)


def test_last_commit_of_a_uri_counts(spark):
    base, dag = scratch_dir(spark, "results"), Dag.default()
    one = results.write_results(items(spark, [b"{}", b'{"a":1}', b"x"], ("result.json", "r.json", "a;b.json")), dag, base, "run-1")
    assert one.manifest.count() == 2 and [r.problem for r in one.refused.collect()] == ["file_name"]
    assert "content" not in one.manifest.columns
    # The same run again, with other content, writes nothing.
    results.write_results(items(spark, [b"other"]), dag, base, "run-1")
    assert sorted(bytes(r.content) for r in results.read_results(spark, base).collect()) == [b'{"a":1}', b"{}"]
    results.write_results(items(spark, [b"[2]"]), dag, base, "run-2")
    got = {r.uri: (bytes(r.content), r.size_bytes) for r in results.read_results(spark, base, "ANALYSIS").collect()}
    assert sorted(got.values()) == [(b"[2]", 3), (b'{"a":1}', 7)]
    assert results.read_results(spark, base, "AVATAR").count() == 0
    assert results.read_manifest(spark, base).count() == 2
    # No item at all is a run as well.
    results.write_results(items(spark, [b"1"]).limit(0), dag, base, "run-3")
    assert results.read_manifest(spark, base).count() == 2


def test_run_killed_before_its_commit_is_not_seen(spark, monkeypatch):
    base, dag = scratch_dir(spark, "results"), Dag.default()
    results.write_results(items(spark, [b"old"]), dag, base, "run-1")

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        results.write_results(items(spark, [b"new"]), dag, base, "run-2")
    monkeypatch.undo()
    assert [bytes(r.content) for r in results.read_results(spark, base).collect()] == [b"old"]
    results.write_results(items(spark, [b"new"]), dag, base, "run-2")
    assert [bytes(r.content) for r in results.read_results(spark, base).collect()] == [b"new"]


def test_messages_by_queue(spark):
    base = scratch_dir(spark, "outbox")
    sent = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "queue string, body string")
    results.write_messages(sent, base, "run")
    results.write_messages(sent, base, "run")
    assert sorted(r.body for r in results.read_messages(spark, base, "a").collect()) == ["1", "3"]
    plan = results.read_messages(spark, base, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(queue" in plan


@pytest.mark.parametrize("share", [0, 0.5, 0.95, 0.999, 1])
def test_percentiles_of_many_values(spark, share):
    rng = np.random.default_rng(2)
    values = np.r_[rng.exponential(50, 60_000), np.full(9_000, 7.25), -rng.exponential(1e6, 1000)].round(4)
    rows = [("hot", float(v)) for v in values] + [("one", 2.0), (None, 1.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.p, r.n) for r in grouped_percentile(
        df, ["k"], "v", share, "p", [F.count(F.lit(1)).alias("n")], accuracy=1000).collect()}
    assert got["hot"] == (pytest.approx(np.quantile(values, share), abs=1e-9), len(values))
    assert got["one"] == (2.0, 1) and got["none"] == (None, 1)
    assert got[None] == (pytest.approx(1 + 3 * share), 2)


def test_last_task_of_a_percentile_is_bounded(spark):
    """200,000 distinct values of one key; the rows that meet in its last task stay few."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.xxhash64("id") / 7).alias("v"))
    error = percentiles.MARGIN / 2000
    groups = df.groupBy("k").agg(F.count("v").alias("_n"), F.percentile_approx(
        "v", F.array(F.lit(0.95 - error), F.lit(0.95 + error)), 2000).alias("_range"))
    left = percentiles.narrowed(groups, df, ["k"], ["g"], "v", 0.95, 2000)
    assert 1 < left.count() < 200_000 * 12 / 2000
    assert left.where("_v is null").first()._count > 180_000
