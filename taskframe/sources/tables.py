"""The driver's tables and the job tables derived from them."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskframe.operators.ranking import positions

# Each derived table and the tables its SQL reads.
INPUTS = {
    "raw_messages": ("events",),
    "task_events": ("events",),
    "step_def": (),
    "step_edge": (),
    "hook_children": ("lineitem",),
    "result_items": ("hook_children",),
    "task_probe": ("task_events",),
    "object_listing": ("task_events",),
    "queue_rows": ("events",),
    "model_prompts": ("documents",),
    "model_responses": ("documents",),
    "log_records": ("events",),
    "completion_rows": ("task_events",),
    "child_uris": ("hook_children",),
    "prefix_parts": ("task_events",),
    "name_rows": ("result_items",),
    "job_updates": ("task_events",),
    "send_rows": ("task_events",),
    "layout_items": ("hook_children",),
    "task_links": ("task_events",),
    "graph_edges": ("task_events",),
    "graph_steps": ("task_events",),
}


def statement(name: str) -> str:
    return (files("taskframe.sources") / "fixture_sql" / f"{name}.sql").read_text()


def with_tables(names: list[str], query: str) -> str:
    """`query` with every derived table it needs as a common table expression."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in INPUTS and name not in needed:
            for dep in INPUTS[name]:
                visit(dep)
            needed.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{name} as (\n{statement(name)})" for name in needed)
    return f"with {ctes}\n{query}" if needed else query


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one."""
    if name not in INPUTS:
        return source(spark, sf_dir, name)
    if name == "hook_children":
        return _hook_children(source(spark, sf_dir, "lineitem"))
    inputs = {dep: table(spark, sf_dir, dep) for dep in INPUTS[name]}
    return derived(spark, name, **inputs)


def derived(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A derived table over inputs given as DataFrames, streaming ones too."""
    for dep, df in inputs.items():
        df.createOrReplaceTempView(dep)
    return spark.sql(statement(name))


def _hook_children(lineitem: DataFrame) -> DataFrame:
    """Same rows as hook_children.sql, with positions that survive a hot parent."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
             "l_shipdate", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]
    k = F.col("l_orderkey")
    step = (
        F.when(k % 5 == 0, "ENHANCEMENT").when(k % 5 == 1, "SEGMENTATION")
        .when(k % 5 == 2, "MODEL_PROFILE").when(k % 5 == 3, "SCRIPT_GENERATION")
        .otherwise("ANALYSIS"))
    return positions(lineitem, "l_orderkey", order, "idx").select(
        F.lpad(F.lower(F.hex(k)), 8, "0").alias("job_id"),
        F.concat(F.lit("u"), (k % 97).cast("string")).alias("user_id"),
        F.lit("v1").alias("schema"),
        step.alias("step"),
        F.concat(F.lit("S"), (k % 4).cast("string")).alias("task_id"),
        F.col("idx").cast("int").alias("child_pos"),
        F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linenumber").cast("int"))
        .alias("explicit_idx"),
        F.concat(F.lit('{"part": '), F.col("l_partkey").cast("string"), F.lit("}"))
        .alias("child_params"))
