"""One entry per job: how to run it and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from taskframe.session import prepare
from taskframe.sources.tables import with_tables

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Job:
    name: str
    run: Run
    sql: str | None


class Jobs:
    """Collects the jobs of one topic."""

    def __init__(self):
        self.jobs: list[Job] = []

    def add(self, name: str, tables: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
        def register(run: Run) -> Run:
            def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
                return run(prepare(spark), sf_dir)

            text = None if sql is None else with_tables(list(tables), sql)
            if recursive and text is not None:
                text = text.replace("with ", "with recursive ", 1)
            self.jobs.append(Job(name, prepared, text))
            return run

        return register


def all_jobs() -> dict[str, Job]:
    from taskframe.plans import calls, fanout, messages, state, streams, work

    found = {}
    for module in (messages, work, state, fanout, calls, streams):
        for job in module.JOBS.jobs:
            if job.name in found:
                raise ValueError(f"two jobs named {job.name}")
            found[job.name] = job
    return found
