"""The step graph: which queue serves a step and where its children go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskframe.functions.paths import DEFAULT_PRIMARY_NAME, PRIMARY_NAMES, literal_map

# The two step graphs the tests use.
DEFAULT_STEPS = {
    "ENHANCEMENT": {"queue": "identification", "filetype": "png",
                    "extensions": [".png"], "next": ["SEGMENTATION"]},
    "SEGMENTATION": {"queue": "segmentation", "filetype": "png",
                     "extensions": [".png"], "next": ["ANALYSIS"]},
    "ANALYSIS": {"queue": "analysis", "filetype": "json", "extensions": [".json"]},
    "VIRTUAL_TRY": {"queue": "vton", "filetype": "png",
                    "extensions": [".png", ".jpg", ".jpeg"]},
    "AVATAR": {"queue": "avatar", "filetype": "png", "extensions": [".png"]},
    "MODEL_PROFILE": {"queue": "model_profile", "filetype": "png",
                      "extensions": [".png"], "next": ["AVATAR"]},
    "SHOT_CREATION": {"queue": "shot", "filetype": "png",
                      "extensions": [".png", ".jpg", ".jpeg"], "next": ["AVATAR"]},
    "SCRIPT_GENERATION": {"queue": "script", "filetype": "json",
                          "extensions": [".json"],
                          "next": ["IMAGE_GENERATION", "SPEECH_GENERATION"]},
    "IMAGE_GENERATION": {"queue": "image", "filetype": "png",
                         "extensions": [".png", ".json"], "next": ["VIDEO_GENERATION"]},
    "VIDEO_GENERATION": {"queue": "animate", "filetype": "mp4",
                         "extensions": [".mp4", ".json"], "join_to": "STITCH"},
    "SPEECH_GENERATION": {"queue": "tts", "filetype": "mp3",
                          "extensions": [".mp3", ".wav", ".json"]},
    "STITCH": {"queue": "stitch", "filetype": "mp4", "extensions": [".mp4", ".json"]},
}

# A graph is hand-written configuration.  The bound keeps its tables small
# enough to broadcast whatever the size of the data.
MAX_STEPS = 10_000
# Edges of a step, on average.
MAX_FANOUT = 10


@dataclass(frozen=True)
class Dag:
    """Step configuration, as tables and as column expressions."""

    steps: dict

    def __post_init__(self):
        if len(self.steps) > MAX_STEPS:
            raise ValueError(f"more than {MAX_STEPS} steps")

    @classmethod
    def default(cls) -> Dag:
        return cls(DEFAULT_STEPS)

    @classmethod
    def from_tables(cls, steps: DataFrame, edges: DataFrame) -> Dag:
        """One graph from its rows.

        Steps: step, queue, filetype, join_to, hooks_path, extensions (array).  Edges:
        step, pos, next_step; a step's next steps are in order of pos.  A repeated
        step, a cycle or a name without a row raises ValueError.
        """
        rows = steps.select("step", "queue", "filetype", "join_to", "hooks_path", "extensions").limit(MAX_STEPS + 1).collect()
        most = MAX_STEPS * MAX_FANOUT
        links = edges.select("step", "pos", "next_step").limit(most + 1).collect()
        if len(links) > most:
            raise ValueError(f"more than {most} edges")
        found: dict = {}
        for row in rows:
            if row.step is None or row.step in found:
                raise ValueError(f"step without a name of its own: {row.step}")
            found[row.step] = {k: v for k, v in row.asDict().items() if k != "step" and v is not None}
        for link in sorted(links, key=lambda x: (x.step, x.pos)):
            if link.step not in found:
                raise ValueError(f"edge from an unknown step: {link.step}")
            found[link.step].setdefault("next", []).append(link.next_step)
        graph = cls(found)
        graph.check()
        return graph

    def check(self) -> None:
        """Raise ValueError for a next or join step that is unknown, and for cycles."""
        waiting = dict.fromkeys(self.steps, 0)
        for name, spec in self.steps.items():
            targets = spec.get("next", [])
            for other in [*targets, *filter(None, [spec.get("join_to")])]:
                if other not in self.steps:
                    raise ValueError(f"{name} names an unknown step: {other}")
            for other in targets:
                waiting[other] += 1
        ready = [s for s, n in waiting.items() if n == 0]
        for name in ready:
            for other in self.steps[name].get("next", []):
                waiting[other] -= 1
                if waiting[other] == 0:
                    ready.append(other)
        if len(ready) < len(self.steps):
            raise ValueError(f"cycle through {sorted(set(self.steps) - set(ready))}")

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.steps)

    def _lookup(self, step: Column, entries: dict) -> Column:
        if not entries:
            return F.lit(None).cast("string")
        return F.element_at(literal_map(entries), step)

    def queue(self, step: Column) -> Column:
        return self._lookup(
            step, {s: d["queue"] for s, d in self.steps.items() if d.get("queue")})

    def join_step(self, step: Column) -> Column:
        return self._lookup(
            step, {s: d["join_to"] for s, d in self.steps.items() if d.get("join_to")})

    def hooks_path(self, step: Column) -> Column:
        return self._lookup(
            step, {s: d["hooks_path"] for s, d in self.steps.items() if d.get("hooks_path")})

    def filetype(self, step: Column) -> Column:
        known = {s: d["filetype"] for s, d in self.steps.items() if d.get("filetype")}
        return F.coalesce(self._lookup(step, known), F.lit("json"))

    def primary_name(self, step: Column) -> Column:
        """File name of the main artifact of a step."""
        return F.coalesce(
            F.element_at(literal_map(PRIMARY_NAMES), self.filetype(step)),
            F.lit(DEFAULT_PRIMARY_NAME))

    def allows_extension(self, step: Column, extension: Column) -> Column:
        allowed = F.lit(False)
        for name, spec in self.steps.items():
            if spec.get("extensions"):
                allowed = allowed | (
                    (step == name) & extension.isin(*spec["extensions"]))
        return allowed

    def next_steps(self, step: Column) -> Column:
        """Array of the steps a step fans out to, null for a terminal step."""
        entries = [
            (s, F.array(*map(F.lit, d["next"])))
            for s, d in self.steps.items() if d.get("next")]
        if not entries:
            return F.lit(None).cast("array<string>")
        flat = [x for s, arr in entries for x in (F.lit(s), arr)]
        return F.element_at(F.create_map(*flat), step)

    def step_table(self, spark: SparkSession) -> DataFrame:
        """One row per step: queue, file type, extensions, join target."""
        rows = [
            F.struct(
                F.lit(s).alias("step"), F.lit(d.get("queue")).alias("queue"),
                F.lit(d.get("filetype", "json")).alias("filetype"),
                F.lit(d.get("join_to")).cast("string").alias("join_to"),
                F.array(*map(F.lit, d.get("extensions", []))).cast("array<string>")
                .alias("extensions"))
            for s, d in self.steps.items()]
        return spark.range(1).select(F.inline(F.array(*rows)))

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """One row per edge: step, position among its edges, next step."""
        steps = self.step_table(spark).select("step")
        return steps.select(
            "step", F.posexplode(self.next_steps(F.col("step"))).alias("pos", "next_step"))
