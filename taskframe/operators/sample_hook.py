"""A small hook for tests and demonstration."""

from __future__ import annotations

from taskframe.operators.hooks import Artifact, Child, Hook, Metrics


class CountingHook(Hook):
    """Reports the `k` of a message and fans out `k % 4` children."""

    def load(self, config):
        return {"refuse": config.get("refuse", 10)}

    def process(self, model, message):
        k = int(message["params"].get("k", 0))
        if k % model["refuse"] == 0:
            raise ValueError(f"k is {k}")
        return {
            "result": {"task": message["task_id"], "k": k},
            "metrics": {"k": k},
            "children": [{"part": i} for i in range(k % 4)],
            "aux": {"note.txt": b"x" * k},
        }


class ReportingHook(Hook):
    """Puts out its files one by one, some of them under names that are refused."""

    def emit(self, model, message):
        k = int(message["params"].get("k", 0))
        for i in range(k % 5 + 1):
            yield Artifact(f"{message['task_id']} {i} ".encode() * k, "files", f"part_{i}.txt", file_pos=i)
        if k % 10 == 0:
            raise ValueError(f"k is {k}")
        yield Metrics({"k": k, "task": message["task_id"]})
        if k % 7 == 5:
            yield Artifact(b"left out", "files", "bad;name.txt", file_pos=9)
        if k % 7 == 3:
            yield Artifact(b"refused", "aux", "note.unknown")
        for i in range(k % 4):
            yield Child({"part": i})
