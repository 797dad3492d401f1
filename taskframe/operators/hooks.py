"""User code over messages: one hook, loaded once per partition."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskframe.schemas import MAX_WRITE_BYTES

OUTPUT_SCHEMA = (
    "message_id string, job_id string, step string, task_id string, status string, "
    "error_code string, error_message string, metrics string, children array<string>, "
    "items array<struct<shape:string,list_pos:int,list_size:int,file_pos:int,"
    "file_name:string,kind:string,size_bytes:bigint,content:binary>>")
ARROW_SCHEMA = pa.schema([
    *[(n, pa.string()) for n in ("message_id", "job_id", "step", "task_id", "status",
                                 "error_code", "error_message", "metrics")],
    ("children", pa.list_(pa.string())),
    ("items", pa.list_(pa.struct([
        ("shape", pa.string()), ("list_pos", pa.int32()), ("list_size", pa.int32()),
        ("file_pos", pa.int32()), ("file_name", pa.string()), ("kind", pa.string()),
        ("size_bytes", pa.int64()), ("content", pa.binary())]))),
])
KEYS = ("message_id", "job_id", "step", "task_id")
ERROR_CODE = "PROCESS_ERROR"

# One row per artifact, child and message; `part` says which.
ARTIFACT, CHILD, CLOSING = "artifact", "child", "closing"
PART_COLUMNS = (
    *[(n, "string") for n in (*KEYS, "step_prefix", "part")], ("position", "bigint"), ("shape", "string"),
    ("list_pos", "int"), ("list_size", "int"), ("file_pos", "int"), ("file_name", "string"), ("kind", "string"),
    ("size_bytes", "bigint"), ("content", "binary"), ("child", "string"), ("status", "string"), ("error_code", "string"),
    ("error_message", "string"), ("metrics", "string"), ("n_artifacts", "bigint"), ("n_children", "bigint"))
# What a closing row carries on from its message.
CARRIED = (*[(n, "string") for n in ("user_id", "schema", "input_uri", "output_prefix", "params", "trace_id", "parent_task_id")],
           ("retry_count", "bigint"))
PART_SCHEMA = ", ".join(f"{n} {t}" for n, t in (*PART_COLUMNS, *CARRIED))
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
PART_STRUCT = pa.struct([(n, _ARROW[t]) for n, t in (*PART_COLUMNS, *CARRIED)])
# What rows of the other parts hold in the columns of artifacts and of closing rows.
_ITEM = tuple(n for n, _ in PART_COLUMNS[7:15])
_NO_ARTIFACT = (None,) * len(_ITEM)
_NO_CLOSING = (None,) * len((*PART_COLUMNS[16:], *CARRIED))
FLUSH_BYTES = 16 * 1024 * 1024
FLUSH_ROWS = 4096
# Messages turned into Python values at once.
TAKEN_ROWS = 64


class Artifact(NamedTuple):
    """An output of a message: bytes, or a dict that is stored as JSON."""

    value: Any
    shape: str = "single"
    name: str | None = None
    list_pos: int | None = None
    list_size: int | None = None
    file_pos: int | None = None


class Child(NamedTuple):
    """Parameters of a child message."""

    params: Any


class Metrics(NamedTuple):
    values: dict


class Hook:
    """What a step implements.

    `process` returns a dict: `result` (bytes, dict, dict of bytes, or a list
    of these), `metrics` (dict), optional `children` (list) and `aux` (dict of
    bytes or dicts).
    """

    def load(self, config: dict) -> Any:
        """Load what `process` needs; called once per partition."""
        return None

    def process(self, model: Any, message: dict) -> dict:
        raise NotImplementedError

    def emit(self, model: Any, message: dict) -> Iterator[Artifact | Child | Metrics]:
        """The outputs of a message one by one.

        A hook whose outputs do not fit in memory implements this instead of `process`.
        """
        output = self.process(model, message)
        result = output.get("result")
        if isinstance(result, list):
            if not result:
                raise IndexError("empty result list")
            for i, value in enumerate(result):
                yield from _result_parts(value, i, len(result))
        elif result is not None:
            yield from _result_parts(result)
        if isinstance(output.get("metrics"), dict):
            yield Metrics(output["metrics"])
        for name, value in (output.get("aux") or {}).items():
            yield Artifact(value, "aux", name)
        children = output.get("children")
        for params in children if isinstance(children, list) else ():
            yield Child(params)


class Processed(NamedTuple):
    succeeded: DataFrame
    failed: DataFrame


def _item(shape, value, name=None, list_pos=None, list_size=None, file_pos=None) -> dict:
    if isinstance(value, (bytes, bytearray)):
        kind, content = "bytes", bytes(value)
    elif isinstance(value, dict):
        kind, content = "json", json.dumps(value, indent=2).encode()
    else:
        kind, content = "other", None
    return {
        "shape": shape, "list_pos": list_pos, "list_size": list_size, "file_pos": file_pos,
        "file_name": name, "kind": kind, "content": content,
        "size_bytes": None if content is None else len(content)}


def _result_parts(value, list_pos=None, list_size=None) -> Iterator[Artifact]:
    if isinstance(value, dict) and value and all(isinstance(v, (bytes, bytearray)) for v in value.values()):
        for i, (name, v) in enumerate(value.items()):
            yield Artifact(v, "files", name, list_pos, list_size, i)
    else:
        yield Artifact(value, "single", None, list_pos, list_size)


def _result_items(value, list_pos=None, list_size=None) -> list[dict]:
    if isinstance(value, dict) and value and all(
            isinstance(v, (bytes, bytearray)) for v in value.values()):
        return [_item("files", v, name, list_pos, list_size, i)
                for i, (name, v) in enumerate(value.items())]
    item = _item("single", value, None, list_pos, list_size)
    if item["kind"] == "other":
        raise TypeError(f"Unsupported result type: {type(value)}")
    return [item]


def flatten_output(output: dict) -> dict:
    """A hook's output as columns: items, metrics and children."""
    result, items = output.get("result"), []
    if isinstance(result, list):
        if not result:
            raise IndexError("empty result list")
        for i, value in enumerate(result):
            items += _result_items(value, i, len(result))
    elif result is not None:
        items += _result_items(result)
    metrics = output.get("metrics")
    if isinstance(metrics, dict):
        items.append(_item("metrics", metrics))
    items += [_item("aux", v, name) for name, v in (output.get("aux") or {}).items()]
    children = output.get("children")
    return {
        "items": items,
        "metrics": json.dumps(metrics) if isinstance(metrics, dict) else None,
        "children": [json.dumps(c) for c in children] if isinstance(children, list) else None}


def run_hook(messages: DataFrame, hook: Hook, config: dict | None = None) -> DataFrame:
    """One row per message with its status and outputs.

    A message whose `process` raises becomes a FAILED row; the others go on.
    All outputs of a message are one row; `stream_hook` has no such bound.
    Write the result to a table before using it more than once, or the hook
    runs again for every use.
    """
    settings = dict(config or {})

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = hook.load(settings)
        for batch in batches:
            rows, held = [], 0
            for at in range(batch.num_rows):
                message = batch.slice(at, 1).to_pylist()[0]
                row = {k: message[k] for k in KEYS}
                try:
                    fields = dict(message, params=json.loads(message.get("params") or "{}"))
                    row.update(flatten_output(hook.process(model, fields)), status="SUCCEEDED")
                    held += sum(i["size_bytes"] or 0 for i in row["items"])
                except Exception as error:  # a hook may raise anything
                    row.update(status="FAILED", error_code=ERROR_CODE, error_message=str(error))
                rows.append(row)
                if held >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)

    return messages.mapInArrow(process, OUTPUT_SCHEMA)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, TAKEN_ROWS):
            yield from batch.slice(at, TAKEN_ROWS).to_pylist()


def stream_hook(messages: DataFrame, hook: Hook, config: dict | None = None, flush_bytes: int = FLUSH_BYTES,
                max_bytes: int = MAX_WRITE_BYTES) -> DataFrame:
    """One row per artifact and child, and a closing row per message.

    Rows leave the Python worker once `flush_bytes` are held, so it holds no
    more than that and one artifact, however much a message puts out.  Contents over
    `max_bytes` are dropped, their size stays.  The closing row carries the status
    and the number of rows before it; rows of a FAILED message count for nothing.
    `messages` carries step_prefix and the fields of an accepted message.
    """
    settings = dict(config or {})

    def text(value) -> str | None:
        if value is None:
            return None
        if not isinstance(value, str):
            raise TypeError(f"Unsupported name: {type(value)}")
        value.encode()  # a text that is no Unicode fails its message here
        return value

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = hook.load(settings)
        rows: list[tuple] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            nonlocal rows, held
            out = pa.RecordBatch.from_struct_array(pa.array(rows, PART_STRUCT))
            rows, held = [], 0
            return out

        for message in _messages(batches):
            key = tuple(message[k] for k in (*KEYS, "step_prefix"))
            artifacts = children = 0
            metrics = code = reason = None
            status = "SUCCEEDED"
            try:
                fields = dict(message, params=json.loads(message.get("params") or "{}"))
                for part in hook.emit(model, fields):
                    if isinstance(part, Child):
                        child = json.dumps(part.params)
                        rows.append((*key, CHILD, children, *_NO_ARTIFACT, child, *_NO_CLOSING))
                        held += len(child)
                        children += 1
                    else:
                        if isinstance(part, Metrics):
                            metrics = json.dumps(part.values)
                            part = Artifact(part.values, "metrics")
                        value, shape, name, *places = part
                        item = _item(shape, value, text(name), *places)
                        if item["kind"] == "other" and shape != "aux":
                            raise TypeError(f"Unsupported result type: {type(value)}")
                        if (item["size_bytes"] or 0) > max_bytes:
                            item["content"] = None
                        rows.append((*key, ARTIFACT, artifacts, *[item[n] for n in _ITEM], None, *_NO_CLOSING))
                        held += len(item["content"] or b"")
                        artifacts += 1
                    if held >= flush_bytes or len(rows) >= FLUSH_ROWS:
                        yield flushed()
            except Exception as error:  # a hook may raise anything
                status, code = "FAILED", ERROR_CODE
                reason = str(error).encode(errors="replace").decode()
            rows.append((*key, CLOSING, None, *_NO_ARTIFACT, None, status, code, reason, metrics, artifacts, children,
                         *[message[n] for n, _ in CARRIED]))
            held += len(message["params"] or "")
            if held >= flush_bytes or len(rows) >= FLUSH_ROWS:
                yield flushed()
        if rows:
            yield flushed()

    taken = messages.select(*KEYS, "step_prefix", *[F.col(n).cast(t).alias(n) for n, t in CARRIED])
    return taken.mapInArrow(process, PART_SCHEMA)


def apply_hook(messages: DataFrame, hook: Hook, config: dict | None = None) -> Processed:
    done = run_hook(messages, hook, config)
    return Processed(
        succeeded=done.filter("status = 'SUCCEEDED'"),
        failed=done.filter("status = 'FAILED'"))


def output_items(processed: DataFrame, messages: DataFrame) -> DataFrame:
    """Artifacts as rows for `layout.lay_out`."""
    prefixes = messages.select("message_id", "step_prefix")
    return processed.select(*KEYS, F.inline("items")).join(prefixes, "message_id")
