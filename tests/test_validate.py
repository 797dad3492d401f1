"""Rule boundaries of both message contracts; expectations written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from taskframe.functions.json_values import spaced_ascii_bytes
from taskframe.operators import normalize, serialize, validate
from taskframe.schemas import raw_messages
from taskframe.sources.dag import Dag

GOOD = {
    "job_id": "j1", "task_id": "S0", "user_id": "u1", "schema": "v1", "step": "AVATAR",
    "input_uri": "s3://work/u1/in.PNG", "output_prefix": "s3://work/u1/j1/AVATAR/S0/",
    "params": {}, "retry_count": 0,
}


def body(drop=None, **changes):
    m = {**GOOD, **changes}
    m.pop(drop, None)
    if "output_prefix" not in changes:
        m["output_prefix"] = f"s3://work/{m.get('user_id')}/{m.get('job_id')}/{m.get('step')}/{m.get('task_id')}/"
    return json.dumps(m)


def nested(levels, leaf):
    out = leaf
    for _ in range(levels):
        out = {"a": out}
    return out


def filled(size):
    """Params whose spaced ASCII JSON has exactly `size` bytes."""
    return {"a": "x" * (size - len(json.dumps({"a": ""})))}


def accented(size):
    n, rest = divmod(size - len(json.dumps({"a": ""})), 6)
    return {"a": "é" * n + "x" * rest}


CASES = [
    (body(), None),
    (body(user_id="u" * 128), None),
    (body(user_id="u" * 129), "user_id"),
    (body(user_id="u\n"), None),
    (body(user_id="u\n\n"), "user_id"),
    (body(user_id=""), "user_id"),
    (body(job_id="j.1"), "job_id"),
    (body(task_id="t" * 256), None),
    (body(task_id="t" * 257), "task_id"),
    (body(user_id=7), "type"),
    (body(user_id="7"), None),
    (body(user_id="true"), None),
    (body(user_id=True), "type"),
    (body(user_id=None), "type"),
    (body(drop="user_id"), "missing"),
    (body(drop="params"), "missing"),
    (body(params=None), "type"),
    (body(params="{"), "type"),
    (body(params=[]), "type"),
    (body(drop="retry_count"), None),
    (body(retry_count=None), "type"),
    (body(retry_count=True), None),
    (body(retry_count="1"), "type"),
    (body(retry_count=3_000_000_000), None),
    (body(retry_count=10**20), "retry_range"),
    (body(retry_count=1.5), "type"),
    (body(trace_id=""), None),
    (body(trace_id=None), None),
    (body(trace_id="ab-12_F"), None),
    (body(trace_id="xyz"), "trace"),
    (body(trace_id="a" * 129), "trace"),
    (body(trace_id=5), "type"),
    (body(parent_task_id="p 1", trace_id="xyz"), "parent"),
    (body(schema="v2"), "schema"),
    (body(step="avatar"), "step"),
    (body(input_uri=""), None),
    (body(input_uri="r2://work/a.json"), None),
    (body(input_uri="http://work/a.json"), "input_uri"),
    (body(input_uri="s3://other/a.json"), "input_uri"),
    (body(input_uri="s3://work/a$(b).json"), "input_uri"),
    (body(input_uri="s3://work/a$b.json"), None),
    (body(input_uri="s3://work/a.jsonx"), "input_uri"),
    (body(output_prefix="s3://anything/u1/j1/AVATAR/"), None),
    (body(output_prefix="s3://work/u1/j1/AVATAR/S1/"), "output_prefix"),
    (body(output_prefix="r2://work/u1/j1/AVATAR/S0/"), "output_prefix"),
    (body(output_prefix="x"), "output_prefix"),
    (body(params=nested(5, 1)), None),
    (body(params=nested(6, 1)), "params"),
    (body(params=nested(6, {})), "params"),
    (body(params=nested(5, {})), None),
    (body(params={"a": "[[[[[[[[", "b": [1, {"c": "}\\\""}]}), None),
    (body(params=filled(65_536)), None),
    (body(params=filled(65_537)), "params"),
    (body(params=accented(65_536)), None),
    (body(params=accented(65_537)), "params"),
    (json.dumps({"Message": body()}), None),
    (json.dumps({"Message": json.loads(body())}), None),
    (json.dumps({"Message": "{"}), "parse"),
    (json.dumps({"Message": None}), "parse"),
    (body() + " x", "parse"),
    (body() + "] x", "parse"),
    (body() + "} x", "parse"),
    (body() + ",{}", "parse"),
    (body(params={"a": [1]}) + "] {}", "parse"),
    (" \n" + body() + "\n ", None),
    ("[" + body() + "]", "parse"),
    ("", "parse"), ("  ", "parse"), (None, "parse"), ("{}", "missing"), ("3", "parse"),
    (body()[:-1] + ', "user_id": "u1"}', None),
    (body()[:-1] + ', "user_id": 1}', "type"),
]


@pytest.fixture(scope="module")
def frame(spark):
    def build(bodies):
        return spark.createDataFrame(
            [(str(i), None, None, b) for i, b in enumerate(bodies)], raw_messages())
    return build


def test_first_contract(frame):
    checked = validate.check_messages(frame([b for b, _ in CASES]), Dag.default(), ["work"])
    got = {int(r.message_id): r.reason for r in checked.collect()}
    wrong = {CASES[i][0]: (got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want}
    assert not wrong


def test_details_and_defaults(frame):
    out = validate.validate_messages(
        frame([body(), json.dumps({"job_id": "j", "step": 1}), body(step="NOPE")]),
        Dag.default(), [])
    row = out.accepted.first()
    assert (row.receive_count, row.retry_count, row.trace_id) == (1, 0, None)
    details = {r.reason: r.detail for r in out.rejected.collect()}
    assert details == {
        "missing": "task_id, user_id, schema, input_uri, output_prefix, params",
        "step": "NOPE"}


@pytest.mark.parametrize("value", [
    {}, {"a": [1, -2, "x, y: z"], "b": {"c": None}}, {"é": "\u2028\U0001f600\x7f", "q": '"\\"\n\t'}])
def test_spaced_size(spark, value):
    compact = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame([(compact,)], "j string")
    assert df.select(spaced_ascii_bytes(F.col("j"))).first()[0] == len(json.dumps(value))


WORK = [
    (body(), None, {}),
    (body(job_id=" ABCDEF01 "), None, {"job_id": "abcdef01"}),
    (body(job_id="ABCDEF0"), None, {"job_id": "ABCDEF0"}),
    (body(job_id="  "), "job_id", {}),
    (body(task_id=" "), None, {"task_id": "S0"}),
    (body(schema=""), None, {"schema": "v1"}),
    (body(step=" avatar\u00a0"), None, {"step": "AVATAR"}),
    (body(user_id=5), None, {"user_id": "5"}),
    (body(user_id=None), None, {"user_id": "None"}),
    (body(user_id=True), None, {"user_id": "True"}),
    (body(user_id="true"), None, {"user_id": "true"}),
    (body(user_id=" "), "user_id", {}),
    (body(retry_count=None), None, {"retry_count": 0}),
    (body(retry_count=" 12 "), None, {"retry_count": 12}),
    (body(retry_count="1_0"), None, {"retry_count": 10}),
    (body(retry_count=2.9), None, {"retry_count": 2}),
    (body(retry_count=1.9999999), None, {"retry_count": 1}),
    (body(retry_count=10**20), "retry", {}),
    (body(retry_count="2.9"), "retry", {}),
    (body(retry_count=-1), "retry", {}),
    (body(drop="retry_count"), "missing", {}),
    (body(parent_task_id=4), "parent", {}),
    (body(input_uri=""), "input_empty", {}),
    (body(input_uri="s3://work"), "input_shape", {}),
    (body(input_uri="s3://work/"), "input_shape", {}),
    (body(input_uri="s3://w/k"), "input_bucket_name", {}),
    (body(input_uri="s3://other/k"), "input_bucket", {}),
    (body(input_uri="s3://work/a\tb"), "input_control", {}),
    (body(input_uri="s3://work/%41BCDEF01/x%zz/ABCDEF012"), None,
     {"input_uri": "s3://work/abcdef01/x%zz/ABCDEF012"}),
    (body(output_prefix="s3://work/ABCDEF01"), None, {"output_prefix": "s3://work/abcdef01/"}),
    (body() + " x", "parse", {}),
    ("[1]", "root", {}),
    (json.dumps({"Message": body()}), "missing", {}),
]


def test_second_contract(frame):
    checked = normalize.check_work_messages(frame([b for b, _, _ in WORK]), "work")
    got = {int(r.message_id): r for r in checked.collect()}
    wrong = []
    for i, (text, reason, values) in enumerate(WORK):
        if got[i].reason != reason or any(got[i][k] != v for k, v in values.items()):
            wrong.append((text, reason, values, got[i]))
    assert not wrong


def test_serialise(frame):
    accepted = validate.validate_messages(
        frame([body(), body(input_uri="", trace_id="ab")]), Dag.default(), ["work"]).accepted
    out = serialize.serialize_task_messages(accepted.withColumn(
        "extra", F.lit('{"tenant": "t", "step": "no", "trace_id": "kept"}')))
    sent = json.loads(out.bodies.first().body)
    assert sent == {**json.loads(body()), "tenant": "t", "trace_id": "kept"}
    assert [r.missing for r in out.refused.collect()] == ["input_uri"]
