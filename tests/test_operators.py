"""Operators on small hand-made tables and against brute force."""

import base64
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from taskframe.functions import paths
from taskframe.operators import (
    fanout, hooks, layout, logs, model_calls, queues, ranking, reads, routing, state,
)
from taskframe.operators.percentiles import grouped_percentile
from taskframe.operators.sample_hook import CountingHook
from taskframe.sources.dag import Dag

DAG = Dag.default()
T0 = dt.datetime(2024, 1, 1)


def test_positions_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 20), rng.randint(1, 3),
             rng.choice([None, *range(40)]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int")
    got = ranking.positions(df, "k", ["a", "b", "c"], "pos", hot_rows=50).collect()
    groups = {}
    for k, a, b, c in rows:
        groups.setdefault(k, []).append((a, -1 if b is None else b, c))
    want = {(k, c): i for k, g in groups.items() for i, (_, _, c) in enumerate(sorted(g))}
    assert {(r.k, r.c): r.pos for r in got} == want and len(got) == len(rows)


def test_top_per_group(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 5), rng.randint(0, 50), i)
            for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = ranking.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 7, ["i"], salts=4)
    want = set()
    for k in {r[0] for r in rows}:
        want |= set(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:7])
    assert {tuple(r) for r in got.collect()} == want


def test_grouped_percentile(spark):
    rows = [("a", v) for v in (1, 2, 2, 10)] + [("b", 5)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: r.p for r in grouped_percentile(df, ["k"], "v", 0.5, "p").collect()}
    assert got == {"a": 2.0, "b": 5.0}


def events(spark, rows):
    data = [(seq, T0 + dt.timedelta(seconds=seq), "j", "A", t, s, retry, code)
            for seq, t, s, retry, code in rows]
    return spark.createDataFrame(
        data, "seq long, ts timestamp_ntz, job_id string, step string, task_id string, "
              "status string, retry_count int, error_code string")


def test_fold_in_any_split(spark):
    rows = [(i, f"S{i % 3}", s, i, "E" if s == "FAILED" else None) for i, s in
            enumerate(["QUEUED", "STARTED", "FAILED", "SUCCEEDED", "BOGUS", "QUEUED"] * 4)]
    df = events(spark, rows)
    whole = sorted(map(str, state.upsert_tasks(df).collect()))
    split = df.filter("seq % 5 < 2")
    rest = df.filter("seq % 5 >= 2")
    assert sorted(map(str, state.upsert_tasks(rest, state.upsert_tasks(split)).collect())) == whole
    assert sorted(map(str, state.upsert_tasks(split, state.upsert_tasks(rest)).collect())) == whole
    last = {r.task_id: (r.status, r.error_code) for r in state.upsert_tasks(df).collect()}
    assert last["S0"][0] == "SUCCEEDED" and last["S0"][1] is None


def test_task_transitions(spark):
    base = events(spark, [(0, "S0", "QUEUED", 2, None), (1, "S1", "QUEUED", 0, None)]).drop(
        "seq").withColumnRenamed("ts", "updated_at")
    moves = events(spark, [
        (2, "S0", "STARTED", 0, None), (3, "S0", "FAILED", 0, "X"), (4, "S0", "RETRIED", 0, None),
        (5, "S0", "STARTED", 0, None), (6, "S0", "SUCCEEDED", 0, None), (7, "S9", "STARTED", 0, None)])
    got = {r.task_id: r for r in state.task_state(base, moves).collect()}
    assert set(got) == {"S0", "S1"}
    s0 = got["S0"]
    assert (s0.status, s0.retry_count, s0.error_code) == ("SUCCEEDED", 3, "X")
    assert s0.started_at == T0 + dt.timedelta(seconds=5)
    assert s0.finished_at == T0 + dt.timedelta(seconds=6)
    assert (got["S1"].status, got["S1"].started_at) == ("QUEUED", None)


@pytest.mark.parametrize("statuses, want", [
    (["SUCCEEDED", "SUCCEEDED"], "SUCCEEDED"), (["SUCCEEDED", "DLQ"], "FAILED"),
    (["QUEUED", "QUEUED"], "QUEUED"), (["QUEUED", "SUCCEEDED"], "RUNNING"),
    (["CANCELLED", "SUCCEEDED"], "CANCELLED"), (["CANCELLED", "STARTED"], "RUNNING"),
    (["RETRIED"], "RUNNING")])
def test_rollup(spark, statuses, want):
    tasks = spark.createDataFrame([("j", s) for s in statuses], "job_id string, status string")
    assert state.job_rollup(tasks).first().status == want


def test_lists_and_reads(spark):
    rows = [("j", "A", f"S{i}", "QUEUED", T0 + dt.timedelta(seconds=i)) for i in range(10)]
    tasks = spark.createDataFrame(
        rows, "job_id string, step string, task_id string, status string, created_at timestamp_ntz")
    newest = reads.list_tasks(tasks, limit=3).collect()
    assert {r.task_id for r in newest} == {"S9", "S8", "S7"}
    one = [r.task_id for r in reads.tasks_of_job(tasks, "j", step="A", limit=2).collect()]
    assert one == ["S9", "S8"]


def layout_rows(spark, rows):
    return spark.createDataFrame(
        [("j", "AVATAR", *r, "s3://work/u/j/AVATAR/") for r in rows],
        "job_id string, step string, task_id string, shape string, list_pos int, list_size int, "
        "file_pos int, file_name string, kind string, size_bytes long, step_prefix string")


def test_layout_shapes(spark):
    rows = [
        ("S3", "single", None, None, None, None, "bytes", 5),
        ("S4", "single", 0, 2, None, None, "bytes", 5), ("S4", "single", 1, 2, None, None, "json", 6),
        ("S5", "single", 0, 1, None, None, "json", 7),
        ("S6", "files", None, None, 0, "a;b.png", "bytes", 1),
        ("S6", "files", None, None, 1, "x.png", "bytes", 2),
        ("S7", "files", 0, 2, 0, "b.png", "bytes", 1), ("S7", "files", 0, 2, 1, "RESULT.png", "bytes", 2),
        ("S7", "files", 1, 2, 0, "bad.exe", "bytes", 1),
        ("S8", "metrics", None, None, None, None, "json", 3),
        ("S8", "aux", None, None, None, "t.txt", "bytes", 3),
        ("S8", "aux", None, None, None, "n.txt", "other", None),
    ]
    laid = layout.lay_out(layout_rows(spark, rows), DAG)
    uris = sorted(r.uri.removeprefix("s3://work/u/j/AVATAR/") for r in laid.collect() if r.uri)
    assert uris == sorted([
        "S3/result.png", "S0/result.png", "S1/result.json", "S5/result.png", "S6/x.png",
        "S0/b.png", "S0/RESULT.png", "metrics.json", "t.txt"])
    info = {r.task_id: r for r in layout.write_info(laid).collect()}
    assert info["S4"].primary_result_uri is None
    assert info["S4"].first_child_uri.endswith("S0/result.png")
    # The wanted file was refused, so the first written one stands in, unsized.
    assert (info["S6"].primary_result_uri[-5:], info["S6"].primary_size_bytes) == ("x.png", None)
    assert info["S7"].first_child_uri.endswith("S0/RESULT.png")
    assert info["S8"].metrics_uri.endswith("AVATAR/metrics.json")
    pos = {(r.task_id, r.uri_pos): r.uri for r in layout.child_uris(laid).collect()}
    assert (("S7", 0) in pos) and (("S7", 1) not in pos)


def test_fanout_of_arrays(spark):
    parents = spark.createDataFrame(
        [("j", "SCRIPT_GENERATION", "S2", "u", "v1", ['{"idx": 7}', '5', '{"a":1}']),
         ("j", "SEGMENTATION", "S3", "u", "v1", ['"x"']),
         ("j", "ANALYSIS", "S0", "u", "v1", ['{}']),
         ("j", "SEGMENTATION", "S4", "u", "v1", [])],
        "job_id string, step string, task_id string, user_id string, schema string, children array<string>")
    rows = fanout.fanout_children(
        fanout.explode_children(parents).withColumn("written_uri", F.lit(None).cast("string")),
        DAG, "work").collect()
    script = [r for r in rows if r.parent_step == "SCRIPT_GENERATION"]
    assert {(r.step, r.task_id) for r in script} == {
        (s, t) for s in ("IMAGE_GENERATION", "SPEECH_GENERATION") for t in ("S7", "S1", "S2")}
    (lone,) = [r for r in rows if r.parent_step == "SEGMENTATION"]
    assert (lone.task_id, json.loads(lone.params)) == ("S3", {"data": "x", "index": 0})
    assert lone.input_uri == "s3://work/u/j/SEGMENTATION/S3/result.png"
    assert {json.loads(r.params).get("data") for r in script} == {None, 5}


def test_input_uris_past_the_end(spark):
    key = "job_id string, step string, task_id string"
    children = spark.createDataFrame([("j", "A", "S0", i) for i in range(4)], f"{key}, child_pos int")
    uris = spark.createDataFrame([("j", "A", "S0", 0, "a"), ("j", "A", "S0", 1, "b")],
                                 f"{key}, uri_pos int, uri string")
    got = {r.child_pos: r.written_uri for r in fanout.with_input_uris(children, uris).collect()}
    assert got == {0: "a", 1: "b", 2: "b", 3: "b"}


def test_done_rules(spark):
    p = "s3://work/u/j/A/"
    tasks = spark.createDataFrame([(t, p) for t in ("S0", "S1", "S2", "root")],
                                  "task_id string, step_prefix string")

    def done(files, **options):
        listing = spark.createDataFrame([(p + f,) for f in files], "path string")
        return {r.task_id for r in routing.split_done(tasks, listing, **options).skipped.collect()}

    assert done(["S1/result.png"]) == {"S1"}
    assert done(["S0/result.json"]) == {"S0", "root"}
    assert done(["metrics.json"]) == {"root"}
    assert done(["result.mp4"]) == {"root"}
    assert done(["S1/metrics.json", "S2/result.mp3"]) == set()
    assert done(["S2/result.mp3"], all_types=True) == {"S2"}


def test_queues(spark):
    rows = spark.createDataFrame([(s,) for s in (-5, 0, 900, 2000)], "s int")
    assert [r[0] for r in rows.select(queues.clamp_delay(F.col("s"))).collect()] == [0, 0, 900, 900]
    letters = queues.dlq_records(spark.createDataFrame(
        [("a", '{"retry_count": 3}', None), ("b", "oops", "parse")],
        "message_id string, body string, reason string"))
    got = {r.message_id: json.loads(r.body) for r in letters.collect()}
    assert got["a"] == {"reason": "poison-pill", "retry_count": 3, "original": {"retry_count": 3}}
    assert got["b"] == {"reason": "parse", "retry_count": 0, "original": "oops"}
    # An enveloped payload is what the letter carries, with its own count.
    inner = json.dumps({"retry_count": 4, "job_id": "j"})
    letters = queues.dlq_records(spark.createDataFrame(
        [("c", json.dumps({"Message": inner}), None), ("d", json.dumps({"Message": "oops"}), "parse")],
        "message_id string, body string, reason string"))
    got = {r.message_id: json.loads(r.body) for r in letters.collect()}
    assert (got["c"]["retry_count"], got["c"]["original"]["job_id"]) == (4, "j")
    assert (got["d"]["retry_count"], got["d"]["original"]) == (0, '{"Message": "oops"}')
    long_id = "t" * 200
    out = queues.outbox(spark.createDataFrame(
        [("Q.FIFO", "é" * 4, "g", long_id), ("Q.fifo", "x", "", "t"), ("q", "x" * 9, None, "t"),
         ("q", None, None, "t")],
        "queue string, body string, group_id string, task_id string"), max_bytes=8)
    (sent,) = out.sent.collect()
    assert sent.dedup_id == "t" * 128
    assert {r.problem for r in out.refused.collect()} == {"fifo_without_group", "body_too_large", "empty_body"}


def test_hook_outputs(spark):
    class Odd(hooks.Hook):
        def process(self, model, message):
            return {"a": {"result": [b"1", {"x": 1}]}, "b": {"result": []}, "c": {"result": 5},
                    "d": {"result": {"f.png": b"1", "g.png": b"22"}}, "e": {}}[message["task_id"]]

    messages = spark.createDataFrame(
        [(t, "j", "AVATAR", t, "{}") for t in "abcde"],
        "message_id string, job_id string, step string, task_id string, params string")
    done = hooks.apply_hook(messages, Odd())
    sizes = {r.task_id: [(i["shape"], i["kind"], i["list_size"]) for i in r["items"]]
             for r in done.succeeded.collect()}
    assert sizes == {"a": [("single", "bytes", 2), ("single", "json", 2)],
                     "d": [("files", "bytes", None)] * 2, "e": []}
    assert {r.task_id: r.error_code for r in done.failed.collect()} == {
        "b": "PROCESS_ERROR", "c": "PROCESS_ERROR"}


def test_hook_refuses(spark):
    messages = spark.createDataFrame(
        [("m", "j", "AVATAR", "S0", '{"k": 10}')],
        "message_id string, job_id string, step string, task_id string, params string")
    row = hooks.run_hook(messages, CountingHook()).first()
    assert (row.status, row.error_message) == ("FAILED", "k is 10")


def answer(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return model_calls.extract_answers(df).first()


def test_answers(spark):
    assert json.loads(answer(spark, 'a ```json\n{"x": {"y": 1}}\n``` {"z": 2}').answer) == {"x": {"y": 1}}
    assert json.loads(answer(spark, 'see {"a": "}"} end').answer) == {"a": "}"}
    fixed = answer(spark, "{\n  a: 1,\n  b_2 : [2]\n}")
    assert (json.loads(fixed.answer), fixed.repaired) == ({"a": 1, "b_2": [2]}, True)
    assert answer(spark, "7").is_json
    assert not answer(spark, "{'a': 1}").is_json


def responses(spark, *bodies):
    return spark.createDataFrame(
        [(i, 200, b) for i, b in enumerate(bodies)], "call_id int, status_code int, body string")


def test_responses(spark):
    def candidate(*parts, **more):
        return json.dumps({"candidates": [{"content": {"parts": list(parts)}, **more}]})

    image = {"inline_data": {"mime_type": "image/png", "data": "QUI="}}
    rows = model_calls.parse_text_responses(responses(
        spark, candidate({"text": " a"}, image, {"text": "b "}, finish_reason="STOP"),
        candidate(image, {"inlineData": {"mimeType": "image/jpeg", "data": "QQ=="}}),
        candidate({"text": ""}), candidate(), '{"candidates": []}', "x")).orderBy("call_id").collect()
    assert (rows[0].text, rows[0].finish_reason, rows[0].image) == ("ab", "STOP", None)
    assert bytes(rows[1].image) == b"A"
    assert [r.problem for r in rows] == [None, None, "no_text", "no_parts", "no_candidates", "not_json"]
    broken = {"inline_data": {"mime_type": "image/png", "data": "Q"}}
    assert model_calls.parse_text_responses(
        responses(spark, candidate(broken))).first().problem == "bad_image"
    first = model_calls.parse_image_responses(responses(spark, candidate({"text": "t"}, image))).first()
    assert bytes(first.image) == b"AB"


def test_logs(spark):
    lines = spark.createDataFrame([
        ('{"timestamp":"t","level":"INFO","logger":"l","msg":"m","n":1}',), ("junk",)], "value string")
    good, bad = logs.parse_log_lines(lines).collect()
    assert (good.level, good.extras, bad.parsed) == ("INFO", {"n": "1"}, False)
    levels = spark.createDataFrame([(x,) for x in ("DEBUG", "INFO", "ERROR", "AUDIT")], "level string")
    assert {r.level for r in logs.log_filter(levels, "warning").collect()} == {"ERROR", "AUDIT"}


@pytest.mark.parametrize("name, clean, mime", [
    ("a/b.png", "ab.png", "image/png"), ("..x", None, None), ("a\x00.json", "a.json", None),
    ("$x.png", None, None), (".json", ".json", "application/octet-stream"),
    ("n" * 256, None, None), ("T.TXT", "T.TXT", "text/plain; charset=utf-8"), (".", None, None)])
def test_names(spark, name, clean, mime):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(paths.clean_file_name(F.col("n")), paths.content_type(F.col("n"))).first()
    assert got[0] == clean and (mime is None or got[1] == mime)


@pytest.mark.parametrize("uri, problem, bucket, key", [
    (" s3://b/k/x ", None, "b", "k/x"), ("s3://b", "no_key", None, None),
    ("s3:///k", "empty_bucket", None, None), ("s3://b/", "empty_key", None, None),
    ("s3://b/k?x", "character", None, None), ("r2://b/k", "scheme", None, None), (" ", "empty", None, None)])
def test_uris(spark, uri, problem, bucket, key):
    c = F.col("u")
    df = spark.createDataFrame([(uri,)], "u string")
    got = df.select(paths.uri_problem(c), paths.uri_bucket(c), paths.uri_key(c)).first()
    assert tuple(got) == (problem, bucket, key)


def test_given_deduplication_ids_win(spark):
    rows = spark.createDataFrame(
        [("j", "t1", "d", 0), ("j", "t2", "d", 1), ("j", "t3", "", 2), ("j", "t3", None, 3)],
        "job_id string, task_id string, dedup_id string, seq int")
    got = {(r.dedup_id, r.seq) for r in queues.dedup_messages(rows, ["job_id"]).collect()}
    assert got == {("d", 0), ("t3", 2)}


def test_no_row_is_lost_by_a_null(spark):
    steps = spark.createDataFrame([("A",), ("B",), (None,)], "step string")
    mine, released = routing.split_for_worker(steps, "A")
    assert (mine.count(), released.count()) == (1, 2)


def test_fallback_uri_is_the_parents_own(spark):
    parent = spark.createDataFrame(
        [("j", "SEGMENTATION", "S3", "u", "v1", ['"x"'], "s3://elsewhere/u/j/SEGMENTATION/S3/")],
        "job_id string, step string, task_id string, user_id string, schema string, "
        "children array<string>, output_prefix string")
    rows = fanout.fanout_children(
        fanout.explode_children(parent).withColumn("written_uri", F.lit(None).cast("string")),
        DAG, "work").collect()
    assert {r.input_uri for r in rows} == {"s3://elsewhere/u/j/SEGMENTATION/S3/result.png"}
    assert all(r.output_prefix.startswith("s3://work/") for r in rows)


def test_objects_are_read_or_refused(spark, tmp_path):
    from taskframe.sources.objects import read_json_objects, read_objects

    for name, text in (("a.json", '{"x": 1}'), ("b.json", "oops"), ("c.exe", "x"), ("d.json", "1" * 50)):
        (tmp_path / name).write_text(text)
    read, refused = read_objects(spark, str(tmp_path), max_bytes=20)
    assert {r.path[-6:] for r in read.collect()} == {"a.json", "b.json"}
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in refused.collect()} == {
        ("c.exe", "extension"), ("d.json", "too_large")}
    parsed, malformed, left = read_json_objects(spark, str(tmp_path), max_bytes=20)
    assert (parsed.count(), malformed.count(), left.count()) == (1, 1, 2)


def test_state_from_created_table_to_replayed_transitions(spark, tmp_path):
    import datetime as dt

    from taskframe import schemas
    from taskframe.operators import reads, state

    reads.create_tables(spark, str(tmp_path), {"tasks": schemas.tasks()})
    created = spark.read.parquet(str(tmp_path / "tasks"))
    at = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    kind = ("job_id string, step string, task_id string, user_id string, status string, "
            "retry_count int, parent_task_id string, parent_step string, seq long, ts timestamp_ntz")
    events = spark.createDataFrame([("j", "A", "S1", "u", "QUEUED", 0, "S0", "B", 1, at[1])], kind)
    tasks = state.upsert_tasks(events, created)
    moves = spark.createDataFrame(
        [("j", "A", "S1", "FAILED", 0, at[0]), ("j", "A", "S1", "STARTED", 2, at[2]),
         ("j", "A", "S1", "RETRIED", 3, at[3]), ("j", "A", "S1", "RETRIED", 3, at[3]),
         ("j", "A", "S1", "SUCCEEDED", 4, at[4])],
        "job_id string, step string, task_id string, status string, seq long, ts timestamp_ntz")
    once = state.task_state(tasks, moves)
    again = state.task_state(once, moves)
    (row,) = again.collect()
    assert once.columns == again.columns and once.collect() == [row]
    assert (row.status, row.retry_count, row.last_seq) == ("SUCCEEDED", 1, 4)
    assert (row.started_at, row.finished_at, row.parent_step) == (at[2], at[4], "B")
    (folded,) = state.upsert_tasks(events, again).collect()
    assert (folded.status, folded.started_at) == ("SUCCEEDED", at[2])


def test_children_of_a_step(spark):
    from taskframe.operators import reads

    parents = spark.createDataFrame([("j", "A", "S0")], "job_id string, step string, task_id string")
    tasks = spark.createDataFrame(
        [("j", "X", "S1", "A", "S0"), ("j", "X", "S2", "B", "S0"), ("k", "X", "S3", "A", "S0")],
        "job_id string, step string, task_id string, parent_step string, parent_task_id string")
    assert [r.task_id for r in reads.children_of(tasks, parents).collect()] == ["S1"]


def test_long_images_stay_on_one_line(spark):
    """A base64 text holds no line ends, however long it is."""
    from taskframe.operators.model_calls import model_requests

    prompt = spark.createDataFrame(
        [("c", "text", "say \"this\"\n", None, None, [("a.png", bytearray(range(256)) * 40)])],
        "call_id string, kind string, prompt string, temperature double, aspect_ratio string, "
        "images array<struct<name:string,content:binary>>")
    parts = json.loads(model_requests(prompt).accepted.first().body)["contents"][0]["parts"]
    assert parts[0]["text"] == "say \"this\"\n"
    assert base64.b64decode(parts[1]["inline_data"]["data"], validate=True) == bytes(range(256)) * 40
