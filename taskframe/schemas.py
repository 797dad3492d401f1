"""Table schemas, status vocabularies and limits."""

from pyspark.sql import types as T

# Status vocabularies.
JOB_STATUSES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED", "DLQ")
TASK_STATUSES = ("QUEUED", "STARTED", "RETRIED", "SUCCEEDED", "FAILED", "CANCELLED", "DLQ")

# Limits of the message contract and of the object store.
SCHEMA_VERSIONS = ("v1",)
MAX_USER_ID = 128
MAX_JOB_ID = 128
MAX_TASK_ID = 256
MAX_TRACE_ID = 128
MAX_PARAMS_BYTES = 65_536
MAX_PARAMS_DEPTH = 5
MAX_BODY_BYTES = 262_144
MAX_READ_BYTES = 50 * 1024 * 1024
MAX_WRITE_BYTES = 1024 * 1024 * 1024
MAX_DELAY_SECONDS = 900
MAX_RECEIVES = 5
MAX_DEDUP_ID = 128
SEND_BATCH = 10
RECEIVE_BATCH = 10
LIST_JOBS_LIMIT = 100
LIST_TASKS_LIMIT = 200
DEFAULT_TASK_ID = "S0"

# Fields a task message must carry.
REQUIRED_FIELDS = (
    "job_id", "task_id", "user_id", "schema", "step",
    "input_uri", "output_prefix", "params",
)

JOB_KEY = ("job_id",)
TASK_KEY = ("job_id", "step", "task_id")


def _struct(spec: str) -> T.StructType:
    """`name:type` pairs; a trailing `!` marks a column that must not be null."""
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(
            name, T._parse_datatype_string(kind.rstrip("!")), not kind.endswith("!")))
    return T.StructType(fields)


def raw_messages() -> T.StructType:
    return _struct("message_id:string! sent_ts:timestamp_ntz receive_count:int body:string")


def task_messages() -> T.StructType:
    return _struct(
        "job_id:string! task_id:string! user_id:string! schema:string! step:string! "
        "input_uri:string! output_prefix:string! params:string! retry_count:bigint! "
        "trace_id:string parent_task_id:string")


def work_messages() -> T.StructType:
    return _struct(
        "job_id:string! task_id:string! user_id:string! schema:string! step:string! "
        "input_uri:string! output_prefix:string! params:string! retry_count:bigint! "
        "parent_task_id:string")


def jobs() -> T.StructType:
    return _struct(
        "job_id:string! user_id:string! schema:string! status:string! trace_id:string "
        "attrs:string! created_at:timestamp_ntz! updated_at:timestamp_ntz! "
        "first_seq:bigint last_seq:bigint")


def tasks() -> T.StructType:
    return _struct(
        "job_id:string! step:string! task_id:string! user_id:string! status:string! "
        "retry_count:int! parent_task_id:string parent_step:string input_uri:string! output_prefix:string! "
        "params:string! error_code:string error_message:string "
        "created_at:timestamp_ntz! updated_at:timestamp_ntz! "
        "started_at:timestamp_ntz finished_at:timestamp_ntz first_seq:bigint last_seq:bigint")


def task_results() -> T.StructType:
    return _struct(
        "job_id:string! step:string! task_id:string! primary_result_uri:string "
        "metrics_uri:string primary_mime:string primary_size_bytes:bigint "
        "extra:string! created_at:timestamp_ntz! updated_at:timestamp_ntz "
        "first_seq:bigint last_seq:bigint")
