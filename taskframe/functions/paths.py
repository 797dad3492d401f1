"""Object paths, file names, slots and content types as column expressions.

Layout of the object store: s3://bucket/user/job/STEP/task/file.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskframe.functions.text import (
    contains_any, has_control_char, is_blank, is_bucket_name, is_id, strip,
    strip_slashes,
)
from taskframe.schemas import (
    DEFAULT_TASK_ID, MAX_JOB_ID, MAX_TASK_ID, MAX_USER_ID,
)

# Allowed file extensions and their content types.
EXTENSION_TYPES = {
    ".json": "application/json",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".mp4": "video/mp4",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".txt": "text/plain",
}

# Main artifact of a step by its file type.
PRIMARY_NAMES = {
    "json": "result.json",
    "png": "result.png",
    "mp4": "result.mp4",
    "mp3": "result.mp3",
    "wav": "result.wav",
}
DEFAULT_PRIMARY_NAME = "result.json"


def _sql_literal(value) -> str:
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(entries: dict) -> Column:
    """A constant map, built as one expression."""
    flat = ", ".join(_sql_literal(x) for pair in entries.items() for x in pair)
    return F.expr(f"map({flat})")


def has_extension(name: Column, extensions=tuple(EXTENSION_TYPES)) -> Column:
    suffixes = "|".join(e.lstrip(".").lower() for e in extensions)
    return F.lower(name).rlike(rf"\.(?:{suffixes})\z")


# --- URIs -------------------------------------------------------------------

def uri_problem(uri: Column) -> Column:
    """Name of the first rule an s3 URI breaks, null for a good one."""
    u = strip(uri)
    path = F.substring(u, 6, 1 << 30)
    return (
        F.when(is_blank(uri), "empty")
        .when(~u.startswith("s3://"), "scheme")
        .when(contains_any(u, ("\\", "?", "#")), "character")
        .when(~path.contains("/"), "no_key")
        .when(path.startswith("/"), "empty_bucket")
        .when(path.rlike(r"\A[^/]+/\z"), "empty_key"))


def uri_bucket(uri: Column) -> Column:
    bucket = F.regexp_extract(strip(uri), r"(?s)\As3://([^/]+)/(.+)\z", 1)
    return F.when(uri_problem(uri).isNull(), bucket)


def uri_key(uri: Column) -> Column:
    key = F.regexp_extract(strip(uri), r"(?s)\As3://([^/]+)/(.+)\z", 2)
    return F.when(uri_problem(uri).isNull(), key)


_PREFIX = (
    r"\As3://[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)"
    r"/[^/]+(?:/[^/]+)?/?\n?\z")


def prefix_user_id(prefix: Column) -> Column:
    return F.nullif(F.regexp_extract(prefix, _PREFIX, 1), F.lit(""))


def prefix_job_id(prefix: Column) -> Column:
    return F.nullif(F.regexp_extract(prefix, _PREFIX, 2), F.lit(""))


def step_level(prefix: Column) -> Column:
    """`s3://bucket/user/job/STEP/` of a prefix with or without a task."""
    parts = F.split(F.regexp_replace(prefix, r"/+\z", ""), "/")
    return F.when(
        F.size(parts) >= 6,
        F.concat(F.lit("s3://"), F.array_join(F.slice(parts, 3, 4), "/"), F.lit("/")),
    ).otherwise(prefix)


def task_prefix(bucket: Column, user: Column, job: Column, step: Column,
                task: Column) -> Column:
    return F.concat(
        F.lit("s3://"), F.concat_ws("/", bucket, user, job, step, task), F.lit("/"))


def checked_prefix(bucket: Column, user: Column, job: Column, step: Column,
                   steps, task: Column | None = None) -> Column:
    """Canonical prefix of validated parts, null if a part is not acceptable."""
    given = [bucket, user, job, step] + ([] if task is None else [task])
    b, u, j, s, *t = [strip_slashes(strip(c)) for c in given]
    s = F.upper(s)
    good = (
        is_bucket_name(b) & is_id(u, MAX_USER_ID) & is_id(j, MAX_JOB_ID)
        & s.isin(*steps) & ~b.contains(".."))
    for c in given:
        good = good & (F.length(c) > 0)
    if t:
        good = good & is_id(t[0], MAX_TASK_ID)
    path = F.concat(F.lit("s3://"), F.concat_ws("/", b, u, j, s, *t), F.lit("/"))
    return F.when(good, path)


def base_prefix(bucket: Column, user: Column, job: Column, step: Column,
                task: Column) -> Column:
    """Task folder without a final slash; a blank task means the root slot."""
    b, u, j = strip(bucket), strip(user), strip(job)
    s = F.upper(strip(step))
    t = F.when(is_blank(task), DEFAULT_TASK_ID).otherwise(strip(task))
    good = (F.length(b) > 0) & (F.length(u) > 0) & (F.length(j) > 0) & (F.length(s) > 0)
    return F.when(good, F.concat(F.lit("s3://"), F.concat_ws("/", b, u, j, s, t)))


# --- slots ------------------------------------------------------------------

def is_slot(task_id: Column) -> Column:
    return F.coalesce(task_id.rlike(r"\AS[0-9]+\z"), F.lit(False))


def slot_index(task_id: Column) -> Column:
    digits = F.regexp_extract(task_id, r"\AS\s*([+-]?[0-9]+)\s*\z", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def slot_folder(step_folder: Column, index: Column) -> Column:
    return F.concat(
        F.regexp_replace(step_folder, r"/+\z", ""), F.lit("/S"),
        index.cast("string"), F.lit("/"))


# --- file names -------------------------------------------------------------

def clean_file_name(name: Column) -> Column:
    """Artifact name without slashes and NUL, null if it is not acceptable."""
    n = F.translate(name, "/\\\x00", "")
    slashless = F.translate(name, "/\\", "")
    bad = (
        slashless.contains("..") | contains_any(n, (";", "|", "&", "$", "`"))
        | n.isin("", ".", "..") | (F.length(n) > 255))
    return F.when(~bad, n)


def file_name_problem(prefix: Column, name: Column) -> Column:
    """First rule a file name breaks below a prefix, null for a good one."""
    n = strip(name)
    return (
        F.when(is_blank(name), "empty")
        .when(uri_problem(prefix).isNotNull(), "prefix")
        .when(n.startswith("/") | n.contains(".."), "traversal")
        .when(contains_any(n, ("/", "\\")), "slash")
        .when(has_control_char(n) | contains_any(n, (";", "|")), "character")
        .when(F.octet_length(n) > 512, "length"))


def file_uri(prefix: Column, name: Column) -> Column:
    folder = F.regexp_replace(uri_key(prefix), r"/+\z", "")
    return F.when(
        file_name_problem(prefix, name).isNull(),
        F.concat(F.lit("s3://"), uri_bucket(prefix), F.lit("/"), folder, F.lit("/"),
                 strip(name)))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty for dot files."""
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    base = F.regexp_extract(base, r"(?s)\A([^?#]*)", 1)
    return F.lower(F.regexp_extract(base, r"(?s)[^.].*?(\.[^.]*)\z", 1))


# The language's own table, without what a host's files add to it.
_TYPES = mimetypes.MimeTypes()


def _with_charset(types: dict) -> dict:
    return {e: f"{t}; charset=utf-8" if t.startswith("text/") or t == "application/json" else t
            for e, t in types.items()}


def content_type(name: Column) -> Column:
    """Content type by extension; texts and JSON also name their charset."""
    ext = extension(name)
    packed = ext.isin(*_TYPES.encodings_map)
    inner = extension(F.regexp_replace(name, r"\.[^.]*\z", ""))
    # The charset is part of the tables, so that the extension is taken once.
    return F.coalesce(
        F.element_at(literal_map(_with_charset(EXTENSION_TYPES)), ext),
        F.element_at(
            literal_map(_with_charset(_TYPES.types_map[True])), F.when(packed, inner).otherwise(ext)),
        F.lit("application/octet-stream"))
