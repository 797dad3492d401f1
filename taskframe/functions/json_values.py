"""JSON documents as VARIANT: strict parsing, typed fields, size and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listed(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _only_value(listed: Column, text: Column) -> Column:
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    closed = ~text.contains("]") | keyed.isNotNull()
    return F.when(alone & closed, F.try_variant_get(listed, "$[0]", "variant"))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null.

    Spark's JSON functions stop at the end of the first value and ignore what
    follows.  Inside brackets, trailing text breaks the document or adds an
    element, unless it starts with a closing bracket; a second wrapping in
    braces, which that text cannot satisfy too, settles those cases.
    """
    return _only_value(_listed(text), text)


def with_strict_json(df: DataFrame, name: str, text: str) -> DataFrame:
    """Add `strict_json` of a column, parsing most rows once."""
    listed = df.withColumn(f"_listed_{name}", _listed(F.col(text)))
    return listed.withColumn(
        name, _only_value(F.col(f"_listed_{name}"), F.col(text))).drop(f"_listed_{name}")


def _listed_struct(text: Column, ddl: str) -> Column:
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{ddl}>>", options)


def _only_struct(listed: Column, text: Column) -> Column:
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    closed = ~text.contains("]") | keyed.isNotNull()
    return F.when((F.size(listed) == 1) & closed, F.get(listed, F.lit(0)))


def strict_struct(text: Column, ddl: str) -> Column:
    """Members of a text that is exactly one JSON object, else null.

    As strict as `strict_json`, in one pass.  A STRING member takes any value,
    other than strings as JSON text, and is null when null or absent; a
    VARIANT member tells all of these apart.
    """
    return _only_struct(_listed_struct(text, ddl), text)


def with_strict_struct(df: DataFrame, name: str, text: str, ddl: str) -> DataFrame:
    """Add `strict_struct` of a column, parsing most rows once."""
    listed = df.withColumn(f"_listed_{name}", _listed_struct(F.col(text), ddl))
    return listed.withColumn(
        name, _only_struct(F.col(f"_listed_{name}"), F.col(text))).drop(f"_listed_{name}")


def may_be_no_string(text: Column) -> Column:
    """Whether a STRING member may stem from a number, boolean, object or array."""
    return text.rlike(
        r"\A(?:[\[{\x22]|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z|true\z|false\z)")


def members(doc: Column, names, kind: str = "variant") -> Column:
    """Members of an object as one struct, null if `doc` is no object."""
    return F.try_variant_get(
        doc, "$", "struct<" + ",".join(f"`{n}`:{kind}" for n in names) + ">")


def is_object(doc: Column) -> Column:
    return members(doc, ["_"]).isNotNull()


def json_or_text(text: Column) -> Column:
    """VARIANT of a JSON text; text that is not JSON becomes a JSON string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def field(doc: Column, name: str) -> Column:
    """A member as VARIANT: SQL null if absent, a VARIANT null if JSON null."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    """Scalars as plain text, objects and arrays as JSON text."""
    return F.try_variant_get(value, "$", "string")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_null(value: Column) -> Column:
    """Absent or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def is_object_text(json_text: Column) -> Column:
    return F.coalesce(json_text.startswith("{"), F.lit(False))


def sealed(df: DataFrame, keep, columns) -> DataFrame:
    """Columns `keep` as they are and `columns` computed once.

    A filter on something derived from a projected column is pushed below the
    projection with the column's expression copied into it, so a parse would
    run again for each use.  Filters stay above a generator, and `inline` of a
    one-element array is a generator that passes its columns through.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, and keep later filters from computing them again."""
    staged = df.withColumns({f"_staged_{name}": expr for name, expr in columns.items()})
    return sealed(
        staged, df.columns, [F.col(f"_staged_{name}").alias(name) for name in columns])


_STRING = r'"[^"]*"'


def _without_escapes(json_text: Column) -> Column:
    """The text with escape pairs dropped, so that quotes only delimit."""
    return F.regexp_replace(json_text, r"(?s)\\.", "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def spaced_ascii_bytes(json_text: Column) -> Column:
    """Bytes of a JSON text written with `, ` and `: ` and ASCII escapes.

    This is the size the params limit is stated in.  Characters outside ASCII
    cost six bytes each, twelve beyond U+FFFF, DEL costs six.
    """
    bare = F.regexp_replace(_without_escapes(json_text), _STRING, "")
    beyond_ascii = F.length(json_text) - F.length(
        F.regexp_replace(json_text, r"[^\x00-\x7f]", ""))
    beyond_bmp = F.length(json_text) - F.length(
        F.regexp_replace(json_text, r"[\x{10000}-\x{10FFFF}]", ""))
    return (
        F.length(json_text) + _count(bare, ",:") + 5 * beyond_ascii
        + 6 * beyond_bmp + 5 * _count(json_text, "\x7f"))


def size_at_most(json_text: Column, limit: int) -> Column:
    """Exact comparison; short texts pass on their length alone."""
    # No character grows by more than a factor of twelve.
    return F.when(F.length(json_text) * 12 <= limit, F.lit(True)).otherwise(
        spaced_ascii_bytes(json_text) <= limit)


def depth_at_most(json_text: Column, limit: int) -> Column:
    """Whether no node lies deeper than `limit`, the root being at 0.

    Every pass turns the innermost containers into leaves, so the root becomes
    a leaf after as many passes as the document is deep.  A text with no more
    than `limit` opening brackets cannot be too deep and skips the passes.
    """
    keyless = F.regexp_replace(_without_escapes(json_text), _STRING + r"\s*:", "")
    leaves = F.regexp_replace(keyless, _STRING, "x")
    shape = F.regexp_replace(F.translate(leaves, "{}[]", "()()"), r"[^()]+", "x")
    shape = F.regexp_replace(shape, r"\(\)", "x")
    for _ in range(limit):
        shape = F.regexp_replace(shape, r"\(x+\)", "x")
    return F.when(_count(json_text, "{[") <= limit, F.lit(True)).otherwise(
        shape.rlike(r"\Ax+\z"))
