"""From raw queue rows to message payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import (
    as_text, field, is_object, is_string, sealed, strict_json, strict_struct,
    with_strict_json, with_strict_struct,
)


def parse_envelopes(raw: DataFrame, unwrap: bool = True) -> DataFrame:
    """Add `payload` (VARIANT) and `parse_problem` (null when parsed).

    An object with a `Message` member is an envelope around the payload, given
    as JSON text or as a JSON value.  A missing receive count reads as 1.
    """
    df = with_strict_json(raw, "_doc", "body")
    if unwrap:
        inner = F.col("_inner")
        df = df.withColumn("_inner", field(F.col("_doc"), "Message")).withColumn(
            "payload",
            F.when(inner.isNull(), F.col("_doc"))
            .when(is_string(inner), strict_json(as_text(inner)))
            .otherwise(inner)).drop("_inner")
    else:
        df = df.withColumn("payload", F.col("_doc"))
    problem = (
        F.when(F.col("body").isNull() | (F.ltrim("body") == ""), "empty_body")
        .when(F.col("_doc").isNull(), "not_json")
        .when(F.col("payload").isNull(), "envelope_not_json")
        .when(~is_object(F.col("payload")), "not_an_object"))
    df = df.withColumns({
        "parse_problem": problem, "receive_count": F.coalesce("receive_count", F.lit(1))})
    return sealed(df, raw.columns, ["payload", "parse_problem"])


def read_payloads(raw: DataFrame, ddl: str) -> DataFrame:
    """Add `_r`, the named members of each payload, and `_text`, its JSON text.

    The members come out of one pass over the body, a second one for rows with
    an envelope.  `_r` is null where the payload is no JSON object.
    """
    df = with_strict_struct(raw, "_r", "body", f"Message variant, {ddl}")
    inner = F.col("_r.Message")
    text = (
        F.when(inner.isNull(), F.col("body"))
        .when(is_string(inner), as_text(inner))
        .otherwise(F.to_json(inner)))
    df = df.withColumns({"_enveloped": inner.isNotNull(), "_text": text})
    opened = F.when(~F.coalesce("_enveloped", F.lit(False)), F.col("_r")).otherwise(
        strict_struct(F.col("_text"), f"Message variant, {ddl}"))
    return df.withColumn("_r", opened).withColumn(
        "receive_count", F.coalesce("receive_count", F.lit(1))).drop("_enveloped")


def payload_problem() -> Column:
    """Why `_r` is null, after `read_payloads`; for rejected rows only."""
    whole = strict_json(F.col("body"))
    return (
        F.when(F.col("body").isNull() | (F.ltrim("body") == ""), "empty_body")
        .when(whole.isNull(), "not_json")
        .when(field(whole, "Message").isNotNull() & strict_json(F.col("_text")).isNull(),
              "envelope_not_json")
        .otherwise("not_an_object"))
