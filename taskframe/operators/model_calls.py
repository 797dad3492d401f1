"""Requests to a generative model, and what its responses say.

The calls themselves belong to a hook (see `hooks`); these jobs prepare the
request bodies as a table and read a table of responses.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskframe.functions.json_values import computed_once, strict_json, with_strict_json
from taskframe.functions.paths import literal_map
from taskframe.functions.text import strip
from taskframe.operators.percentiles import grouped_percentile

# Supported aspect ratios and their pixel sizes.
ASPECT_RATIOS = {
    "1:1": (1024, 1024),
    "2:3": (832, 1248),
    "3:2": (1248, 832),
    "3:4": (864, 1184),
    "4:3": (1184, 864),
    "4:5": (896, 1152),
    "5:4": (1152, 896),
    "9:16": (768, 1344),
    "16:9": (1344, 768),
    "21:9": (1536, 672),
}

# Content types of request images by extension.
IMAGE_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
}
DEFAULT_IMAGE_TYPE = "image/jpeg"
RAW_IMAGE_TYPE = "image/png"
DEFAULT_TEMPERATURE = 0.7

_PART = (
    "struct<text:string,inlineData:struct<mimeType:string,mime_type:string,data:string>,"
    "inline_data:struct<mimeType:string,mime_type:string,data:string>>")


class Requests(NamedTuple):
    accepted: DataFrame
    refused: DataFrame


def image_type(name: Column) -> Column:
    """By extension for files; raw bytes (no name) are PNG."""
    ext = F.lower(F.regexp_extract(name, r"[^./](\.[^./]*)\z", 1))
    return F.when(name.isNull(), RAW_IMAGE_TYPE).otherwise(
        F.coalesce(F.element_at(literal_map(IMAGE_TYPES), ext), F.lit(DEFAULT_IMAGE_TYPE)))


def _one_line_base64(content: Column) -> Column:
    """Spark breaks lines after 76 characters, depending on its settings."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def image_parts(images: Column) -> Column:
    """Request parts of an array of (name, content) structs."""
    def part(image: Column) -> Column:
        return F.struct(
            F.lit(None).cast("string").alias("text"),
            F.struct(image_type(image["name"]).alias("mime_type"),
                     _one_line_base64(image["content"]).alias("data")).alias("inline_data"))

    return F.transform(images, part)


def model_requests(prompts: DataFrame) -> Requests:
    """Request bodies of text and image prompts.

    Needs kind (`text` or `image`), prompt, temperature and aspect_ratio;
    `images` (array of name and content) and `response_mime_type` are optional.
    Image prompts with an unsupported ratio are refused.
    """
    c = F.col
    text = F.struct(
        c("prompt").alias("text"),
        F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"))
    parts = F.array(text)
    if "images" in prompts.columns:
        parts = F.concat(parts, F.coalesce(image_parts(c("images")), F.array().cast(
            "array<struct<text:string,inline_data:struct<mime_type:string,data:string>>>")))
    temperature = F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)).alias("temperature")
    mime = (c("response_mime_type") if "response_mime_type" in prompts.columns
            else F.lit(None).cast("string"))
    contents = F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts")))
    ratio = F.coalesce("aspect_ratio", F.lit("1:1"))
    text_body = F.to_json(F.struct(
        contents.alias("contents"),
        F.struct(temperature, mime.alias("response_mime_type")).alias("generationConfig")))
    image_body = F.to_json(F.struct(
        contents.alias("contents"),
        F.struct(
            F.array(F.lit("IMAGE")).alias("responseModalities"),
            F.struct(ratio.alias("aspectRatio")).alias("imageConfig"),
            temperature).alias("generationConfig")))
    refused = F.coalesce((c("kind") == "image") & ~ratio.isin(*ASPECT_RATIOS), F.lit(False))
    widths = literal_map({r: w for r, (w, _) in ASPECT_RATIOS.items()})
    heights = literal_map({r: h for r, (_, h) in ASPECT_RATIOS.items()})
    image = c("kind") == "image"
    return Requests(
        accepted=prompts.filter(~refused).select(
            "call_id", "kind",
            F.when(image, F.element_at(widths, ratio)).alias("width"),
            F.when(image, F.element_at(heights, ratio)).alias("height"),
            F.when(image, image_body).otherwise(text_body).alias("body")),
        refused=prompts.filter(refused).select(
            "call_id", "aspect_ratio", F.lit("aspect_ratio").alias("problem")))


def _inline(part: Column) -> Column:
    return F.coalesce(part["inline_data"], part["inlineData"])


def _mime(part: Column) -> Column:
    data = _inline(part)
    return F.coalesce(data["mime_type"], data["mimeType"], F.lit(""))


def _is_image(part: Column) -> Column:
    return _mime(part).startswith("image/")


def read_responses(responses: DataFrame) -> DataFrame:
    """Add candidates, finish_reason, parts and `problem` for unusable bodies."""
    c = F.col
    df = with_strict_json(responses, "_doc", "body")
    first = "$.candidates[0]"

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(c("_doc"), path, kind)

    df = computed_once(
        df,
        candidates=F.coalesce(F.size(at("$.candidates", "array<variant>")), F.lit(0)),
        finish_reason=F.coalesce(
            F.nullif(at(f"{first}.finishReason"), F.lit("")), at(f"{first}.finish_reason")),
        parts=at(f"{first}.content.parts", f"array<{_PART}>"))
    problem = (
        F.when(c("status_code") != 200, "http_status")
        .when(c("_doc").isNull(), "not_json")
        .when(c("candidates") <= 0, "no_candidates")
        .when(F.coalesce(F.size("parts"), F.lit(0)) <= 0, "no_parts"))
    return df.withColumn("problem", problem).drop("_doc")


def parse_text_responses(responses: DataFrame) -> DataFrame:
    """Text of each response, else its last image, else a problem.

    All text parts of the first candidate are joined and trimmed.  Parts with
    inline data are never text.
    """
    c = F.col
    df = read_responses(responses)
    texts = F.filter("parts", lambda p: _inline(p).isNull() & (F.length(p["text"]) > 0))
    images = F.filter(
        "parts", lambda p: _is_image(p) & (F.length(_inline(p)["data"]) > 0))
    df = computed_once(df, _texts=texts, _images=images)
    has_text, has_image = F.size("_texts") > 0, F.size("_images") > 0
    good = c("problem").isNull()
    last = _inline(F.try_element_at(c("_images"), F.lit(-1)))["data"]
    return df.withColumns({
        "text": F.when(good & has_text, strip(
            F.array_join(F.transform("_texts", lambda p: p["text"]), ""))),
        "image": F.when(good & ~has_text & has_image, F.try_to_binary(last, F.lit("base64"))),
    }).withColumn(
        "problem",
        F.when(good & ~has_text & ~has_image, "no_text")
        .when(good & ~has_text & c("image").isNull(), "bad_image")
        .otherwise(c("problem"))).drop("_texts", "_images", "parts")


def parse_image_responses(responses: DataFrame) -> DataFrame:
    """The first image part of each response, else a problem."""
    c = F.col
    df = read_responses(responses)
    df = computed_once(df, _images=F.filter("parts", _is_image))
    good = c("problem").isNull()
    found = F.size("_images") > 0
    data = F.coalesce(_inline(F.try_element_at(c("_images"), F.lit(1)))["data"], F.lit(""))
    return df.withColumns({
        "image": F.when(good & found, F.try_to_binary(data, F.lit("base64"))),
    }).withColumn(
        "problem",
        F.when(good & ~found, "no_image").when(good & c("image").isNull(), "bad_image")
        .otherwise(c("problem"))).drop("_images", "parts")


def extract_answers(texts: DataFrame) -> DataFrame:
    """JSON found in each `text`: answer (JSON text), where, repaired, is_json.

    Looked for in a fenced block, else between the outermost braces, else in the
    whole text.  Bare keys at line starts are quoted for a second try.  Text
    without JSON is wrapped as {"meta": ..., "raw_response": ...}.
    """
    c = F.col
    fenced = F.regexp_extract("text", r"(?sU)```json\s*+(\{.*?\})\s*+```", 1)
    braces = F.regexp_substr("text", F.lit(r"(?s)\{.*\}"))
    df = computed_once(texts, _fenced=fenced, _braces=braces)
    df = computed_once(
        df,
        where=F.when(c("_fenced") != "", "fence").when(c("_braces").isNotNull(), "braces")
        .otherwise("text"),
        _found=F.coalesce(F.nullif("_fenced", F.lit("")), c("_braces"), c("text")))
    df = with_strict_json(df, "_first", "_found")
    quoted = F.regexp_replace(
        "_found", r"(?U)(\n\s*)([a-zA-Z_][a-zA-Z0-9_]*)\s*:", r'$1"$2":')
    df = computed_once(
        df, _second=F.when(c("_first").isNull(), strict_json(quoted)))
    doc = F.coalesce("_first", "_second")
    wrapped = F.to_json(F.struct(
        F.struct(F.lit("Raw response (not JSON)").alias("note")).alias("meta"),
        c("text").alias("raw_response")))
    return df.withColumns({
        "is_json": doc.isNotNull(),
        "repaired": c("_first").isNull() & c("_second").isNotNull(),
        "answer": F.when(doc.isNotNull(), F.to_json(doc)).otherwise(wrapped),
    }).drop("_fenced", "_braces", "_found", "_first", "_second")


def call_metrics(parsed: DataFrame) -> DataFrame:
    """Calls, sizes and latency per kind of call, status and finish reason."""
    keys = ["kind", "status_code", "finish_reason"]
    millis = F.round(F.col("elapsed_sec") * 1000).cast("bigint")
    return grouped_percentile(parsed.withColumn("_ms", millis), keys, "_ms", 0.95, "p95_ms", [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("problem").isNotNull()).alias("problems"),
        F.sum(F.col("candidates").cast("bigint")).alias("candidates"),
        F.sum("prompt_chars").alias("prompt_chars"),
        F.sum(F.length("text").cast("bigint")).alias("response_chars"),
        F.sum(F.octet_length("image").cast("bigint")).alias("response_bytes"),
        F.sum("_ms").alias("elapsed_ms")])
