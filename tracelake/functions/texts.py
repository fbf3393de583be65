"""What is searchable in an event, and content blocks in one shape."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Keys whose content is never searchable.
OPAQUE = {"encrypted_content", "signature", "raw"}


def sdk_text(event: str = "event") -> Column:
    """Type, text blocks, tool name, status and summary, artifact address: a line each."""
    at = lambda path: F.get_json_object(event, path)
    blocks = F.from_json(at("$.payload.message.content"), "array<struct<type string, text string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.concat_ws("\n", at("$.type"), texts, at("$.payload.tool.name"), at("$.payload.tool.status"), at("$.payload.tool.summary"), at("$.payload.artifact.uri"))


def _leaves(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _leaves(x)
    elif isinstance(value, dict):
        for k, x in value.items():
            if k not in OPAQUE:
                yield from _leaves(x)


@F.pandas_udf(StringType())
def index_text(events: pd.Series) -> pd.Series:
    """All strings of a JSON text in document order, a line each, without opaque keys. A walk to any
    depth has no built-in; null and malformed JSON give null."""

    def one(text):
        try:
            return None if text is None else "\n".join(_leaves(json.loads(text)))
        except ValueError:
            return None

    return events.map(one)


BLOCK = "struct<type string, text string, thinking string, id string, name string, arguments string, input string, tool_use_id string, toolCallId string, content string, is_error boolean, isError boolean, mimeType string, data string, uri string, signature string, thinkingSignature string>"
TEXTS, CALLS, RESULTS = ("text", "input_text", "output_text"), ("tool_use", "toolCall", "tool-call", "tool_call", "function_call"), ("tool_result", "tool-result", "toolResult")


def blocks(content: Column | str) -> Column:
    """Content in JSON (a string, or an array of provider blocks) as an array of one sparse struct:
    type is text, thinking, tool-call, tool-result or unknown; unknown keeps the native type."""
    content = F.col(content) if isinstance(content, str) else content
    listed = F.from_json(content, f"array<{BLOCK}>")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), BLOCK))
    every = F.when(content.isNull(), F.array().cast(f"array<{BLOCK}>")).when(F.ltrim(content).startswith("["), listed).otherwise(plain)

    def shaped(b: Column) -> Column:
        kind = F.when(b["type"].isin(*TEXTS), "text").when(b["type"].isin("thinking", "reasoning"), "thinking").when(b["type"].isin(*CALLS), "tool-call").when(b["type"].isin(*RESULTS), "tool-result").otherwise("unknown")
        return F.struct(
            kind.alias("type"),
            F.when(kind.isin("text", "thinking"), F.coalesce(b["text"], b["thinking"])).alias("text"),
            F.when(kind == "tool-call", b["id"]).when(kind == "tool-result", F.coalesce(b["tool_use_id"], b["toolCallId"])).alias("toolCallId"),
            F.when(kind == "tool-call", b["name"]).alias("name"),
            F.when(kind == "tool-call", F.coalesce(b["arguments"], b["input"])).alias("arguments"),
            F.when(kind == "tool-result", b["content"]).alias("content"),
            F.when(kind == "tool-result", F.coalesce(b["is_error"], b["isError"], F.lit(False))).alias("isError"),
            F.when(kind == "thinking", F.coalesce(b["signature"], b["thinkingSignature"])).alias("signature"),
            F.when(kind == "unknown", b["type"]).alias("nativeType"),
        )

    return F.transform(every, shaped)
