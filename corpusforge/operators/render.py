"""Training texts of records, their segments and masks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.calculator import canonical
from corpusforge.operators.packing import IGNORED
from corpusforge.schema import TRACES

# Terminal tags of behaviours without an answer, and the note of records that end with a call.
BEHAVIOR_TAG = {"refuse_unsupported": "unsupported", "flag_undefined": "error", "flag_missing_information": "unsupported", "request_clarification": "unsupported"}
CALL_ONLY = "phase8_sft_stage:tool_call_only"


def answer_text(answer_json: Column) -> Column:
    """An answer as text: strings bare, truth values by their Python names; null for null."""
    bare = F.get_json_object(F.concat(F.lit('{"v":'), answer_json, F.lit("}")), "$.v")
    return F.when(answer_json == "true", "True").when(answer_json == "false", "False").when(answer_json.startswith('"'), bare).when(answer_json != "null", answer_json)


def behavior_tag(behavior: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BEHAVIOR_TAG.items() for x in pair])[behavior]


def expected_tag(df: DataFrame) -> DataFrame:
    """``df`` with ``expected_tag`` and ``expected_value``: the terminal tag and, for ``final``, its text; null where none is defined."""
    answer = answer_text(F.col("answer_json"))
    return df.withColumn("expected_tag", F.when(answer.isNotNull(), "final").otherwise(behavior_tag(F.col("expected_behavior")))).withColumn("expected_value", answer)


@F.pandas_udf(TRACES)
def _canonical_traces(traces: pd.Series) -> pd.Series:
    def text(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return t

    return traces.map(lambda of: [] if of is None else [{"call": text(t["call"]), "result": text(t["result"])} for t in of])


def canonical_traces(df: DataFrame) -> DataFrame:
    """``df`` with ``tool_traces`` in canonical JSON; a null list is empty, broken JSON stays as it is."""
    return df.withColumn("tool_traces", _canonical_traces("tool_traces"))


def segments(df: DataFrame, out: str = "segments") -> DataFrame:
    """``df`` (canonical traces) with an array of ``text, role``: prompt and results are context, calls and ending supervised.

    A record marked as call-only ends with its first call; a tool error ends with the last trace's error.  Without any
    ending (no answer, no known behaviour) there is none.
    """
    part = lambda text, role: F.struct(text.alias("text"), F.lit(role).alias("role"))
    notes = F.coalesce(F.col("notes"), F.lit(""))
    only = notes.startswith(CALL_ONLY) & (F.size("tool_traces") > 0)
    call = lambda t: part(F.concat(F.lit("\n<tool_call>"), t["call"]), "supervised")
    pairs = F.flatten(F.transform("tool_traces", lambda t: F.array(call(t), part(F.concat(F.lit("\n<tool_result>"), t["result"]), "context"))))
    answer = answer_text(F.col("answer_json"))
    error = F.get_json_object(F.try_element_at("tool_traces", F.lit(-1))["result"], "$.error.code"), F.get_json_object(F.try_element_at("tool_traces", F.lit(-1))["result"], "$.error.message")
    failed = F.when((F.col("expected_behavior") == "invoke_tool") & (F.col("category") == "tool_error"), F.concat(F.lit("\n<error>"), error[0], F.lit(": "), error[1]))
    ending = F.coalesce(F.concat(F.lit("\n<final>"), answer), F.concat(F.lit("\n<"), behavior_tag(F.col("expected_behavior")), F.lit(">")), failed)
    none = F.array().cast("array<struct<text:string,role:string>>")
    rest = F.when(only, F.array(call(F.col("tool_traces")[0]))).otherwise(F.concat(pairs, F.when(ending.isNotNull(), F.array(part(ending, "supervised"))).otherwise(none)))
    return df.withColumn(out, F.concat(F.array(part(F.coalesce(F.col("prompt"), F.lit("")), "context")), rest))


def training_text(df: DataFrame, out: str = "rendered") -> DataFrame:
    """``df`` (canonical traces) with prompt, calls, results and the ending, one per line."""
    lines = F.flatten(F.transform("tool_traces", lambda t: F.array(F.concat(F.lit("<tool_call>"), t["call"]), F.concat(F.lit("<tool_result>"), t["result"]))))
    ending = F.coalesce(F.concat(F.lit("<final>"), answer_text(F.col("answer_json"))), F.concat(F.lit("<"), behavior_tag(F.col("expected_behavior")), F.lit(">")))
    return df.withColumn(out, F.array_join(F.concat(F.array(F.coalesce(F.col("prompt"), F.lit(""))), lines, F.array(ending)), "\n"))


def segments_text(segments: Column) -> Column:
    """The whole text that segments render to."""
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def masked(ids: Column, roles: Column, begin: int, end: int) -> tuple[Column, Column]:
    """``input_ids`` and ``labels`` of segments' id lists: begin mark and context are ignored, the end mark isn't."""
    inputs = F.concat(F.array(F.lit(begin)), F.flatten(ids), F.array(F.lit(end)))
    kept = F.zip_with(ids, roles, lambda x, r: F.when(r == "supervised", x).otherwise(F.transform(x, lambda _: F.lit(IGNORED))))
    return inputs, F.concat(F.array(F.lit(IGNORED)), F.flatten(kept), F.array(F.lit(end)))
