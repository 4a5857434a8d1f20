"""Recorded turns of a model with its tool, replayed: calls are run, invented results are thrown away."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.calculator import Refused, executed, parsed
from corpusforge.functions.text import TAGS

ATTEMPT = T.StructType([T.StructField(n, t) for n, t in (("call", T.StringType()), ("parsed", T.BooleanType()), ("tool", T.StringType()), ("status", T.StringType()), ("value", T.StringType()))])
TRACE = T.StructType([T.StructField("attempts", T.ArrayType(ATTEMPT)), T.StructField("final_text", T.StringType()), T.StructField("ending", T.StringType()), T.StructField("stopped", T.StringType()), T.StructField("fabricated", T.BooleanType())])
_TAG = re.compile("<(" + "|".join(TAGS) + ")>")


def replay(turns: list[str], most_calls: int = 2) -> tuple:
    """What a conversation's turns amount to: attempts, final text, ending, why it stopped, and whether a result was invented.

    A turn counts up to its first call; what follows a call in the same turn is the model's own guess of the result.
    The first ending tag stops the replay, as do ``most_calls`` calls and the last turn.
    """
    attempts, fabricated = [], False
    for turn in turns:
        found = _TAG.search(turn or "")
        if not found:
            return attempts, None, None, "no_tag", fabricated
        tag, rest = found.group(1), turn[found.end() :]
        after = _TAG.search(rest)
        body = (rest[: after.start()] if after else rest).strip()
        if tag == "tool_result":
            return attempts, None, None, "invented_result", True
        if tag != "tool_call":
            return attempts, body if tag == "final" else None, tag, "ended", fabricated
        fabricated |= "<tool_result>" in rest
        if len(attempts) == most_calls:
            return attempts, None, None, "too_many_calls", fabricated
        result = executed(body)
        try:
            ok = bool(parsed(body))
        except Refused:
            ok = False
        attempts.append({"call": body, "parsed": ok, "tool": result["tool"], "status": result["status"], "value": (result["result"] or {}).get("value")})
    return attempts, None, None, "no_more_turns", fabricated


@F.pandas_udf(TRACE)
def _replayed(turns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([replay([] if t is None else list(t)) for t in turns], columns=TRACE.names)


def replayed(turns: Column) -> Column:
    """``TRACE`` of an array of turns; a null array has no turns."""
    return _replayed(turns)


def trace_flags(df: DataFrame, trace: str) -> DataFrame:
    """``df`` with ``emitted_call``, ``any_valid_call`` and ``any_success`` of its traces."""
    attempts = F.col(f"{trace}.attempts")
    return df.withColumn("emitted_call", F.size(attempts) > 0).withColumn("any_valid_call", F.exists(attempts, lambda a: a["parsed"])).withColumn("any_success", F.exists(attempts, lambda a: a["status"] == "success"))
