"""Scores of generated answers; the generated text is an input column."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.calculator import Refused, call_refusal, canonical, executed, parsed
from corpusforge.functions.exact import number_matches
from corpusforge.functions.text import first_call, last_number, strip, tagged
from corpusforge.operators.render import answer_text, expected_tag


def capability(df: DataFrame, generated: str) -> DataFrame:
    """``df`` with ``correct``: for a ``final`` answer the number matches, for other tags the tag is there; false where no tag is defined."""
    cases = expected_tag(df)
    final = F.coalesce(number_matches(tagged(F.col(generated), "final"), F.col("answer_json"), F.col("tolerance")), F.lit(False))
    other = F.coalesce(F.col(generated).contains(F.concat(F.lit("<"), F.col("expected_tag"), F.lit(">"))), F.lit(False))
    return cases.withColumn("correct", F.when(F.col("expected_tag") == "final", final).otherwise(other))


def accuracy(df: DataFrame, correct: str, by: str) -> DataFrame:
    """Cases, correct ones and accuracy per group and overall (null group); 0 for no cases."""
    return df.rollup(by).agg(F.count("*").alias("cases"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("correct")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "cases"), F.lit(0.0)))


def joined(cases: DataFrame, generations: DataFrame, id: str, generated: str) -> DataFrame:
    """``cases`` with the text generated for each, by id; a case without one keeps a null and counts as wrong.

    Of several texts for an id the least is taken, so a case stays one row.
    """
    one = generations.groupBy(F.col(id).alias("_id")).agg(F.min(generated).alias(generated))
    return cases.join(one, F.col(id) == F.col("_id"), "left").drop("_id")


def capability_suites(cases: DataFrame, generations: DataFrame, id: str, suite: str, by: str, generated: str = "generated") -> DataFrame:
    """Accuracy of each suite, per group and overall (null group), in one pass: ``suite, by, cases, correct, accuracy``."""
    scored = capability(joined(cases, generations, id, generated), generated)
    right = F.count_if(F.coalesce("correct", F.lit(False)))
    sums = scored.groupingSets([[F.col(suite), F.col(by)], [F.col(suite)]], suite, by).agg(F.count("*").alias("cases"), right.alias("correct"))
    return sums.withColumn("accuracy", F.col("correct") / F.col("cases"))


def tool_format(df: DataFrame, generated: str) -> DataFrame:
    """``df`` with ``emitted`` (a tool call is there), ``valid`` (it is well formed) and ``name_match``; nothing is run."""
    text = tagged(F.col(generated), "tool_call")
    read = df.withColumn("_call", text).withColumn("_refusal", call_refusal(text))
    valid = F.coalesce(F.col("_refusal") == "", F.lit(False))
    name = F.coalesce(F.get_json_object("_call", "$.tool").eqNullSafe(F.col("tool_name")), F.lit(False))
    return read.withColumn("emitted", F.col("_call").isNotNull()).withColumn("valid", valid).withColumn("name_match", valid & name).drop("_call", "_refusal")


def rates(df: DataFrame, wanted: dict[str, tuple[Column, Column]], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Conditional rates in one pass: for each name the rows that meet the condition, among those of its denominator.

    Columns ``name_n, name_of, name`` - null where the denominator is empty.  Null conditions count as not met.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    sums = [x for name, (met, among) in wanted.items() for x in (F.count_if(yes(met) & yes(among)).alias(f"{name}_n"), F.count_if(yes(among)).alias(f"{name}_of"))]
    counted = df.groupBy(*by).agg(*sums)
    return counted.withColumns({name: F.try_divide(f"{name}_n", f"{name}_of") for name in wanted})


def long_rates(counted: DataFrame, names: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """``rates`` with a row per name: ``metric, numerator, denominator, rate``."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}_n").alias("numerator"), F.col(f"{n}_of").alias("denominator"), F.col(n).alias("rate")) for n in names])
    return counted.select(*by, F.inline(rows))


def final_answer_correct(answer_json: Column, tolerance: Column, final: Column) -> Column:
    """Whether a final text gives the answer: as numbers within the tolerance where both are, else as equal texts; null without an answer."""
    expected = answer_text(answer_json)
    theirs = last_number(final)
    numeric = last_number(expected).isNotNull() & theirs.isNotNull()
    same = F.coalesce(strip(final) == strip(expected), F.lit(False))
    close = F.coalesce(number_matches(theirs, F.concat(F.lit('"'), last_number(expected), F.lit('"')), tolerance), F.lit(False))
    return F.when(expected.isNull(), F.lit(None).cast("boolean")).when(final.isNull(), F.lit(False)).when(numeric, close).otherwise(same)


CALL_FACTS = T.StructType([T.StructField(n, t) for n, t in (("valid", T.BooleanType()), ("tool", T.StringType()), ("status", T.StringType()), ("same_arguments", T.BooleanType()))])


@F.pandas_udf(CALL_FACTS)
def _call_facts(calls: pd.Series, traced: pd.Series) -> pd.DataFrame:
    def arguments(text: str | None) -> str | None:
        try:
            found = json.loads(text)
            return canonical(found["arguments"]) if isinstance(found, dict) and found.get("arguments") is not None else None
        except (ValueError, TypeError):
            return None

    def of(call: str | None, trace: str | None) -> tuple:
        if call is None:
            return False, None, None, False
        try:
            _, tool, own = parsed(call)
        except Refused:
            return False, None, executed(call)["status"], False
        wanted = arguments(trace)
        return True, tool, executed(call)["status"], wanted is not None and wanted == canonical(own)

    return pd.DataFrame([of(*x) for x in zip(calls, traced)], columns=CALL_FACTS.names).astype(object)


def interactions(df: DataFrame, generated: str) -> DataFrame:
    """``df`` with what a generated turn does: its routing, first call, that call's result, and the ending.

    A call counts if it is the first tag of the text.  ``tool_name_correct``, ``arguments_correct`` and ``end_to_end``
    are null where no tool is required and false for missing or malformed calls.
    """
    text, required = F.col(generated), F.coalesce(F.col("tool_required"), F.lit(False))
    first = F.try_element_at("tool_traces", F.lit(1))
    read = df.withColumn("_call", first_call(text)).withColumn("_facts", _call_facts(F.col("_call"), first["call"]))
    read = read.withColumn("emitted_call", F.col("_call").isNotNull()).withColumn("call_parsed", F.col("_facts.valid"))
    name = F.col("call_parsed") & F.coalesce(F.col("_facts.tool").eqNullSafe(F.col("tool_name")), F.lit(False))
    arguments = name & F.col("_facts.same_arguments")
    success = F.when(F.col("emitted_call"), F.coalesce(F.col("_facts.status") == "success", F.lit(False)))
    final = F.coalesce(tagged(text, "final"), F.lit(None).cast("string"))
    ending = F.when(text.contains("<final>"), "final").when(text.contains("<unsupported>"), "unsupported").when(text.contains("<error>"), "error")
    out = expected_tag(read).withColumns({
        "routed": F.col("emitted_call") == required,
        "tool_name_correct": F.when(required, name),
        "arguments_correct": F.when(required, arguments),
        "execution_successful": success,
        "final_correct": final_answer_correct(F.col("answer_json"), F.col("tolerance"), final),
        "ending": ending,
        "unnecessary_call": F.col("emitted_call") & ~required,
        "missing_call": required & ~F.col("emitted_call"),
        "fabricated_result": F.coalesce(text.contains("<tool_result>"), F.lit(False)),
    })
    told = F.coalesce((F.col("_facts.status") == F.get_json_object(first["result"], "$.status")) & (F.col("ending") == "error"), F.lit(False))
    done = F.when(F.col("expected_value").isNull(), F.col("arguments_correct") & told).otherwise(F.col("arguments_correct") & F.coalesce("execution_successful", F.lit(False)) & F.coalesce("final_correct", F.lit(False)))
    out = out.withColumn("end_to_end", F.when(required, done)).withColumn("ending_correct", F.when(F.col("expected_tag").isNotNull(), F.coalesce(F.col("ending") == F.col("expected_tag"), F.lit(False))))
    return out.drop("_call", "_facts")


def interaction_rates() -> dict[str, tuple[Column, Column]]:
    """The rates of ``interactions`` with their denominators."""
    every, tool = F.lit(True), F.coalesce(F.col("tool_required"), F.lit(False))
    c = F.col
    return {
        "correct_routing": (c("routed"), every),
        "emitted_tool_call": (c("emitted_call"), every),
        "call_parsed_valid": (c("call_parsed"), every),
        "required_call_emitted": (c("emitted_call"), tool),
        "required_call_parsed": (c("call_parsed"), tool),
        "tool_name_correct": (c("tool_name_correct"), tool),
        "arguments_correct": (c("arguments_correct"), tool),
        "argument_execution_successful": (c("arguments_correct") & c("execution_successful"), tool),
        "end_to_end_success": (c("end_to_end"), tool),
        "final_answer_correct": (c("final_correct"), c("final_correct").isNotNull()),
        "direct_answer_correct": (c("final_correct"), ~tool & c("final_correct").isNotNull()),
        "unnecessary_tool_call": (c("unnecessary_call"), ~tool),
        "missing_required_call": (c("missing_call"), tool),
        "fabricated_result": (c("fabricated_result"), every),
        "terminal_tag_correct": (c("ending_correct"), c("ending_correct").isNotNull()),
    }

