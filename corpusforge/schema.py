"""The record types and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and types of the two record types.
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct_of(fields: str) -> T.StructType:
    """A struct type from ``name type`` pairs of simple types, without a session (modules load on workers too)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


TRACES = T.ArrayType(struct_of("call string, result string"))
VERIFICATION = struct_of("mode string, expression string")
_ANSWER = "prompt string, expected_behavior string, answer_json string, answer_kind string, tolerance double, tool_required boolean"


def _record(*parts: str | T.StructField) -> T.StructType:
    return T.StructType([f for p in parts for f in (struct_of(p).fields if isinstance(p, str) else [p])])


EXAMPLE_SCHEMA = _record(
    "example_id string, generator_id string, generator_version string, family_id string, template_id string, derivation_id string, seed bigint",
    "category string, difficulty string, synthetic boolean, split string",
    _ANSWER,
    "tool_name string",
    T.StructField("tool_traces", TRACES),
    T.StructField("verification", VERIFICATION),
    "provenance string, notes string, token_count int",
)
CASE_SCHEMA = _record("id string, category string, difficulty string", _ANSWER, T.StructField("verification", VERIFICATION), "provenance string, notes string")

# The closed vocabularies of a record.
DIFFICULTIES = ["trivial", "easy", "medium", "hard"]
BEHAVIORS = ["answer", "request_clarification", "refuse_unsupported", "flag_missing_information", "flag_undefined", "flag_incorrect_answer", "invoke_tool"]
MODES = ["deterministic", "semantic", "tool"]
SPLITS = ["train", "validation", "test"]
CATEGORIES = [
    "arithmetic", "operator_precedence", "negative_values", "decimals", "fractions", "percentages", "ratios_proportions", "scientific_notation",
    "unit_conversion", "financial_math", "basic_algebra", "expression_translation", "word_problem", "estimation", "numerical_comparison", "multi_step",
    "tool_use", "incorrect_supplied_answer", "incorrect_tool_call", "ambiguity", "missing_information", "undefined_operation", "unsupported_capability", "tool_error",
]
NOT_IN_CASES = ["numerical_comparison", "tool_error"]


def _in(c: str, values: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(values), F.lit(False))


def example_rules() -> dict[str, Column]:
    """Each rule's name with the condition that breaks it; never null."""
    answer = F.coalesce(F.col("answer_json"), F.lit("null"))
    traces = F.coalesce(F.size("tool_traces"), F.lit(0)) > 0
    tool = F.coalesce(F.col("tool_required"), F.lit(False))
    mode = F.coalesce(F.col("verification.mode"), F.lit(""))
    return {
        "empty_id": F.coalesce(F.col("example_id"), F.lit("")) == "",
        "unknown_category": ~_in("category", CATEGORIES),
        "unknown_difficulty": ~_in("difficulty", DIFFICULTIES),
        "unknown_behavior": ~_in("expected_behavior", BEHAVIORS),
        "unknown_split": ~_in("split", SPLITS),
        "blank_prompt": ~F.coalesce(F.col("prompt").rlike(r"\S"), F.lit(False)),
        "unknown_mode": ~mode.isin(MODES),
        "semantic_with_answer": (mode == "semantic") & (answer != "null"),
        "tool_without_trace": tool & ~traces,
        "tool_without_name": tool & F.col("tool_name").isNull(),
        "trace_without_tool": ~tool & traces,
        "negative_tolerance": F.coalesce(F.col("tolerance") < 0, F.lit(False)),
    }


def case_rules() -> dict[str, Column]:
    """Rules of evaluation cases, as ``example_rules``."""
    mode = F.coalesce(F.col("verification.mode"), F.lit(""))
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    return {
        "blank_id": blank("id"),
        "unknown_category": ~_in("category", [c for c in CATEGORIES if c not in NOT_IN_CASES]),
        "unknown_difficulty": ~_in("difficulty", DIFFICULTIES),
        "blank_prompt": blank("prompt"),
        "unknown_behavior": ~_in("expected_behavior", BEHAVIORS),
        "unknown_mode": ~mode.isin(MODES),
        "null_tool_required": F.col("tool_required").isNull(),
        "null_provenance": F.col("provenance").isNull(),
        "negative_tolerance": F.coalesce(F.col("tolerance") < 0, F.lit(False)),
    }


def violations(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """``df`` with the names of the rules that each row breaks, an empty array if none."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def typed(c: Column, schema: T.StructType) -> Column:
    """A JSON line as a typed row; a broken line, or one that isn't an object, fails the query; null stays null."""
    return F.from_json(c, schema, {"mode": "FAILFAST"})


def raw_violations(c: Column, schema: T.StructType, required: list[str] | None = None) -> Column:
    """What is wrong with the keys and types of a JSON object's text, an empty array if nothing.

    ``no_object``, ``missing_x`` for a required key (by default every field) that isn't there, ``unexpected_x`` for a key
    that is no field, ``type_x`` for a value that isn't null and isn't of the field's type.  A null is no object.
    """
    keys = F.json_object_keys(c)
    names = F.array(*[F.lit(n) for n in schema.names])
    wanted = F.array(*[F.lit(n) for n in (schema.names if required is None else required)])
    tagged = lambda tag, found: F.transform(found, lambda x: F.concat(F.lit(tag), x))
    wrong = []
    for field in schema.fields:
        one = F.from_json(c, T.StructType([field]))[field.name]
        raw = F.get_json_object(c, f"$.{field.name}")
        kind = T.StringType() if not isinstance(field.dataType, T.StringType) else None
        plain = F.lit(True) if kind else F.from_json(c, T.StructType([T.StructField(field.name, T.VariantType())]))[field.name]
        off = raw.isNotNull() & one.isNull() if kind else raw.isNotNull() & (F.schema_of_variant(plain) != "STRING")
        wrong.append(F.when(off, F.lit(f"type_{field.name}")))
    found = F.concat(tagged("missing_", F.array_except(wanted, keys)), tagged("unexpected_", F.array_except(keys, names)), F.array_compact(F.array(*wrong)))
    return F.when(keys.isNull(), F.array(F.lit("no_object"))).otherwise(found)
