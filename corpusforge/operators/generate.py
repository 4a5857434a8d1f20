"""Synthetic records from declared families: a table function over ``spark.range``.

A family is data: prompt patterns with operands ``{a} {b} {c}``, the operands' ranges and the expression tree of the
answer.  Operands are hashes of seed, family and index, so a record depends on nothing but these, and any range of
indexes can be made on its own, by any number of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.calculator import VERSION as PROTOCOL
from corpusforge.functions.calculator import result_json
from corpusforge.functions.exact import expression_value
from corpusforge.functions.ids import derive_id, derive_seed, hash_split
from corpusforge.operators.render import CALL_ONLY
from corpusforge.schema import CASE_SCHEMA, CATEGORIES, NOT_IN_CASES

VERSION = "1.0.0"


@dataclass(frozen=True)
class Family:
    """One family of a category.

    ``tree`` is the answer's expression with the operands as ``$a`` and so on, ``None`` for records judged by meaning.
    ``derived`` are further operands ``$x, $y``, computed from trees.  With a ``tool`` the record has a call with
    ``arguments`` (JSON with operands), which is run, and its result; the result's value, if any, is the answer.
    """

    category: str
    name: str
    prompts: tuple[str, ...]
    ranges: tuple[tuple[int, int], ...]
    tree: str | None
    behavior: str = "answer"
    tolerance: float = 0.0
    derived: tuple[str, ...] = ()
    tool: str | None = None
    arguments: str = ""


def _op(name: str, *args: str) -> str:
    return '{"args":[' + ",".join(args) + '],"op":"' + name + '"}'


def _sum(*args: str) -> str:
    return _op("add", *args)


def _product(*args: str) -> str:
    return _op("mul", *args)


FAMILIES = [
    Family("arithmetic", "sums", ("Add {a} to {b}.", "{a} + {b} = ?", "How much is {a} and {b} together?", "Total of {a} and {b}?"), ((10, 9999), (10, 9999)), _sum("$a", "$b")),
    Family("arithmetic", "products", ("Multiply {a} by {b}.", "{a} times {b}?", "Product of {a} and {b}, please.", "{a} x {b} ="), ((2, 999), (2, 999)), _product("$a", "$b")),
    Family("arithmetic", "differences", ("Take {b} from {a}.", "{a} - {b} = ?", "By how much does {a} differ from {b}, as {a} less {b}?"), ((10, 9999), (10, 9999)), _op("sub", "$a", "$b")),
    Family("operator_precedence", "mixed", ("Evaluate {a} + {b} * {c}.", "{a} plus the product of {b} and {c}?", "Mind the order of operations: {a} + {b} x {c}."), ((1, 99), (2, 30), (2, 30)), _sum("$a", _product("$b", "$c"))),
    Family("operator_precedence", "bracketed", ("Evaluate ({a} + {b}) * {c}.", "First add {a} and {b}, then multiply by {c}.", "({a} + {b}) x {c} = ?"), ((1, 99), (2, 30), (2, 30)), _product(_sum("$a", "$b"), "$c")),
    Family("negative_values", "below_zero", ("What is {a} less {b}?", "Subtract {b} from {a}.", "{a} - {b} = ?"), ((-500, 0), (1, 500)), _op("sub", "$a", "$b")),
    Family("negative_values", "opposite", ("What number is the opposite of {a}?", "Change the sign of {a}.", "-({a}) = ?"), ((-900, 900),), _op("neg", "$a")),
    Family("fractions", "halves", ("{a}/{b} of {c} is how much?", "Find {a}/{b} of {c}.", "How many are {a}/{b} out of {c}?"), ((1, 9), (2, 12), (10, 500)), _product(_op("div", "$a", "$b"), "$c")),
    Family("fractions", "unlike_sum", ("{a}/{b} + 1/{c} = ?", "Add 1/{c} to {a}/{b}."), ((1, 9), (2, 12), (2, 12)), _sum(_op("div", "$a", "$b"), _op("div", "1", "$c"))),
    Family("percentages", "share", ("Take {a} percent of {b}.", "What is {a}% of {b}?", "{a} per cent of {b} makes how much?"), ((1, 99), (10, 9000)), _op("percent_of", "$a", "$b")),
    Family("percentages", "raised", ("{b} grows by {a}%. What is it then?", "Raise {b} by {a} percent."), ((1, 99), (10, 9000)), _sum("$b", _op("percent_of", "$a", "$b"))),
    Family("ratios_proportions", "ratio", ("Write {a} to {b} as a ratio in lowest terms.", "Reduce the ratio {a} : {b}.", "{a} : {b} as one fraction?"), ((2, 400), (2, 400)), _op("ratio", "$a", "$b")),
    Family("ratios_proportions", "proportion", ("If {a} cups cost {b} coins, what do {c} cups cost?", "{a} is to {b} as {c} is to what?"), ((2, 40), (2, 400), (2, 40)), _op("div", _product("$b", "$c"), "$a")),
    Family("estimation", "rough_sum", ("Roughly, what do {a} and {b} make?", "Estimate {a} + {b}.", "About how much are {a} and {b}?"), ((1000, 99999), (1000, 99999)), _sum("$a", "$b"), tolerance=500.0),
    Family("estimation", "rough_root", ("About what is the square root of {a}?", "Estimate the side of a square of area {a}."), ((10, 9999),), _op("sqrt", "$a", "2"), tolerance=0.5),
    Family("numerical_comparison", "greater", ("Is {a} greater than {b}?", "Does {a} exceed {b}?", "True or false: {a} > {b}."), ((1, 9999), (1, 9999)), _op("gt", "$a", "$b")),
    Family("numerical_comparison", "equal", ("Is {a} + {b} the same as {c}?", "Do {a} and {b} make {c}?"), ((1, 20), (1, 20), (2, 40)), _op("equals", _sum("$a", "$b"), "$c")),
    Family("basic_algebra", "linear", ("Solve x + {a} = {b}.", "Which x gives {b} when {a} is added?", "x + {a} is {b}. Find x."), ((1, 500), (1, 999)), _op("sub", "$b", "$a")),
    Family("basic_algebra", "scaled", ("Solve {a}x = {b}.", "{a} times x is {b}. What is x?"), ((2, 90), (1, 999)), _op("div", "$b", "$a")),
    Family("multi_step", "two_steps", ("Double {a}, then take {b} away.", "Start with {a}, double it, subtract {b}.", "Twice {a} less {b}?"), ((10, 900), (1, 300)), _op("sub", _product("2", "$a"), "$b")),
    Family("multi_step", "three_steps", ("Add {a} and {b}, multiply by {c}, halve the result.", "Half of {c} times the sum of {a} and {b}?"), ((1, 90), (1, 90), (2, 20)), _op("div", _product(_sum("$a", "$b"), "$c"), "2")),
    Family("word_problem", "boxes", ("{a} boxes hold {b} pens each and {c} pens are lost. How many pens remain?", "There are {b} pens in each of {a} boxes. {c} go missing. How many are left?"), ((2, 60), (5, 80), (0, 9)), _op("sub", _product("$a", "$b"), "$c")),
    Family("word_problem", "journey", ("A cart goes {a} miles a day for {b} days and {c} miles more. How far is that?", "{b} days at {a} miles each, then {c} miles: what distance?"), ((2, 60), (2, 30), (0, 50)), _sum(_product("$a", "$b"), "$c")),
    Family("decimals", "two_places", ("{a}.{b} + {c}.25 = ?", "Add {c}.25 to {a}.{b}.", "How much are {a}.{b} and {c}.25?"), ((1, 900), (10, 99), (1, 90)), _sum('"$a.$b"', '"$c.25"')),
    Family("decimals", "tenths", ("{a}.{b} x {c} = ?", "Multiply {a}.{b} by {c}."), ((1, 90), (1, 9), (2, 30)), _product('"$a.$b"', "$c")),
    Family("scientific_notation", "powers", ("What is {a} x 10^{b} times {c}?", "Multiply {a} x 10^{b} by {c}.", "{c} times {a}e{b} = ?"), ((2, 99), (1, 6), (2, 9)), _product("$a", _op("pow", "10", "$b"), "$c")),
    Family("expression_translation", "more_than", ("Turn into an expression and evaluate: {a} more than the product of {b} and {c}.", "{a} more than {b} times {c} is what number?"), ((1, 99), (2, 20), (2, 20)), _sum(_product("$b", "$c"), "$a")),
    Family("incorrect_supplied_answer", "wrong_sum", ("A friend claims {a} + {b} = {x}. Is that so?", "My sheet says {a} plus {b} makes {x}; check it.", "Is {x} right for {a} + {b}?"), ((10, 999), (10, 999), (1, 40)), _sum("$a", "$b"), "flag_incorrect_answer", derived=(_sum("$a", "$b", "$c"),)),
    Family("tool_use", "long_product", ("Use the calculator for {a} * {b} + {c}.", "Let the tool work out {a} * {b} + {c}."), ((1000, 999999), (100, 9999), (1, 999)), None, "invoke_tool", tool="calculator.evaluate", arguments='{"expression":"$a*$b+$c"}'),
    Family("tool_use", "roots", ("What does the calculator give for the square root of {a}?", "Have the tool take the square root of {a}."), ((2, 99999),), None, "invoke_tool", tool="calculator.evaluate", arguments='{"expression":"sqrt($a)"}'),
    Family("unit_conversion", "lengths", ("How many meters are {a} feet?", "Convert {a} feet into meters.", "{a} ft in m?"), ((1, 9000),), None, "invoke_tool", tool="calculator.convert", arguments='{"category":"length","from_unit":"foot","to_unit":"meter","value":$a}'),
    Family("unit_conversion", "weights", ("How many grams are {a} ounces?", "Convert {a} ounces into grams."), ((1, 900),), None, "invoke_tool", tool="calculator.convert", arguments='{"category":"mass","from_unit":"ounce","to_unit":"gram","value":$a}'),
    Family("financial_math", "shares_of", ("What are {a} percent of {b}?", "{b} coins at {a} percent: what is the part?"), ((1, 99), (10, 90000)), None, "invoke_tool", tool="calculator.finance", arguments='{"number":$b,"operation":"percentage_of","percent":$a}'),
    Family("financial_math", "tips", ("The bill is {b}. What is a tip of {a} percent?", "Tip {a}% on a bill of {b}."), ((1, 30), (10, 900)), None, "invoke_tool", tool="calculator.finance", arguments='{"bill_total":$b,"operation":"tip","tip_percent":$a}'),
    Family("incorrect_tool_call", "no_such_argument", ("Work out {a} - {b} with the tool.", "Tool, please: {a} - {b}, two places."), ((1, 9999), (1, 9999)), None, "invoke_tool", tool="calculator.evaluate", arguments='{"expression":"$a-$b","places":2}'),
    Family("tool_error", "by_zero_call", ("Let the tool divide {a} by zero.", "Calculator: {a} / 0."), ((1, 9999),), None, "invoke_tool", tool="calculator.evaluate", arguments='{"expression":"$a/0"}'),
    Family("undefined_operation", "by_zero", ("Divide {a} by zero.", "{a} / 0 = ?", "How often does 0 go into {a}?"), ((1, 9999),), None, "flag_undefined"),
    Family("missing_information", "no_price", ("{a} tickets were sold. What did they bring in?", "A shop sells {a} lamps. How much does it earn?"), ((2, 900),), None, "flag_missing_information"),
    Family("ambiguity", "half", ("Take half of {a} and {b}.", "What is {a} and {b} by two?"), ((2, 900), (2, 900)), None, "request_clarification"),
    Family("unsupported_capability", "plot", ("Draw the curve of x^{a} + {b}.", "Sketch x^{a} + {b} for me."), ((2, 9), (1, 99)), None, "refuse_unsupported"),
]

# other wordings, which no training family has, for suites that are held out
HELD_OUT = [
    Family("arithmetic", "held_sums", ("Someone counts {a} here and {b} there; how many is that?",), ((10, 9999), (10, 9999)), _sum("$a", "$b")),
    Family("operator_precedence", "held_mixed", ("Without a calculator, {b} times {c} with {a} put on top comes to?",), ((1, 99), (2, 30), (2, 30)), _sum("$a", _product("$b", "$c"))),
    Family("negative_values", "held_depth", ("At {a} degrees it gets {b} degrees colder. What does the thermometer read?",), ((-50, 0), (1, 50)), _op("sub", "$a", "$b")),
    Family("decimals", "held_prices", ("One item costs {a}.{b}, another {c}.25. What is to pay?",), ((1, 900), (10, 99), (1, 90)), _sum('"$a.$b"', '"$c.25"')),
    Family("fractions", "held_parts", ("Of {c} seeds {a} in every {b} sprout. How many do?",), ((1, 9), (2, 12), (10, 500)), _product(_op("div", "$a", "$b"), "$c")),
    Family("percentages", "held_share", ("{a}% of the {b} seats are taken. How many seats are these?",), ((1, 99), (10, 9000)), _op("percent_of", "$a", "$b")),
    Family("ratios_proportions", "held_ratio", ("How does {a} relate to {b}, in smallest whole numbers?",), ((2, 400), (2, 400)), _op("ratio", "$a", "$b")),
    Family("scientific_notation", "held_powers", ("{c} parcels weigh {a} x 10^{b} each. What do they weigh?",), ((2, 99), (1, 6), (2, 9)), _product("$a", _op("pow", "10", "$b"), "$c")),
    Family("basic_algebra", "held_linear", ("I think of a number; with {a} more it is {b}. What is it?",), ((1, 500), (1, 999)), _op("sub", "$b", "$a")),
    Family("expression_translation", "held_words", ("Put in figures and work out: the product of {b} and {c}, enlarged by {a}.",), ((1, 99), (2, 20), (2, 20)), _sum(_product("$b", "$c"), "$a")),
    Family("word_problem", "held_shelves", ("Each of {a} shelves carries {b} jars until {c} jars break. How many stay whole?",), ((2, 60), (5, 80), (0, 9)), _op("sub", _product("$a", "$b"), "$c")),
    Family("estimation", "held_rough", ("Give a fair guess of {a} and {b} put together.",), ((1000, 99999), (1000, 99999)), _sum("$a", "$b"), tolerance=500.0),
    Family("multi_step", "held_steps", ("{a} doubles overnight and {b} vanish by noon. What is left?",), ((10, 900), (1, 300)), _op("sub", _product("2", "$a"), "$b")),
    Family("incorrect_supplied_answer", "held_claim", ("It is said that {a} and {b} give {x}. Confirm or correct.",), ((10, 999), (10, 999), (1, 40)), _sum("$a", "$b"), "flag_incorrect_answer", derived=(_sum("$a", "$b", "$c"),)),
    Family("unit_conversion", "held_miles", ("The sign says {a} miles. How many meters is that?",), ((1, 900),), None, "invoke_tool", tool="calculator.convert", arguments='{"category":"length","from_unit":"mile","to_unit":"meter","value":$a}'),
    Family("financial_math", "held_discount", ("A coat of {b} coins is {a} percent cheaper today. What does it cost?",), ((1, 90), (10, 900)), None, "invoke_tool", tool="calculator.finance", arguments='{"operation":"discount","percent":$a,"price":$b}'),
    Family("tool_use", "held_powers_tool", ("Ask the tool for {a} to the power of three.",), ((10, 9999),), None, "invoke_tool", tool="calculator.evaluate", arguments='{"expression":"$a**3"}'),
    Family("incorrect_tool_call", "held_bad_unit", ("Convert {a} cubits with the tool.",), ((1, 999),), None, "invoke_tool", tool="calculator.convert", arguments='{"category":"length","from_unit":"cubit","to_unit":"meter","value":$a}'),
    Family("undefined_operation", "held_root", ("Which real number squared is -{a}?",), ((1, 999),), None, "flag_undefined"),
    Family("missing_information", "held_age", ("Ann is {a} years younger than her aunt. How old is Ann?",), ((2, 40),), None, "flag_missing_information"),
    Family("ambiguity", "held_it", ("Add {a} to it and then to the other one.",), ((2, 900),), None, "request_clarification"),
    Family("unsupported_capability", "held_video", ("Play me a film of {a} falling stones.",), ((2, 90),), None, "refuse_unsupported"),
]
DIRECT = ["arithmetic", "operator_precedence", "negative_values", "decimals", "fractions", "percentages", "ratios_proportions", "scientific_notation", "basic_algebra", "expression_translation", "word_problem", "estimation"]
SAFETY = ["ambiguity", "missing_information", "undefined_operation", "unsupported_capability"]
TOOLS = ["tool_use", "unit_conversion", "financial_math"]


def families_of(category: str, families: list[Family] | None = None) -> list[Family]:
    """The families of a category; a category without any is an error."""
    found = [f for f in (FAMILIES if families is None else families) if f.category == category]
    if not found:
        raise KeyError(f"no family makes {category!r}")
    return found


def missing_categories(families: list[Family] | None = None) -> list[str]:
    """Categories of the schema that no family makes."""
    return sorted(set(CATEGORIES) - {f.category for f in (FAMILIES if families is None else families)})


_DECLARED = "family int, family_id string, category string, prompts array<string>, lows array<bigint>, highs array<bigint>, tree string, behavior string, tolerance double, derived array<string>, tool string, arguments string, mode string, first bigint, n bigint"


def _declared(spark: SparkSession, runs: list[tuple[Family, int, int]]) -> DataFrame:
    """A row per family and run of indexes."""
    rows = [
        (
            k, f.name, f.category, list(f.prompts), [low for low, _ in f.ranges], [high for _, high in f.ranges], f.tree, f.behavior, f.tolerance if f.tree or f.tool else None,
            list(f.derived), f.tool, f.arguments if f.tool else None, "tool" if f.tool else "deterministic" if f.tree else "semantic", begin, max(0, end - begin),
        )
        for k, (f, begin, end) in enumerate(runs)
    ]
    return spark.createDataFrame(rows, _DECLARED)


def _made(spark: SparkSession, runs: list[tuple[Family, int, int]], seed: int, train: float, validation: float) -> DataFrame:
    """The records of all runs in one plan: the families are a small table that a range of numbers meets."""
    most = max((end - begin for _, begin, end in runs), default=0)
    numbers = spark.range(max(0, most) * len(runs)).select((F.col("id") % max(1, len(runs))).cast("int").alias("_family"), F.floor(F.col("id") / max(1, len(runs))).alias("_k"))
    rows = numbers.join(F.broadcast(_declared(spark, runs)), F.col("_family") == F.col("family")).filter("_k < n").withColumn("_index", F.col("first") + F.col("_k"))
    part = lambda what: derive_seed(F.lit(str(seed)), F.col("family_id"), F.lit(what), F.col("_index"))
    operand = lambda k, name: (F.get("lows", F.lit(k)) + part(name) % (F.get("highs", F.lit(k)) - F.get("lows", F.lit(k)) + 1)).cast("string")
    rows = rows.withColumns({name: operand(k, name) for k, name in enumerate("abc")})
    rows = rows.withColumn("_template", (part("template") % F.size("prompts")).cast("int"))

    def filled(pattern: Column, mark: str, names: str = "abcxy") -> Column:
        for name in names:
            pattern = F.replace(pattern, F.lit(mark % name), F.coalesce(F.col(name), F.lit("")))
        return pattern

    for k, name in enumerate("xy"):
        rows = rows.withColumn(name, expression_value(filled(F.get("derived", F.lit(k)), "$%s", "abc")))
    call = F.concat(F.lit('{"arguments":'), filled(F.col("arguments"), "$%s"), F.lit(f',"protocol_version":"{PROTOCOL}","tool":"'), F.col("tool"), F.lit('"}'))
    made = rows.withColumns({"prompt": filled(F.get("prompts", F.col("_template")), "{%s}"), "_tree": filled(F.col("tree"), "$%s"), "_call": call})
    made = made.withColumn("_result", result_json(F.col("_call")))
    value = F.when(F.col("tool").isNotNull(), F.get_json_object("_result", "$.result.value")).otherwise(expression_value(F.col("_tree")))
    made = made.withColumns({"_value": value, "template_id": F.concat(F.lit("t"), F.col("_template")), "derivation_id": derive_id(F.lit(str(seed)), F.col("family_id"), F.col("_index"))})
    truth = F.col("_value").isin("true", "false")
    generator, name = F.concat("category", F.lit("_gen")), F.col("family_id")
    traces = F.when(F.col("tool").isNotNull(), F.array(F.struct(F.col("_call").alias("call"), F.col("_result").alias("result")))).otherwise(F.array().cast("array<struct<call:string,result:string>>"))
    return made.select(
        derive_id(F.lit("example"), generator, name, F.col("template_id"), F.col("derivation_id"), F.lit(str(seed)), length=24).alias("example_id"),
        generator.alias("generator_id"), F.lit(VERSION).alias("generator_version"), "family_id", "template_id", "derivation_id",
        part("row").alias("seed"), "category",
        F.element_at(F.array(*[F.lit(x) for x in ("easy", "medium", "hard")]), (part("difficulty") % 3 + 1).cast("int")).alias("difficulty"),
        F.lit(True).alias("synthetic"), hash_split(generator, name, F.col("derivation_id"), seed, train, validation).alias("split"), "prompt",
        F.col("behavior").alias("expected_behavior"),
        F.when(truth, F.col("_value")).otherwise(F.concat(F.lit('"'), F.col("_value"), F.lit('"'))).alias("answer_json"),
        F.when(truth, "bool").when(F.col("_value").isNotNull(), "str").alias("answer_kind"), "tolerance",
        F.col("tool").isNotNull().alias("tool_required"), F.col("tool").alias("tool_name"), traces.alias("tool_traces"),
        F.struct("mode", F.col("_tree").alias("expression")).alias("verification"),
        F.concat(generator, F.lit("/"), name, F.lit(f" v{VERSION}")).alias("provenance"), F.lit("").alias("notes"), F.lit(None).cast("int").alias("token_count"),
        F.col("_index").alias("index"),
    )


def generated(spark: SparkSession, family: Family, begin: int, end: int, seed: int, train: float = 0.9, validation: float = 0.05, indexed: bool = False) -> DataFrame:
    """Records ``begin`` to ``end - 1`` of a family, in the columns of ``EXAMPLE_SCHEMA``; with ``indexed`` also their ``index``."""
    rows = _made(spark, [(family, begin, end)], seed, train, validation)
    return rows if indexed else rows.drop("index")


def corpus(spark: SparkSession, per_family: int, seed: int, families: list[Family] | None = None) -> DataFrame:
    """``per_family`` records of each family."""
    return _made(spark, [(f, 0, per_family) for f in (FAMILIES if families is None else families)], seed, 0.9, 0.05).drop("index")


def held_out_suite(spark: SparkSession, per_family: int, seed: int, offset: int = 0) -> DataFrame:
    """Evaluation cases in the columns of ``CASE_SCHEMA`` from the held-out families; each family's indexes begin at its own multiple of ``offset``.

    Cases are what the rules of cases allow; ids come from seed, family and index, so they never clash.
    """
    runs = [(f, k * offset, k * offset + per_family) for k, f in enumerate(HELD_OUT) if f.category not in NOT_IN_CASES]
    rows = _made(spark, runs, seed, 0.9, 0.05)
    return rows.withColumn("id", F.concat(F.lit("held-"), "example_id")).select(*CASE_SCHEMA.names)


def curriculum(spark: SparkSession, kind: str, split: str, per_category: int, seed: int) -> DataFrame:
    """Further training records that no parent has: ``direct`` (12 categories), ``safety`` (4), ``tools`` (3) or ``calls`` (3, ending with the call).

    ``per_category`` records of each category, dealt to its families in turn; indexes of tool records begin at a million,
    those of calls have a seed of their own.
    """
    categories = {"direct": DIRECT, "safety": SAFETY, "tools": TOOLS, "calls": TOOLS}[kind]
    begin, own = (1_000_000 if kind in ("tools", "calls") else 0), seed + 17 * (kind == "calls")
    runs = []
    for category in categories:
        families = families_of(category)
        for k, family in enumerate(families):
            n = per_category // len(families) + (k < per_category % len(families))
            runs.append((family, begin, begin + n))
    rows = _made(spark, runs, own, 0.9, 0.05).drop("index").withColumns({"split": F.lit(split), "family_id": F.concat(F.lit(f"{kind}_"), "family_id"), "example_id": derive_id(F.lit(kind), F.lit(split), F.col("example_id"), length=24)})
    return rows.withColumn("notes", F.lit(CALL_ONLY)) if kind == "calls" else rows


# Shares of the kinds of lines in a tokenizer's corpus.
LINE_SHARES = {
    "natural_language_math_problems": 0.22, "arithmetic": 0.12, "algebra": 0.10, "percentages": 0.05, "ratios_proportions": 0.05, "units": 0.08,
    "financial_math": 0.08, "scientific_notation": 0.04, "explanations": 0.10, "tool_syntax": 0.06, "errors": 0.03, "general_english": 0.07,
}
LINES = {
    "natural_language_math_problems": ["{a} crates hold {b} plums each. How many plums are there?", "From {a} marbles {b} roll away. What is left?", "{a} walkers share {b} rolls. How many does each get?"],
    "arithmetic": ["{a} + {b} = {c}", "{a} - {b} + {c}", "{a} x {b} / {c}", "({a} + {b}) * {c}"],
    "algebra": ["{a}x + {b} = {c}", "Solve for y: {a}y - {b} = {c}.", "f(x) = {a}x^2 + {b}x + {c}"],
    "percentages": ["{a}% of {b}", "{b} rises by {a}%.", "{a} out of {b} as a percentage"],
    "ratios_proportions": ["{a}:{b} = {c}:x", "The ratio of {a} to {b}", "{a} to {b} as {c} to what?"],
    "units": ["{a} km = {b} m", "{a} ft and {b} in", "{a} kg at {b} km/h for {c} min"],
    "financial_math": ["A loan of {a} at {b}% for {c} years", "{a} coins less {b}% discount", "Split a bill of {a} among {b}."],
    "scientific_notation": ["{a}.{b}e{c}", "{a} x 10^{b}", "{a}.{b} x 10^-{c}"],
    "explanations": ["First add {a} and {b}; then divide by {c}.", "Because {a} is more than {b}, the answer is positive.", "To check, multiply {a} by {b} again."],
    "tool_syntax": ['<tool_call>{"arguments":{"expression":"{a}*{b}"},"protocol_version":"1.0.0","tool":"calculator.evaluate"}', "<tool_result>{a}", "<final>{a}"],
    "errors": ["<error>DIVISION_BY_ZERO: {a}/0", "<unsupported>", "{a} / 0 is undefined."],
    "general_english": ["The market opens at {a} and closes at {b}.", "Please write to us before the end of the month.", "It rained for {a} days in a row."],
}


def line_counts(total: int) -> dict[str, int]:
    """Lines of each kind among ``total``: its share, rounded half to even."""
    return {kind: round(total * share) for kind, share in LINE_SHARES.items()}


def corpus_lines(spark: SparkSession, counts: dict[str, int], seed: int) -> DataFrame:
    """``kind, line_index, line``: lines of a tokenizer's corpus; a line depends on seed, kind and index only."""
    parts = []
    for kind, n in counts.items():
        rows = spark.range(n).select(F.lit(kind).alias("kind"), F.col("id").alias("line_index"))
        part = lambda what, kind=kind: derive_seed(F.lit(str(seed)), F.lit(kind), F.lit(what), F.col("line_index"))
        line = F.element_at(F.array(*[F.lit(x) for x in LINES[kind]]), (part("pattern") % len(LINES[kind]) + 1).cast("int"))
        for name, most in (("a", 9999), ("b", 999), ("c", 99)):
            line = F.replace(line, F.lit("{" + name + "}"), (part(name) % most + 1).cast("string"))
        parts.append(rows.withColumn("line", line))
    return reduce(DataFrame.unionByName, parts)


def held_out_lines(spark: SparkSession, per_kind: int = 150, seed: int = 771177) -> DataFrame:
    """Lines that a tokenizer is measured on; blank ones are dropped."""
    return corpus_lines(spark, dict.fromkeys(LINE_SHARES, per_kind), seed).filter(F.col("line").rlike(r"\S"))


def numeric_strings(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``k, text``: numbers of all kinds of writing, for checks of tokenizers."""
    part = lambda what: derive_seed(F.lit(str(seed)), F.lit("numeric"), F.lit(what), F.col("k"))
    whole, digits = (part("whole") % 10**9).cast("string"), F.lpad((part("digits") % 10**6).cast("string"), 6, "0")
    forms = [whole, F.concat(F.lit("-"), whole), F.concat_ws(".", whole, digits), F.concat(whole, F.lit("e"), (part("e") % 300).cast("string")), F.concat_ws("/", whole, digits), F.format_number(part("whole") % 10**9, 0), F.concat(F.lit("$"), whole), F.concat(whole, F.lit("%"))]
    return spark.range(n).select(F.col("id").alias("k")).select("k", F.element_at(F.array(*forms), (part("form") % len(forms) + 1).cast("int")).alias("text"))
