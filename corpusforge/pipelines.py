"""A corpus from end to end, and the audits of one that is there."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.exact import verified
from corpusforge.functions.text import shape
from corpusforge.operators import build, contamination, dedup, generate, stats
from corpusforge.plans.stage import staged
from corpusforge.schema import EXAMPLE_SCHEMA, example_rules, violations
from corpusforge.sources import shards
from corpusforge.sources.files import write_json


def exact_key() -> Column:
    return dedup.exact_key(F.col("prompt"), dedup.python_repr(F.col("answer_json"), F.col("answer_kind")))


def build_dataset(
    rows: DataFrame,
    folder: str,
    name: str,
    cases: DataFrame,
    quotas: dict[str, int] | None = None,
    tokens: Column | None = None,
    template_share: float = 0.6,
    family_tokens: int | None = None,
    shape_cap: int = 30_000,
    context: int = 1024,
    rows_per_shard: int = 50_000,
) -> dict[str, Any]:
    """Clean, check, cap, deduplicate, budget, shard and record candidate records; the document that is written beside the shards.

    ``rows``: ``EXAMPLE_SCHEMA``, one row per id.  ``cases``: evaluation cases, whose exact keys no record may have and
    whose shapes count as met once.  ``quotas``: tokens per category (without one: no limit); ``tokens`` the tokens of a
    record (by default ``token_count``).  Writes ``name.split.00000.jsonl``, ``manifest.json`` with the identity, and
    ``stats.json`` to the folder.  Returns ``identity, funnel, stats``.  No accepted record is an error.
    """
    spark = rows.sparkSession
    counted = rows.withColumn("token_count", F.coalesce(F.col("token_count") if tokens is None else tokens, F.lit(0)).cast("int"))
    examined = build.examined(counted.withColumns({"template_id": F.coalesce("template_id", F.lit("")), "tokens": F.col("token_count")}))
    limits = F.create_map(*[F.lit(x) for p in quotas.items() for x in p])[F.col("category")] if quotas else F.lit(None).cast("long")
    thin = examined.select("example_id", "category", "family_id", "template_id", exact_key().alias("key"), shape(F.col("prompt")).alias("shape"), "tokens", "reject", limits.cast("long").alias("quota"))
    known = cases.select(exact_key().alias("exact_key"), F.lit(None).cast("string").alias("family"), shape(F.col("prompt")).alias("shape"))
    held = staged(build.seeded(thin, "family_id", "key", "shape", known))
    columns = {"family": "family_id", "template": "template_id", "exact_key": "key", "shape": "shape", "tokens": "tokens", "reject": "reject", "reserved": "reserved", "seeded": "seeded"}
    decided = staged(build.accept(held, "category", "example_id", columns, template_share, F.lit(family_tokens).cast("long"), F.col("quota"), shape_cap, context))
    kept = decided.filter("decision = 'accepted'").select(F.col("example_id").alias("_kept"))
    clean = examined.join(kept, F.col("example_id") == F.col("_kept"), "left_semi").select(*EXAMPLE_SCHEMA.names)
    corpus = staged(clean)
    if corpus.isEmpty():
        raise ValueError("no record was accepted")
    manifest = shards.write_shards(corpus, folder, name, "split", "example_id", rows_per_shard)
    identity = shards.write_manifest(manifest, f"{folder}/manifest.json")
    funnel = build.funnel(decided, "decision", beyond=True).first().asDict()
    told = stats.document(corpus, context, funnel, shape(F.col("prompt")))
    write_json(spark, f"{folder}/stats.json", told)
    return {"identity": identity, "funnel": funnel, "stats": told}


def generate_dataset(spark: SparkSession, folder: str, name: str, per_family: int, seed: int, held_out: int = 10, **limits: Any) -> dict[str, Any]:
    """``build_dataset`` over generated records, against the held-out suite, which is written as ``suite.json``; a token is a word or sign."""
    cases = staged(generate.held_out_suite(spark, held_out, seed, 1_000_000))
    shards.write_suite(cases, f"{folder}/suite.json")
    rows = staged(generate.corpus(spark, per_family, seed))
    tokens = F.regexp_count(F.coalesce("prompt", F.lit("")), F.lit(r"\w+|[^\w\s]+"))
    return build_dataset(rows, folder, name, cases, tokens=tokens, **limits)


def validate_dataset(records: DataFrame, shown: int = 20) -> tuple[int, int, list[str]]:
    """Records in all, records that break a rule, and a line for each of the first ``shown`` of them."""
    told = violations(records, example_rules())
    counts = told.agg(F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("broken")).first()
    first = told.filter(F.size("violations") > 0).orderBy("example_id").select("example_id", F.array_join("violations", ", ").alias("v")).limit(shown).collect()
    return counts["n"], counts["broken"], [f"{r['example_id']}: {r['v']}" for r in first]


def verify_dataset(records: DataFrame) -> DataFrame:
    """Ground truth and recorded tool results, checked again: ``check, outcome, n``.

    A record's first call is run again and its whole result must be the recorded one, field by field.
    """
    from corpusforge.functions.calculator import canonical_json, result_json

    truth = build.ground_truth(records).groupBy(F.lit("ground_truth").alias("check"), F.col("truth").alias("outcome")).agg(F.count("*").alias("n"))
    first = F.try_element_at("tool_traces", F.lit(1))
    ran = records.filter(F.size("tool_traces") > 0).select(result_json(first["call"]).alias("live"), canonical_json(first["result"]).alias("recorded"))
    same = F.when(F.col("live").eqNullSafe(F.col("recorded")), "ok").otherwise("mismatch")
    return truth.unionByName(ran.groupBy(F.lit("tool_results").alias("check"), same.alias("outcome")).agg(F.count("*").alias("n")))


def verify_suite(cases: DataFrame, frozen: bool = True) -> DataFrame:
    """``id, verdict`` of each deterministic case; semantic ones hold without an answer and are in error with one.

    ``frozen``: by the operations that recorded suites may use, else by all.
    """
    mode, answer = F.col("verification.mode"), F.coalesce(F.col("answer_json"), F.lit("null"))
    exact = verified(F.col("verification.expression"), F.col("answer_json"), F.col("tolerance"), frozen=frozen)
    held = F.when(answer == "null", "ok").otherwise("error")
    return cases.select("id", F.when(mode == "semantic", held).when((mode == "deterministic") & (answer != "null"), exact).otherwise("error").alias("verdict"))


def check_contamination(records: DataFrame, cases: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``check, violations, clean``: derivations and exact keys in two splits, near and shape pairs with evaluation cases."""
    rows = staged(records.withColumn("_exact", exact_key()).select("example_id", "prompt", "split", "_exact", "generator_id", "family_id", "derivation_id"))
    train = rows.filter("split = 'train'")
    derivation = F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in ("generator_id", "family_id", "derivation_id")])
    return contamination.report({
        "split_isolation": contamination.split_violations(rows, derivation, "split", ["example_id"]),
        "cross_split_duplicates": contamination.split_violations(rows, F.col("_exact"), "split", ["example_id"]),
        "near_pairs": contamination.near_pairs(cases, "id", "prompt", train, "example_id", "prompt", size, threshold),
        "shape_pairs": contamination.shape_pairs(cases, "id", "prompt", train, "prompt", "example_id"),
    })


def self_test(cases: list[dict]) -> list[str]:
    """What goes wrong in a suite of tool calls, a line for each failure.

    A case has ``id`` and ``call`` or ``call_text``, or ``steps`` of them, and any of ``expected_status, expected_result,
    expected_error_code``; of an expected result only the fields it names are compared.
    """
    from corpusforge.functions.calculator import canonical, executed

    failures = []
    for case in cases:
        for k, step in enumerate(case.get("steps") or [case]):
            result = executed(step["call_text"] if "call_text" in step else canonical(step["call"]))
            told = {"status": result["status"], "error_code": (result["error"] or {}).get("code")}
            for key, found in told.items():
                if step.get(f"expected_{key}") not in (None, found):
                    failures.append(f"{case['id']}.{k}: {key} is {found}, not {step[f'expected_{key}']}")
            for key, want in (step.get("expected_result") or {}).items():
                if (found := (result["result"] or {}).get(key)) != want:
                    failures.append(f"{case['id']}.{k}: {key} is {found}, not {want}")
    return failures
