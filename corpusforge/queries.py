"""Named queries of the core operators over the test tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import tokenizer
from corpusforge.functions.calculator import UNITS, canonical_json, factor, run_call
from corpusforge.functions.exact import expression_value, verified
from corpusforge.functions.ids import derive_id, derive_seed, hash_split
from corpusforge.functions.text import first_call, first_tag, last_number, normalized, quality_counts, shape, tagged
from corpusforge.functions.words import clean_category, clean_name, token_count
from corpusforge.operators import build as building
from corpusforge.operators import contamination, dedup, dialogue, generate, manifests, packing, render, sampling, scoring, selection, stats, subsets
from corpusforge.plans.stage import staged
from corpusforge.schema import CATEGORIES, case_rules, example_rules, violations
from corpusforge.sources.tables import table
from corpusforge.streaming.records import windowed_counts

SEED = 20260401
SPECIAL = {"begin": 1, "end": 2, "pad": 0}

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _shape_sql(c: str) -> str:
    number = r"[-+]?\p{Nd}+(?:\.\p{Nd}+)?(?:/\p{Nd}+)?(?:e[-+]?\p{Nd}+)?"
    pieces = rf"list_transform(regexp_extract_all(lower({c}), '[a-z_][-+\p{{Nd}}]?|{number}|(?s:.)'), lambda t: CASE WHEN regexp_full_match(t, '{number}') THEN '<NUM>' ELSE t END)"
    return _strip_sql(f"regexp_replace(regexp_replace(array_to_string({pieces}, ''), '\\$[{_SPACE}]*<NUM>', '$<NUM>', 'g'), '[{_SPACE}]+', ' ', 'g')")


def _tokens_sql(c: str) -> str:
    return rf"coalesce(len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+')), 0)"


def _category_sql(c: str) -> str:
    return f"regexp_replace(lower({_strip_sql(c)}), '[{_SPACE}-]+', '_', 'g')"


_BARE = "json_extract_string({0}, '$')"
_ANSWER_SQL = f"CASE WHEN answer_json = 'true' THEN 'True' WHEN answer_json = 'false' THEN 'False' WHEN starts_with(answer_json, '\"') THEN {_BARE.format('answer_json')} WHEN answer_json != 'null' THEN answer_json END"
_REPR_SQL = f"CASE WHEN answer_json IS NULL OR answer_json = 'null' THEN 'None' WHEN answer_json = 'true' THEN 'True' WHEN answer_json = 'false' THEN 'False' WHEN answer_kind = 'str' OR starts_with(answer_json, '\"') THEN '''' || {_BARE.format('answer_json')} || '''' ELSE answer_json END"
_KEY_SQL = f"sha256(coalesce(prompt, '') || chr(31) || {_REPR_SQL})"
_SEED_SQL = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT & 9223372036854775807)::BIGINT"
_REC = f"""rec AS (SELECT example_id, min(prompt) AS prompt, min(lower({_strip_sql("split")})) AS split, min(lower({_strip_sql("family_id")})) AS family_id,
    min(template_id) AS template_id, min({_category_sql("category")}) AS category, min(generator_id) AS generator_id, min(derivation_id) AS derivation_id,
    min(answer_json) AS answer_json, min(answer_kind) AS answer_kind, min(tolerance) AS tolerance, min(expected_behavior) AS expected_behavior,
    min(difficulty) AS difficulty, min(tool_required) AS tool_required, min(synthetic) AS synthetic, min(tool_name) AS tool_name,
    coalesce(max(token_count), 0) AS tokens FROM examples GROUP BY example_id)"""


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def records(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One row per example id, names cleaned, with ``more`` columns; of repeated rows the least values and the most tokens."""
    least = lambda c, name: F.min(c).alias(name)
    return table(spark, folder, "examples").groupBy("example_id").agg(
        least(F.col("prompt"), "prompt"), least(clean_name(F.col("split")), "split"), least(clean_name(F.col("family_id")), "family_id"), least(F.col("template_id"), "template_id"),
        least(clean_category(F.col("category")), "category"), least(F.col("generator_id"), "generator_id"), least(F.col("derivation_id"), "derivation_id"),
        least(F.col("answer_json"), "answer_json"), least(F.col("answer_kind"), "answer_kind"), least(F.col("tolerance"), "tolerance"), least(F.col("expected_behavior"), "expected_behavior"),
        F.coalesce(F.max("token_count"), F.lit(0)).alias("tokens"), *[least(F.col(c), c) for c in more],
    )


def _key() -> Column:
    return dedup.exact_key(F.col("prompt"), dedup.python_repr(F.col("answer_json"), F.col("answer_kind")))


# --- text ------------------------------------------------------------------------------------------------------------

_NORMAL = _strip_sql(r"regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')")


@query(rf"SELECT doc_id, sha256(n) AS digest, length(n) AS n_normal FROM (SELECT doc_id, text, {_NORMAL} AS n FROM documents) WHERE n != '' AND NOT regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.transform(F.array(normalized(F.col("text"))), lambda n: F.when(n.isNotNull(), F.struct(F.sha2(n, 256).alias("digest"), F.length(n).alias("n_normal"))))
    return table(spark, folder, "documents").select("doc_id", F.inline(F.array_compact(kept)))


@query(rf"""SELECT count(*) AS texts, count(*) FILTER (prompt IS NULL) AS nulls, count(*) FILTER (c) AS control, count(*) FILTER (NOT c AND {_strip_sql("prompt")} = '') AS blank,
    count(*) FILTER (NOT c AND {_strip_sql("prompt")} != '') AS accepted FROM (SELECT prompt, regexp_matches(prompt, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') AS c FROM examples)""")
def control_char_filter(spark: SparkSession, folder: str) -> DataFrame:
    return quality_counts(table(spark, folder, "examples"), "prompt")


@query(f"WITH {_REC} SELECT value, n FROM (SELECT {_shape_sql('prompt')} AS value, count(*) AS n, min(example_id) AS f FROM rec GROUP BY 1) ORDER BY n DESC, f LIMIT 20")
def structural_topk(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_values(records(spark, folder), shape(F.col("prompt")), "example_id", 20)


_END = "(?:<(?:tool_call|tool_result|final|unsupported|error)>|\\z)"


def _tag_sql(tag: str) -> str:
    return f"CASE WHEN contains(text, '<{tag}>') THEN {_strip_sql(f"regexp_extract(text, '(?s)<{tag}>(.*?){_END}', 1)")} END"


@query(f"""SELECT doc_id, f AS first_tag, {_tag_sql("final")} AS final, CASE WHEN f = 'tool_call' THEN {_tag_sql("tool_call")} END AS call
    FROM (SELECT doc_id, text, nullif(regexp_extract(text, '<(tool_call|tool_result|final|unsupported|error)>', 1), '') AS f FROM documents) WHERE f IS NOT NULL""")
def terminal_tag_extract(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", first_tag(text).alias("first_tag"), tagged(text, "final").alias("final"), first_call(text).alias("call")).filter("first_tag is not null")


@query()
def last_number_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", last_number(F.col("text")).alias("last_number"))


@query(f"SELECT source, count(*) AS texts, sum(t) AS tokens, sum(coalesce(length(text), 0)) AS chars, CASE WHEN sum(length(text)) > 0 THEN sum(t) / sum(length(text)) END AS tokens_per_char, sum(t) / count(*) AS tokens_per_text FROM (SELECT lower({_strip_sql('source')}) AS source, text, {_tokens_sql('text')} AS t FROM documents) GROUP BY 1")
def token_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(clean_name(F.col("source")).alias("source"), "text")
    return tokenizer.efficiency(docs, "text", "source", token_count(F.col("text")))


@query()
def vocabulary_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).withColumn("_ids", tokenizer.encoded(F.col("prompt"), tokenizer.path("piece_bpe_32k.model")))
    return tokenizer.efficiency(rows, "prompt", "category", F.when(F.col("_ids").isNotNull(), F.size("_ids")))


@query()
def tokenizer_checks(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.token_checks(table(spark, folder, "documents"), "text", tokenizer.path("byte_bpe_50k.tiktoken"), 50_256)


@query()
def tokenizer_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.piece_audit(tokenizer.vocabulary(spark, tokenizer.path("piece_bpe_32k.model")))


# --- identities ------------------------------------------------------------------------------------------------------

_IDS = "concat_ws(chr(31), coalesce(generator_id, ''), coalesce(family_id, ''), coalesce(derivation_id, ''))"


@query(f"WITH {_REC} SELECT example_id, substr(sha256({_IDS}), 1, 16) AS id16, {_SEED_SQL.format(_IDS)} AS seed63 FROM rec")
def derived_ids(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.col("generator_id"), F.col("family_id"), F.col("derivation_id")]
    return records(spark, folder).select("example_id", derive_id(*parts).alias("id16"), derive_seed(*parts).alias("seed63"))


_STEP = _SEED_SQL.format(f"'{SEED}' || chr(31) || 'split' || chr(31) || {_IDS}") + " % 100000"


@query(f"WITH {_REC} SELECT example_id, CASE WHEN {_STEP} < 90000 THEN 'train' WHEN {_STEP} < 95000 THEN 'validation' ELSE 'test' END AS new_split FROM rec")
def hash_splits(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("example_id", hash_split(F.col("generator_id"), F.col("family_id"), F.col("derivation_id"), SEED, 0.9, 0.05).alias("new_split"))


@query(f"WITH {_REC} SELECT split, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS digest, count(*) AS n FROM rec GROUP BY split")
def ids_set_digest(spark: SparkSession, folder: str) -> DataFrame:
    return stats.set_digest(records(spark, folder), "example_id", ["split"])


# --- duplicates ------------------------------------------------------------------------------------------------------


@query(f"WITH {_REC} SELECT min(example_id) AS example_id FROM rec GROUP BY {_KEY_SQL}")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    keyed = records(spark, folder).select("example_id", _key().alias("key"))
    return dedup.first_of_each(keyed, F.col("key"), ["example_id"]).select("example_id")


@query(f"WITH {_REC} SELECT example_id FROM (SELECT example_id, row_number() OVER (PARTITION BY family_id, {_shape_sql('prompt')} ORDER BY example_id) AS k FROM rec) WHERE k <= 3")
def near_dedup_cap(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.shape_capped(records(spark, folder).select("example_id", "family_id", "prompt"), F.col("family_id"), F.col("prompt"), ["example_id"], 3).select("example_id")


@query(f"WITH {_REC} SELECT example_id FROM rec WHERE {_KEY_SQL} NOT IN (SELECT {_KEY_SQL} FROM phase0_v1)")
def reserved_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.without_reserved(records(spark, folder), _key(), table(spark, folder, "phase0_v1"), _key()).select("example_id")


# --- contamination ---------------------------------------------------------------------------------------------------


def _shingles_sql(k: int) -> str:
    words = f"list_filter(string_split_regex(lower(prompt), '[{_SPACE}]+'), lambda x: x != '')"
    return f"list_distinct(CASE WHEN len({words}) < {k} THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i:i + {k - 1}], ' ')) END)"


_NEAR = f"""WITH {_REC}, e AS (SELECT id, {_shingles_sql(3)} AS s FROM phase0_v1 WHERE prompt IS NOT NULL), t AS (SELECT example_id, {_shingles_sql(3)} AS s FROM rec WHERE split = 'train' AND prompt IS NOT NULL),
    p AS (SELECT eid, tid, any_value(en) AS en, any_value(tn) AS tn, count(*) AS b FROM (SELECT id AS eid, len(s) AS en, unnest(s) AS x FROM e) JOIN (SELECT example_id AS tid, len(s) AS tn, unnest(s) AS x FROM t) USING (x) GROUP BY eid, tid)
    SELECT eid AS eval_id, tid AS train_id, b / (en + tn - b) AS jaccard FROM p WHERE b / (en + tn - b) >= 0.5"""


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).filter("split = 'train'")


def _near(rows: DataFrame, cases: DataFrame) -> DataFrame:
    return contamination.near_pairs(cases, "id", "prompt", rows.filter("split = 'train'"), "example_id", "prompt", 3, 0.5)


@query(_NEAR)
def shingle_jaccard_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return _near(records(spark, folder), table(spark, folder, "phase0_v1"))


_SHAPES = f"""WITH {_REC}, t AS (SELECT {_shape_sql('prompt')} AS s, arg_min(prompt, example_id) AS train_text FROM rec
    WHERE split = 'train' AND prompt IS NOT NULL GROUP BY 1) SELECT id AS eval_id, train_text FROM phase0_v1 JOIN t ON {_shape_sql('prompt')} = s"""


def _same_shape(rows: DataFrame, cases: DataFrame) -> DataFrame:
    return contamination.shape_pairs(cases, "id", "prompt", rows.filter("split = 'train'"), "prompt", "example_id")


@query(_SHAPES)
def structural_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return _same_shape(records(spark, folder), table(spark, folder, "phase0_v1"))


def _violations_sql(key: str) -> str:
    return f"""WITH {_REC} SELECT example_id, key, split, first_split FROM
        (SELECT example_id, split, {key} AS key, first_value(split) OVER (PARTITION BY {key} ORDER BY example_id) AS first_split FROM rec) WHERE split IS DISTINCT FROM first_split"""


_DERIVATION = "coalesce(generator_id, '') || '/' || coalesce(family_id, '') || '/' || coalesce(derivation_id, '')"


def _torn(rows: DataFrame, key: Column) -> DataFrame:
    return contamination.split_violations(rows, key, "split", ["example_id"]).select("example_id", "key", "split", "first_split")


def _derivation() -> Column:
    return F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in ("generator_id", "family_id", "derivation_id")])


@query(_violations_sql(_DERIVATION))
def split_isolation(spark: SparkSession, folder: str) -> DataFrame:
    return _torn(records(spark, folder), _derivation())


@query(_violations_sql(_KEY_SQL))
def cross_split_dups(spark: SparkSession, folder: str) -> DataFrame:
    return _torn(records(spark, folder), _key())


_SHARED_FIELDS = ["generator_id", "family_id", "template_id"]
_SHARED = f"WITH {_REC} " + " UNION ALL ".join(
    f"(SELECT '{c}' AS field, {c} AS value FROM rec WHERE split = 'test' AND {c} IS NOT NULL INTERSECT SELECT '{c}', {c} FROM rec WHERE split = 'train')" for c in _SHARED_FIELDS
)


def _shared(rows: DataFrame) -> DataFrame:
    return contamination.shared_values(rows.filter("split = 'test'"), rows.filter("split = 'train'"), _SHARED_FIELDS)


@query(_SHARED)
def shared_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _shared(records(spark, folder))


_CHECKS = {"split_isolation": _violations_sql(_DERIVATION), "cross_split_duplicates": _violations_sql(_KEY_SQL), "near_pairs": _NEAR, "shape_pairs": _SHAPES, "shared_ids": _SHARED}


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) AS violations, count(*) = 0 AS clean FROM ({sql})" for name, sql in _CHECKS.items()))
def contamination_report(spark: SparkSession, folder: str) -> DataFrame:
    """All checks over records that are gathered once."""
    cases = table(spark, folder, "phase0_v1")
    rows = staged(records(spark, folder).withColumn("_exact", _key()).select("example_id", "prompt", "split", "derivation_id", "_exact", *_SHARED_FIELDS))
    found = (_torn(rows, _derivation()), _torn(rows, F.col("_exact")), _near(rows, cases), _same_shape(rows, cases), _shared(rows))
    return contamination.report(dict(zip(_CHECKS, found)))


# --- statistics ------------------------------------------------------------------------------------------------------


@query(f"WITH {_REC} SELECT count(*) AS examples, sum(tokens) AS tokens, sum(strlen(prompt)) AS bytes, avg(tokens) AS mean_tokens, median(tokens) AS median_tokens, max(tokens) AS max_tokens, avg((tokens > 64)::INT) AS beyond_context FROM rec")
def corpus_stats_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.totals(records(spark, folder), "prompt", "tokens", 64)


@query(f"WITH {_REC} SELECT split, count(*) AS examples, sum(tokens) AS tokens FROM rec GROUP BY split")
def split_composition(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).groupBy("split").agg(F.count("*").alias("examples"), F.sum("tokens").alias("tokens"))


_DIMENSIONS = {
    "category": "category",
    "difficulty": "difficulty",
    "tool_required": "CASE WHEN tool_required THEN 'tool_required' ELSE 'no_tool' END",
    "synthetic": "CASE WHEN synthetic THEN 'synthetic' ELSE 'external' END",
    "family": "generator_id || '/' || family_id",
    "tool_name": "tool_name",
    "behavior": "expected_behavior",
    "answer_kind": "answer_kind",
}
_MORE = ["difficulty", "tool_required", "synthetic", "tool_name"]


@query(f"WITH {_REC} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS value, count(*) AS examples, sum(tokens) AS tokens FROM rec WHERE {e} IS NOT NULL GROUP BY 2" for d, e in _DIMENSIONS.items()))
def distributions(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distributions(records(spark, folder, *_MORE), {d: F.expr(e) for d, e in _DIMENSIONS.items()}, "tokens")


@query(f"""WITH {_REC}, r AS (SELECT category, tokens, row_number() OVER (PARTITION BY category ORDER BY tokens) - 1 AS k, count(*) OVER (PARTITION BY category) AS n FROM rec)
    SELECT category, p::DOUBLE AS p, tokens AS value FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) v(p) WHERE k = least(n - 1, floor(n * p))""")
def percentile_floor_rank(spark: SparkSession, folder: str) -> DataFrame:
    return stats.floor_percentiles(records(spark, folder), "tokens", [0.5, 0.9, 0.99], ["category"])


@query(f"SELECT source, sum(n_chars * t) / sum(CASE WHEN n_chars IS NOT NULL THEN t END) AS mean, sum(t) AS weight FROM (SELECT lower({_strip_sql('source')}) AS source, n_chars, {_tokens_sql('text')} AS t FROM documents) GROUP BY ROLLUP (source)")
def weighted_means(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(clean_name(F.col("source")).alias("source"), "n_chars", token_count(F.col("text")).alias("t"))
    return stats.weighted_means(docs, "n_chars", "t", "source")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def log_event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return windowed_counts(table(spark, folder, "events"), "ts", "1 hour", ["event_type"], "value")


@query("""WITH e AS (SELECT *, event_id % 2 = 0 AS l, event_id // 2 AS step FROM events), a AS (SELECT step AS s, max(value) AS v FROM e WHERE l GROUP BY 1), b AS (SELECT step AS s, max(value) AS v FROM e WHERE NOT l GROUP BY 1)
    SELECT count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS common_steps, count(*) FILTER (a.s IS NULL OR b.s IS NULL) AS single_steps, max(abs(a.v - b.v)) AS greatest_difference,
    count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) > 0 AND max(abs(a.v - b.v)) <= 1e-6 AS resumed FROM a FULL JOIN b ON a.s = b.s""")
def resume_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """All events as two logs by turns, aligned by step."""
    log = table(spark, folder, "events").withColumn("step", F.floor(F.col("event_id") / 2))
    return stats.log_drift(log.filter("event_id % 2 = 0"), log.filter("event_id % 2 != 0"), "step", "value", 1e-6)


_DOCUMENT = {"category_distribution": "category", "difficulty_distribution": "difficulty", "tool_required_distribution": _DIMENSIONS["tool_required"], "synthetic_vs_external": _DIMENSIONS["synthetic"],
    "generator_family_distribution": "concat_ws('/', coalesce(generator_id, ''), coalesce(family_id, ''))", "tool_name_distribution": "nullif(tool_name, '')", "expected_behavior_distribution": "expected_behavior"}
_COUNTERS = "generated rejected_ground_truth_mismatch rejected_schema_invalid rejected_exceeds_context rejected_exact_duplicate rejected_near_duplicate rejected_diversity_cap accepted".split()


@query(f"""WITH {_REC}, shapes AS (SELECT {_shape_sql('prompt')} AS shp, count(*) AS n, min(example_id) AS f FROM rec WHERE prompt IS NOT NULL GROUP BY 1), top AS (SELECT shp, n FROM shapes ORDER BY n DESC, f, shp LIMIT 20),
    b AS (SELECT {", ".join(f"max({c}) AS {c}" for c in _COUNTERS)} FROM build_counters GROUP BY build_id, family_id), k AS (SELECT tokens, row_number() OVER (ORDER BY tokens) - 1 AS k, count(*) OVER () AS n FROM rec)
    """ + " UNION ALL ".join([
    *[f"(SELECT '{k}' AS key, {e} AS name, count(*)::DOUBLE AS value FROM rec WHERE {e} IS NOT NULL GROUP BY 2)" for k, e in _DOCUMENT.items()],
    f"(SELECT 'tokens_by_generator_family', {_DOCUMENT['generator_family_distribution']}, sum(tokens)::DOUBLE FROM rec GROUP BY 2)",
    "(SELECT 'split_composition.examples', split, count(*)::DOUBLE FROM rec WHERE split IS NOT NULL GROUP BY 2)", "(SELECT 'split_composition.tokens', split, sum(tokens)::DOUBLE FROM rec WHERE split IS NOT NULL GROUP BY 2)",
    "(SELECT 'top_structural_template_counts', shp, n::DOUBLE FROM top)", "(SELECT 'structural_template_count', '', count(*)::DOUBLE FROM shapes)",
    *[f"(SELECT '{k}', '', ({e})::DOUBLE FROM rec)" for k, e in {"total_examples": "count(*)", "total_tokens": "sum(tokens)", "total_bytes": "sum(strlen(prompt))", "average_tokens_per_example": "avg(tokens)", "median_tokens_per_example": "median(tokens)",
        "max_example_tokens": "max(tokens)", "fraction_exceeding_context": "avg((tokens > 64)::INT)"}.items()],
    *[f"(SELECT 'token_length_percentiles', 'p{p}', tokens::DOUBLE FROM k WHERE k = least(n - 1, floor(n * {p / 100}::DOUBLE)))" for p in (50, 90, 99)],
    *[f"(SELECT 'build_counters', '{c}', coalesce(sum({c}), 0)::DOUBLE FROM b)" for c in _COUNTERS],
    ]))
def statistics_document(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics document of the corpus and its build counters, a row per number."""
    rows = _chosen(spark, folder, "synthetic", "tool_name")
    once = table(spark, folder, "build_counters").groupBy("build_id", "family_id").agg(*[F.max(c).alias(c) for c in _COUNTERS])
    counters = once.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS]).first().asDict()
    told = stats.document(rows, 64, counters, shape(F.col("prompt")))
    flat = []
    for key, value in told.items():
        if key == "split_composition":
            flat += [(f"{key}.{k}", split, float(n)) for split, of in value.items() for k, n in of.items()]
        elif isinstance(value, dict):
            flat += [(key, name, float(n)) for name, n in value.items()]
        else:
            flat.append((key, "", float(value)))
    return spark.createDataFrame(flat, "key string, name string, value double")


# --- sampling --------------------------------------------------------------------------------------------------------

_TARGET_TOKENS, _FLOOR = 20_000, 18
_TARGETS = f"""c AS (SELECT category, count(*) AS available, sum(tokens) AS t FROM rec WHERE split = 'train' AND category IS NOT NULL GROUP BY 1),
    targets AS (SELECT category, available, greatest(least({_FLOOR}, available), least(coalesce(round_even((t / sum(t) OVER ()) * {_TARGET_TOKENS} / nullif(t / available, 0), 0), 0), available))::BIGINT AS target FROM c)"""


def _category_targets(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.proportional_targets(_train(spark, folder), "category", "tokens", _TARGET_TOKENS, _FLOOR)


@query(f"WITH {_REC}, {_TARGETS} SELECT * FROM targets")
def category_counts_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _category_targets(spark, folder)


_WEIGHTS = {c: 1 / len(CATEGORIES) for c in CATEGORIES}


@query(f"WITH {_REC} SELECT category, count(*) AS available, least(round_even(1500 * {1 / len(CATEGORIES)!r}, 0), count(*))::BIGINT AS target FROM rec WHERE category IN ({', '.join(repr(c) for c in CATEGORIES)}) GROUP BY 1")
def flattened_targets(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.flattened_targets(records(spark, folder), "category", 1500, _WEIGHTS)


def _stride_sql(rows: str, by: str, target: str, seed: int) -> str:
    return f"""SELECT example_id FROM (SELECT example_id, r.{by}, available, {target} AS target, row_number() OVER (PARTITION BY r.{by} ORDER BY example_id) - 1 AS k, greatest(1, available // {target}) AS step
        FROM {rows} r JOIN targets USING ({by}) WHERE {target} > 0) WHERE k >= {seed} % step AND (k - {seed} % step) % step = 0 AND (k - {seed} % step) // step < target"""


@query(f"WITH {_REC}, targets AS (SELECT split, count(*) AS available, greatest(1, count(*) // 7) AS target FROM rec WHERE split IS NOT NULL GROUP BY 1) {_stride_sql('rec', 'split', 'target', 5)}")
def stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(records(spark, folder).select("example_id", "split"))
    targets = rows.filter("split is not null").groupBy("split").agg(F.count("*").alias("available")).withColumn("target", F.greatest(F.lit(1), F.floor(F.col("available") / 7)))
    return sampling.stride_sample(rows, "example_id", targets, "split", 5).select("example_id")


@query(f"WITH {_REC}, {_TARGETS}, train AS (SELECT * FROM rec WHERE split = 'train') {_stride_sql('train', 'category', 'target', 11)}")
def stratified_stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stride_sample(_train(spark, folder), "example_id", _category_targets(spark, folder), "category", 11).select("example_id")


@query(f"""WITH {_REC}, {_TARGETS}, train AS (SELECT * FROM rec WHERE split = 'train'), more AS (SELECT category, available, target, least(available, floor(target * 1.15::DOUBLE)::BIGINT + 5) AS reserve FROM targets),
    k AS (SELECT example_id, tokens, category, target, reserve, row_number() OVER (PARTITION BY category ORDER BY example_id) - 1 AS k, greatest(1, available // reserve) AS step FROM train JOIN more USING (category)),
    hit AS (SELECT * FROM k WHERE k >= 3 % step AND (k - 3 % step) % step = 0 AND (k - 3 % step) // step < reserve AND tokens <= 60)
    SELECT example_id FROM (SELECT example_id, target, row_number() OVER (PARTITION BY category ORDER BY example_id) AS r FROM hit) WHERE r <= target""")
def oversample_length_gate(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.gated_sample(_train(spark, folder), "example_id", "category", _category_targets(spark, folder), F.col("tokens") <= 60, 3).select("example_id")


@query(f"WITH {_REC} SELECT example_id FROM (SELECT example_id, coalesce(sum(tokens) OVER (PARTITION BY category ORDER BY example_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rec) WHERE before < 2000")
def token_quota_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.quota_prefix(records(spark, folder), "category", "example_id", F.col("tokens"), 2000).select("example_id")


_POSITION = "row_number() OVER (ORDER BY sha256('17' || chr(31) || '2' || chr(31) || example_id)) - 1"


@query(f"WITH {_REC} SELECT example_id, {_POSITION} AS position FROM rec")
def epoch_order(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.shuffled(records(spark, folder).select("example_id"), F.col("example_id"), 17, 2)


@query(f"WITH {_REC} SELECT example_id, ['red', 'green', 'blue'][(row_number() OVER (ORDER BY example_id) - 1) % 3 + 1] AS slot FROM rec")
def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.round_robin(records(spark, folder).select("example_id"), "example_id", ["red", "green", "blue"], "slot")


@query("SELECT * FROM (SELECT id, category, difficulty FROM phase0_v1 ORDER BY id LIMIT 50)")
def case_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "phase0_v1").select("id", "category", "difficulty").orderBy("id").limit(50)


_FRAMES = ["Please answer: %s", "%s Give only the result.", "Question: %s", "Work this out. %s"]
_COPY = "example_id || ':' || variant"


@query(f"""WITH {_REC}, v AS (SELECT *, unnest(CASE WHEN answer_json IS NOT NULL AND answer_json != 'null' AND expected_behavior = 'answer' THEN [0, 1, 2] ELSE [0] END) AS variant FROM rec)
    SELECT CASE WHEN variant > 0 THEN substr(sha256({_COPY}), 1, 24) ELSE example_id END AS example_id, variant,
    CASE WHEN variant > 0 THEN replace([{", ".join(repr(f) for f in _FRAMES)}][('0x' || substr(sha256({_COPY}), 57, 8))::UBIGINT::BIGINT % 4 + 1], '%s', prompt) ELSE prompt END AS prompt FROM v""")
def instruction_augment(spark: SparkSession, folder: str) -> DataFrame:
    allowed = F.col("answer_json").isNotNull() & (F.col("answer_json") != "null") & (F.col("expected_behavior") == "answer")
    return sampling.augmented(records(spark, folder), "example_id", "prompt", allowed, _FRAMES, 2).select("example_id", "variant", "prompt")


@query(f"WITH {_REC} SELECT split, count(*) AS records, sum(tokens) AS tokens, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS ids_sha256, count(DISTINCT family_id) AS distinct_family_id FROM rec GROUP BY split")
def subset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return subsets.subset_manifest(records(spark, folder), "example_id", "split", "tokens", [], ["family_id"])


def _map_sql(c: str, rows: str = "rec", by: str = "split") -> str:
    return f"""SELECT {by}, '{{' || string_agg('"' || {c} || '":' || n, ',' ORDER BY {c}) || '}}' AS j FROM (SELECT {by}, {c}, count(*) AS n FROM {rows} WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY {by}"""


@query(f"""WITH {_REC}, c AS ({_map_sql("category")}), b AS ({_map_sql("expected_behavior")}), m AS (SELECT split, count(*) AS records, sum(tokens) AS tokens, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS ids_sha256,
    count(DISTINCT family_id) AS distinct_family_id, count(*) FILTER (tool_required) AS with_tool_required FROM rec GROUP BY split)
    SELECT m.*, c.j AS category_counts, b.j AS expected_behavior_counts FROM m LEFT JOIN c ON m.split IS NOT DISTINCT FROM c.split LEFT JOIN b ON m.split IS NOT DISTINCT FROM b.split""")
def subset_manifest_maps(spark: SparkSession, folder: str) -> DataFrame:
    counted = ["category", "expected_behavior"]
    found = subsets.subset_manifest(records(spark, folder, "tool_required"), "example_id", "split", "tokens", counted, ["family_id"], "tool_required")
    return found.withColumns({f"{c}_counts": F.to_json(f"{c}_counts") for c in counted})


_FACTS = ["example_count", "total_token_count", "example_ids_sha256", "tool_required_count", "family_count", "category_counts", "difficulty_counts"]
_FACTS_SQL = f"""SELECT s.split, count(*) AS example_count, sum(tokens) AS total_token_count, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS example_ids_sha256,
    count(*) FILTER (tool_required) AS tool_required_count, count(DISTINCT family_id) AS family_count, any_value(c.j) AS category_counts, any_value(d.j) AS difficulty_counts
    FROM sel s LEFT JOIN ({_map_sql("category", "sel")}) c USING (split) LEFT JOIN ({_map_sql("difficulty", "sel")}) d USING (split) GROUP BY s.split"""


def _manifest_rows(spark: SparkSession, manifest: dict, more: list[str] = []) -> DataFrame:  # noqa: B006
    """A manifest's splits as rows, maps as JSON."""
    rows = [(s, *[json.dumps(of[k], sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(of[k], dict) else of[k] for k in [*_FACTS, *more]]) for s, of in manifest["splits"].items()]
    kinds = {"example_ids_sha256": "string", "category_counts": "string", "difficulty_counts": "string", "representation_sha256": "string"}
    return spark.createDataFrame(rows, "split string, " + ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in [*_FACTS, *more]))


def _chosen(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return staged(records(spark, folder, "difficulty", "tool_required", *more).withColumnRenamed("tokens", "token_count"))


_EVENLY = """w AS (SELECT split, count(*) AS n, greatest(1, count(*) // CASE split WHEN 'train' THEN 9 ELSE 3 END) AS target FROM rec WHERE split IN ('train', 'validation') GROUP BY 1),
    k AS (SELECT rec.*, n, target, greatest(1, n // target) AS step, row_number() OVER (PARTITION BY split ORDER BY example_id) - 1 AS k FROM rec JOIN w USING (split)),
    sel AS (SELECT * FROM k WHERE k >= 7 % step AND (k - 7 % step) % step = 0 AND (k - 7 % step) // step < target)"""


@query(f"WITH {_REC}, {_EVENLY} {_FACTS_SQL}")
def smoke_subset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A ninth of the training and a third of the validation records, evenly spaced, and their manifest."""
    rows = _chosen(spark, folder)
    counts = {r["split"]: r["count"] for r in rows.filter("split in ('train', 'validation')").groupBy("split").count().collect()}
    targets = {s: max(1, n // (9 if s == "train" else 3)) for s, n in counts.items()}
    return _manifest_rows(spark, selection.smoke_subset(rows, "example_id", "split", targets, 7)[1])


_BY_TOKENS = """cfg AS (SELECT * FROM pilot_subset_config ORDER BY config_id LIMIT 1), part AS (SELECT * FROM rec WHERE split IN ('train', 'validation') AND category IS NOT NULL),
    wanted AS (SELECT 'train' AS split, target_train_tokens AS tokens, min_category_examples AS floor_ FROM cfg UNION ALL SELECT 'validation',
    (SELECT round_even(sum(tokens) / count(*) * (SELECT validation_examples FROM cfg), 0)::BIGINT FROM part WHERE split = 'validation'), min_category_examples_validation FROM cfg),
    c AS (SELECT split, category, count(*) AS available, sum(tokens) AS t FROM part GROUP BY ALL),
    targets AS (SELECT split, category, available, greatest(least(w.floor_, available), least(coalesce(round_even((t / sum(t) OVER (PARTITION BY split)) * w.tokens / nullif(t / available, 0), 0), 0), available))::BIGINT AS target FROM c JOIN wanted w USING (split)),
    k AS (SELECT part.*, target, greatest(1, available // target) AS step, row_number() OVER (PARTITION BY split, category ORDER BY example_id) - 1 AS k FROM part JOIN targets USING (split, category) WHERE target > 0),
    sel AS (SELECT * FROM k WHERE k >= 11 % step AND (k - 11 % step) % step = 0 AND (k - 11 % step) // step < target)"""


@query(f"WITH {_REC}, {_BY_TOKENS} {_FACTS_SQL}")
def pilot_subset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The first pilot configuration's records by category, and their manifest."""
    config = table(spark, folder, "pilot_subset_config").orderBy("config_id").first().asDict()
    return _manifest_rows(spark, selection.pilot_subset(_chosen(spark, folder), "example_id", "split", "category", "token_count", config, 11)[1])


@query(f"WITH {_REC}, sel AS (SELECT * FROM rec WHERE split IN ('train', 'validation')) {_FACTS_SQL}")
def full_set_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest_rows(spark, selection.full_set(_chosen(spark, folder), "example_id", "split", "token_count")[1])


def _code_points(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


def _represented(df: DataFrame) -> DataFrame:
    """Records with code points for token ids: the prompt masked, the answer supervised."""
    answer = F.coalesce(F.concat(F.lit("\n<final>"), render.answer_text(F.col("answer_json"))), F.lit(""))
    parts = F.array(_code_points(F.coalesce("prompt", F.lit(""))), _code_points(answer))
    ids, labels = render.masked(parts, F.array(F.lit("context"), F.lit("supervised")), SPECIAL["begin"], SPECIAL["end"])
    return df.withColumns({"input_ids": ids, "labels": labels})


_POINTS = "list_transform(list_filter(string_split({0}, ''), lambda x: x != ''), lambda x: unicode(x))"
_TUNED = f"""c AS (SELECT split, category, count(*) AS available, least(CASE split WHEN 'train' THEN 12 ELSE 3 END * CASE category WHEN 'tool_error' THEN 1.5 ELSE 1 END, count(*)) AS t FROM rec WHERE split IN ('train', 'validation') AND category IS NOT NULL GROUP BY split, category),
    targets AS (SELECT split, category, available, round_even(t, 0)::BIGINT AS target FROM c), more AS (SELECT *, least(available, floor(target * 1.15::DOUBLE)::BIGINT + 5) AS reserve FROM targets WHERE target > 0),
    k AS (SELECT rec.*, target, reserve, greatest(1, available // reserve) AS step, row_number() OVER (PARTITION BY split, category ORDER BY example_id) - 1 AS k FROM rec JOIN more USING (split, category)),
    hit AS (SELECT *, row_number() OVER (PARTITION BY split, category ORDER BY example_id) AS r FROM k WHERE k >= 5 % step AND (k - 5 % step) % step = 0 AND (k - 5 % step) // step < reserve AND tokens <= 1024), sel AS (SELECT * FROM hit WHERE r <= target),
    p AS (SELECT split, example_id, {_POINTS.format("coalesce(prompt, '')")} AS p, {_POINTS.format(f"coalesce(chr(10) || '<final>' || ({_ANSWER_SQL}), '')")} AS a FROM sel),
    q AS (SELECT split, example_id, '{{"example_id":"' || example_id || '","input_ids":[' || array_to_string([1] || p || a || [2], ',') || '],"labels":[' || array_to_string([-100] || list_transform(p, lambda x: -100) || a || [2], ',') || ']}}' AS j FROM p),
    d AS (SELECT split, sha256('[' || string_agg(j, ',' ORDER BY example_id) || ']') AS representation_sha256 FROM q GROUP BY split)"""


@query(f"WITH {_REC}, {_TUNED} SELECT m.*, d.representation_sha256 FROM ({_FACTS_SQL}) m JOIN d USING (split)")
def tuning_subset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The same number of records of every category, and the hash of their exact representation by code points."""
    made = selection.tuning_subset(_chosen(spark, folder), "example_id", "split", "category", {"train": 12, "validation": 3}, {"tool_error": 1.5}, F.col("token_count") <= 1024, 1024, 5, _represented)
    return _manifest_rows(spark, made[1], ["representation_sha256"])


_UNION = f"WITH {_REC}, m AS (SELECT split, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS d FROM rec WHERE split IS NOT NULL GROUP BY split) SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS identity FROM (SELECT split || ':' || d || ':none' AS l FROM m)"


@query(_UNION)
def subset_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).filter("split is not null")
    manifest = stats.set_digest(rows, "example_id", ["split"]).withColumn("replay", F.lit(None).cast("string"))
    return subsets.union_identity(manifest, "split", ["digest", "replay"])


@query(f"WITH {_REC} SELECT source, count(*) AS n, sum(tokens) AS tokens FROM (SELECT 'base' AS source, tokens FROM rec WHERE split = 'train' UNION ALL SELECT 'replay', tokens FROM rec WHERE split = 'validation') GROUP BY source")
def curriculum_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    parts = {"base": rows.filter("split = 'train'"), "replay": rows.filter("split = 'validation'")}
    return subsets.union_of_sources(parts).groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("""SELECT id AS row, 'missing_difficulty' AS rule FROM phase0_v1 WHERE NOT coalesce(regexp_matches(difficulty, '\\S'), false)
    UNION ALL SELECT DISTINCT id, 'repeated' FROM phase0_v1 WHERE id IN (SELECT id FROM phase0_v1 GROUP BY id HAVING count(*) > 1)""")
def manifest_table_rules(spark: SparkSession, folder: str) -> DataFrame:
    return subsets.table_rules(table(spark, folder, "phase0_v1"), ["id", "difficulty", "prompt"], "id", {"difficulty": ["trivial", "easy", "medium", "hard"]})


# --- sequences -------------------------------------------------------------------------------------------------------

_CAPACITY = 512
_PACK = f"""WITH RECURSIVE {_REC}, o AS (SELECT category, example_id, least(tokens, {_CAPACITY}) AS s, row_number() OVER (PARTITION BY category ORDER BY example_id) AS k FROM rec),
    f AS (SELECT category, k, s AS used, 0 AS bin, example_id, s FROM o WHERE k = 1 UNION ALL
    SELECT o.category, o.k, CASE WHEN f.used > 0 AND f.used + o.s > {_CAPACITY} THEN o.s ELSE f.used + o.s END, f.bin + (f.used > 0 AND f.used + o.s > {_CAPACITY})::INT, o.example_id, o.s FROM f JOIN o ON o.category IS NOT DISTINCT FROM f.category AND o.k = f.k + 1)"""


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).select("category", "example_id", F.least("tokens", F.lit(_CAPACITY)).alias("tokens"))
    return packing.next_fit(rows, ["category"], "example_id", "tokens", _CAPACITY)


@query(f"{_PACK} SELECT category, example_id, s AS tokens, bin FROM f")
def next_fit_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@query(f"""{_PACK}, b AS (SELECT category, bin, sum(s) AS used FROM f GROUP BY 1, 2)
    SELECT category, count(*) AS bins, sum(used) AS tokens, sum({_CAPACITY} - used) AS padding, sum(greatest(0, used - 1)) AS loss_tokens, sum({_CAPACITY} - used) / (sum(used) + sum({_CAPACITY} - used)) AS padding_fraction FROM b GROUP BY 1""")
def packing_padding_stats(spark: SparkSession, folder: str) -> DataFrame:
    return packing.padding(_packed(spark, folder), ["category"], "bin", "tokens", _CAPACITY)


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with code points for token ids, clipped to the capacity."""
    raw = records(spark, folder).select("category", "example_id", _code_points(F.coalesce("prompt", F.lit(""))).alias("raw"))
    return raw.select("category", "example_id", packing.clipped(F.col("raw"), _CAPACITY, SPECIAL["begin"], SPECIAL["end"]).alias("ids"))


def _list_digest(c: str) -> Column:
    return F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256).alias(c)


_IDS_SQL = f"i AS (SELECT category, example_id, [1] || list_slice({_POINTS.format("coalesce(prompt, '')")}, 1, {_CAPACITY - 2}) || [2] AS ids FROM rec)"
_PADDED_SQL = f"""sha256(array_to_string(ids || list_transform(range({_CAPACITY} - len(ids)), lambda x: 0), ',')) AS input_ids, sha256(array_to_string(ids || list_transform(range({_CAPACITY} - len(ids)), lambda x: -100), ',')) AS labels,
    sha256(array_to_string(list_transform(ids, lambda x: 1) || list_transform(range({_CAPACITY} - len(ids)), lambda x: 0), ',')) AS attention_mask"""


@query(f"""{_PACK.replace(_REC, f"{_REC}, {_IDS_SQL}").replace(f"least(tokens, {_CAPACITY}) AS s, row_number() OVER (PARTITION BY category ORDER BY example_id) AS k FROM rec", "len(ids) AS s, row_number() OVER (PARTITION BY category ORDER BY example_id) AS k FROM i")},
    b AS (SELECT f.category, bin, flatten(list(ids ORDER BY example_id)) AS ids FROM f JOIN i USING (example_id) GROUP BY ALL) SELECT category, bin, {_PADDED_SQL} FROM b""")
def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(_ids(spark, folder))
    bins = packing.next_fit(rows.withColumn("n", F.size("ids")), ["category"], "example_id", "n", _CAPACITY)
    met = rows.join(bins.select(F.col("example_id").alias("_e"), "bin"), F.col("example_id") == F.col("_e")).drop("_e")
    made = packing.packed_bins(met, ["category"], "bin", "example_id", "ids", _CAPACITY, SPECIAL["pad"])
    return made.select("category", "bin", *[_list_digest(c) for c in ("input_ids", "labels", "attention_mask")])


@query(f"WITH {_REC}, {_IDS_SQL} SELECT category, example_id, {_PADDED_SQL} FROM i")
def padded_examples(spark: SparkSession, folder: str) -> DataFrame:
    made = packing.padded_rows(_ids(spark, folder), "ids", _CAPACITY, SPECIAL["pad"])
    return made.select("category", "example_id", *[_list_digest(c) for c in ("input_ids", "labels", "attention_mask")])


_BUCKETS = f"""WITH {_REC}, p AS (SELECT example_id, tokens, {_POSITION} AS position FROM rec), b AS (SELECT *, position // 256 AS bucket FROM p),
    q AS (SELECT *, bucket * 256 + row_number() OVER (PARTITION BY bucket ORDER BY tokens, position) - 1 AS place FROM b), r AS (SELECT *, place // 8 AS batch FROM q)"""


def _bucketed(spark: SparkSession, folder: str) -> DataFrame:
    placed = sampling.shuffled(records(spark, folder).select("example_id", "tokens"), F.col("example_id"), 17, 2)
    return packing.length_buckets(placed, "position", "tokens", 8)


@query(f"{_BUCKETS} SELECT example_id, tokens, position, bucket, place, batch FROM r")
def length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _bucketed(spark, folder)


@query(f"{_BUCKETS} SELECT batch, count(*) AS rows, max(tokens) AS width, max(tokens) * count(*) - sum(tokens) AS padding FROM r GROUP BY batch")
def dynamic_pad(spark: SparkSession, folder: str) -> DataFrame:
    return packing.batch_padding(_bucketed(spark, folder), "batch", "tokens")


@query(f"WITH {_REC}, k AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS k FROM rec) SELECT example_id, k // 32 AS batch, k % 32 AS slot FROM k")
def micro_batches(spark: SparkSession, folder: str) -> DataFrame:
    return packing.micro_batches(records(spark, folder).select("example_id"), "example_id", 32)


@query("SELECT range AS step, CASE WHEN range < 100 THEN 0.001 * (range + 1) / 100 ELSE 0.0001 + 0.5 * (0.001 - 0.0001) * (1 + cos(pi() * least(1.0, (range - 100) / 900.0))) END AS rate FROM range(1000)")
def learning_rates(spark: SparkSession, folder: str) -> DataFrame:
    return packing.learning_rates(spark, 1000, 100, 0.001, 0.0001)


# --- rendering -------------------------------------------------------------------------------------------------------


def _distinct_examples(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["example_id", "prompt", "category", "expected_behavior", "answer_json", "answer_kind", "tolerance", "tool_required", "tool_name", "tool_traces"]
    return table(spark, folder, "examples").select(*columns, F.lit("").alias("notes")).distinct()


_TAG_SQL = "CASE expected_behavior WHEN 'refuse_unsupported' THEN 'unsupported' WHEN 'flag_undefined' THEN 'error' WHEN 'flag_missing_information' THEN 'unsupported' WHEN 'request_clarification' THEN 'unsupported' END"
_LINES = "array_to_string(list_concat([coalesce(prompt, '')], list_transform(coalesce(tool_traces, []), lambda t: '<tool_call>' || t.call || chr(10) || '<tool_result>' || t.result)), chr(10))"


@query(f"SELECT DISTINCT example_id, sha256({_LINES} || coalesce(chr(10) || coalesce('<final>' || ({_ANSWER_SQL}), '<' || ({_TAG_SQL}) || '>'), '')) AS digest FROM examples")
def render_training_text(spark: SparkSession, folder: str) -> DataFrame:
    return render.training_text(render.canonical_traces(_distinct_examples(spark, folder))).select("example_id", F.sha2("rendered", 256).alias("digest")).distinct()


@query(f"WITH {_REC} SELECT example_id, CASE WHEN ({_ANSWER_SQL}) IS NOT NULL THEN 'final' ELSE {_TAG_SQL} END AS expected_tag, {_ANSWER_SQL} AS expected_value FROM rec")
def expected_completion(spark: SparkSession, folder: str) -> DataFrame:
    return render.expected_tag(records(spark, folder)).select("example_id", "expected_tag", "expected_value")


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and labels of every distinct record's segments, with code points for token ids."""
    rows = render.segments(render.canonical_traces(_distinct_examples(spark, folder)))
    ids, roles = F.transform("segments", lambda x: _code_points(x["text"])), F.transform("segments", lambda x: x["role"])
    inputs, labels = render.masked(ids, roles, SPECIAL["begin"], SPECIAL["end"])
    return rows.select("example_id", inputs.alias("input_ids"), labels.alias("labels"))


_SEGMENTS = f"""s AS (SELECT DISTINCT example_id, coalesce(prompt, '') AS p, coalesce(tool_traces, []) AS traces, coalesce(chr(10) || coalesce('<final>' || ({_ANSWER_SQL}), '<' || ({_TAG_SQL}) || '>'),
    CASE WHEN expected_behavior = 'invoke_tool' AND category = 'tool_error' THEN chr(10) || '<error>' || json_extract_string(tool_traces[-1].result, '$.error.code') || ': ' || json_extract_string(tool_traces[-1].result, '$.error.message') END, '') AS ending FROM examples),
    parts AS (SELECT example_id, list_concat([{{'t': p, 'c': true}}], flatten(list_transform(traces, lambda t: [{{'t': chr(10) || '<tool_call>' || t.call, 'c': false}}, {{'t': chr(10) || '<tool_result>' || t.result, 'c': true}}])), [{{'t': ending, 'c': false}}]) AS x FROM s),
    m AS (SELECT example_id, [1] || flatten(list_transform(x, lambda y: {_POINTS.format("y.t")})) || [2] AS input_ids,
    [-100] || flatten(list_transform(x, lambda y: CASE WHEN y.c THEN list_transform({_POINTS.format("y.t")}, lambda z: -100) ELSE {_POINTS.format("y.t")} END)) || [2] AS labels FROM parts)"""


@query(f"WITH {_SEGMENTS} SELECT example_id, len(input_ids) AS n_ids, len(list_filter(labels[2:], lambda x: x != -100)) AS loss_tokens FROM m WHERE len(input_ids) <= 1024")
def loss_mask_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _masked(spark, folder).select("example_id", F.size("input_ids").alias("n_ids"), packing.loss_tokens(F.col("labels")).alias("loss_tokens")).filter("n_ids <= 1024")


@query(f"""WITH {_REC}, {_SEGMENTS}, j AS (SELECT split, example_id, '{{"example_id":"' || example_id || '","input_ids":[' || array_to_string(input_ids, ',') || '],"labels":[' || array_to_string(labels, ',') || ']}}' AS j FROM m JOIN rec USING (example_id))
    SELECT split, sha256('[' || string_agg(j, ',' ORDER BY example_id, j) || ']') AS representation_sha256, count(*) AS n FROM j GROUP BY split""")
def representation_identity(spark: SparkSession, folder: str) -> DataFrame:
    split = records(spark, folder).select(F.col("example_id").alias("_id"), "split")
    rows = _masked(spark, folder).join(split, F.col("example_id") == F.col("_id"))
    return subsets.representation_digest(rows, "example_id", "input_ids", "labels", ["split"])


# --- rules, truth and scores -----------------------------------------------------------------------------------------


def _rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return violations(df, rules).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def _rules_sql(table_: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM {table_} WHERE {broken} HAVING count(*) > 0" for name, broken in rules.items())


def _not_in(c: str, values: list[str]) -> str:
    return f"coalesce({c}, '') NOT IN ({', '.join(repr(v) for v in values)})"


_MODE = "coalesce(verification.mode, '')"
_ENUMS = {"unknown_difficulty": _not_in("difficulty", ["trivial", "easy", "medium", "hard"]), "unknown_mode": _not_in(_MODE, ["deterministic", "semantic", "tool"]), "unknown_behavior": _not_in("expected_behavior", ["answer", "request_clarification", "refuse_unsupported", "flag_missing_information", "flag_undefined", "flag_incorrect_answer", "invoke_tool"])}


@query(_rules_sql("examples", _ENUMS | {
    "empty_id": "coalesce(example_id, '') = ''", "unknown_category": _not_in("category", CATEGORIES), "unknown_split": _not_in("split", ["train", "validation", "test"]),
    "blank_prompt": "NOT coalesce(regexp_matches(prompt, '\\S'), false)", "semantic_with_answer": f"{_MODE} = 'semantic' AND coalesce(answer_json, 'null') != 'null'",
    "tool_without_trace": "coalesce(tool_required, false) AND coalesce(len(tool_traces), 0) = 0", "tool_without_name": "coalesce(tool_required, false) AND tool_name IS NULL",
    "trace_without_tool": "NOT coalesce(tool_required, false) AND coalesce(len(tool_traces), 0) > 0", "negative_tolerance": "tolerance < 0",
}))
def schema_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_counts(table(spark, folder, "examples"), example_rules())


@query(_rules_sql("phase0_v1", _ENUMS | {
    "blank_id": "NOT coalesce(regexp_matches(id, '\\S'), false)", "unknown_category": _not_in("category", [c for c in CATEGORIES if c not in ("numerical_comparison", "tool_error")]),
    "blank_prompt": "NOT coalesce(regexp_matches(prompt, '\\S'), false)", "null_tool_required": "tool_required IS NULL", "null_provenance": "provenance IS NULL", "negative_tolerance": "tolerance < 0",
}))
def case_schema_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_counts(table(spark, folder, "phase0_v1"), case_rules())


# the test tables' trees are single operations on two whole numbers, which SQL can compute
_NUMERIC = "CASE o WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b END"
_TREES = """SELECT {0}, json_extract_string(verification.expression, '$.op') AS o, TRY_CAST(json_extract_string(verification.expression, '$.args[0]') AS HUGEINT) AS a,
    TRY_CAST(json_extract_string(verification.expression, '$.args[1]') AS HUGEINT) AS b, TRY_CAST(json_extract_string(answer_json, '$') AS HUGEINT) AS w FROM {1}"""
_VERDICT = f"""CASE WHEN o IS NULL OR answer_json IS NULL THEN 'error' WHEN o IN ('gt', 'equals') THEN CASE WHEN answer_json = (CASE o WHEN 'gt' THEN a > b ELSE a = b END)::VARCHAR THEN 'ok' ELSE 'mismatch' END
    WHEN answer_json IN ('true', 'false') THEN 'mismatch' WHEN tolerance < 0 OR w IS NULL THEN 'error' WHEN abs(({_NUMERIC}) - w) <= coalesce(tolerance, 0) THEN 'ok' ELSE 'mismatch' END"""


@query(f"""WITH t AS ({_TREES.format("DISTINCT example_id, category, answer_json, tolerance, verification.mode AS m, len(tool_traces) AS k", "examples")})
    SELECT {_category_sql("category")} AS category, CASE m WHEN 'deterministic' THEN {_VERDICT} WHEN 'tool' THEN CASE WHEN k > 0 THEN 'ok' ELSE 'mismatch' END WHEN 'semantic' THEN 'ok' ELSE 'mismatch' END AS truth, count(DISTINCT example_id) AS n FROM t GROUP BY 1, 2""")
def ground_truth_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "examples").select("example_id", "category", "answer_json", "tolerance", "verification", "tool_traces").distinct()
    return building.ground_truth(rows).groupBy(clean_category(F.col("category")).alias("category"), "truth").agg(F.countDistinct("example_id").alias("n"))


@query(f"SELECT id, {_VERDICT} AS verdict FROM ({_TREES.format('id, answer_json, tolerance', 'phase0_v1')})")
def suite_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "phase0_v1").select("id", verified(F.col("verification.expression"), F.col("answer_json"), F.col("tolerance"), frozen=True).alias("verdict"))


@query(f"SELECT DISTINCT example_id, CASE o WHEN 'gt' THEN (a > b)::VARCHAR ELSE ({_NUMERIC})::VARCHAR END AS value FROM ({_TREES.format('example_id', 'examples')})")
def expression_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "examples").select("example_id", expression_value(F.col("verification.expression")).alias("value")).distinct()


# the test tables' calls hold trees where the calculator takes expressions; those of calculator.evaluate are written out, so that they succeed
_SIGNS = {"add": "+", "sub": "-", "mul": "*"}
_LIVE = "CASE WHEN tool = 'calculator.evaluate' AND ca IS NOT NULL AND cb IS NOT NULL THEN CASE co WHEN 'add' THEN ca + cb WHEN 'sub' THEN ca - cb WHEN 'mul' THEN ca * cb END END"
_TRACE = """json_extract_string({0}.call, '$.tool') AS tool, json_extract_string({0}.result, '$.status') AS status, json_extract_string({0}.result, '$.result.value') AS recorded,
    json_extract_string(json_extract_string({0}.call, '$.arguments.expression'), '$.op') AS co, TRY_CAST(json_extract_string(json_extract_string({0}.call, '$.arguments.expression'), '$.args[0]') AS HUGEINT) AS ca,
    TRY_CAST(json_extract_string(json_extract_string({0}.call, '$.arguments.expression'), '$.args[1]') AS HUGEINT) AS cb"""


def _written_out(traces: str) -> Column:
    def of(t: Column) -> Column:
        tree = F.get_json_object(t["call"], "$.arguments.expression")
        sign = F.create_map(*[F.lit(x) for p in _SIGNS.items() for x in p])[F.get_json_object(tree, "$.op")]
        expression = F.concat(F.get_json_object(tree, "$.args[0]"), sign, F.get_json_object(tree, "$.args[1]"))
        call = F.concat(F.lit('{"arguments":{"expression":"'), expression, F.lit('"},"protocol_version":"1.0.0","tool":"calculator.evaluate"}'))
        own = F.when(F.get_json_object(t["call"], "$.tool") == "calculator.evaluate", call)
        return F.struct(F.coalesce(own, t["call"]).alias("call"), t["result"].alias("result"))

    return F.transform(traces, of)


@query(f"""WITH t AS (SELECT DISTINCT example_id, {_TRACE.format("tool_traces[1]")} FROM examples WHERE len(tool_traces) > 0), v AS (SELECT *, {_LIVE} AS live FROM t)
    SELECT CASE WHEN live IS NULL THEN 'error' ELSE 'success' END AS status, coalesce(status = CASE WHEN live IS NULL THEN 'error' ELSE 'success' END AND recorded IS NOT DISTINCT FROM live::VARCHAR, false) AS same, count(*) AS n FROM v GROUP BY 1, 2""")
def tool_reexecution(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded results of first calls against live ones, per status and agreement."""
    first = F.try_element_at(_written_out("tool_traces"), F.lit(1))
    rows = table(spark, folder, "examples").filter(F.size("tool_traces") > 0).select("example_id", first["call"].alias("call"), first["result"].alias("result")).distinct()
    live = rows.withColumn("live", run_call(F.col("call"))).withColumn("recorded", canonical_json(F.col("result")))
    value = F.get_json_object("recorded", "$.result.value")
    same = (F.get_json_object("recorded", "$.status") == F.col("live.status")) & value.eqNullSafe(F.col("live.value"))
    return live.groupBy(F.col("live.status").alias("status"), F.coalesce(same, F.lit(False)).alias("same")).agg(F.count("*").alias("n"))


_STORAGE = {u: float(factor("data_storage", u)) for u in UNITS["data_storage"]}


@query(f"SELECT doc_id, unit, n_chars / per AS size FROM documents, (VALUES {', '.join(f'({u!r}, {f!r}::DOUBLE)' for u, f in _STORAGE.items())}) v(unit, per) WHERE n_chars IS NOT NULL")
def unit_convert(spark: SparkSession, folder: str) -> DataFrame:
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(f).alias("per")) for u, f in _STORAGE.items()])
    return table(spark, folder, "documents").filter("n_chars is not null").select("doc_id", "n_chars", F.inline(units)).select("doc_id", "unit", (F.col("n_chars") / F.col("per")).alias("size"))


# every operation of the calculator over the parts' numbers a and b; SQL has them in whole numbers: the value times 10 ** places
_CALLS = {
    "percentage_of": ('{"operation":"percentage_of","number":$b,"percent":$a}', "b * a", 2),
    "percentage_increase": ('{"operation":"percentage_increase","number":$b,"percent":$a}', "b * (100 + a)", 2),
    "percentage_decrease": ('{"operation":"percentage_decrease","number":$b,"percent":$a}', "b * (100 - a)", 2),
    "percentage_difference": ('{"operation":"percentage_difference","old_value":$a,"new_value":$b}', "sign(b - a) * ((2 * abs(b - a) * 100000000 + a) // (2 * a))", 6),
    "discount": ('{"operation":"discount","price":$b,"percent":$a}', "b * (100 - a)", 2),
    "sales_tax": ('{"operation":"sales_tax","price":$b,"tax_rate_percent":$a}', "b * a", 2),
    "final_price": ('{"operation":"final_price","price":$b,"discount_percent":$a,"tax_rate_percent":8}', "(b * (100 - a) * 108 + 50) // 100", 2),
    "tip": ('{"operation":"tip","bill_total":$b,"tip_percent":$a}', "b * a", 2),
    "split_bill": ('{"operation":"split_bill","bill_total":$b,"num_people":$a,"tip_percent":15}', "(2 * b * 115 + a) // (2 * a)", 2),
    "simple_interest": ('{"operation":"simple_interest","principal":$b,"annual_rate_percent":$a,"years":3}', "b * a * 3", 2),
    "compound_interest": ('{"operation":"compound_interest","principal":$b,"annual_rate_percent":$a,"years":2}', "(b * (100 + a) * (100 + a) + 50) // 100", 2),
    "whole_numbers": ('{"expression":"$a*$b+$b//7-$b%5+2**3"}', "a * b + b // 7 - b % 5 + 8", 0),
    "functions": ('{"expression":"sqrt($a*$a)+abs(-$b)+factorial(4)-reciprocal(0.5)"}', "a + b + 22", 0),
    "length": ('{"category":"length","from_unit":"foot","to_unit":"centimeter","value":$b}', "b * 3048", 2),
    "mass": ('{"category":"mass","from_unit":"kilogram","to_unit":"milligram","value":$b}', "b * 1000000", 0),
    "area": ('{"category":"area","from_unit":"hectare","to_unit":"square_meter","value":$b}', "b * 10000", 0),
    "volume": ('{"category":"volume","from_unit":"cubic_meter","to_unit":"liter","value":$b}', "b * 1000", 0),
    "speed": ('{"category":"speed","from_unit":"meters_per_second","to_unit":"kilometers_per_hour","value":$b}', "b * 36", 1),
    "time": ('{"category":"time","from_unit":"week","to_unit":"minute","value":$b}', "b * 10080", 0),
    "data_storage": ('{"category":"data_storage","from_unit":"kibibyte","to_unit":"byte","value":$b}', "b * 1024", 0),
    "temperature": ('{"category":"temperature","from_unit":"celsius","to_unit":"fahrenheit","value":$b}', "b * 18 + 320", 1),
}


@query("WITH p AS (SELECT p_partkey, p_size::BIGINT AS a, (p_partkey % 997 + 1)::BIGINT AS b FROM part) " + " UNION ALL ".join(
    f"SELECT p_partkey, '{name}' AS operation, 'success' AS status, round(({value}) / power(10, {places}), {places}) AS value FROM p" for name, (_, value, places) in _CALLS.items()))
def calculator_results(spark: SparkSession, folder: str) -> DataFrame:
    """Calls that succeed, for every operation, over all parts' numbers."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), (F.col("p_partkey") % 997 + 1).cast("string").alias("b"))
    tool = lambda arguments: "evaluate" if "expression" in arguments else "convert" if "from_unit" in arguments else "finance"
    calls = [F.struct(F.lit(name).alias("operation"), F.lit(f'{{"protocol_version":"1.0.0","tool":"calculator.{tool(x)}","arguments":{x}}}').alias("call"), F.lit(places).alias("places")) for name, (x, _, places) in _CALLS.items()]
    each = parts.select("p_partkey", "a", "b", F.inline(F.array(*calls)))
    ran = each.withColumn("r", run_call(F.replace(F.replace("call", F.lit("$a"), F.col("a")), F.lit("$b"), F.col("b"))))
    value = F.col("r.value").cast("double")
    rounded = F.when(F.col("places") == 0, F.round(value, 0)).when(F.col("places") == 1, F.round(value, 1)).when(F.col("places") == 2, F.round(value, 2)).otherwise(F.round(value, 6))
    return ran.select("p_partkey", "operation", F.col("r.status").alias("status"), rounded.alias("value"))


def _answered(df: DataFrame) -> DataFrame:
    """``df`` with a text as a model might have written it: right, wrong or without an answer by the prompt's length."""
    n = F.length(F.coalesce("prompt", F.lit(""))) % 3
    answer = F.coalesce(render.answer_text(F.col("answer_json")), F.lit("none"))
    return df.withColumn("generated", F.when(n == 0, F.concat(F.lit("so <final> "), answer)).when(n == 1, F.concat(F.lit("<final>1"), answer)).otherwise(F.concat(F.lit("hm <"), F.coalesce(render.behavior_tag(F.col("expected_behavior")), F.lit("error")), F.lit(">"))))


_ACCURACY = f"""WITH {_REC}, a AS (SELECT *, {_ANSWER_SQL} AS ans, {_TAG_SQL} AS tag, length(coalesce(prompt, '')) % 3 AS n FROM rec),
    c AS (SELECT category, CASE WHEN ans IS NOT NULL THEN n = 0 AND coalesce(tolerance, 0) >= 0 AND regexp_full_match(ans, '\\s*[-+]?[0-9]+(\\.[0-9]+)?(e[-+]?[0-9]+)?\\s*|\\s*[-+]?[0-9]+/0*[1-9][0-9]*\\s*') AND answer_json NOT IN ('true', 'false') OR n = 1 AND TRY_CAST(tolerance AS DOUBLE) >= abs(TRY_CAST('1' || ans AS DOUBLE) - TRY_CAST(ans AS DOUBLE)) ELSE coalesce(n = 2 AND tag IS NOT NULL, false) END AS ok FROM a)
    SELECT category, count(*) AS cases, count(*) FILTER (ok) AS correct, count(*) FILTER (ok) / count(*) AS accuracy FROM c GROUP BY ROLLUP (category)"""


@query(_ACCURACY)
def accuracy_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.accuracy(scoring.capability(_answered(records(spark, folder)), "generated"), "correct", "category")


@query(_ACCURACY.replace("SELECT category, count(*) AS cases", "SELECT split AS suite, category, count(*) AS cases").replace("c AS (SELECT category,", "c AS (SELECT split, category,").replace("FROM c GROUP BY ROLLUP (category)", "FROM c GROUP BY GROUPING SETS ((split, category), (split))"))
def capability_suite_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Every split as a suite, with texts generated elsewhere and joined by id."""
    cases = records(spark, folder)
    texts = _answered(cases).select("example_id", "generated")
    return scoring.capability_suites(cases.withColumnRenamed("split", "suite"), texts, "example_id", "suite", "category")


def _interacted(df: DataFrame) -> DataFrame:
    """``df``, its calls written out, with a turn as a model might have written it: calls whole, broken, with an answer or with an invented result, or none."""
    rows = df.withColumn("tool_traces", _written_out("tool_traces"))
    call, answer = F.try_element_at("tool_traces", F.lit(1))["call"], F.concat(F.lit("<final>"), render.answer_text(F.col("answer_json")))
    n = F.length(F.coalesce("prompt", F.lit(""))) % 5
    called = F.concat(F.lit("<tool_call>"), call)
    said = F.when(n == 0, called).when(n == 1, F.concat(called, F.lit("}"))).when(n == 2, F.concat(called, answer)).when(n == 4, F.concat(called, F.lit("<tool_result>{}"), answer))
    return rows.withColumn("generated", F.coalesce(said, answer, F.lit("<error>")))


_SAID = f"""said AS (SELECT *, coalesce(call, false) AND (n < 2 OR n IN (2, 4) AND ans IS NOT NULL) AS emitted, {_LIVE} IS NOT NULL AS live FROM (SELECT DISTINCT example_id, {_ANSWER_SQL} AS ans, {_TAG_SQL} AS tag, coalesce(tool_required, false) AS required, tool_name, tolerance,
    len(tool_traces) > 0 AS call, {_TRACE.format("tool_traces[1]")}, length(coalesce(prompt, '')) % 5 AS n FROM examples))"""
_NUMBER_SQL = r"'(^|[^\p{L}\p{N}_.])[$€£]?\s*([+-]?\p{Nd}+\s*/\s*\p{Nd}+|[+-]?(\p{Nd}+(,\p{Nd}{3})*(\.\p{Nd}+)?|\.\p{Nd}+)([eE][+-]?\p{Nd}+)?)($|[^\p{L}\p{N}_/])'"
_TURNS = f"""{_SAID}, did AS (SELECT *, emitted AND n != 1 AS parsed, emitted AND n != 1 AND tool IS NOT DISTINCT FROM tool_name AS named, CASE WHEN emitted THEN n != 1 AND live END AS success,
    CASE WHEN emitted AND n < 2 THEN NULL ELSE ans END AS final FROM said),
    turns AS (SELECT *, CASE WHEN ans IS NULL THEN NULL WHEN final IS NULL THEN false WHEN regexp_matches(ans, {_NUMBER_SQL}) THEN coalesce(tolerance, 0) >= 0 ELSE true END AS right_, CASE WHEN final IS NOT NULL THEN 'final' WHEN NOT emitted THEN 'error' END AS ending,
    CASE WHEN ans IS NOT NULL THEN 'final' ELSE tag END AS wanted FROM did)"""
_RATES = {
    "correct_routing": ("emitted = required", "true"), "emitted_tool_call": ("emitted", "true"), "call_parsed_valid": ("parsed", "true"), "required_call_emitted": ("emitted", "required"), "required_call_parsed": ("parsed", "required"),
    "tool_name_correct": ("named", "required"), "arguments_correct": ("named", "required"), "argument_execution_successful": ("named AND success", "required"),
    "end_to_end_success": ("named AND CASE WHEN ans IS NULL THEN status = CASE WHEN success THEN 'success' ELSE 'error' END AND ending = 'error' ELSE success AND right_ END", "required"), "final_answer_correct": ("right_", "right_ IS NOT NULL"), "direct_answer_correct": ("right_", "NOT required AND right_ IS NOT NULL"),
    "unnecessary_tool_call": ("emitted", "NOT required"), "missing_required_call": ("NOT emitted", "required"), "fabricated_result": ("emitted AND n = 4", "true"), "terminal_tag_correct": ("ending IS NOT DISTINCT FROM wanted", "wanted IS NOT NULL"),
}


def _rates_sql(rates: dict[str, tuple[str, str]]) -> str:
    row = lambda met, of: f"count(*) FILTER (coalesce({met}, false) AND {of}) AS numerator, count(*) FILTER ({of}) AS denominator, count(*) FILTER (coalesce({met}, false) AND {of}) / nullif(count(*) FILTER ({of}), 0) AS rate"
    return f"WITH {_TURNS} " + " UNION ALL ".join(f"SELECT '{name}' AS metric, {row(*x)} FROM turns" for name, x in rates.items())


@query(_rates_sql(_RATES))
def conditional_rates(spark: SparkSession, folder: str) -> DataFrame:
    wanted = scoring.interaction_rates()
    cases = scoring.interactions(_interacted(_distinct_examples(spark, folder)), "generated")
    return scoring.long_rates(scoring.rates(cases, wanted), list(wanted))


@query(_rates_sql({"emitted": ("emitted", "true"), "valid": ("parsed", "true"), "name_match": ("named", "true")}))
def tool_format_rates(spark: SparkSession, folder: str) -> DataFrame:
    cases = scoring.tool_format(_interacted(_distinct_examples(spark, folder)), "generated")
    wanted = {n: (F.col(n), F.lit(True)) for n in ("emitted", "valid", "name_match")}
    return scoring.long_rates(scoring.rates(cases, wanted), list(wanted))


@query(f"WITH {_TURNS} SELECT 'ended' AS stopped, emitted AS emitted_call, parsed AS any_valid_call, coalesce(success, false) AS any_success, emitted AND n = 4 AS fabricated, count(*) AS n FROM turns GROUP BY ALL")
def dialogue_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded calls and answers as two turns, replayed, per way of stopping."""
    final = F.concat(F.lit("<final>"), F.coalesce(render.answer_text(F.col("answer_json")), F.lit("")))
    cases = _interacted(_distinct_examples(spark, folder)).withColumn("trace", dialogue.replayed(F.array("generated", final)))
    return dialogue.trace_flags(cases, "trace").groupBy("trace.stopped", "emitted_call", "any_valid_call", "any_success", "trace.fabricated").agg(F.count("*").alias("n"))


# --- building --------------------------------------------------------------------------------------------------------



@query(f"""WITH c AS (SELECT DISTINCT ON (build_id, family_id) build_id, family_id, category, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTERS)} FROM
    (SELECT build_id, family_id, max({_category_sql("category")}) AS category, {", ".join(f"max({c}) AS {c}" for c in _COUNTERS)} FROM build_counters GROUP BY 1, 2))
    SELECT category, {", ".join(f"sum({c}) AS {c}" for c in _COUNTERS)}, count(*) FILTER (generated != {" + ".join(_COUNTERS[1:])}) AS unbalanced FROM c GROUP BY category""")
def reject_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Counters per category, rows received twice counting once, and how many don't add up."""
    once = table(spark, folder, "build_counters").groupBy("build_id", "family_id").agg(F.max(clean_category(F.col("category"))).alias("category"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in _COUNTERS])
    rejected = sum((F.col(c) for c in _COUNTERS[2:]), F.col(_COUNTERS[1]))
    return once.groupBy("category").agg(*[F.sum(c).alias(c) for c in _COUNTERS], F.count_if(F.col("generated") != rejected).alias("unbalanced"))


@query(f"""WITH {_REC}, want AS (SELECT {_category_sql("category")} AS category, sum(target_share * target_train_tokens) AS target_tokens FROM category_mixture JOIN pilot_subset_config USING (config_id) GROUP BY 1)
    SELECT category, target_tokens, coalesce(t, 0) AS tokens FROM want LEFT JOIN (SELECT category, sum(tokens) AS t FROM rec GROUP BY 1) USING (category) WHERE coalesce(t, 0) < 0.9 * target_tokens""")
def shortfall_report(spark: SparkSession, folder: str) -> DataFrame:
    want = table(spark, folder, "category_mixture").join(table(spark, folder, "pilot_subset_config"), "config_id").groupBy(clean_category(F.col("category")).alias("category")).agg(F.sum(F.col("target_share") * F.col("target_train_tokens")).alias("target_tokens"))
    return building.shortfalls(records(spark, folder), "category", F.col("tokens"), want)


_DECIDE = f"""WITH {_REC}, s AS (SELECT *, {_KEY_SQL} AS key, {_shape_sql("prompt")} AS shp, prompt IS NULL AS gone FROM rec),
    f AS (SELECT *, example_id != min(example_id) FILTER (NOT gone) OVER (PARTITION BY key) AS dup FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(gone, false) OR dup, family_id, shp ORDER BY example_id) AS k FROM f)
    SELECT example_id, CASE WHEN gone THEN 'schema_invalid' WHEN dup THEN 'exact_duplicate' WHEN k > 2 THEN 'near_duplicate' WHEN tokens > 64 THEN 'exceeds_context' ELSE 'accepted' END AS decision FROM r"""


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return building.build(rows, F.col("family_id"), _key(), F.col("prompt"), shape(F.col("prompt")), F.col("tokens"), ["example_id"], 2, 64)


@query(_DECIDE)
def build_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("example_id", "decision")


def _limited(rows: DataFrame, mixture: DataFrame, configs: DataFrame) -> DataFrame:
    """``rows`` with ``quota`` and ``family_tokens``: shares of all their tokens, so that both grow with the data.

    A category's share is its part of all configurations' target tokens, 0 where none wants it; what isn't a category
    has no quota (the schema rejects it).  A family may hold 0.15 of the tokens, as in the reference.
    """
    want = mixture.join(configs, "config_id").groupBy(clean_category(F.col("category")).alias("_category")).agg(F.sum(F.col("target_share") * F.col("target_train_tokens")).alias("_want"))
    whole = want.agg(F.sum("_want").alias("_whole")).crossJoin(rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens")))
    known = F.col("category").isin(CATEGORIES)
    met = rows.join(F.broadcast(want.filter(F.col("_category").isin(CATEGORIES))), F.col("category") == F.col("_category"), "left").crossJoin(F.broadcast(whole))
    quota = F.when(known, F.floor(F.coalesce(F.col("_want") / F.col("_whole"), F.lit(0.0)) * F.col("_tokens")))
    return met.withColumns({"quota": quota, "family_tokens": F.floor(F.col("_tokens") * 0.15)}).drop("_category", "_want", "_whole", "_tokens")


# the fold row by row: what was seen, met and accepted so far travels along, lists of the category begin anew with it
_CLEAN_PROMPT = _NORMAL.replace("(text)", "(prompt)").replace("nfc_normalize(text)", "nfc_normalize(prompt)")
_REJECT = f"""q AS (SELECT rec.*, x.verification, x.traces, x.required, CASE WHEN NOT regexp_matches(prompt, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN nullif({_CLEAN_PROMPT}, '') END AS clean
    FROM rec JOIN (SELECT example_id, any_value(verification) AS verification, any_value(tool_traces) AS traces, any_value(tool_required) AS required FROM examples GROUP BY 1) x USING (example_id)),
    t AS ({_TREES.format("* EXCLUDE (prompt), clean AS prompt", "q")}), u AS (SELECT *, {_MODE} AS m, coalesce(len(traces), 0) AS k, coalesce(required, false) AS tool FROM t),
    v AS (SELECT *, prompt IS NULL OR coalesce(example_id, '') = '' OR {_not_in("category", CATEGORIES)} OR {_not_in("split", ["train", "validation", "test"])} OR {" OR ".join(_ENUMS.values())} OR m = 'semantic' AND coalesce(answer_json, 'null') != 'null'
    OR tool AND k = 0 OR tool AND tool_name IS NULL OR NOT tool AND k > 0 OR coalesce(tolerance < 0, false) AS broken, CASE m WHEN 'deterministic' THEN {_VERDICT} WHEN 'tool' THEN CASE WHEN k > 0 THEN 'ok' ELSE 'mismatch' END WHEN 'semantic' THEN 'ok' ELSE 'mismatch' END AS truth FROM u)"""
_FOLD = f"""WITH RECURSIVE {_REC}, {_REJECT},
    want AS (SELECT {_category_sql("category")} AS category, sum(target_share * target_train_tokens) AS want FROM category_mixture JOIN pilot_subset_config USING (config_id) GROUP BY 1),
    o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY category NULLS FIRST, example_id) AS pos, category, coalesce(family_id, chr(1)) AS fa, coalesce(template_id, chr(1)) AS te, hash({_KEY_SQL}) AS ke, hash(coalesce(family_id, chr(1)), coalesce({_shape_sql("prompt")}, chr(1))) AS sh, tokens,
    CASE WHEN broken THEN 'schema_invalid' WHEN truth != 'ok' THEN 'ground_truth_mismatch' END AS reject, floor((SELECT sum(tokens) FROM rec) * 0.15::DOUBLE) AS most,
    CASE WHEN category IN ({", ".join(repr(c) for c in CATEGORIES)}) THEN floor(coalesce((SELECT want FROM want w WHERE w.category = v.category) / (SELECT sum(want) FROM want), 0) * (SELECT sum(tokens) FROM rec)) END AS quota FROM v),
    f AS (SELECT 0::BIGINT AS pos, NULL::VARCHAR AS category, 0::HUGEINT AS total, []::UBIGINT[] AS seen, []::STRUCT(f VARCHAR, t VARCHAR, n BIGINT)[] AS fam, []::UBIGINT[] AS met, ''::VARCHAR AS d
    UNION ALL SELECT pos, category, total + CASE WHEN d = 'accepted' THEN tokens ELSE 0 END, CASE WHEN d IN ('near_duplicate', 'exceeds_context', 'family_cap', 'accepted') THEN list_append(seen, ke) ELSE seen END,
    CASE WHEN d = 'accepted' THEN list_append(fam, {{'f': fa, 't': te, 'n': tokens}}) ELSE fam END, CASE WHEN d IN ('exceeds_context', 'family_cap', 'accepted') THEN list_append(met, sh) ELSE met END, d
    FROM (SELECT *, CASE WHEN total >= coalesce(quota, 1e30) THEN 'beyond_quota' WHEN reject IS NOT NULL THEN reject WHEN len(own) >= 30 AND (len(list_filter(own, lambda x: x.t = te)) + 1) / (len(own) + 1) > 0.6::DOUBLE THEN 'diversity_cap' WHEN list_contains(seen, ke) THEN 'exact_duplicate'
    WHEN len(list_filter(met, lambda x: x = sh)) >= 5 THEN 'near_duplicate' WHEN tokens > 1024 THEN 'exceeds_context' WHEN coalesce(list_sum(list_transform(own, lambda x: x.n)), 0) + tokens > most THEN 'family_cap' ELSE 'accepted' END AS d
    FROM (SELECT *, list_filter(fam, lambda x: x.f = fa) AS own FROM (SELECT o.*, f.seen, CASE WHEN same THEN f.total ELSE 0 END AS total, CASE WHEN same THEN f.fam ELSE [] END AS fam, CASE WHEN same THEN f.met ELSE [] END AS met
    FROM (SELECT *, f.category AS before FROM f) f JOIN o ON o.pos = f.pos + 1, LATERAL (SELECT o.category IS NOT DISTINCT FROM f.before AS same)))))
    SELECT category, count(*) FILTER (d != 'beyond_quota') AS generated, {", ".join(f"count(*) FILTER (d = '{r}') AS {r if r == 'accepted' else 'rejected_' + r}" if r != "diversity_cap" else "count(*) FILTER (d IN ('diversity_cap', 'family_cap')) AS rejected_diversity_cap" for r in building.REASONS)},
    count(*) FILTER (d = 'beyond_quota') AS beyond_quota FROM f WHERE pos > 0 GROUP BY category"""


@query(_FOLD)
def build_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The build from the clean prompt to its limits on shares, as a funnel per category."""
    rows = building.examined(records(spark, folder, "difficulty", "tool_required", "tool_name", "tool_traces", "verification"))
    limited = _limited(rows, table(spark, folder, "category_mixture"), table(spark, folder, "pilot_subset_config"))
    thin = limited.select("category", "example_id", "family_id", "template_id", _key().alias("key"), shape(F.col("prompt")).alias("shape"), "tokens", "reject", "quota", "family_tokens")
    columns = {"family": "family_id", "template": "template_id", "exact_key": "key", "shape": "shape", "tokens": "tokens", "reject": "reject"}
    return building.funnel(building.accept(thin, "category", "example_id", columns, 0.6, F.col("family_tokens"), F.col("quota"), 5, 1024), "decision", ["category"], beyond=True)


@query(f"SELECT coalesce(d, l) AS package, CASE WHEN l IS NULL THEN 'missing' WHEN d IS NULL THEN 'stale' WHEN ds IS DISTINCT FROM ls THEN 'wrong_scope' ELSE 'ok' END AS outcome FROM (SELECT DISTINCT lower(regexp_replace({_strip_sql('source')}, '[-_.]+', '-', 'g')) AS d, 'text' AS ds FROM documents) FULL JOIN (SELECT DISTINCT lower(regexp_replace({_strip_sql('source')}, '[-_.]+', '-', 'g')) AS l, CASE WHEN mix_id = 'mix_base' THEN 'text' ELSE 'other' END AS ls FROM source_mix) ON d = l")
def manifest_crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    declared = table(spark, folder, "documents").select(clean_name(F.col("source")).alias("name"), F.lit("text").alias("scope")).distinct()
    licensed = table(spark, folder, "source_mix").select(clean_name(F.col("source")).alias("name"), F.when(F.col("mix_id") == "mix_base", "text").otherwise("other").alias("scope"))
    return manifests.cross_check(declared, "name", "scope", licensed, "name", "scope")


@query("WITH b AS (SELECT max(generated) AS n FROM build_counters GROUP BY build_id, family_id), w AS (SELECT ceil(coalesce(sum(n), 0) / %d)::BIGINT AS n FROM b) SELECT v.*, 'ok' AS truth, 0 AS broken_rules, w.n FROM (VALUES %s) v(category, family_id), w" % (
    len(generate.FAMILIES), ", ".join(f"('{f.category}', '{f.name}')" for f in generate.FAMILIES)))
def generated_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """As many records as ``build_counters`` has generated ones, rows received twice counting once, in equal parts per family."""
    once = table(spark, folder, "build_counters").groupBy("build_id", "family_id").agg(F.max("generated").alias("n"))
    wanted = once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = building.ground_truth(generate.corpus(spark, -(-wanted // len(generate.FAMILIES)), SEED))
    return violations(rows, example_rules()).groupBy("category", "family_id", "truth", F.size("violations").alias("broken_rules")).agg(F.count("*").alias("n"))


def _part_sql(family: str, what: str, index: str) -> str:
    return _SEED_SQL.format(f"concat_ws(chr(31), '{SEED}', {family}, '{what}', ({index})::VARCHAR)")


_OPERATIONS = {"sums": "a + b", "products": "a * b", "differences": "a - b"}
_REMADE = {f.name: f for f in generate.families_of("arithmetic")}


@query("WITH n AS (SELECT count(*) AS n FROM build_counters), i AS (SELECT unnest(range(n)) AS i FROM n), " + ", ".join(
    f"""f_{name} AS (SELECT '{name}' AS family_id, i AS index, {f.ranges[0][0]} + {_part_sql(f"'{name}'", 'a', 'i')} % {f.ranges[0][1] - f.ranges[0][0] + 1} AS a, {f.ranges[1][0]} + {_part_sql(f"'{name}'", 'b', 'i')} % {f.ranges[1][1] - f.ranges[1][0] + 1} AS b,
    [{", ".join(repr(p) for p in f.prompts)}][{_part_sql(f"'{name}'", 'template', 'i')} % {len(f.prompts)} + 1] AS p FROM i)""" for name, f in _REMADE.items())
    + " " + " UNION ALL ".join(f"SELECT family_id, index, replace(replace(p, '{{a}}', a::VARCHAR), '{{b}}', b::VARCHAR) AS prompt, '\"' || ({_OPERATIONS[name]})::VARCHAR || '\"' AS answer_json FROM f_{name}" for name in _REMADE))
def generated_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Generated sums, products and differences, as many of each as there are build counters; SQL makes them again."""
    n = table(spark, folder, "build_counters").count()
    parts = [generate.generated(spark, f, 0, n, SEED, indexed=True).select("family_id", "index", "prompt", "answer_json") for f in _REMADE.values()]
    return reduce(DataFrame.unionByName, parts)


@query("WITH t AS (SELECT count(*) AS t FROM documents), " + ", ".join(
    f"""k_{kind} AS (SELECT '{kind}' AS kind, i AS line_index, [{", ".join("'" + p.replace("'", "''") + "'" for p in of)}][{_part_sql(f"'{kind}'", 'pattern', 'i')} % {len(of)} + 1] AS p,
    {", ".join(f"{_part_sql(f"'{kind}'", v, 'i')} % {most} + 1 AS {v}" for v, most in (("a", 9999), ("b", 999), ("c", 99)))} FROM (SELECT unnest(range(round_even(t * {generate.LINE_SHARES[kind]}::DOUBLE, 0)::BIGINT)) AS i FROM t))""" for kind, of in generate.LINES.items())
    + " " + " UNION ALL ".join(f"SELECT kind, line_index, replace(replace(replace(p, '{{a}}', a::VARCHAR), '{{b}}', b::VARCHAR), '{{c}}', c::VARCHAR) AS line FROM k_{kind}" for kind in generate.LINES))
def tokenizer_corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A tokenizer's corpus with as many lines as there are documents, in the kinds' shares; SQL makes it again."""
    return generate.corpus_lines(spark, generate.line_counts(table(spark, folder, "documents").count()), SEED)


# --- the flagship ----------------------------------------------------------------------------------------------------


@query(f"""{_DECIDE.replace("SELECT example_id, CASE", "SELECT *, CASE").replace("AS decision FROM r", "AS decision FROM r").replace("WITH ", "WITH d AS (WITH ", 1)}),
    e AS (SELECT DISTINCT {_shape_sql("prompt")} AS shp FROM phase0_v1 WHERE prompt IS NOT NULL),
    k AS (SELECT *, CASE WHEN {_STEP} < 90000 THEN 'train' WHEN {_STEP} < 95000 THEN 'validation' ELSE 'test' END AS new_split FROM d WHERE decision = 'accepted' AND shp NOT IN (SELECT shp FROM e))
    SELECT new_split, count(*) AS examples, sum(tokens) AS tokens, count(DISTINCT shp) AS shapes FROM k GROUP BY new_split""")
def corpus_flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Deduplicate, take out what shares its shape with an evaluation case, split by hash, and report each split."""
    kept = _decided(spark, folder).filter("decision = 'accepted'").withColumn("shp", shape(F.col("prompt")))
    held = table(spark, folder, "phase0_v1").filter("prompt is not null").select(shape(F.col("prompt")).alias("_eval")).distinct()
    clean = kept.join(held, F.col("shp") == F.col("_eval"), "left_anti")
    placed = clean.withColumn("new_split", hash_split(F.col("generator_id"), F.col("family_id"), F.col("derivation_id"), SEED, 0.9, 0.05))
    return placed.groupBy("new_split").agg(F.count("*").alias("examples"), F.sum("tokens").alias("tokens"), F.countDistinct("shp").alias("shapes"))
