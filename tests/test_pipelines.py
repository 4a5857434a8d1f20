"""Corpora from end to end, recorded subsets and the command line."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusforge import pipelines
from corpusforge.__main__ import main
from corpusforge.functions import tokenizer
from corpusforge.operators import build, generate, manifests, packing, sampling, selection
from corpusforge.plans.digests import ordered_digest
from corpusforge.plans.ranks import ranked
from corpusforge.schema import CASE_SCHEMA, case_rules, example_rules, violations
from corpusforge.sources import shards


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("built"))
    return folder, pipelines.generate_dataset(spark, folder, "corpus", 30, 5, rows_per_shard=200)


def test_build_writes_what_it_tells(spark, built):
    folder, made = built
    rows = shards.read_shards(spark, folder)
    assert rows.count() == made["funnel"]["accepted"] == made["stats"]["total_examples"] and made["funnel"]["generated"] == 30 * len(generate.FAMILIES)
    assert made["funnel"]["generated"] == sum(n for k, n in made["funnel"].items() if k not in ("generated", "beyond_quota"))
    manifest, identity = shards.verify_parent(spark, folder, f"{folder}/manifest.json")
    assert identity == made["identity"] and manifest.agg(F.max("rows")).first()[0] == 200
    assert len(made["stats"]) == 20 and json.load(open(f"{folder}/stats.json")) == json.loads(json.dumps(made["stats"]))
    held = shards.read_suite(spark, f"{folder}/suite.json", CASE_SCHEMA)
    assert rows.join(held, "prompt", "left_semi").count() == 0


def test_audits_of_a_built_corpus(spark, built):
    rows = shards.read_shards(spark, built[0])
    assert pipelines.validate_dataset(rows)[1:] == (0, [])
    assert {r["outcome"] for r in pipelines.verify_dataset(rows).collect()} == {"ok"}
    suite = shards.read_suite(spark, f"{built[0]}/suite.json", CASE_SCHEMA)
    found = {r["check"]: r["clean"] for r in pipelines.check_contamination(rows, suite).collect()}
    assert found["split_isolation"] and found["near_pairs"] and found["shape_pairs"]
    first = rows.filter("split = 'train'").orderBy("example_id").select(F.lit("c").alias("id"), "prompt")
    dirty = {r["check"]: r["violations"] for r in pipelines.check_contamination(rows, first.limit(1)).collect()}
    assert dirty["near_pairs"] >= 1 and dirty["shape_pairs"] == 1


def test_verify_tells_a_changed_result(spark, built):
    rows = shards.read_shards(spark, built[0]).filter("category = 'tool_use'").limit(3)
    broken = rows.withColumn("tool_traces", F.transform("tool_traces", lambda t: F.struct(t["call"].alias("call"), F.replace(t["result"], F.lit('"exact":true'), F.lit('"exact":false')).alias("result"))))
    told = {(r["check"], r["outcome"]): r["n"] for r in pipelines.verify_dataset(broken).collect()}
    assert told.get(("tool_results", "mismatch"), 0) >= 1 and told[("ground_truth", "ok")] == 3


def test_reserved_keys_and_shapes_come_first(spark):
    rows = [(k, "c", "f", "t", f"k{k % 5}", f"s{k % 2}", 1, None) for k in range(10)]
    df = spark.createDataFrame(rows, "n int, c string, f string, t string, k string, s string, tok int, reject string")
    reserved = spark.createDataFrame([("k0", "f", "s1")], "exact_key string, family string, shape string")
    columns = {"family": "f", "template": "t", "exact_key": "k", "shape": "s", "tokens": "tok", "reject": "reject", "reserved": "reserved", "seeded": "seeded"}
    found = {r["n"]: r["decision"] for r in build.accept(build.seeded(df, "f", "k", "s", reserved), "c", "n", columns, 2.0, 10**9, 10**9, 2, 64).collect()}
    assert [found[k] for k in range(10)] == ["exact_duplicate", "accepted", "accepted", "near_duplicate", "accepted", *["exact_duplicate"] * 5]


def population(spark):
    rows = [(f"ex{c}{i:05d}", s, c, 8, f"What is {i} + 1?", f'"{i + 1}"', "answer", i % 7 == 0, "easy", f"f{i % 3}") for s, of in (("train", {"arithmetic": 200, "word_problem": 100, "tool_error": 5}), ("validation", {"arithmetic": 40, "word_problem": 20, "tool_error": 3})) for c, n in of.items() for i in range(n)]
    rows = [(i + s[0], s, *r) for i, s, *r in rows]
    return spark.createDataFrame(rows, "example_id string, split string, category string, token_count int, prompt string, answer_json string, expected_behavior string, tool_required boolean, difficulty string, family_id string")


def test_pilot_subset(spark, tmp_path):
    config = {"target_train_tokens": 800, "validation_examples": 10, "min_category_examples": 4, "min_category_examples_validation": 2, "max_sequence_length": 64, "pack_sequences": True}
    made, manifest = selection.pilot_subset(population(spark), "example_id", "split", "category", "token_count", config, 3, str(tmp_path), parent_dataset_identity="p", tokenizer_identity="t")
    counts = {r["category"]: r["count"] for r in made["train"].rows.groupBy("category").count().collect()}
    assert counts == {"arithmetic": 66, "word_problem": 33, "tool_error": 4} == made["train"].audit["category_selected_counts"]
    assert made["train"].audit["category_strides"]["arithmetic"] == {"stride": 3, "offset": 0}
    ids = sorted(r[0] for r in made["train"].rows.select("example_id").collect())
    assert manifest["splits"]["train"]["example_ids_sha256"] == hashlib.sha256("\n".join(ids).encode()).hexdigest()
    assert json.load(open(tmp_path / "pilot_manifest.json")) == manifest and json.load(open(tmp_path / "pilot_selection_audit.json"))["validation"]["min_category_examples"] == 2


def test_smoke_and_full(spark):
    df = population(spark)
    made, manifest = selection.smoke_subset(df, "example_id", "split", {"train": 30, "validation": 9}, 5)
    assert made["train"].rows.count() == 30 and manifest["splits"]["train"]["stride"] == 10 and manifest["splits"]["train"]["offset"] == 5
    with pytest.raises(ValueError):
        selection.smoke_subset(df, "example_id", "split", {"train": 3000}, 5)
    assert selection.full_set(df, "example_id", "split", "token_count")[1]["splits"]["validation"]["example_count"] == 63


def test_tuning_subset(spark):
    df = population(spark)
    represent = lambda x: x.withColumn("input_ids", F.transform(F.filter(F.split("prompt", ""), lambda c: c != ""), lambda c: F.ascii(c))).withColumn("labels", F.col("input_ids"))
    options = dict(represent=represent, curricula={"train": {"more": df.filter("split = 'train'").limit(4).withColumn("example_id", F.concat(F.lit("m"), "example_id"))}}, replay={"train": df.filter("category = 'tool_error' and split = 'train'")}, variants=1, frames=["Do: %s"])
    made, manifest = selection.tuning_subset(df, "example_id", "split", "category", {"train": 10, "validation": 2}, {"tool_error": 0.3}, F.lit(True), 64, 1, **options)
    train = manifest["splits"]["train"]
    assert made["train"].audit["category_targets"] == {"arithmetic": 10, "word_problem": 10, "tool_error": 3} and train["replay_example_count"] == 5
    assert train["example_count"] == made["train"].audit["total_examples_after_instruction_augmentation"] == 23 + 4 + made["train"].rows.filter("prompt like 'Do: %'").count()
    rows = made["train"].rows.orderBy("example_id").collect()
    listed = json.dumps([{"example_id": r["example_id"], "input_ids": list(r["input_ids"]), "labels": list(r["labels"])} for r in rows], separators=(",", ":"))
    assert train["representation_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert manifest["splits"]["validation"]["replay_representation_sha256"] == hashlib.sha256(b"[]").hexdigest()
    lines = "\n".join(f"{s}:{of['parent_example_ids_sha256']}:{of['replay_example_ids_sha256']}" for s, of in sorted(manifest["splits"].items()))
    assert manifest["sft_identity"] == hashlib.sha256(lines.encode()).hexdigest() and len(manifest["sft_representation_identity"]) == 64
    with pytest.raises(ValueError, match="fall short"):
        selection.tuning_subset(df, "example_id", "split", "category", {"train": 10, "validation": 2}, {}, F.col("prompt") < "What is 2", 64, 1, represent)


def test_rejected_while_selecting(spark):
    """Of a reserve of 16 every third record is too long: ten kept ones pass over five."""
    df = spark.createDataFrame([(f"i{k:03d}", "c", k % 3 == 0) for k in range(16)], "id string, c string, long boolean")
    targets = spark.createDataFrame([("c", 16, 9)], "c string, available bigint, target bigint")
    assert sampling.gated_sample(df, "id", "c", targets, ~F.col("long"), 0).count() == 9
    assert sampling.passed_over(df, "id", "c", targets, ~F.col("long"), 0).first()["n"] == 5


def test_digests_of_groups(spark):
    rows = [("a", f"id{k:04d}") for k in range(700)] + [("b", "x"), (None, "y"), ("b", None), ("b", "é")]
    df = spark.createDataFrame(rows, "g string, id string").repartition(6)
    found = {r["g"]: (r["digest"], r["n"]) for r in ordered_digest(df, ["g"], F.col("id"), F.col("id")).collect()}
    want = {g: sorted(i for h, i in rows if h == g and i) for g in ("a", "b", None)}
    assert found == {g: (hashlib.sha256("\n".join(of).encode()).hexdigest(), len(of)) for g, of in want.items()}
    assert ordered_digest(df.limit(0), [], F.col("id"), F.col("id")).first()["digest"] == hashlib.sha256(b"").hexdigest()
    assert ordered_digest(df.limit(0), ["g"], F.col("id"), F.col("id")).count() == 0


def test_ranks_of_prefixed_ids(spark):
    """Ids that all begin alike, one of them a prefix of others, nulls and an empty text."""
    ids = [f"doc_{k:06d}" for k in range(0, 3000, 7)] + ["doc_0", "doc_00", "doc_0000001", "doc_z"]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    assert {r["id"]: r["n"] for r in ranked(df, [], "id", [], "n").collect()} == {i: k for k, i in enumerate(sorted(ids))}
    for more in ([None, "", "a"], ["same"], ["same", "same"], [None]):
        found = [r["n"] for r in ranked(spark.createDataFrame([(i,) for i in more], "id string"), [], "id", [], "n").orderBy(F.col("id").asc_nulls_first(), "n").collect()]
        assert found == list(range(len(more)))


def test_one_text_is_a_third_of_the_rows(spark):
    """Decisions of a table where one exact key and one shape hold a third of the rows each."""
    rows = [(f"e{k:05d}", "f", "hot" if k % 3 == 0 else f"k{k}", "shape" if k % 3 < 2 else f"s{k}") for k in range(900)]
    df = spark.createDataFrame(rows, "id string, f string, k string, s string")
    found = build.build(df, F.col("f"), F.col("k"), F.col("s"), F.col("s"), F.lit(1), ["id"], 3, 10)
    counts = {r["decision"]: r["count"] for r in found.groupBy("decision").count().collect()}
    assert counts == {"exact_duplicate": 299, "near_duplicate": 301 - 3, "accepted": 300 + 3} and found.columns == [*df.columns, "decision"]


def test_suites(spark, tmp_path):
    cases = generate.held_out_suite(spark, 3, 9, 1000)
    n = shards.write_suite(cases, f"{tmp_path}/a.json")
    union, missing = None, None
    with pytest.warns(UserWarning, match="missing"):
        union, missing = shards.union_of_suites(spark, {"a": f"{tmp_path}/a.json", "b": f"{tmp_path}/b.json"})
    assert union.count() == n == len(generate.HELD_OUT) * 3 and missing == ["b"]
    assert shards.checked_suite(union).count() == n and violations(union, case_rules()).filter("size(violations) > 0").count() == 0
    assert {r["verdict"] for r in pipelines.verify_suite(cases.filter("verification.mode != 'tool'"), frozen=False).collect()} == {"ok"}
    for wrong in (union.unionByName(union.limit(1)), union.withColumn("prompt", F.lit(" "))):
        with pytest.raises(ValueError):
            shards.checked_suite(wrong)
    with pytest.raises(FileNotFoundError):
        shards.union_of_suites(spark, {})


@pytest.mark.parametrize("kind", ["direct", "safety", "tools", "calls"])
def test_curricula_hold(spark, kind):
    rows = generate.curriculum(spark, kind, "train", 5, 3)
    n = {"direct": 12, "safety": 4, "tools": 3, "calls": 3}[kind]
    assert rows.count() == rows.select("example_id").distinct().count() == 5 * n and rows.groupBy("category").count().filter("count != 5").count() == 0
    assert violations(build.ground_truth(rows), example_rules()).filter("truth != 'ok' or size(violations) > 0").count() == 0
    assert rows.join(generate.corpus(spark, 5, 3), "example_id", "left_semi").count() == 0


def test_registry_of_families():
    assert generate.missing_categories() == [] and [f.name for f in generate.families_of("estimation")] == ["rough_sum", "rough_root"]
    assert "arithmetic" in generate.missing_categories([])
    with pytest.raises(KeyError):
        generate.families_of("poetry")
    assert sum(generate.LINE_SHARES.values()) == pytest.approx(1) and generate.line_counts(50)["errors"] == 2 and set(generate.LINES) == set(generate.LINE_SHARES)


def test_lines_depend_on_their_index_only(spark):
    few, more = (generate.corpus_lines(spark, {"arithmetic": n, "errors": 2}, 3) for n in (5, 9))
    assert few.exceptAll(more).count() == 0 and more.count() == 11 and more.filter("line rlike '[{][abc][}]'").count() == 0
    assert generate.held_out_lines(spark, 5).count() == 60


def test_vocabulary_checks(spark):
    file = tokenizer.path("piece_bpe_32k.model")
    texts = spark.createDataFrame([("two words",), (None,), ("  spaces   kept  ",), ("é 12",)], "t string")
    found = {r["check"]: (r["tested"], r["failed"]) for r in tokenizer.validation(spark, file, 32000, texts, "t", generate.numeric_strings(spark, 50, 1)).collect()}
    assert len(found) == 11 and found["vocab_size"] == (1, 0) and found["id_range"] == (3, 0) and found["digit_atomicity"] == (90, 0) and found["long_input"] == (1, 0)
    wrong = {r["check"]: r["failed"] for r in tokenizer.validation(spark, file, 31999, texts, "t", generate.numeric_strings(spark, 5, 1), {"<s>": 99}).collect()}
    assert wrong["vocab_size"] == wrong["special_token_ids"] == 1
    pieces = texts.select(tokenizer.pieces(F.col("t"), file).alias("p"), tokenizer.encoded(F.col("t"), file).alias("i")).first()
    assert [tokenizer.piece_of(file, k) for k in pieces["i"]] == list(pieces["p"]) and tokenizer.piece_of(file, 10**9) is None
    assert tokenizer.ids_of(file, ["</s>", "no such piece"])["no such piece"] is None


def test_dependencies_and_artifacts(spark):
    toml = '[project]\ndependencies = ["PySpark>=4", "py_arrow[x] ; python_version>\'3\'"]\n[project.optional-dependencies]\ntest = ["pytest"]\n'
    assert manifests.declared_dependencies(toml) == {"runtime": ["py-arrow", "pyspark"], "dev": ["pytest"]} and manifests.declared_dependencies("") == {"runtime": [], "dev": []}
    manifest = spark.createDataFrame([("a", "AA"), ("b", "bb"), ("c", "cc")], "file string, sha256 string")
    found = spark.createDataFrame([("a", "aa"), ("b", "xx"), ("d", "dd")], "file string, sha256 string")
    assert {r["file"]: r["outcome"] for r in manifests.artifact_outcomes(manifest, found).collect()} == {"a": "ok", "b": "hash", "c": "missing"}


def test_micro_batches_of_prefixed_ids(spark):
    df = spark.createDataFrame([(f"doc_{k:04d}",) for k in range(100)], "id string")
    assert packing.micro_batches(df, "id", 32).groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 4


def test_command_line(spark, built, tmp_path, capsys):
    folder = built[0]
    run = lambda *a: (main([str(x) for x in a]), capsys.readouterr().out)
    assert run("dataset-validate", folder)[0] == 0 and run("dataset-verify", folder)[0] == 0 and '"total_examples"' in run("dataset-stats", folder)[1]
    assert run("dataset-eval-suites-build", tmp_path / "s", "--per-family", 2)[0] == 0
    suites = [tmp_path / "s" / f"held_out_{x}.json" for x in "ab"]
    assert run("evals-validate", *suites)[0] == 0 and run("dataset-contamination-check", folder, *suites)[1].count("True") >= 3
    assert run("evals-verify", suites[0])[0] == 1  # tool cases have no answer that a tree gives
    assert run("tools-schemas", tmp_path / "schemas")[0] == 0 and run("tools-validate", tmp_path / "schemas")[0] == 0
    (tmp_path / "schemas" / "call.schema.json").write_text("{}")
    assert "drifted" in run("tools-validate", tmp_path / "schemas")[1]
    calls = [{"id": "a", "call": {"protocol_version": "1.0.0", "tool": "calculator.evaluate", "arguments": {"expression": "2+2"}}, "expected_status": "success", "expected_result": {"value": "4"}}, {"id": "b", "steps": [{"call_text": "x", "expected_error_code": "MALFORMED_CALL"}]}]
    (tmp_path / "calls.json").write_text(json.dumps({"cases": calls}))
    assert run("tools-self-test", tmp_path / "calls.json") == (0, "2 cases, 0 failures\n")
    calls[0]["expected_result"]["value"] = "5"
    (tmp_path / "calls.json").write_text(json.dumps({"cases": calls}))
    assert run("tools-self-test", tmp_path / "calls.json")[0] == 1
    (tmp_path / "t.jsonl").write_text('{"id":"a","kind":"x"}\n{"id":"a","kind":""}\n')
    code, out = run("manifests-validate", tmp_path / "t.jsonl", "id", "--required", "kind", "--allowed", "kind=y,z")
    assert code == 1 and "missing_kind" in out and "unknown_kind" in out and "repeated" in out
    (tmp_path / "p.toml").write_text('[project]\ndependencies = ["pyspark"]\n')
    (tmp_path / "l.jsonl").write_text('{"name":"PySpark","scope":"runtime"}\n')
    assert run("deps-check", tmp_path / "p.toml", tmp_path / "l.jsonl") == (0, "pyspark\tok\n")
    file = tokenizer.path("piece_bpe_32k.model")
    ids = run("tokenizer-encode", file, "two words")[1].split()
    assert run("tokenizer-decode", file, *ids)[1].strip() == "two words" and run("tokenizer-encode", file, "two", "--pieces")[1]
    assert "<pad>" in run("tokenizer-inspect", file)[1] and run("tokenizer-benchmark", file)[1].count("\n") == 12
    assert run("tokenizer-validate", file, 32000, "--strings", 20)[1].count("\n") == 11
    assert run("tokenizer-corpus", tmp_path / "lines", "--lines", 50)[0] == 0 and "file" not in run("tokenizer-hashes", tmp_path / "s")[1]
    assert run("dataset-generate", tmp_path / "g", "--per-family", 1)[1].strip() == str(len(generate.FAMILIES))
    assert "corpus_flagship" in run("list")[1] and run("tools")[1].startswith("calculator.evaluate") and run("hash", tmp_path / "p.toml", "--expect", "0")[0] == 1
    assert run("call", "{}")[0] == 1 and run("run", "case_prefix", "/root/testdata/sf0.001", "--rows", "1")[0] == 0
