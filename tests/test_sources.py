import json

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import tokenizer
from corpusforge.functions.ids import derive_id
from corpusforge.operators import generate, manifests
from corpusforge.operators.build import ground_truth
from corpusforge.schema import CASE_SCHEMA, CATEGORIES, example_rules, violations
from corpusforge.sources import shards
from corpusforge.streaming import records as streams


@pytest.fixture(scope="module")
def corpus(spark):
    return generate.corpus(spark, 30, 7, generate.FAMILIES[:6])


def test_generated_records_hold(spark):
    rows = generate.corpus(spark, 20, 7)
    assert violations(ground_truth(rows), example_rules()).filter("truth != 'ok' or size(violations) > 0").count() == 0
    assert {r["category"] for r in rows.select("category").distinct().collect()} == set(CATEGORIES)
    failed = rows.filter("category in ('tool_error', 'incorrect_tool_call')")
    assert failed.filter("answer_json is null and size(tool_traces) = 1").count() == failed.count() == 40
    again = generate.generated(spark, generate.FAMILIES[0], 5, 10, 7)
    assert again.exceptAll(generate.generated(spark, generate.FAMILIES[0], 0, 20, 7)).count() == 0


def test_shards_round_trip(spark, corpus, tmp_path):
    manifest = shards.write_shards(corpus, str(tmp_path / "s"), "set", "split", "example_id", 50)
    rows = manifest.collect()
    told = spark.createDataFrame(rows, manifest.schema)
    counts = {r["split"]: r["count"] for r in corpus.groupBy("split").count().collect()}
    for split, n in counts.items():
        own = sorted((r for r in rows if r["split"] == split), key=lambda r: r["shard_index"])
        assert [r["rows"] for r in own] == [50] * (n // 50) + ([n % 50] if n % 50 else [])
    back = shards.read_shards(spark, str(tmp_path / "s"))
    assert back.count() == corpus.count() and back.drop("verification").exceptAll(corpus.drop("verification")).count() == 0
    lines = [json.loads(x) for r in rows if r["split"] == "train" for x in open(tmp_path / "s" / r["file"])]
    assert [x["example_id"] for x in lines] == sorted(x["example_id"] for x in lines)
    assert shards.read_manifested(spark, str(tmp_path / "s"), told, "train").count() == counts["train"]
    assert manifests.verify_files(told, manifests.files(spark, str(tmp_path / "s"), "*.jsonl")).filter("outcome != 'ok'").count() == 0
    identity = shards.write_manifest(told, str(tmp_path / "manifest.json"))
    assert identity == json.loads((tmp_path / "manifest.json").read_text())["identity"] == manifests.identity(told)
    first = rows[0]["file"]
    (tmp_path / "s" / f".{first}.crc").unlink(missing_ok=True)  # who changes a file can change its local checksum too
    (tmp_path / "s" / first).write_bytes((tmp_path / "s" / first).read_bytes()[:-2] + b" \n")
    (tmp_path / "s" / "extra.jsonl").write_text("{}\n")
    outcomes = {r["file"]: r["outcome"] for r in manifests.verify_files(told.union(told.filter(F.col("file") == rows[1]["file"])), manifests.files(spark, str(tmp_path / "s"), "*.jsonl")).collect()}
    assert outcomes[first] == "hash" and outcomes["extra.jsonl"] == "unmanifested" and outcomes[rows[1]["file"]] == "repeated"
    with pytest.raises(ValueError):
        shards.read_manifested(spark, str(tmp_path / "s"), told, "train")


def test_missing_shards_are_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        shards.read_shards(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception):  # noqa: B017
        manifests.files(spark, str(tmp_path / "empty"))


def test_broken_lines_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"example_id": "x"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        shards.read_shards(spark, str(tmp_path)).collect()


def test_suite_and_lines(spark, tmp_path):
    (tmp_path / "suite.json").write_text(json.dumps({"suite_id": "s", "cases": [{"id": "a", "category": "arithmetic", "prompt": "1+1?", "verification": {"mode": "deterministic", "expression": "1"}}]}))
    assert shards.read_suite(spark, str(tmp_path / "suite.json"), CASE_SCHEMA).first()["id"] == "a"
    shards.write_lines(spark.createDataFrame([("a\nb",), ("  ",), (None,), ("c",)], "t string").coalesce(1), "t", str(tmp_path / "lines"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a b", "c"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","t":1}\n{"id":"b","t":2}\n')
    (tmp_path / "in" / "2.json").write_text('{"id":"a","t":3}\n')
    schema = spark.createDataFrame([], "id string, t int").schema
    stream = streams.first_seen(streams.record_stream(spark, str(tmp_path / "in"), schema, 1), derive_id(F.col("id")))
    streams.append_log(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]
    (tmp_path / "in" / "3.json").write_text('{"id":"c","t":4}\n{"id":"b","t":4}\n')
    streams.append_log(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = streams.windowed_counts(events, "ts", "1 hour", ["event_type"], "value")
    assert batch.agg(F.sum("n")).first()[0] == events.count()
    events.write.parquet(str(tmp_path / "events"))
    live = streams.windowed_counts(streams.record_stream(spark, str(tmp_path / "events"), events.schema, format="parquet"), "ts", "1 hour", ["event_type"], "value")
    query = live.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").select("window_start", "event_type", "n").exceptAll(batch.select("window_start", "event_type", "n")).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_tokenizers_round_trip(spark, name):
    df = spark.createDataFrame([("What is 12 + 30?",), ("é√π",), (None,)], "t string")
    file = tokenizer.path(name)
    rows = df.withColumn("ids", tokenizer.encoded(F.col("t"), file)).withColumn("back", tokenizer.decoded(F.col("ids"), file)).collect()
    assert [r["back"] for r in rows] == [r["t"] for r in rows] and rows[2]["ids"] is None
    assert tokenizer.token_checks(df, "t", file, 60_000).first()["broken_round_trips"] == 0


def test_digits_stay_single(spark):
    row = tokenizer.piece_audit(tokenizer.vocabulary(spark, tokenizer.path("piece_bpe_32k.model"))).first()
    assert row["pieces"] == 32000 and row["bytes"] == 256


@pytest.mark.parametrize("times", [1, 4])
def test_generated_corpus_follows_the_counters(spark, tmp_path, times):
    from corpusforge.queries import queries

    rows = [(f"b{k}", "f", 60) for k in range(times)] + [("b0", "f", 60), ("b0", "f", None), ("b0", None, 40)]
    spark.createDataFrame(rows, "build_id string, family_id string, generated long").write.parquet(f"{tmp_path}/build_counters.parquet")
    found = queries()["generated_corpus"](spark, str(tmp_path)).groupBy("family_id").sum("n").collect()
    assert len(found) == len(generate.FAMILIES) and {r[1] for r in found} == {-(-(60 * times + 40) // len(generate.FAMILIES))}
