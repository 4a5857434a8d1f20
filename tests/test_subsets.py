import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import dialogue, subsets

CALL = json.dumps({"protocol_version": "1.0.0", "tool": "calculator.evaluate", "arguments": {"expression": "6*7"}})


def test_manifest(spark):
    df = spark.createDataFrame([("b", "train", 3, "x", True), ("a", "train", None, "y", None), ("c", None, 1, None, False)], "id string, split string, n int, c string, f boolean")
    rows = {r["split"]: r for r in subsets.subset_manifest(df, "id", "split", "n", ["c"], ["c"], "f").collect()}
    assert (rows["train"]["records"], rows["train"]["tokens"], rows["train"]["ids_sha256"], rows["train"]["c_counts"], rows["train"]["with_f"]) == (2, 3, hashlib.sha256(b"a\nb").hexdigest(), {"x": 1, "y": 1}, 1)
    assert rows[None]["distinct_c"] == 0 and rows[None]["c_counts"] is None


def test_representation_digest_is_of_the_set(spark):
    df = spark.createDataFrame([("a", [1, 2], [-100, 2], "s"), ("b", [3], [3], "s")], "id string, i array<int>, l array<int>, split string")
    one = lambda d: subsets.representation_digest(d, "id", "i", "l", ["split"]).first()["representation_sha256"]
    assert one(df) == one(df.orderBy(F.desc("id")).repartition(3)) != one(df.withColumn("l", F.col("i")))


def test_configuration():
    assert subsets.shares_add_up({"a": 0.5, "b": 0.5})
    for bad in ({"a": 0.9}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            subsets.shares_add_up(bad)


def test_manifest_count(spark):
    df = spark.createDataFrame([("train", 5), ("train", 6)], "split string, rows bigint")
    assert subsets.manifest_count(df, "train") == 11
    with pytest.raises(ValueError):
        subsets.manifest_count(df, "test")


def test_table_rules(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", " "), ("c", "q")], "id string, kind string")
    assert sorted(map(tuple, subsets.table_rules(df, ["id", "kind"], "id", {"kind": ["x"]}).collect())) == [("a", "repeated"), ("b", "missing_kind"), ("c", "unknown_kind")]


def test_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, y string")
    assert sorted(map(tuple, subsets.union_of_sources({"p": a, "q": b}).select("x", "source").collect())) == [(1, "p"), (2, "q")]


@pytest.mark.parametrize(("turns", "want"), [
    ([f"<tool_call>{CALL}", "<final> 42 "], (1, "42", "final", "ended", False)),
    ([f"<tool_call>{CALL}<tool_result>41<final>41", "<final>42"], (1, "42", "final", "ended", True)),
    (["<tool_call>{", "<error>x"], (1, None, "error", "ended", False)),
    ([f"<tool_call>{CALL}"] * 3, (2, None, None, "too_many_calls", False)),
    ([f"<tool_call>{CALL}"], (1, None, None, "no_more_turns", False)),
    (["plain"], (0, None, None, "no_tag", False)), (["<tool_result>5"], (0, None, None, "invented_result", True)), ([], (0, None, None, "no_more_turns", False)),
])
def test_replay(turns, want):
    attempts, *rest = dialogue.replay(turns)
    assert (len(attempts), *rest) == want


def test_replay_in_a_frame(spark):
    df = spark.createDataFrame([([f"<tool_call>{CALL}", "<final>42"],), (None,)], "turns array<string>")
    rows = dialogue.trace_flags(df.withColumn("t", dialogue.replayed(F.col("turns"))), "t").collect()
    assert rows[0]["t"]["attempts"][0]["value"] == "42" and rows[0]["any_success"] and rows[0]["any_valid_call"] and not rows[1]["emitted_call"]


def test_command_line(capsys, tmp_path):
    from corpusforge.__main__ import main

    assert main(["call", CALL]) == 0 and '"value":"42"' in capsys.readouterr().out
    assert main(["call", "{"]) == 1
    (tmp_path / "x").write_bytes(b"x")
    assert main(["hash", str(tmp_path / "x"), "--expect", hashlib.sha256(b"x").hexdigest()]) == 0
    assert main(["hash", str(tmp_path / "x"), "--expect", "00"]) == 1
    assert main(["tools"]) == 0 and main(["list"]) == 0 and "corpus_flagship" in capsys.readouterr().out


def test_zero_cap(spark):
    from corpusforge.operators.dedup import shape_fold

    rows = [(1, "f", "the sum of 1 and 2 is asked"), (2, "f", "the sum of 5 and 9 is asked"), (3, "g", "the sum of 5 and 9 is asked"), (4, "f", "the sum of 5 and 9 is asked now"), (5, "f", "quite another text it is"), (6, "f", None), (7, "f", "")]
    df = spark.createDataFrame(rows, "n int, f string, t string")
    assert sorted(r["n"] for r in shape_fold(df, F.col("f"), F.col("t"), "n", 3, 0.5).collect()) == [1, 3, 5, 6]


def test_raw_cases(spark):
    from corpusforge.schema import CASE_SCHEMA, raw_violations, typed

    good = {n: None for n in CASE_SCHEMA.names} | {"id": "a", "tool_required": False, "tolerance": 0.5, "verification": {"mode": "semantic", "expression": None}}
    rows = [good, good | {"extra": 1}, {k: v for k, v in good.items() if k != "prompt"}, good | {"tool_required": "yes"}, good | {"id": 7}, [1], good | {"tolerance": "x"}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(7, None), (8, "{")], "k int, t string")
    found = {r["k"]: list(r["v"]) for r in df.select("k", raw_violations(F.col("t"), CASE_SCHEMA).alias("v")).collect()}
    assert found == {0: [], 1: ["unexpected_extra"], 2: ["missing_prompt"], 3: ["type_tool_required"], 4: ["type_id"], 5: ["no_object"], 6: ["type_tolerance"], 7: ["no_object"], 8: ["no_object"]}
    assert df.filter("k = 0").select(typed(F.col("t"), CASE_SCHEMA).alias("r")).select("r.id", "r.verification.mode").first()[1] == "semantic"
    with pytest.raises(Exception):  # noqa: B017
        df.filter("k = 8").select(typed(F.col("t"), CASE_SCHEMA)).collect()


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dataset_id": "d", "shares": {"train": 0.9, "test": 0.1}}))
    assert subsets.load_config(spark, str(tmp_path / "c.json"), ["dataset_id"], ["shares"])["dataset_id"] == "d"
    with pytest.raises(ValueError, match="missing"):
        subsets.load_config(spark, str(tmp_path / "c.json"), ["seed"], [])
    (tmp_path / "d.json").write_text(json.dumps({"shares": {"train": 0.9}}))
    with pytest.raises(ValueError, match="add up"):
        subsets.load_config(spark, str(tmp_path / "d.json"), [], ["shares"])


def test_conditional_rules(spark):
    df = spark.createDataFrame([("a", "python", "yes", None), ("b", "other", "true", None), ("c", "python", "False", "p")], "id string, kind string, own string, package string")
    found = {(r["row"], r["rule"]) for r in subsets.table_rules(df, ["id"], "id", booleans=["own"], needed={"package": ("kind", "python")}).collect()}
    assert found == {("a", "type_own"), ("a", "missing_package")}


def test_batches_are_padded_to_their_longest(spark):
    from corpusforge.operators import packing, render

    df = spark.createDataFrame([(0, "b", [1, 2, 3], [-100, 2, 3]), (0, "a", [7], [7]), (1, "c", [5], [5])], "batch int, id string, i array<int>, l array<int>")
    rows = {r["batch"]: r for r in packing.collated(df, "batch", "id", "i", "l", 0).collect()}
    assert rows[0]["input_ids"] == [[7, 0, 0], [1, 2, 3]] and rows[0]["labels"] == [[7, -100, -100], [-100, 2, 3]] and rows[0]["attention_mask"] == [[1, 0, 0], [1, 1, 1]] and rows[1]["input_ids"] == [[5]]
    both = packing.masked_rows(df, df.limit(1), "id", "i", "l")
    assert both.count() == 4 and both.filter("replayed and input_ids != labels").count() == 0
    text = spark.sql("select array(struct('a' as text, 'x' as role), struct('b' as text, 'y' as role)) as s").select(render.segments_text(F.col("s"))).first()[0]
    assert text == "ab"
