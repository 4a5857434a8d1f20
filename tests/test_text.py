import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import ids, text
from corpusforge.functions.words import clean_category, clean_name, words

DATA = "/root/testdata/sf0.001"
NUMBER = re.compile(text.NUMBER.replace(r"\p{Nd}", r"\d"), re.IGNORECASE)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def python_shape(t):
    lowered = NUMBER.sub("<NUM>", t.lower())
    return " ".join(re.sub(r"\$\s*<NUM>", "$<NUM>", lowered).split())


@pytest.mark.parametrize(("given", "want"), [
    ("What is 12 plus 13?", "what is <NUM> plus <NUM>?"), ("12-3", "<NUM><NUM>"), ("x12", "x1<NUM>"), ("x1", "x1"), ("2e5e6", "<NUM>e6"), ("1.2.3", "<NUM>.<NUM>"),
    ("x-5", "x-<NUM>"), ("x+-5", "x+<NUM>"), ("Pay $ 7.50 now", "pay $<NUM> now"), ("  \t \n ", ""), (None, None),
])
def test_shape(spark, given, want):
    assert one(spark, given, text.shape) == want


def test_shape_equals_python(spark):
    rows = [r[0] for r in spark.read.parquet(f"{DATA}/examples.parquet").select("prompt").dropna().collect()]
    found = dict(map(tuple, spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.shape(F.col("t"))).collect()))
    assert found == {t: python_shape(t) for t in rows}


@pytest.mark.parametrize(("given", "want"), [
    ("a  b\t\tc", "a b c"), ("é", "é"), ("√2 ≤ π", "√2 ≤ π"), ("a\x07b", None), ("  \n ", None), ("a\n\n\n\nb", "a\n\nb"), (" x　", "x"), ("", None), (None, None),
])
def test_normalized(spark, given, want):
    assert one(spark, given, text.normalized) == want


def test_normalized_equals_python(spark):
    def python(t):
        if t is None or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", t):
            return None
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", t))).strip()
        return t or None

    found = spark.read.parquet(f"{DATA}/documents.parquet").select("text", text.normalized(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in found] == [python(r["text"]) for r in found]


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([("a b", "a b c d"), ("", None), ("x y z w", "x y z v")], "a string, b string")
    rows = df.select(text.shingles(F.col("a"), 3).alias("a"), text.shingles(F.col("b"), 3).alias("b"))
    assert [tuple(r) for r in rows.collect()] == [(["a b"], ["a b c", "b c d"]), ([""], None), (["x y z", "y z w"], ["x y z", "y z v"])]
    assert [r[0] for r in rows.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, None, 1 / 3]


@pytest.mark.parametrize(("given", "tag", "want"), [
    ("so <final> 5 <error>x", "final", "5"), ("<final>", "final", ""), ("none", "final", None), ("<tool_call>{}\n<final>\n7\n", "final", "7"), ("a<final>b\nc", "final", "b\nc"), (None, "final", None),
])
def test_tagged(spark, given, tag, want):
    assert one(spark, given, lambda c: text.tagged(c, tag)) == want


def test_first_call(spark):
    assert one(spark, "<tool_call>{1}<final>2", text.first_call) == "{1}"
    assert one(spark, "<final>2<tool_call>{1}", text.first_call) is None
    assert one(spark, "x<tool_result>", text.first_tag) == "tool_result"


@pytest.mark.parametrize(("given", "want"), [
    ("$12.50.", "12.50"), ("1,234.5 meters", "1234.5"), ("-1.2e-3", "-1.2e-3"), ("1e3", "1e3"), ("7 / 8", "7/8"), ("15%", "15"), ("We add 2 and 3, so the final answer is 5.", "5"), ("none", None), (None, None),
])
def test_last_number(spark, given, want):
    assert one(spark, given, text.last_number) == want


def test_ids(spark):
    key = "g\x1ff\x1fd"
    head = hashlib.sha256(key.encode()).hexdigest()
    row = spark.range(1).select(ids.derive_id(F.lit("g"), F.lit("f"), F.lit("d")), ids.derive_seed(F.lit("g"), F.lit("f"), F.lit("d"))).first()
    assert tuple(row) == (head[:16], int(head[:16], 16) & (2**63 - 1))


def test_hash_split_shares_and_grouping(spark):
    rows = spark.range(20000).select(ids.hash_split(F.lit("g"), F.lit("f"), F.col("id"), 1, 0.9, 0.05).alias("s"), F.col("id"))
    counts = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}
    assert abs(counts["train"] / 20000 - 0.9) < 0.01 and abs(counts["test"] / 20000 - 0.05) < 0.01
    twice = rows.unionByName(spark.range(20000).select(ids.hash_split(F.lit("g"), F.lit("f"), F.col("id"), 1, 0.9, 0.05).alias("s"), F.col("id")))
    assert twice.groupBy("id").agg(F.countDistinct("s").alias("n")).filter("n > 1").count() == 0


def test_clean_names(spark):
    assert one(spark, "  TRAIN\t", clean_name) == "train"
    assert one(spark, " Multi -Step ", clean_category) == "multi_step"
    assert one(spark, None, clean_category) is None


def test_words():
    assert words("It's ½ of X_y") == ["it", "s", "1", "2", "of", "x", "y"]


def test_package_name(spark):
    assert one(spark, "Sentence__Piece.x-_y", ids.package_name) == "sentence-piece-x-y"
