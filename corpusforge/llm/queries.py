"""The pN_ queries over the tables of TESTDATA.md.

A query pN_checks states what must hold of its problem's operator whatever choice it makes, next to figures that SQL
can tell from the tables; the SQL is in ``sql``.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.words import clean_category, clean_name, token_count
from corpusforge.llm.calibrate import proportional_sample, sample_report
from corpusforge.llm.leaks import tilings
from corpusforge.llm.mix import mixed
from corpusforge.llm.near import near_groups
from corpusforge.llm.overlaps import overlap_pairs, overlapping_records
from corpusforge.llm.pack import packed
from corpusforge.llm.pieces import pieces
from corpusforge.llm.splits import grouped_split, shares_of, torn
from corpusforge.llm.sql import oracle_sql
from corpusforge.plans.stage import staged
from corpusforge.sources.tables import table

LIKENESS = Fraction(3, 4)  # TESTDATA.md's bound for likeness by single words
MIN_MATCH = 8  # its words in sequence
REORDERED_MATCH, REORDERED_COVERAGE = 4, 0.6  # passages of half that length, covering most of a test


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    train = table(spark, folder, "examples").filter(clean_name(F.col("split")) == "train").select(F.lit("examples").alias("found_in"), F.col("example_id").alias("record_id"), F.col("prompt").alias("text"))
    return train.unionByName(table(spark, folder, "documents").select(F.lit("documents").alias("found_in"), F.col("doc_id").cast("string").alias("record_id"), "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = tilings(_corpus(spark, folder), "text", table(spark, folder, "phase0_v1"), "id", "prompt", MIN_MATCH)
    return found.select(F.col("test_id").alias("case_id"), "found_in", "record_id").distinct()


def p1_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold most of a test's words in tiles of at least four words, in any order."""
    found = tilings(_corpus(spark, folder), "text", table(spark, folder, "phase0_v1"), "id", "prompt", REORDERED_MATCH, REORDERED_COVERAGE)
    return found.select(F.col("test_id").alias("case_id"), "found_in", "record_id", "tiles", "longest", "coverage").distinct()


def _held_out() -> Column:
    split = clean_name(F.col("split"))
    return F.when(split == "train", False).when(split.isin("validation", "test"), True)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap_pairs(table(spark, folder, "examples"), "example_id", "prompt", _held_out(), LIKENESS, 1, likeness=LIKENESS)
    return pairs.select(F.least("id_eval", "id_train").alias("example_id_a"), F.greatest("id_eval", "id_train").alias("example_id_b"))


def p2_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records of which a training record holds three quarters of the words, and those also alike, per split and generator."""
    rows = table(spark, folder, "examples")
    found = overlapping_records(rows, "example_id", "prompt", _held_out(), LIKENESS, 1, LIKENESS)
    where = rows.select("example_id", clean_name(F.col("split")).alias("split"), "generator_id").distinct()
    met = found.join(where, F.col("id") == F.col("example_id"))
    counts = [F.countDistinct("id").alias("contained"), F.countDistinct(F.when(F.col("alike"), F.col("id"))).alias("overlapping")]
    return met.groupBy("split", "generator_id").agg(*counts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "examples"), "example_id", "prompt", LIKENESS, 1)


def p3_shingles(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by shingles of five words at a likeness of 0.8."""
    return near_groups(table(spark, folder, "examples"), "example_id", "prompt")


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "examples").select("example_id", clean_name(F.col("family_id")).alias("family_id"), "template_id", clean_name(F.col("split")).alias("split"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return torn(_linked(spark, folder), ["family_id", "template_id"], "split")


def p4_split(spark: SparkSession, folder: str) -> DataFrame:
    shares = shares_of(table(spark, folder, "split_plan"), "split", "target_share")
    return grouped_split(_linked(spark, folder), "example_id", ["family_id", "template_id"], shares)


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the new splits, values that lie in several of them, and splits but the largest that miss their share by more than a record."""
    rows = _linked(spark, folder)
    placed = staged(p4_split(spark, folder))
    shares = shares_of(table(spark, folder, "split_plan"), "split", "target_share")
    whole = placed.select("example_id", "new_split").distinct()
    several = [placed.filter(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("new_split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit(f"{c}s_in_several_splits").alias("what"), "n") for c in ("example_id", "family_id", "template_id")]
    got = whole.groupBy("new_split").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame(sorted((s, float(x)) for s, x in shares.items() if s != max(shares, key=lambda k: (shares[k], k))), "_split string, _share double")
    all_ = whole.agg(F.count("*").alias("_all"))
    off = wanted.crossJoin(all_).join(got, F.col("_split") == F.col("new_split"), "left").agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("_share") * F.col("_all")) > 1).alias("n"))
    missing = rows.filter("example_id is not null").select("example_id").distinct().join(whole, "example_id", "left_anti").agg(F.count("*").alias("n"))
    parts = [whole.agg(F.count("*").alias("n")).select(F.lit("records").alias("what"), "n"), *several, off.select(F.lit("splits_off_target").alias("what"), "n"), missing.select(F.lit("records_without_split").alias("what"), "n")]
    return reduce(DataFrame.unionByName, parts)


def _population(spark: SparkSession, folder: str) -> DataFrame:
    train = table(spark, folder, "examples").filter(clean_name(F.col("split")) == "train")
    return train.groupBy(F.col("example_id").alias("id")).agg(F.min(clean_category(F.col("category"))).alias("category"), F.coalesce(F.max("token_count"), F.lit(0)).cast("bigint").alias("tokens"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    config = table(spark, folder, "pilot_subset_config").select("config_id", "target_train_tokens", F.col("min_category_examples").alias("floor_examples"))
    mixture = table(spark, folder, "category_mixture").select("config_id", clean_category(F.col("category")).alias("category"), "target_share")
    return mixture.join(config, "config_id").select("config_id", "category", (F.col("target_share") * F.col("target_train_tokens")).alias("want_tokens"), "floor_examples")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    gaps = sample_report(staged(_population(spark, folder)), _targets(spark, folder))
    reasons = F.array_compact(F.array(F.when(F.col("short_tokens"), "tokens"), F.when(F.col("short_examples"), "examples")))
    return gaps.select("config_id", "category", F.explode(reasons).alias("reason"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return proportional_sample(staged(_population(spark, folder)), _targets(spark, folder))


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What the sample gives each target."""
    return sample_report(staged(_population(spark, folder)), _targets(spark, folder))


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per target what there is and what is short, whether its floor is kept, and whether the draw comes within two records of the tokens."""
    r = p5_shares(spark, folder)
    longest = _population(spark, folder).agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("_longest"))
    near = F.abs(F.col("sampled_tokens") - F.least("want_tokens", "available_tokens")) <= 2 * F.col("_longest") + 1
    close = F.coalesce(F.col("reason").isin("floor", "examples"), F.lit(False)) | near
    kept = F.col("sampled_examples") >= F.least("floor_examples", "available_examples")
    columns = ["config_id", "category", "available_tokens", "available_examples", "short_tokens", "short_examples"]
    return r.crossJoin(longest).select(*columns, kept.alias("floor_kept"), close.alias("tokens_close"))


def _limits(spark: SparkSession, folder: str, purpose: str) -> DataFrame:
    return table(spark, folder, "size_limits").filter(F.col("purpose") == purpose)


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), "doc_id", token_count(F.col("text")), _limits(spark, folder, "container")).withColumnRenamed("id", "doc_id")


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity the parts, texts and tokens placed, containers above capacity, parts of texts that would have fitted whole, and whether nine tenths are filled."""
    cap = _limits(spark, folder, "container").select(F.col("spec_id").alias("_s"), F.col("max_tokens").cast("bigint").alias("_cap"))
    rows = staged(p6_packed(spark, folder)).join(F.broadcast(cap), F.col("spec_id") == F.col("_s"))
    loads = rows.groupBy("spec_id", "container", "_cap").agg(F.sum("tokens").alias("load"), F.count("*").alias("parts"), F.count_if("oversize").alias("cut"), F.count_if(F.col("tokens") > 0).alias("filled"))
    per = loads.groupBy("spec_id").agg(F.sum("parts").alias("parts"), F.sum("load").alias("tokens"), F.count_if(F.col("load") > F.col("_cap")).alias("overfull"), (F.sum("load") >= 0.9 * F.sum(F.when(F.col("filled") > 0, F.col("_cap")))).alias("well_filled"))
    texts = rows.groupBy("spec_id", "doc_id", "_cap").agg(F.sum("tokens").alias("n"), F.countDistinct("part").alias("parts"))
    cut = texts.groupBy(F.col("spec_id").alias("_s")).agg(F.count("*").alias("texts"), F.count_if((F.col("n") <= F.col("_cap")) & (F.col("parts") > 1)).alias("cut_in_vain"))
    return per.join(cut, F.col("spec_id") == F.col("_s")).select("spec_id", "texts", "parts", "tokens", "overfull", "cut_in_vain", "well_filled")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_packed(spark, folder).filter("oversize").select("spec_id", "doc_id").distinct()


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    mixture = table(spark, folder, "source_mix").withColumn("source", clean_name(F.col("source")))
    return mixed(table(spark, folder, "documents"), "doc_id", clean_name(F.col("source")), token_count(F.col("text")), mixture)


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per target what there is and what is short, repeats beyond the allowed, and whether the choice comes within a record of what it should."""
    docs = table(spark, folder, "documents").select(clean_name(F.col("source")).alias("_source"), token_count(F.col("text")).alias("_n"))
    longest = docs.groupBy("_source").agg(F.max("_n").alias("_longest"))
    chosen, shares = _mixed(spark, folder)
    limits = table(spark, folder, "source_mix").select(F.col("mix_id").alias("_m"), clean_name(F.col("source")).alias("_s"), "max_repeats")
    most = chosen.groupBy("mix_id", "source", "id").agg((F.max("repeat") + 1).alias("times")).groupBy(F.col("mix_id").alias("_m"), F.col("source").alias("_s")).agg(F.max("times").alias("times"))
    over = limits.join(most, ["_m", "_s"], "left").select("_m", "_s", (F.coalesce("times", F.lit(0)) > F.col("max_repeats")).alias("over_repeated"))
    met = shares.join(longest, F.col("source") == F.col("_source"), "left").join(over, (F.col("mix_id") == F.col("_m")) & (F.col("source") == F.col("_s")))
    close = F.abs(F.col("chosen_tokens") - F.least("target_tokens", "usable_tokens")) <= F.coalesce("_longest", F.lit(0))
    return met.select("mix_id", "source", "available_tokens", "usable_tokens", "short", "over_repeated", close.alias("close"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].filter("short").select("mix_id", "source")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(table(spark, folder, "documents"), "doc_id", "text", _limits(spark, folder, "piece")).withColumnRenamed("id", "doc_id")


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per limit the texts cut and their tokens, pieces beyond the limit, with a wrong overlap, out of order or with another text than their span's."""
    limits = _limits(spark, folder, "piece").select(F.col("spec_id").alias("_s"), "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap"))
    cut = staged(p8_pieces(spark, folder)).join(F.broadcast(limits), F.col("spec_id") == F.col("_s"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("_text"))
    rows = cut.join(texts, F.col("doc_id") == F.col("_d"))
    other = F.col("text") != F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    wrong = F.when(F.col("piece") == 0, F.col("n_tokens") != F.col("own_tokens")).otherwise(F.col("n_tokens") - F.col("own_tokens") != F.col("overlap"))
    per = rows.groupBy("spec_id", "doc_id").agg(
        F.sum("own_tokens").alias("tokens"),
        F.count_if(F.col("n_tokens") > F.col("max_tokens")).alias("too_long"),
        F.count_if(wrong).alias("wrong_overlap"),
        F.count_if(other | (F.col("n_tokens") != token_count(F.col("text")))).alias("wrong_text"),
        (F.max("piece") + 1 - F.count("*")).alias("gaps"),
        F.count_if(F.col("ends_at") == "end").alias("ends"),
    )
    sums = ["tokens", "too_long", "wrong_overlap", "wrong_text", "gaps"]
    return per.groupBy("spec_id").agg(F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in sums], F.count_if(F.col("ends") != 1).alias("open_ends"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = pieces(table(spark, folder, "documents"), "doc_id", "text", _limits(spark, folder, "piece"), with_text=False)
    return cut.filter("piece = 0").select("spec_id", F.col("id").alias("doc_id"), "cut_kind").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


__all__ = ["oracle_sql", "queries"]
