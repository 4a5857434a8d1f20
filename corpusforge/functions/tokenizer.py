"""Public tokenizers over Arrow batches.  Their files' folder is a parameter; none is trained here."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
# Fixed value: the public byte-level pattern that goes with the ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _loaded(file: str):
    """``encode, decode, pieces`` of a vocabulary file, once per Python worker."""
    if file.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=file)
        return (lambda t: p.encode(t, num_threads=1)), p.decode, [p.id_to_piece(k) for k in range(p.get_piece_size())]
    if file.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = {v: k for k, v in ranks.items()}
        return e.encode_ordinary, e.decode, [names.get(k, b"").decode("utf-8", "replace") for k in range(max(names) + 1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    return (lambda x: t.encode(x, add_special_tokens=False).ids), t.decode, [t.id_to_token(k) for k in range(t.get_vocab_size())]


def path(name: str, folder: str = FOLDER) -> str:
    return str(Path(folder) / name)


def encoded(c: Column, file: str) -> Column:
    """Token ids of a text; null stays null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _loaded(file)[0]
        for texts in batches:
            yield texts.map(lambda t: None if t is None else of(t))

    return encode(c)


def decoded(c: Column, file: str) -> Column:
    """Text of token ids; null stays null."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _loaded(file)[1]
        for ids in batches:
            yield ids.map(lambda x: None if x is None else of([int(k) for k in x]))

    return decode(c)


def pieces(c: Column, file: str) -> Column:
    """The text's tokens as the vocabulary writes them; null stays null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, _, names = _loaded(file)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [names[k] for k in of(t)])

    return split(c)


def ids_of(file: str, names: list[str]) -> dict[str, int | None]:
    """Ids of pieces, None for those the vocabulary doesn't have."""
    found = {piece: k for k, piece in reversed(list(enumerate(_loaded(file)[2])))}
    return {name: found.get(name) for name in names}


def piece_of(file: str, id: int) -> str | None:
    names = _loaded(file)[2]
    return names[id] if 0 <= id < len(names) else None


# Pieces with a meaning of their own in the corpora here.
CORE = ["<unk>", "<s>", "</s>", "<pad>"]
CONTROL = ["<tool_call>", "<tool_result>", "<final>", "<unsupported>", "<error>"]
DIGITS = list("0123456789")
CONTEXTS = ["{0}", " {0}", "{0} ", "a{0}", "{0}b", "-{0}", "{0}.5", "1{0}2", "({0})"]


def special_tokens(spark, file: str) -> DataFrame:
    """``kind, piece, id`` of core and control pieces and single digits; a null id where the vocabulary has none."""
    kinds = {"core": CORE, "control": CONTROL, "digit": DIGITS}
    known = ids_of(file, [p for of in kinds.values() for p in of])
    return spark.createDataFrame([(kind, p, known[p]) for kind, of in kinds.items() for p in of], "kind string, piece string, id int")


def _checked(name: str, cases: DataFrame, failed: Column) -> DataFrame:
    return cases.agg(F.lit(name).alias("check"), F.count("*").alias("tested"), F.count_if(F.coalesce(failed, F.lit(True))).alias("failed"))


def validation(spark, file: str, size: int, texts: DataFrame, text: str, numbers: DataFrame, recorded: dict[str, int] | None = None, context: int = 1024) -> DataFrame:
    """Eleven checks of a vocabulary: ``check, tested, failed``.

    ``texts`` are the cases of round trips, ``numbers`` (a column ``text``) those of segmentation and random
    concatenations, ``recorded`` the ids that special pieces should have (by default those they have).
    """
    ids = lambda c: encoded(F.col(c), file)
    words = texts.select(F.col(text).alias("t")).filter("t is not null").withColumn("ids", ids("t")).withColumn("back", decoded(F.col("ids"), file))
    names = vocabulary(spark, file)
    special = special_tokens(spark, file).filter("id is not null")
    wanted = recorded if recorded is not None else {r["piece"]: r["id"] for r in special.collect()}
    live = spark.createDataFrame([(k, v, ids_of(file, [k])[k]) for k, v in wanted.items()], "piece string, want int, have int")
    digits = spark.createDataFrame([(d, c.format(d)) for d in DIGITS for c in CONTEXTS], "digit string, t string").withColumn("p", pieces(F.col("t"), file))
    bare = lambda p: F.regexp_replace(p, "^[\u2581\u0120 ]+", "")
    segmented = numbers.select(F.col("text").alias("t")).withColumn("p", pieces(F.col("t"), file))
    unknown = ids_of(file, ["<unk>"])["<unk>"]
    pairs = numbers.select(F.concat_ws(" ", "text", F.reverse("text"), F.lit("= ?")).alias("t")).withColumn("back", decoded(encoded(F.col("t"), file), file))
    blank = spark.createDataFrame([("",), (" ",), ("\n",), ("\t \n",)], "t string").withColumn("ids", ids("t"))
    long = spark.range(1).select(F.repeat(F.lit("12 + 34 = 46; "), context).alias("t")).withColumn("ids", ids("t")).withColumn("back", decoded(F.col("ids"), file))
    stripped = lambda c: F.btrim(c)
    rows = [
        names.agg(F.lit("vocab_size").alias("check"), F.lit(1).cast("bigint").alias("tested"), (F.count("*") != size).cast("bigint").alias("failed")),
        _checked("id_range", words, F.exists("ids", lambda x: (x < 0) | (x >= size))),
        _checked("special_token_ids", live, ~F.col("want").eqNullSafe(F.col("have"))),
        _checked("digit_atomicity", digits, ~F.exists("p", lambda p: bare(p) == F.col("digit"))),
        _checked("no_unauthorized_multi_digit", names, F.col("piece").rlike("[0-9]{2,}")),
        _checked("random_numeric_segmentation", segmented, F.exists("p", lambda p: p.rlike("[0-9]{2,}"))),
        _checked("byte_fallback_unk_rate", words, F.array_contains("ids", F.lit(-1 if unknown is None else unknown))),
        _checked("round_trips", words, F.col("back") != F.col("t")),
        _checked("random_round_trips", pairs, F.col("back") != F.col("t")),
        _checked("empty_whitespace_input", blank, F.col("ids").isNull()),
        _checked("long_input", long, (stripped("back") != stripped("t")) | (F.size("ids") <= context)),
    ]
    return reduce(DataFrame.unionByName, rows)


def vocabulary(spark, file: str) -> DataFrame:
    """``id, piece`` of a vocabulary."""
    return spark.createDataFrame(list(enumerate(_loaded(file)[2])), "id int, piece string")


def piece_audit(pieces: DataFrame) -> DataFrame:
    """One row: pieces, single digits, pieces of several digits, byte pieces, long pieces, blank ones."""
    p = F.col("piece")
    return pieces.agg(F.count("*").alias("pieces"), F.count_if(p.rlike(r"^[0-9]$")).alias("digits"), F.count_if(p.rlike(r"[0-9]{2,}")).alias("digit_runs"), F.count_if(p.rlike("^<0x[0-9A-F]{2}>$")).alias("bytes"), F.count_if(F.length(p) > 16).alias("long"), F.count_if(~p.rlike(r"\S")).alias("blank"))


def token_checks(df: DataFrame, text: str, file: str, size: int) -> DataFrame:
    """One row: texts, ids out of range, round trips that fail, greatest number of ids."""
    ids = df.select(F.col(text).alias("t")).filter("t is not null").withColumn("ids", encoded(F.col("t"), file))
    back = ids.withColumn("back", decoded(F.col("ids"), file))
    return back.agg(F.count("*").alias("texts"), F.count_if(F.exists("ids", lambda x: (x < 0) | (x >= size))).alias("out_of_range"), F.count_if(F.col("back") != F.col("t")).alias("broken_round_trips"), F.max(F.size("ids")).alias("most_ids"))


def efficiency(df: DataFrame, text: str, by: str, tokens: Column) -> DataFrame:
    """Texts, tokens, characters and tokens per character and per text, per group; null ratio without characters."""
    n = df.groupBy(by).agg(F.count("*").alias("texts"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    return n.withColumn("tokens_per_char", F.try_divide("tokens", "chars")).withColumn("tokens_per_text", F.col("tokens") / F.col("texts"))
