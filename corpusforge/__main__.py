"""Command line: queries, the calculator, suites, manifests, tokenizers, and data sets from end to end.

Every command prints what it found and ends with 0 if all is well, with 1 if a check failed.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Callable
from pathlib import Path

COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(*arguments: tuple[str, dict] | str) -> Callable:
    """Register a handler under its name with hyphens; an argument is a name, or a name and its options."""

    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.strip("_").replace("_", "-")] = f, [a if isinstance(a, tuple) else (a, {}) for a in arguments]
        return f

    return add


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _suite(path: str):
    from corpusforge.schema import CASE_SCHEMA
    from corpusforge.sources.shards import read_suite

    return read_suite(_spark(), path, CASE_SCHEMA)


def _records(path: str):
    from corpusforge.sources.shards import read_shards

    return read_shards(_spark(), path)


def _told(rows: list, good: Callable = lambda r: True) -> int:
    for r in rows:
        print(*r, sep="\t")
    return int(not all(map(good, rows)))


def sha256(path: str) -> str:
    """SHA-256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@command()
def _list(given) -> int:
    """Names of the queries."""
    from corpusforge.queries import queries

    print("\n".join(queries()))
    return 0


@command("name", "folder", ("--out", {}), ("--rows", {"type": int, "default": 20}))
def run(given) -> int:
    """Run a query over a folder of tables, write Parquet or show the first rows."""
    from corpusforge.queries import queries

    found = queries()[given.name](_spark(), given.folder)
    found.write.parquet(given.out) if given.out else found.show(given.rows, truncate=False)
    return 0


@command()
def tools(given) -> int:
    """The calculator's tools."""
    from corpusforge.functions.calculator import TOOLS

    print("\n".join(TOOLS))
    return 0


@command("text")
def call(given) -> int:
    """Result of a tool call's text, - for standard input."""
    from corpusforge.functions.calculator import canonical, executed

    result = executed(sys.stdin.read() if given.text == "-" else given.text)
    print(canonical(result))
    return int(result["status"] != "success")


@command("folder")
def tools_schemas(given) -> int:
    """Write the JSON schemas of calls, results and arguments."""
    from corpusforge.functions.calculator import schemas

    Path(given.folder).mkdir(parents=True, exist_ok=True)
    for name, schema in schemas().items():
        (Path(given.folder) / f"{name}.schema.json").write_text(json.dumps(schema, indent=2, sort_keys=True) + "\n")
        print(name)
    return 0


@command("folder")
def tools_validate(given) -> int:
    """Whether written schemas are those of now."""
    from corpusforge.functions.calculator import schemas

    rows = []
    for name, schema in schemas().items():
        path = Path(given.folder) / f"{name}.schema.json"
        rows.append((name, "missing" if not path.exists() else "ok" if json.loads(path.read_text()) == schema else "drifted"))
    return _told(rows, lambda r: r[1] == "ok")


@command("suite")
def tools_self_test(given) -> int:
    """Run a suite of tool calls."""
    from corpusforge.pipelines import self_test

    cases = json.loads(Path(given.suite).read_text())["cases"]
    failures = self_test(cases)
    print(f"{len(cases)} cases, {len(failures)} failures")
    return _told([(f,) for f in failures], lambda r: False)


@command("path", ("--expect", {}))
def hash(given) -> int:
    """SHA-256 of a file; with --expect, whether it is that."""
    found = sha256(given.path)
    print(found)
    return int(bool(given.expect) and found != given.expect.lower())


@command(("suites", {"nargs": "+"}))
def evals_validate(given) -> int:
    """Whether the cases of suites keep the rules and have ids of their own."""
    from corpusforge.sources.shards import checked_suite

    rows = []
    for path in given.suites:
        try:
            rows.append((path, checked_suite(_suite(path)).count(), "ok"))
        except ValueError as e:
            rows.append((path, 0, str(e)))
    return _told(rows, lambda r: r[2] == "ok")


@command("suite", ("--all-operations", {"action": "store_true"}))
def evals_verify(given) -> int:
    """Verdicts on the recorded answers of a suite."""
    from corpusforge.pipelines import verify_suite

    return _told(verify_suite(_suite(given.suite), not given.all_operations).orderBy("id").collect(), lambda r: r["verdict"] == "ok")


@command("table", "unique", ("--required", {"nargs": "*", "default": []}), ("--allowed", {"nargs": "*", "default": [], "help": "column=value,value"}))
def manifests_validate(given) -> int:
    """Rows of a small JSON-lines or Parquet table that break its rules."""
    from corpusforge.operators.subsets import table_rules

    spark = _spark()
    df = spark.read.parquet(given.table) if given.table.endswith(".parquet") else spark.read.json(given.table)
    allowed = {c: v.split(",") for c, v in (a.split("=", 1) for a in given.allowed)}
    return _told(table_rules(df, given.required, given.unique, allowed).orderBy("row", "rule").collect(), lambda r: False)


@command("project", "licenses")
def deps_check(given) -> int:
    """A project's declared packages (TOML) against licensed ones (JSON lines of name, scope)."""
    from corpusforge.operators.manifests import cross_check, declared_dependencies

    spark = _spark()
    declared = [(n, scope) for scope, names in declared_dependencies(Path(given.project).read_text()).items() for n in names]
    left = spark.createDataFrame(declared, "name string, scope string")
    return _told(cross_check(left, "name", "scope", spark.read.json(given.licenses), "name", "scope").orderBy("package").collect(), lambda r: r["outcome"] == "ok")


@command("file")
def tokenizer_inspect(given) -> int:
    """Size and special pieces of a vocabulary."""
    from corpusforge.functions import tokenizer

    spark = _spark()
    _told(tokenizer.piece_audit(tokenizer.vocabulary(spark, given.file)).collect())
    return _told(tokenizer.special_tokens(spark, given.file).collect())


@command("file", "text", ("--pieces", {"action": "store_true"}))
def tokenizer_encode(given) -> int:
    """Token ids of a text, or its pieces."""
    from corpusforge.functions import tokenizer

    encode, _, names = tokenizer._loaded(given.file)
    print(*([names[k] for k in encode(given.text)] if given.pieces else encode(given.text)))
    return 0


@command("file", ("ids", {"nargs": "+", "type": int}))
def tokenizer_decode(given) -> int:
    """The text of token ids."""
    from corpusforge.functions import tokenizer

    print(tokenizer._loaded(given.file)[1](given.ids))
    return 0


def _lines():
    from corpusforge.operators import generate

    return generate.held_out_lines(_spark())


@command("file", "size", ("--strings", {"type": int, "default": 2000}))
def tokenizer_validate(given) -> int:
    """The eleven checks of a vocabulary."""
    from corpusforge.functions import tokenizer
    from corpusforge.operators import generate

    spark = _spark()
    found = tokenizer.validation(spark, given.file, int(given.size), _lines(), "line", generate.numeric_strings(spark, given.strings, 1))
    return _told(found.collect(), lambda r: not r["failed"])


@command("file")
def tokenizer_benchmark(given) -> int:
    """Tokens per character on held-out lines of every kind."""
    from pyspark.sql import functions as F

    from corpusforge.functions import tokenizer

    return _told(tokenizer.efficiency(_lines(), "line", "kind", F.size(tokenizer.encoded(F.col("line"), given.file))).orderBy("kind").collect())


@command("folder")
def tokenizer_hashes(given) -> int:
    """SHA-256 of a vocabulary's files."""
    from corpusforge.operators.manifests import files

    return _told(files(_spark(), given.folder).orderBy("file").collect())


@command("out", ("--lines", {"type": int, "default": 100_000}), ("--seed", {"type": int, "default": 1}))
def tokenizer_corpus(given) -> int:
    """Write the lines a tokenizer would be trained on; tokenizers themselves aren't trained here."""
    from corpusforge.operators import generate
    from corpusforge.sources.shards import write_lines

    counts = generate.line_counts(given.lines)
    write_lines(generate.corpus_lines(_spark(), counts, given.seed), "line", given.out)
    return _told(list(counts.items()))


@command("out", ("--per-family", {"type": int, "default": 100}), ("--seed", {"type": int, "default": 1}))
def dataset_generate(given) -> int:
    """Write generated records as Parquet."""
    from corpusforge.operators import generate

    rows = generate.corpus(_spark(), given.per_family, given.seed)
    rows.write.parquet(given.out)
    print(rows.count())
    return 0


@command("folder", ("--name", {"default": "corpus"}), ("--per-family", {"type": int, "default": 100}), ("--seed", {"type": int, "default": 1}), ("--rows-per-shard", {"type": int, "default": 50_000}))
def dataset_build(given) -> int:
    """Generate, clean, check, cap, deduplicate, shard and record a data set."""
    from corpusforge.pipelines import generate_dataset

    made = generate_dataset(_spark(), given.folder, given.name, given.per_family, given.seed, rows_per_shard=given.rows_per_shard)
    return _told([("identity", made["identity"]), *made["funnel"].items()])


@command("folder")
def dataset_validate(given) -> int:
    """Records of shards that break a rule, the first 20 of them named."""
    from corpusforge.pipelines import validate_dataset

    n, broken, lines = validate_dataset(_records(given.folder))
    _told([(x,) for x in lines])
    print(f"{n} records, {broken} broken")
    return int(broken > 0)


@command("folder")
def dataset_verify(given) -> int:
    """Shards against their manifest, then ground truth and tool results again."""
    from corpusforge.pipelines import verify_dataset
    from corpusforge.sources.shards import verify_parent

    verify_parent(_spark(), given.folder, f"{given.folder}/manifest.json")
    return _told(verify_dataset(_records(given.folder)).orderBy("check", "outcome").collect(), lambda r: r["outcome"] == "ok")


@command("folder")
def dataset_stats(given) -> int:
    """The recorded statistics of a data set."""
    from corpusforge.sources.files import read_json

    print(json.dumps(read_json(_spark(), f"{given.folder}/stats.json"), indent=2, sort_keys=True, ensure_ascii=False))
    return 0


@command("folder", ("--per-family", {"type": int, "default": 30}), ("--seed", {"type": int, "default": 1}))
def dataset_eval_suites_build(given) -> int:
    """Write the held-out suites, refused if a case breaks a rule or isn't what its expression says."""
    from corpusforge.operators import generate
    from corpusforge.sources.shards import checked_suite, write_suite

    rows = []
    for k, name in enumerate(("held_out_a", "held_out_b")):
        cases = checked_suite(generate.held_out_suite(_spark(), given.per_family, given.seed + k, 1_000_000))
        rows.append((name, write_suite(cases, f"{given.folder}/{name}.json")))
    return _told(rows)


@command("folder", ("suites", {"nargs": "+"}))
def dataset_contamination_check(given) -> int:
    """Shards against evaluation suites and their own splits."""
    from corpusforge.pipelines import check_contamination
    from corpusforge.sources.shards import union_of_suites

    cases, missing = union_of_suites(_spark(), {Path(s).stem: s for s in given.suites})
    found = _told(check_contamination(_records(given.folder), cases).collect(), lambda r: r["clean"])
    return int(bool(found or missing))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (handler, options) in COMMANDS.items():
        own = commands.add_parser(name, help=handler.__doc__)
        for option, more in options:
            own.add_argument(option, **more)
    given = parser.parse_args(arguments)
    return COMMANDS[given.command][0](given)


if __name__ == "__main__":
    sys.exit(main())
