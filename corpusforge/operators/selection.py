"""Subsets selected from a data set and recorded: which records, why these, and the identities of what came out.

A selection is a frame of whole records and an audit of how it was made; a manifest tells its splits; both are small
documents that go beside the data.  Every selection is checked when it is made: a group that falls short is an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.calculator import canonical
from corpusforge.operators import sampling
from corpusforge.operators.stats import set_digest
from corpusforge.operators.subsets import representation_digest, union_of_sources
from corpusforge.plans.stage import staged
from corpusforge.sources.files import write_json

GROUPS = 10_000


@dataclass
class Selection:
    rows: DataFrame
    audit: dict[str, Any]
    parents: DataFrame | None = None
    replay: DataFrame | None = None
    facts: dict[str, Any] = field(default_factory=dict)


def _small(df: DataFrame) -> list[dict]:
    rows = [r.asDict() for r in df.limit(GROUPS + 1).collect()]
    if len(rows) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    return rows


def _counts(df: DataFrame, column: str) -> dict[str, int]:
    return {r[column]: r["n"] for r in _small(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(column))}


def _refuse_short(selected: DataFrame, targets: DataFrame, by: str) -> None:
    short = {r[by]: {"target": r["target"], "selected": r["selected"]} for r in _small(sampling.missed(selected, targets, by))}
    if short:
        raise ValueError(f"groups fall short of their targets: {short}")


def evenly(df: DataFrame, id: str, target: int, seed: int) -> Selection:
    """``target`` records evenly spaced in the order of ids (smoke subsets); more than there are is an error."""
    n = df.count()
    step, offset = sampling.stride(n, target, seed)
    everything = df.withColumn("_all", F.lit("all"))
    targets = df.sparkSession.createDataFrame([("all", n, target)], "_all string, available bigint, target bigint")
    rows = staged(sampling.stride_sample(everything, id, targets, "_all", seed))
    _refuse_short(rows, targets, "_all")
    return Selection(rows.drop("_all"), {"seed": seed, "target_examples": target, "parent_record_count": n, "stride": step, "offset": offset})


def by_tokens(df: DataFrame, id: str, category: str, tokens: str, target_tokens: int, floor: int, seed: int) -> Selection:
    """Records of every category in proportion to its tokens, for ``target_tokens`` in all, evenly spaced in each (pilot subsets)."""
    targets = staged(sampling.proportional_targets(df, category, tokens, target_tokens, floor))
    rows = staged(sampling.stride_sample(df, id, targets, category, seed))
    _refuse_short(rows, targets, category)
    told = {r[category]: r for r in _small(targets.orderBy(category))}
    steps = {c: sampling.stride(r["available"], r["target"], seed) for c, r in told.items() if r["target"]}
    by_category = {r[category]: r for r in _small(df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("t")).orderBy(category))}
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(tokens), F.lit(0)).alias("t")).first()
    return Selection(rows, {
        "seed": seed,
        "target_total_tokens": target_tokens,
        "min_category_examples": floor,
        "category_record_counts": {c: r["n"] for c, r in by_category.items()},
        "category_token_counts": {c: r["t"] for c, r in by_category.items()},
        "category_targets": {c: r["target"] for c, r in told.items()},
        "category_strides": {c: {"stride": s, "offset": o} for c, (s, o) in steps.items()},
        "category_selected_counts": _counts(rows, category),
        "total_selected_examples": whole["n"],
        "total_selected_tokens": whole["t"],
    })


def by_counts(df: DataFrame, id: str, category: str, per_category: int, weights: dict[str, float], fits: Column, context: int, seed: int) -> Selection:
    """The same number of records of every category, times its weight, evenly spaced with a reserve of which only those that fit are kept (fine-tuning subsets)."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col(category)], F.lit(1.0)) if weights else F.lit(1.0)
    counts = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("available"))
    targets = staged(counts.withColumn("target", F.greatest(F.lit(0), F.least(F.bround(weight * per_category, 0).cast("bigint"), "available"))))
    rows = staged(sampling.gated_sample(df.withColumn("_fits", fits), id, category, targets, F.col("_fits"), seed))
    _refuse_short(rows, targets, category)
    told = {r[category]: r for r in _small(targets.orderBy(category))}
    rejected = {r[category]: r["n"] for r in _small(sampling.passed_over(df.withColumn("_fits", fits), id, category, targets, F.col("_fits"), seed))}
    return Selection(rows.drop("_fits"), {
        "seed": seed,
        "max_sequence_length": context,
        "category_record_counts": {c: r["available"] for c, r in told.items()},
        "category_targets": {c: r["target"] for c, r in told.items()},
        "category_selected_counts": _counts(rows, category),
        "category_rejected_oversized": {c: rejected.get(c, 0) for c in told},
        "total_selected_examples": sum(r["target"] for r in told.values()),
        "total_rejected_oversized": sum(rejected.values()),
    })


def with_more(selection: Selection, more: dict[str, DataFrame], facts: dict[str, Any] = {}) -> Selection:  # noqa: B006
    """A selection with further records (augmented copies, curricula) of the same columns; its parents stay what was selected."""
    union = union_of_sources({"selected": selection.rows, **more}).drop("source")
    return Selection(union, selection.audit | facts, selection.parents or selection.rows, selection.replay)


def ids_sha256(df: DataFrame, id: str) -> str:
    return set_digest(df, id).first()["digest"]


def split_facts(selection: Selection, id: str, tokens: str = "token_count", ids: str | None = None, labels: str | None = None) -> dict[str, Any]:
    """What a manifest tells of one split; with ``ids, labels`` (columns of token ids and their labels) also the hash of the exact representation."""
    rows = selection.rows
    whole = rows.agg(
        F.count("*").alias("example_count"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_token_count"),
        F.count_if(F.coalesce("tool_required", F.lit(False))).alias("tool_required_count"),
        F.countDistinct("family_id").alias("family_count"),
    ).first()
    told = whole.asDict() | {"example_ids_sha256": ids_sha256(rows, id), "difficulty_counts": _counts(rows, "difficulty"), "category_counts": _counts(rows, "category"), "behavior_counts": _counts(rows, "expected_behavior")}
    told |= {k: v for k, v in selection.audit.items() if k in ("category_targets", "category_rejected_oversized", "stride", "offset", "target_examples", "parent_record_count")}
    if "category_token_counts" in selection.audit:
        told["category_token_counts_source"] = selection.audit["category_token_counts"]
    if ids and labels:
        told["parent_example_ids_sha256"] = ids_sha256(rows if selection.parents is None else selection.parents, id)
        told["representation_sha256"] = representation_digest(rows, id, ids, labels).first()["representation_sha256"]
        replay = rows.limit(0) if selection.replay is None else selection.replay
        told |= {"replay_example_count": replay.count(), "replay_example_ids_sha256": ids_sha256(replay, id), "replay_representation_sha256": representation_digest(replay, id, ids, ids).first()["representation_sha256"]}
    return told


def selection_identity(splits: dict[str, dict]) -> str:
    """Which parent records were selected: SHA-256 of the splits' sorted ``split:ids:replay ids`` lines."""
    lines = [f"{s}:{of['parent_example_ids_sha256']}:{of.get('replay_example_ids_sha256', '')}" for s, of in sorted(splits.items())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def representation_identity(manifest: dict) -> str:
    """Which token ids and labels came of them: SHA-256 of the canonical JSON of identities and representation hashes."""
    hashes = {s: {"sft": of["representation_sha256"], "replay": of.get("replay_representation_sha256")} for s, of in manifest["splits"].items()}
    told = {k: manifest[k] for k in ("parent_dataset_identity", "tokenizer_identity", "renderer_schema_version", "max_sequence_length")}
    return hashlib.sha256(canonical(told | {"selection_identity": selection_identity(manifest["splits"]), "splits": hashes}).encode()).hexdigest()


def manifest_of(splits: dict[str, dict], **facts: Any) -> dict[str, Any]:
    """A subset's manifest; with representation hashes in all splits also its two identities."""
    told = {"schema_version": "1.0.0", **facts, "splits": splits}
    if splits and all("representation_sha256" in of for of in splits.values()):
        told |= {"sft_identity": selection_identity(splits), "sft_representation_identity": representation_identity(told)}
    return told


def record(df: DataFrame, folder: str, name: str, manifest: dict, audits: dict[str, dict]) -> None:
    """Write ``name_manifest.json`` and ``name_selection_audit.json`` into a folder; ``df`` only lends its session."""
    write_json(df.sparkSession, f"{folder}/{name}_manifest.json", manifest)
    write_json(df.sparkSession, f"{folder}/{name}_selection_audit.json", audits)


def _parts(df: DataFrame, split: str) -> dict[str, DataFrame]:
    return {s: df.filter(F.col(split) == s) for s in ("train", "validation")}


def smoke_subset(df: DataFrame, id: str, split: str, targets: dict[str, int], seed: int, folder: str | None = None, **facts: Any) -> tuple[dict[str, Selection], dict]:
    """Evenly spaced records of each split, and their manifest, written to ``folder`` if one is given."""
    made = {s: evenly(part, id, targets[s], seed) for s, part in _parts(df, split).items() if s in targets}
    return _recorded(df, made, {s: split_facts(x, id) for s, x in made.items()}, folder, "smoke", seed=seed, **facts)


def pilot_subset(df: DataFrame, id: str, split: str, category: str, tokens: str, config: dict, seed: int, folder: str | None = None, **facts: Any) -> tuple[dict[str, Selection], dict]:
    """Training records for ``target_train_tokens`` and validation records for the tokens that ``validation_examples`` have on average, by category.

    ``config``: ``target_train_tokens, validation_examples, min_category_examples, min_category_examples_validation,
    max_sequence_length, pack_sequences``.
    """
    parts = _parts(df, split)
    mean = parts["validation"].filter(F.col(category).isNotNull()).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    wanted = round(mean["t"] / mean["n"] * config["validation_examples"]) if mean["n"] else 0
    made = {
        "train": by_tokens(parts["train"], id, category, tokens, config["target_train_tokens"], config["min_category_examples"], seed),
        "validation": by_tokens(parts["validation"], id, category, tokens, wanted, config["min_category_examples_validation"], seed),
    }
    told = {k: config[k] for k in ("max_sequence_length", "pack_sequences")}
    return _recorded(df, made, {s: split_facts(x, id, tokens) for s, x in made.items()}, folder, "pilot", seed=seed, **told, **facts)


def full_set(df: DataFrame, id: str, split: str, tokens: str, folder: str | None = None, **facts: Any) -> tuple[dict[str, Selection], dict]:
    """Whole splits, recorded as a subset is."""
    made = {s: Selection(part, {}) for s, part in _parts(df, split).items()}
    return _recorded(df, made, {s: split_facts(x, id, tokens) for s, x in made.items()}, folder, "full", **facts)


def tuning_subset(
    df: DataFrame,
    id: str,
    split: str,
    category: str,
    per_category: dict[str, int],
    weights: dict[str, float],
    fits: Column,
    context: int,
    seed: int,
    represent,
    curricula: dict[str, dict[str, DataFrame]] = {},  # noqa: B006
    replay: dict[str, DataFrame] = {},  # noqa: B006
    variants: int = 0,
    frames: list[str] = [],  # noqa: B006
    folder: str | None = None,
    **facts: Any,
) -> tuple[dict[str, Selection], dict]:
    """Records by category that fit the context, reframed copies and curricula, with the identity of their exact representation.

    ``represent`` gives a frame of records its columns ``input_ids`` and ``labels``; ``curricula`` are further records per
    split and name, ``replay`` records per split that are only recorded.
    """
    made, told = {}, {}
    for s, part in _parts(df, split).items():
        chosen = by_counts(part, id, category, per_category[s], weights, fits, context, seed)
        chosen.parents = chosen.rows
        more = dict(curricula.get(s, {}))
        if variants:
            allowed = ~F.coalesce("tool_required", F.lit(False)) & F.coalesce(F.col("answer_json") != "null", F.lit(False))
            more["reframed"] = sampling.augmented(chosen.rows, id, "prompt", allowed, frames, variants).filter("variant > 0").drop("variant")
        selection = with_more(chosen, more, {"direct_instruction_variants_per_parent": variants, "curricula": sorted(curricula.get(s, {}))})
        selection.rows = staged(represent(selection.rows))
        selection.replay = staged(represent(replay[s])) if s in replay else None
        selection.audit["total_examples_after_instruction_augmentation"] = selection.rows.count()
        made[s] = selection
        told[s] = split_facts(selection, id, ids="input_ids", labels="labels")
    facts = {"parent_dataset_identity": None, "tokenizer_identity": None, "renderer_schema_version": "1.0.0"} | facts
    return _recorded(df, made, told, folder, "sft", seed=seed, max_sequence_length=context, **facts)


def _recorded(df: DataFrame, made: dict[str, Selection], splits: dict[str, dict], folder: str | None, name: str, **facts: Any) -> tuple[dict[str, Selection], dict]:
    manifest = manifest_of(splits, **facts)
    if folder:
        record(df, folder, name, manifest, {s: x.audit for s, x in made.items()})
    return made, manifest
