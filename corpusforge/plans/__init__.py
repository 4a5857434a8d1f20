"""Physical-plan helpers: cut lineage in shared storage, rank and accumulate without a single hot task."""
