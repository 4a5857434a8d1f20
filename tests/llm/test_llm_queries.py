"""The pN_ queries on whole small tables: against their SQL, else that they run; on empty tables they give no rows."""

import unicodedata

import pytest
from oracle import DATA, connect, same

from corpusforge.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, DATA)
    if name in oracle_sql():
        same(con, df, oracle_sql()[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = tmp_path_factory.getbasetemp() / "empty"
    if not folder.exists():
        for t in ("examples", "documents"):
            spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
        for t in ("phase0_v1", "pilot_subset_config", "category_mixture", "split_plan", "source_mix", "size_limits"):
            spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    rows = queries()[name](spark, str(folder)).collect()
    if name in ("p4_checks", "p5_found", "p5_shares", "p5_checks", "p7_found", "p7_shares", "p7_checks"):
        assert rows  # every target is short
    else:
        assert not rows


def test_compatibility_forms_are_those_of_the_sql(con):
    """The SQL's words hold for the forms it knows; no others are in the tables."""
    from corpusforge.llm.sql import _WIDE

    rows = con.sql("SELECT prompt FROM examples UNION ALL SELECT text FROM documents UNION ALL SELECT prompt FROM phase0_v1").fetchall()
    odd = {c for (t,) in rows if t for c in set(t) if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)}
    assert odd <= set(_WIDE) | {"…"}
