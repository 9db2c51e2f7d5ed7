"""Every registered query with SQL agrees with it; every other one yields rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

ENTRIES = contract.entries()
SLOW = {n for n, e in ENTRIES.items() if e.sql is None}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - SLOW))
def test_matches_sql(spark, con, sf, name):
    ok, note = compare(spark, con, ENTRIES[name], sf)
    assert ok, note


@pytest.mark.parametrize("name", sorted(SLOW))
def test_yields_rows(spark, sf, name):
    rows = ENTRIES[name].run(spark, sf).collect()
    assert rows
    for row in rows:
        for metric in ("accuracy", "precision", "recall", "f1_score", "specificity", "roc_auc", "pr_auc", "mean_score"):
            if metric in row and row[metric] is not None:
                assert 0 <= row[metric] <= 1 + 1e-9


def test_entry(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 22 and df.count() == 1500


def test_contract_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["classification_target", "standardised_table", "robust_scaled"])
def test_tasks_follow_the_rows(spark, sf, name, monkeypatch):
    """The tables that a query writes are cut by rows, as shuffle partitions are few and joined up by compressed size."""
    from mergescope import session
    from mergescope.catalog import preparation

    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    written, write = {}, preparation.materialise

    def noted(df, name="table", *args, **kwargs):
        written[name] = write(df, name, *args, **kwargs)
        return written[name]

    monkeypatch.setattr(preparation, "materialise", noted)
    settings = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ENTRIES[name].run(spark, sf)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(written["features"].inputFiles()) >= 50
    assert settings == {k: spark.conf.get(k) for k in settings}
