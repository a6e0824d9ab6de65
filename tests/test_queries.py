import os

import duckdb
import pytest

import __spark_entry__ as entry
from epochlake.plans import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.queries())
def test_against_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_the_mapping_catches_the_usual_mistakes(spark, sf_dir):
    from epochlake.operators import changelog
    from epochlake.plans.mapping import durable_epoch_of, events_log

    log = events_log(spark, sf_dir)
    kept = changelog.durable(log, durable_epoch_of(log))
    assert changelog.snapshot(log, durable_epoch_of(log)).count() == 176
    assert changelog.live(changelog.latest(kept)).count() == 193  # cutoffs ignored
    risen = changelog.latest(changelog.drop_cleared(kept.filter("entry_type <> 'remove_entry'"), changelog.cutoffs(kept)))
    assert risen.count() == 209  # deletes dropped first


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 176
    assert set(entry.oracle_sql()) <= set(entry.queries())
