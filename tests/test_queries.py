"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from kinelake.plans import modelling, registry, round_trips  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return made


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    if name not in registry.ORACLES:
        assert got.num_rows > 0
        return
    db.register("got", got)
    db.execute(f"create or replace temp table want as {registry.ORACLES[name]}")
    assert sorted(got.column_names) == sorted(r[0] for r in db.execute("describe want").fetchall())
    columns = ", ".join(f'"{c}"' for c in got.column_names)
    for a, b in (("got", "want"), ("want", "got")):
        assert db.execute(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []
