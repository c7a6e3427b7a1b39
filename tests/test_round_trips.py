"""Queries that write and read tables, against their SQL on tables that the smallest ones don't stand for: many rows of a subject, large keys, repeated times."""

import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinelake.operators import signal
from kinelake.plans import modelling, registry, round_trips  # noqa: F401
from kinelake.sources import devices, readers

START = "timestamp '2024-01-01 00:00:00'"


def against_sql(spark, folder, name, **tables):
    """Rows that only the query has, rows that only its SQL has, and how many the SQL has, over tables made by SQL."""
    db = duckdb.connect()
    for table, sql in tables.items():
        db.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    db.register("got", registry.QUERIES[name](spark, str(folder)).toArrow())
    db.execute(f"create temp table want as {registry.ORACLES[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in db.execute("describe want").fetchall())
    lost = [db.execute(f"select count(*) from (select {columns} from {a} except all select {columns} from {b})").fetchall()[0][0] for a, b in (("got", "want"), ("want", "got"))]
    return *lost, db.execute("select count(*) from want").fetchall()[0][0]


def test_device_blocks_of_a_long_recording(spark, tmp_path):
    """More samples than 32-bit microseconds hold at 100 a second."""
    events = f"select i as event_id, {START} + to_microseconds(i * 1000) as ts, i % 9 as user_id, 'view' as event_type, (i % 700) / 100 as value, '' as props from range(220000) t(i)"
    assert against_sql(spark, tmp_path, "device_blocks", events=events) == (0, 0, 220_000)


def test_blocks_written_as_they_come_equal_blocks_at_once(spark, tmp_path):
    rng, rows, own = np.random.default_rng(3), [], {}
    for name, n in (("a", 1000), ("b", 119), ("c", 240), ("d", 1)):
        us, xyz = 1_715_000_000_000_000 + np.arange(n) * 10_000, np.rint(rng.uniform(-1.9, 1.9, (n, 3)) * 256) / 256
        own[name] = us, xyz
        rows += [(name, int(t), *map(float, v)) for t, v in zip(us, xyz, strict=True)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "subject_id string, us long, x double, y double, z double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for wide in (False, True):
            made = {r.subject_id: r for r in devices.write_blocks(df, f"{tmp_path}/{wide}", 100.0, wide).collect()}
            for name, (us, xyz) in own.items():
                raw = (tmp_path / str(wide) / f"{name}.cwa").read_bytes()
                assert raw == devices.blocks_of(us, xyz, 100.0, wide) and made[name].bytes == len(raw)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_feature_source_of_large_keys(spark, tmp_path):
    part = "select unnest([0, 7, 999999, 1000000, 1199999, 123456789012, null]) as p_partkey, 5 as p_size, 900.25 as p_retailprice"
    assert against_sql(spark, tmp_path, "feature_source", part=part) == (0, 0, 7)


def test_parquet_source_of_repeated_times_and_large_numbers(spark, tmp_path):
    """All rows of a time stay, and numbers beyond 24 bits are whole."""
    events = f"select i + 30000000 as event_id, {START} + to_microseconds(i // 3) as ts, 1 as user_id, case when i % 2 = 0 then 'view' else 'click' end as event_type, i * 100.25 as value, '' as props from range(3000) t(i)"
    assert against_sql(spark, tmp_path, "parquet_source", events=events) == (0, 0, 3000)


def test_file_stems_take_no_time_in_the_length_of_a_path(spark):
    names = {"file:/a/b.c/p1.csv.gz": "p1", "p2": "p2", "/x/.hidden": "", "s3://k/s0.12.parquet": "s0", "/a/b/": "", "/a.b/c": "c", "": ""}
    far = {f"/{'a' * 600}/s{k}.parquet": f"s{k}" for k in range(300)}
    df = spark.createDataFrame(list((names | far).items()) + [(None, None)], "path string, want string")
    began = time.perf_counter()
    made = df.select(readers.stem(F.col("path")).alias("got"), "want").collect()
    assert len(made) == 308 and all(r.got == r.want for r in made) and time.perf_counter() - began < 8


def test_training_source_writes_and_reads_subjects_in_parallel(spark, tmp_path):
    """Files whose names are equal up to the first dot are one subject; each has as many writers as the events have parts."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        events = f"select i as event_id, {START} + to_microseconds(i * 1000) as ts, 1 as user_id, 'view' as event_type, hash(i) % 100000 / 100 as value, '' as props from range(60000) t(i)"
        assert against_sql(spark, tmp_path, "training_source", events=events) == (0, 0, 48_000)
        made = registry.QUERIES["training_source"](spark, str(tmp_path))
        assert {r.split("/")[-1].split(".")[0] for r in made.inputFiles()} == {"s0", "s1", "s2"} and len(made.inputFiles()) > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_low_pass_of_many_short_subjects(spark, tmp_path):
    """No call of Python for each subject, which took 0.1 s and more."""
    began = time.perf_counter()
    embeddings = "select i as vec_id, list_transform(range(64), lambda t: ((hash(i * 64 + t) % 2000) / 1000.0 - 1)::float) as embedding, 0 as label from range(3000) t(i)"
    assert against_sql(spark, tmp_path, "low_pass", embeddings=embeddings) == (0, 0, 192_000)
    assert time.perf_counter() - began < 45


def test_low_pass_of_chunks_longer_than_a_batch(spark):
    n = 600_000
    v = np.random.default_rng(4).normal(size=n)
    for lo, hi in ((0, 3), (1000, 1001), (262_140, 262_150), (500_000, 500_300)):
        v[lo:hi] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"us": np.arange(n) * 10_000, "x": v})).withColumns({"subject_id": F.lit(None).cast("string"), "x": F.when(~F.isnan("x"), F.col("x"))})
    got = signal.low_pass(df, ["x"], 20, 100).toPandas().sort_values("us")["x"].to_numpy(float)
    cascade = signal.Cascade(signal.butterworth(8, 20, 100))
    edge = np.flatnonzero(np.diff(np.r_[False, np.isfinite(v), False].astype(int)))
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        v[lo:hi] = cascade.run(cascade.run(v[lo:hi])[0][::-1])[0][::-1]
    np.testing.assert_allclose(got, v, atol=1e-9)


def test_runs_cut_anywhere_go_on_from_their_state():
    rng = np.random.default_rng(8)
    cascade = signal.Cascade(signal.butterworth(8, 20, 100))
    size = [1, 64, 300, 2, 700, 64, 64]
    group, v = np.repeat(np.arange(len(size)), size), rng.normal(size=sum(size))
    v[[0, 5, 200, 201, 600, 1194]] = np.nan
    given = {2: rng.normal(size=8), 5: rng.normal(size=8), 6: rng.normal(size=8)}
    want = v.copy()
    for g in range(len(size)):
        ok = np.isfinite(v) & (group == g)
        edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(int)))
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            want[lo:hi] = cascade.run(v[lo:hi], given.get(g) if lo == np.searchsorted(group, g) else None)[0]
    for cuts in ([], [1], [63, 64, 65], [300, 301, 600, 601], sorted(rng.choice(np.arange(1, len(v)), 40, replace=False))):
        own = signal._Column(cascade)
        got = [own.step(v[lo:hi], group[lo:hi], given)[0] for lo, hi in zip([0, *cuts], [*cuts, len(v)], strict=True)]
        np.testing.assert_allclose(np.concatenate(got), want, atol=1e-9)
