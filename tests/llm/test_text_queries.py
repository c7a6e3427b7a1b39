"""Text queries on the smallest tables: columns of each, and SQL where there is some."""

import duckdb
import numpy as np
import pytest

from kinelake.llm import queries

SF = "/root/testdata/sf0.001"
#: First columns of each query.
COLUMNS = {
    "op1": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3": "page_id host path rule verdict",
    "op4": "doc_id held_out score predicted",
    "op5": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "query_id rank vec_id score",
    "op9": "doc_id n_shingles component_id kept",
    "op10": "doc_id held_out lang_pred score",
    "op11": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op12": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    wanted = COLUMNS[name.split("_")[0]].split()
    assert got.column_names[: len(wanted)] == wanted and got.num_rows > 0
    if name in queries.ORACLES:
        db = duckdb.connect()
        for table in ("documents", "pages", "embeddings", "labels", "benchmark"):
            db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        db.register("got", got)
        db.execute(f"create temp table want as {queries.ORACLES[name]}")
        columns = ", ".join(f'"{c}"' for c in got.column_names)
        for a, b in (("got", "want"), ("want", "got")):
            assert db.execute(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_of_neighbours(spark, size):
    got = queries.QUERIES["op8_collision_counting"](spark, SF.replace("0.001", size)).collect()
    table = spark.read.parquet(f"{SF.replace('0.001', size)}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    asked = {int(i): np.sqrt(np.square(vectors - vectors[n]).sum(axis=1)) for n, i in enumerate(ids) if i % 100 == 0}
    hit = 0
    for r in got:
        assert r.score == pytest.approx(asked[r.query_id][np.flatnonzero(ids == r.vec_id)[0]], rel=1e-12)
    for i, distance in asked.items():
        want = ids[np.lexsort((ids, np.where(ids == i, np.inf, distance)))][:10]
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == i)
        assert [x for x, _ in own] == list(range(1, 11))
        hit += len({x for _, x in own} & set(want.tolist()))
    assert hit / (10 * len(asked)) >= 0.9
