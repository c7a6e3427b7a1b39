"""Decontamination, centroid clustering and cross-tokenizer alignment against plain versions, and on awkward rows."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from kinelake.llm import alignment, centroids, decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, item_id string, term int, text_key string, n_words double"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items, window):
    out = []
    for i, text in docs:
        own, hit, names = words(text), set(), set()
        for name, other in items:
            want = words(other)
            n = min(window, len(want))
            grams = {tuple(want[k : k + n]) for k in range(len(want) - n + 1)} if n else set()
            for k in range(len(own) - n + 1):
                if n and tuple(own[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    names |= {name} - {None}
        out.append((i, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(rng.choice(["a", "b", "c", "É", "é", "K"], n))  # noqa: E731 - few words, so windows meet by chance too
    items = [(str(i), word(int(n))) for i, n in enumerate(rng.integers(0, 14, 12))] + [("7", "zeta Eta, theta"), ("10", "a"), (None, "iota kappa"), ("12", None), ("13", ""), ("14", "absent words here"), ("15", "zeta eta THETA")]
    docs = [(i, word(int(n))) for i, n in enumerate(rng.integers(0, 60, 40))]
    docs += [(50, None), (51, ""), (52, "--"), (53, "zeta.Eta theta zeta eta theta iota\nkappa"), (53, "zeta.Eta theta zeta eta theta iota\nkappa"), (54, "x " * 3000 + "ZETA eta theta"), (None, "zeta eta theta"), (None, None), (55, " ".join(w for _, t in items[:6] for w in (t or "").split()))]
    given = spark.createDataFrame([(i, t, "q", 1, "k", 2.0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, doc_id int")
    got = decontamination.scan(given, bench, window=4)
    assert sorted(map(tuple, got.collect()), key=repr) == contaminated(docs, items, 4)
    assert decontamination.scan(given.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in decontamination.scan(given, bench.limit(0)).collect())


def test_decontamination_shuffles_what_is_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    docs, items = [(i, f"one two three four five {i % 3} six") for i in range(30)], [("x", "two three four five"), ("y", "five 1 six")]
    got = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=3)
    assert sorted(map(tuple, got.collect()), key=repr) == contaminated(docs, items, 3)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y y gamma alpha"), (2, "gamma beta alpha"), (3, "alpha x x x x x x beta gamma"), (4, "beta gamma"), (None, "q beta gamma alpha")], "doc_id long, text string")
    items = decontamination.Items(spark.createDataFrame([("i", "Alpha beta gamma")], "item_id string, text string"))
    got = {(r.doc_id, r.start, r.end) for r in decontamination.near_matches(decontamination.index(docs, items), items, span=6).collect()}
    assert {(1, 0, 5), (2, 0, 2), (None, 1, 3)} <= got and not {3, 4} & {i for i, _, _ in got}
    assert all(e - s < 6 for _, s, e in got)


def lloyd(rows, k, rounds):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], object)
    order = sorted(range(len(rows)), key=lambda n: (ids[n] is None, hashlib.sha256(f"2:{ids[n]}".encode()).hexdigest(), list(v[n])))[:k]
    c = [list(v[n]) for n in order]
    near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), n) for n, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for x in v]
        for n in range(len(c)):
            held = [x for x, o in zip(v, own, strict=True) if o == n]
            if held:
                c[n] = [sum(d) // len(held) for d in zip(*held, strict=True)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in zip(ids, v, strict=True)), key=repr)


@pytest.mark.parametrize("k, spread", [(5, 1.0), (7, 1e4), (60, 0.02)])
def test_centroids(spark, k, spread):
    rng = np.random.default_rng(k)
    at = rng.normal(size=(5, 4)) * 8
    raw = [(int(i), [float(x) for x in (at[i % 5] + rng.normal(size=4)) * spread]) for i in range(300)] + [(7, [0.0, 0.0, 0.0, 0.0])] * 3
    odd = [(900, None), (901, [1.0, 2.0, 3.0]), (902, [1.0, None, 3.0, 4.0]), (903, [1.0, float("nan"), 3.0, 4.0]), (904, [1.0, float("inf"), 3.0, 4.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in raw + odd], "vec_id long, embedding array<double>, cluster int, v int")
    out, _, scans = centroids.cluster(df, k=k, rounds=5, dims=4, scale=256)
    whole = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in raw]
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=repr) == lloyd(whole, k, 5)
    assert scans[0] == len(raw) and (k > 7 or scans[-1] < len(raw) / 2)  # the bounds decide most where clusters are apart
    assert centroids.digest(df.limit(0)).count() == 0 and centroids.digest(df).count() == 0


def test_shrink_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(4)
    for _ in range(300):
        centre, old, new = rng.normal(size=3) * 3, rng.normal(size=(1, 3)) * 3, rng.normal(size=(1, 3)) * 3
        radius = rng.uniform(0, 2)
        x = rng.normal(size=(400, 3))
        x = centre + radius * x / np.linalg.norm(x, axis=1)[:, None]
        loss = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        assert loss <= centroids.shrink(centre, radius, old, new)[0] <= np.linalg.norm(new - old) * (1 + 1e-8) + 1e-8


def test_far_components_are_held_and_few_vectors_are_few_centroids(spark):
    df = spark.createDataFrame([(i, [1e300 if i % 2 else -1e300] * 64) for i in range(6)] + [(None, [0.5] * 64)], "vec_id long, embedding array<double>")
    got = centroids.digest(df).collect()
    assert len(got) == 7 and {r.distance for r in got} == {0} and len({r.cluster for r in got}) == 3


def plain(rows):
    voc, per, count = alignment.loaded(A, B), [], Counter()
    for i, text in rows:
        a = voc.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b, whole = voc.b.encode(text) if text else [], b" " + (text or "").encode()
        if not text or b"".join(voc.a_bytes[x] for x in a) != whole or b"".join(voc.b_bytes[x] for x in b) != whole:
            per.append((i, 0, 0, [], [], None))
            continue
        ends = [dict(zip(np.cumsum([len(v[x]) for x in s]).tolist(), s, strict=True)) for s, v in ((a, voc.a_bytes), (b, voc.b_bytes))]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        groups = ["|".join(",".join(str(t) for e, t in side.items() if lo < e <= hi) for side in ends) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(ends[0][e], ends[1][e]) for e in cuts]
        count.update(links)
        per.append((i, len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, a, b, len(g), len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), s or "") for i, a, b, g, l, s in per), key=repr)


def test_alignment(spark):
    odd = ["  two  spaces\n\n x", "<s> </s> <|endoftext|> a", "tab\tx y z 　w", "under ▁ score", "café au lait 1,000 it's don't", "", " ", "\n", " a", "a ", "日本語 テキスト ok", "\U0001f600 \U0001f600", "e ́x", "x" * 5000, "ﬁ ①", None, "nul\x00 byte"]
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("text").collect()
    rows = [(i, t) for i, t in enumerate(odd + [r.text for r in texts])] + [(None, "no id"), (4, odd[4]), (4, odd[4])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    got = alignment.digest(df, A, B)
    assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr) == plain(rows)
    assert alignment.digest(df.limit(0), A, B).count() == 0
    spans = [r for r in alignment.groups(df.where("doc_id = 0"), A, B).orderBy("start").collect()]
    voc = alignment.loaded(A, B)
    whole = b" " + odd[0].encode()
    assert [r.start for r in spans] == [0, *(r.end for r in spans[:-1])] and spans[-1].end == len(whole)
    for r in spans:
        assert b"".join(voc.a_bytes[x] for x in r.a_ids) == b"".join(voc.b_bytes[x] for x in r.b_ids) == whole[r.start : r.end]


def test_groups_and_overlaps():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 2, 7, 9])
    group = alignment.coalesced(np.r_[0, a[:-1], 0, b[:-1]], np.r_[a, b])
    assert group.tolist() == [0, 1, 1, 1, 0, 0, 1, 1]
    assert list(zip(*map(np.ndarray.tolist, alignment.overlaps(a, b)), strict=True)) == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 2), (3, 3)]


def test_packed_links_are_those_of_the_ids(spark):
    texts = ["café au lait 1,000", None, "", "日本語 x", "the the the \U0001f600", "　w  two", "x" * 3000] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    pairs, packed = alignment.loaded(A, B).pairs, alignment.pack(df, A, B).collect()
    assert (np.diff(pairs) > 0).all() and len(pairs) <= alignment.loaded(A, B).most_pairs()
    ids = {r.doc_id: list(zip(r.a_ids, r.b_ids, strict=True)) for r in alignment.align(df, A, B).collect()}
    links = {r.doc_id: np.frombuffer(r.links, "<i4") for r in packed}
    assert {i: [(int(c) & 0xFFFFFFFF, int(c) >> 32) for c in pairs[x]] for i, x in links.items()} == ids and len(ids[0]) > 5
    count = Counter()
    for r in packed:
        count.update(dict(zip(r.pair, r.pair_n, strict=True)))
    assert count == Counter(np.concatenate(list(links.values())).tolist())
    assert {r.pair: r.n for r in alignment.pair_counts(alignment.pack(df, A, B)).collect()} == count


def test_batches_of_many_links_are_looked_up_in_bounded_memory():
    rng, docs, many = np.random.default_rng(3), 10_000, 800  # as many rows as Spark's batches hold
    n, links = rng.integers(1, 9, 5000), rng.integers(0, 5000, docs * many).astype("<i4")
    at = np.arange(docs + 1, dtype=np.int32) * (4 * many)
    column = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(at), pa.py_buffer(links)])
    same = pa.array(np.arange(docs))
    batch = pa.RecordBatch.from_pydict({"doc_id": same, "n_a": same, "n_b": same, "n_groups": same, "links": column, "groups_sha256": pa.array([""] * docs)})
    tracemalloc.start()
    got = list(alignment.summed([batch], n, n > 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # whole, each array of eight bytes a link has 64 MB
    whole = pa.Table.from_batches(got)
    assert whole["doc_id"].to_pylist() == list(range(docs)) and set(whole["n_links"].to_pylist()) == {many}
    assert whole["count_sum"].to_pylist() == n[links].reshape(docs, many).sum(1).tolist() and whole["n_best"].to_pylist() == (n > 4)[links].reshape(docs, many).sum(1).tolist()
