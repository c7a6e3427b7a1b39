"""The network against plain loops and numeric gradients; the forest's out-of-bag votes against a plain replay."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import bagging, bundle, fit, network, score, sequence, signal
from kinelake.sources import readers

SHAPE = network.Shape(("a", "b", "c"), widths=(4, 6), depth=1, kernel=3, pool=2, hidden=5)


def plain(w, shape, x):
    """One window (3, samples), a sample and channel at a time."""

    def conv(h, weight, bias):
        length, channels, k = len(h), len(h[0]), shape.kernel
        return [[bias[o] + sum(h[t + j - k // 2][c] * weight[c * k + j][o] for c in range(channels) for j in range(k) if 0 <= t + j - k // 2 < length) for o in range(len(bias))] for t in range(length)]

    def active(h, g, c):
        return [[max(0.0, v * g[i] + c[i]) for i, v in enumerate(row)] for row in h]

    h = conv([list(r) for r in x.T], w["stem.w"], w["stem.b"])
    for s in range(len(shape.widths)):
        for d in range(shape.depth):
            n = f"{s}.{d}."
            v = conv(active(conv(active(h, w[n + "g1"], w[n + "c1"]), w[n + "w1"], w[n + "b1"]), w[n + "g2"], w[n + "c2"]), w[n + "w2"], w[n + "b2"])
            side = (np.array(h) @ w[n + "skip"]).tolist() if n + "skip" in w else h
            h = [[p + q for p, q in zip(a, b, strict=True)] for a, b in zip(v, side, strict=True)]
        if len(h) >= shape.pool:
            h = [[sum(h[t * shape.pool + j][c] for j in range(shape.pool)) / shape.pool for c in range(len(h[0]))] for t in range(len(h) // shape.pool)]
    m = [sum(r[c] for r in h) / len(h) for c in range(len(h[0]))]
    u = [max(0.0, sum(m[i] * w["hidden.w"][i][j] for i in range(len(m))) + w["hidden.b"][j]) for j in range(shape.hidden)]
    return [sum(u[i] * w["out.w"][i][j] for i in range(len(u))) + w["out.b"][j] for j in range(len(shape.labels))]


def test_forward_equals_plain_loops_and_gradients_are_right():
    rng, w = np.random.default_rng(1), network.start(SHAPE, 3)
    w = {k: v + rng.normal(0, 0.1, v.shape) for k, v in w.items()}
    x = rng.normal(size=(4, 3, 9))
    np.testing.assert_allclose(network.forward(w, SHAPE, x), [plain(w, SHAPE, v) for v in x], atol=1e-10)
    code, weight, tape = np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 0.5]), []
    _, d = network.loss(network.forward(w, SHAPE, x, tape), code, weight)
    got, at = network.flat(network.backward(w, SHAPE, tape, d)), network.flat(w)
    value = lambda v: network.loss(network.forward(network.shaped(v, SHAPE), SHAPE, x), code, weight)[0]
    for i in rng.choice(len(at), 60, replace=False):
        e = np.zeros(len(at))
        e[i] = 1e-6
        assert (value(at + e) - value(at - e)) / 2e-6 == pytest.approx(got[i], abs=1e-5)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        k = i % 3
        v = np.sin(np.arange(20) * (k + 1) * 0.7 + rng.uniform(0, 6)) + rng.normal(0, 0.2, (3, 20))
        rows.append((f"s{i % 12}", i, *(v[c].tolist() for c in range(3)), "abc"[k]))
    rows += [("s1", 999, None, None, None, "a"), ("s1", 998, [1.0, float("nan")], [0.0, 1.0], [0.0, 1.0], "b"), ("s2", 997, [1.0], [1.0], [1.0], None)]
    return spark.createDataFrame(rows, "subject_id string, idx long, x array<double>, y array<double>, z array<double>, label string").repartition(5)


def test_gradients_do_not_hang_on_partitions(spark, windows, monkeypatch):
    rows = windows.where("label is not null and idx < 900").withColumn("code", (F.ascii("label") - 97).cast("int")).cache()
    w, weight = network.start(SHAPE, 3), np.array([1.0, 2.0, 0.5])
    one, value, mass = network.gradient(rows.coalesce(1), w, SHAPE, weight)
    monkeypatch.setattr(network, "FAN", 2)
    many, other, heavy = network.gradient(rows.repartition(7), w, SHAPE, weight)
    np.testing.assert_allclose(many, one, rtol=1e-9, atol=1e-9)
    assert other == pytest.approx(value, rel=1e-12) and heavy == mass == 80 * 3.5


def test_training_learns_goes_on_and_scores(spark, windows, tmp_path):
    whole, history = network.train(windows, SHAPE, str(tmp_path / "one"), epochs=8, batches=2, rate=0.02, percent=30)
    network.train(windows, SHAPE, str(tmp_path / "two"), epochs=3, batches=2, rate=0.02, percent=30)
    again, more = network.train(windows, SHAPE, str(tmp_path / "two"), epochs=8, batches=2, rate=0.02, percent=30)  # goes on from the third
    assert np.allclose(more, history) and history[-1][0] < history[0][0] / 2
    np.testing.assert_allclose(network.flat(again), network.flat(whole), rtol=1e-6, atol=1e-9)
    loaded, shape, *_ = network.load(spark, str(tmp_path / "one/best"))
    got = network.scorer(loaded, shape)(windows.withColumnRenamed("label", "true")).collect()
    assert sum(r.label == r.true for r in got if r.idx < 900) > 200 and all(r.label is None for r in got if r.idx in (998, 999))


def forest_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "yes" if i % 5 == 0 else "no", float(rng.normal(2 if i % 5 == 0 else 0)), float(rng.normal()), float(rng.normal(1 if i % 5 == 0 else 0))) for i in range(400)]
    return rows, spark.createDataFrame(rows + [(900, "no", None, 1.0, 1.0), (901, None, 1.0, 1.0, 1.0)], "id long, label string, a double, b double, c double").repartition(4)


def test_out_of_bag_votes_equal_a_replay(spark, tmp_path):
    rows, df = forest_rows(spark)
    model = bagging.fit(df, ["a", "b", "c"], "label", ["id"], trees=12, depth=3, bins=8)
    got = {r.id: r for r in bagging.predict(model, df, ["id"], label="label").collect()}
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    mean = {"no": 80 / 320, "yes": 1.0}
    for i, label, *values in rows:
        bins = [sum(e < v for e in model.edges[k]) for k, v in enumerate(values)]
        total, seen = np.zeros(2), 0
        for t in range(12):
            if bagging.draws(np.array([keys[i]]), t, 42, np.array([mean[label]]))[0]:
                continue
            node = 0
            while node in model.splits[t]:
                f, b = model.splits[t][node]
                node = 2 * node + 1 + (bins[f] > b)
            total, seen = total + model.leaves[t][node], seen + 1
        assert got[i].trees == seen and (got[i].probability is None) == (seen == 0)
        if seen:
            np.testing.assert_allclose(got[i].probability, total / seen)
    judged = [(label, got[i].label_pred) for i, label, *_ in rows if got[i].label_pred]
    assert np.mean([a == b for a, b in judged if a == "yes"]) > 0.7 and np.mean([a == b for a, b in judged if a == "no"]) > 0.7
    assert got[900].label_pred is None and got[901].trees == 12
    bagging.save(spark, model, str(tmp_path / "f"))
    assert bagging.load(spark, str(tmp_path / "f")) == model


def test_splits_are_the_best_of_those_offered(spark):
    rows, df = forest_rows(spark)
    model = bagging.fit(df, ["a", "b", "c"], "label", ["id"], trees=2, depth=2, bins=8, take=3)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    gini = lambda c: c.sum() - (c**2).sum() / max(c.sum(), 1)
    for t in range(2):
        own = [(label == "yes", [sum(e < v for e in model.edges[k]) for k, v in enumerate(values)], int(bagging.draws(np.array([keys[i]]), t, 42, np.array([1.0 if label == "yes" else 0.25]))[0])) for i, label, *values in rows]
        count = lambda some: np.array([sum(n for y, _, n in some if y == k) for k in (False, True)], float)
        best = max(gini(count(own)) - gini(count([r for r in own if r[1][f] <= b])) - gini(count([r for r in own if r[1][f] > b])) for f in range(3) for b in range(8))
        f, b = model.splits[t][0]
        assert gini(count(own)) - gini(count([r for r in own if r[1][f] <= b])) - gini(count([r for r in own if r[1][f] > b])) == pytest.approx(best)
        assert math.isclose(sum(model.leaves[t][0]), 1)


def test_balanced_folds_equal_a_replay_and_beat_dealing(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{u}", "xyz"[int(k)]) for u in range(23) for k in rng.choice(3, int(rng.integers(1, 60)), p=rng.dirichlet([0.4, 0.4, 0.4]))]
    df = spark.createDataFrame(rows, "u string, label string")
    got = {r.u: r.fold for r in fit.balanced_folds(df, "u", "label", 4).collect()}
    users = sorted(got)
    counts = {u: np.array([sum(a == u and b == k for a, b in rows) for k in "xyz"], float) for u in users}
    total, folds, want = sum(counts.values()), [np.zeros(3) for _ in range(4)], {}
    for u in sorted(users, key=lambda u: (-counts[u].std(), u)):
        cost = [round(float(np.mean(np.std([(f + (counts[u] if i == k else 0)) / total for i, f in enumerate(folds)], axis=0))), 12) for k in range(4)]
        k = min(range(4), key=lambda k: (cost[k], folds[k].sum(), k))
        folds[k], want[u] = folds[k] + counts[u], k
    assert got == want
    spread = lambda where: np.std([sum(counts[u] for u in users if where[u] == k) / total for k in range(4)], axis=0).mean()
    assert spread(got) <= spread({r.u: r.fold for r in fit.stratified_folds(df, "u", "label", 4).collect()})


def test_shuffle_splits_hold_whole_subjects_out(spark):
    df = spark.createDataFrame([(i % 11, i) for i in range(100)], "u int, v int")
    rows = fit.shuffle_split(df, "u", 3, 0.2).collect()
    assert [sum(r.split == k for r in rows) for k in range(3)] == [3, 3, 3] and len({frozenset(r.u for r in rows if r.split == k) for k in range(3)}) > 1


def test_lines_are_numbered_without_gathering_a_file(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 17)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = readers._lines(spark, f"{tmp_path}/*.csv")
        rows = lines.collect()
        assert len(rows) == 3017 and all(r.value == f"{r.path.rsplit('/', 1)[1][0]}{r.n}" for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_low_pass_in_chunks_equals_whole_runs(spark):
    rng, rows = np.random.default_rng(9), []
    for name, n in (("a", 1000), ("b", 7), ("c", 300)):
        x, y = rng.normal(size=n), rng.normal(size=n)
        for at in ((100, 130), (399, 400), (400, 401), (620, 1000 if name == "a" else 0)):
            x[at[0] : at[1]] = np.nan
        rows += [(name, i * 10_000, None if np.isnan(p) else float(p), float(q), i) for i, (p, q) in enumerate(zip(x, y, strict=True)) if not (name == "c" and 150 <= i < 260)]
    df = spark.createDataFrame(rows, "subject_id string, us long, x double, y double, other int").repartition(3)
    got = {(r.subject_id, r.us): r for r in signal.low_pass(df, ["x", "y"], 20, 100, chunk_us=500_000).collect()}
    sections = signal.butterworth(8, 20, 100)
    once = lambda v: [v := signal.Cascade([s]).run(v)[0] for s in sections][-1]  # noqa: E731, F841
    for name in "abc":
        own = [r for r in rows if r[0] == name]
        for k, c in ((2, "x"), (3, "y")):
            v = np.array([np.nan if r[k] is None else r[k] for r in own])
            edge = np.flatnonzero(np.diff(np.r_[False, np.isfinite(v), False].astype(int)))
            for lo, hi in zip(edge[::2], edge[1::2], strict=True):
                v[lo:hi] = once(once(v[lo:hi])[::-1])[::-1]
            made = np.array([np.nan if (z := getattr(got[name, r[1]], c)) is None else z for r in own])
            np.testing.assert_allclose(made, v, atol=1e-9)
    assert len(got) == len(rows) and all(got[r[0], r[1]].other == r[4] for r in rows)


def test_bundles_come_back_and_damage_is_an_error(spark, tmp_path):
    labels = score.SCHEMES["four"]
    smoother = sequence.HiddenMarkov(labels, np.full(4, 0.25), np.eye(4) * 0.6 + 0.1, np.eye(4) * 0.6 + 0.1)
    shape = network.Shape(tuple(labels), widths=(4,), kernel=3, pool=2, hidden=4)
    rng = np.random.default_rng(1)
    windows = spark.createDataFrame([(f"s{i % 3}", i * 1000, *(rng.normal(size=12).tolist() for _ in range(3)), labels[i % 4]) for i in range(40)], "subject_id string, epoch_us long, x array<double>, y array<double>, z array<double>, true string")
    names = ["mean", "sd", "zRange"]
    forest = bagging.fit(score.array_features(windows), names, "true", ["subject_id", "epoch_us"], trees=4, depth=2, bins=4)
    for k, classifier in enumerate((forest, (network.start(shape, 2), shape), "threshold")):
        made = bundle.Bundle(classifier, "four", 15.0, smoother, "2.1")
        bundle.save(spark, made, f"{tmp_path}/{k}")
        back = bundle.load(spark, f"{tmp_path}/{k}")
        assert back.to_text() == made.to_text() and back.labels == labels and back.epoch_s == 15.0
        want, got = (sorted((r.epoch_us, r.label) for r in b.scorer()(score.window_enmo(windows)).collect()) for b in (made, back))
        assert got == want and len(got) == 40 and {x for _, x in got} <= set(labels)
    text = bundle.Bundle("threshold", "four").to_text()
    for bad in (text.replace("four", "foul"), text[:-2] + " }", "{}", "nothing", text.replace('"form": 1', '"form": 9')):
        with pytest.raises(ValueError):
            bundle.Bundle.from_text(bad)
