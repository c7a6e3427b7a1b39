"""Hand-computed cases of single operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import cli
from kinelake.functions import scalar
from kinelake.operators import circadian, epochs, evaluate, fit, impute, quality, score, sequence, signal, summary
from kinelake.plans import recording
from kinelake.sources import readers, writers
from kinelake.streaming.epochs import stream_epochs

S = scalar.SECOND


def series(spark, rows, schema="subject_id string, us long, value double"):
    return spark.createDataFrame(rows, schema)


def test_anchored_epochs_emit_empty_bins(spark):
    df = series(spark, [("a", t * S, 1.0) for t in (7, 8, 120)])
    got = [(r.epoch_us // S, r.n) for r in epochs.anchored_grid(df, 30, "value").orderBy("idx").collect()]
    assert got == [(7, 2), (37, 0), (67, 0), (97, 1)]


@pytest.mark.parametrize("first", [130, 135])
def test_nearest_grid_ties_go_to_the_later(spark, first):
    df = series(spark, [("a", (first + 30 * k) * S, float(k + 1)) for k in range(4)])
    grid = series(spark, [("a", 30 * k * S, None) for k in range(13)]).select("subject_id", "us")
    got = [r.value for r in epochs.nearest(grid, df, "value", 30).orderBy("us").collect()]
    assert got == [None] * 4 + [1, 2, 3, 4, 4] + [None] * 4


def test_fit_and_resize(spark):
    rows = spark.createDataFrame([([0.0, 1.0, 2.0],), ([float(i) for i in range(8)],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in rows.select(epochs.fit(F.col("v"), 5)).collect()] == [[0, 1, 2, 0, 1], [0, 1, 2, 3, 4], None]
    assert rows.select(epochs.resize(F.col("v"), 5)).first()[0] == [0, 0.5, 1, 1.5, 2]


def test_mode_counts_missing_labels_of_the_dictionary(spark):
    df = spark.createDataFrame([("s", 0, x) for x in ("a", "n", "n")] + [("s", 1, x) for x in ("b", "a", "b", "a")], "subject_id string, idx long, annotation string")
    book = spark.createDataFrame([("a", "a"), ("b", "b"), ("n", None)], "annotation string, label string")
    assert {r.idx: r.label for r in epochs.window_label(df, book, "annotation", "label").collect()} == {0: None, 1: "a"}


def test_imputation_levels_chain_and_keep_values(spark):
    week = 7 * scalar.DAY
    rows = [("a", 0, 4.0), ("a", scalar.DAY, None), ("a", week, None), ("a", 5 * scalar.DAY, None), ("a", 60 * S, None)]
    got = {r.us: r.value for r in impute.hierarchical(series(spark, rows), ["value"]).collect()}
    assert got == {0: 4.0, scalar.DAY: 4.0, week: 4.0, 5 * scalar.DAY: 4.0, 60 * S: None}


def test_ecdf_counts_missing_as_below(spark):
    df = series(spark, [("a", 0, 10.0), ("a", 1, None)])
    both = [summary.ecdf(df, "value", [5], missing_as_below=m).first().share for m in (True, False)]
    assert both == [0.5, 0.0] and len(summary.LEVELS) == 67


def test_wear_threshold_edges(spark):
    df = series(spark, [("a", h * scalar.HOUR, 1.0 if h < 12 else None) for h in range(24)])
    assert quality.blank_low_wear_days(df, ["value"], 3600, 12 * 3600).where("value is not null").count() == 12
    assert summary.daily_mean(df, {"value": "m"}, 3600, 12 * 60).first().m is None
    assert quality.wear_stats(df, ["value"], 3600).first().covers_24h == 0


def test_m10_l5_days(spark):
    day = lambda n: series(spark, [("a", h * scalar.HOUR, float(h % 24)) for h in range(24 * n)])
    assert circadian.m10_l5(day(1), "value", 3600).first().status == "NA_too_few_days"
    row = circadian.m10_l5(day(8), "value", 3600).first()
    assert (row.m10, row.l5) == (17.5, 2.0) and circadian.m10_l5(day(8), "value", 3600, include_last=True).first().m10 == 18.5


def test_psd_and_frequency_of_a_daily_wave(spark):
    df = series(spark, [("a", h * scalar.HOUR, math.cos(2 * math.pi * h / 24)) for h in range(240)])
    assert circadian.psd(df, F.col("value"), 3600).first().psd == pytest.approx(0.25)
    assert circadian.dominant_frequency(df, "value", 3600).first().frequency == pytest.approx(1.0, abs=5e-3)


def labels(spark, text):
    names = {"s": "sleep", "l": "light", ".": "sedentary", " ": None}
    return spark.createDataFrame([("a", i * 30 * S, names[c]) for i, c in enumerate(text)], "subject_id string, us long, label string")


def test_short_sleep_and_blocks(spark):
    got = sequence.remove_short_sleep(labels(spark, "ssl sss"), 3).orderBy("us").collect()
    assert [r.label for r in got] == ["sedentary"] * 2 + ["light", None] + ["sleep"] * 3
    blocks = sequence.sleep_blocks(labels(spark, "ss..s...s"), 3).orderBy("block").collect()
    assert [(r.first, r.last) for r in blocks] == [(0, 4), (8, 8)]


def test_single_block_only_turns_sleep_to_sedentary(spark):
    df = labels(spark, "lss.l" + "l" * 5 + "ssss" + "l" * 6 + "s" + "l" * 9)
    before, after = ([r.label for r in x.orderBy("us").collect()] for x in (df, sequence.single_sleep_block(df, 2, 20)))
    assert all(a == b or (a, b) == ("sleep", "sedentary") for a, b in zip(before, after, strict=True)) and after[10:14] == ["sleep"] * 4 and after[20] == "sedentary"


def test_viterbi_identity_and_gap(spark):
    eye = np.eye(3)
    hmm = sequence.HiddenMarkov(["light", "sedentary", "sleep"], np.full(3, 1 / 3), eye, np.full((3, 3), 1 / 3))
    codes = np.array([random.Random(1).randrange(3) for _ in range(200)])
    assert (hmm.decode(codes) == codes).all()
    sticky = sequence.HiddenMarkov.from_json(sequence.HiddenMarkov(hmm.labels, hmm.prior, eye * 0.7 + 0.1, eye * 0.97 + 0.01).to_json())
    df = labels(spark, "sssslsss").withColumn("us", F.col("us") + F.when(F.col("us") >= 120 * S, S).otherwise(0))
    got = [r.smoothed for r in sticky.smooth(df, "label", 30 * S).orderBy("us").collect()]
    assert got == ["sleep"] * 4 + ["light"] + ["sleep"] * 3


def test_transitions_filter_and_pseudo(spark):
    df = spark.createDataFrame([("a", t * S, "light") for t in (0, 30, 60, 120)], "subject_id string, us long, label string")
    assert sequence.transitions(df, "label", 30 * S).first().n == 2
    assert sequence.transitions(df, "label", 30 * S, ("sleep", "sedentary")).count() == 3


def test_metrics_and_t(spark):
    df = spark.createDataFrame([(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "b", "b")], "g int, y_true string, y_pred string")
    row = evaluate.metrics(evaluate.confusion(df, ["g"]), ["g"]).first()
    assert row.accuracy == 0.75 and row.kappa == 0.5 and row.balanced_accuracy == 0.75 and row.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)
    assert evaluate.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and evaluate.t_two_sided(0.0, 5) == 1.0


def test_functions(spark):
    assert scalar.seconds("12H") == 43200 and scalar.seconds("1h30min") == 5400
    with pytest.raises(ValueError):
        scalar.seconds("soon")
    assert scalar.java_pattern("%Y-%m-%d %H:%M:%S.%f") == "yyyy-MM-dd HH:mm:ss.SSSSSS"
    row = spark.range(1).select(scalar.zoned_local(F.lit("2014-05-07 13:29:50.439+0100 [Europe/London]")).cast("string"), scalar.capitalised(F.lit("light-ACT")), scalar.truth(F.lit(" Yes"))).first()
    assert tuple(row) == ("2014-05-07 13:29:50.439", "Light-act", True)
    header = ["t", "x", "y", "z"]
    for bad in ("0,1,2", "-1,1,2,3", "0,1,2,99"):
        with pytest.raises(ValueError):
            readers.column_indices(bad, header)
    with pytest.raises(ValueError):
        readers.kind_of("a.docx")


def test_csv_sources_and_sinks(spark, tmp_path):
    import lzma

    (tmp_path / "p1.csv").write_text("note\nHEADER,X,Y,Z\n07/05/2014 13:29:50.439000,1,nan,3\n07/05/2014 13:29:50.439000,9,9,9\n")
    args = {"columns": "HEADER,X,Y,Z", "start_row": 2, "date_format": "%d/%m/%Y %H:%M:%S.%f"}
    rows = readers.read_csv(spark, str(tmp_path / "p1.csv"), **args).collect()
    assert [(r.subject_id, r.x, r.y, r.z) for r in rows] == [("p1", 1.0, None, 3.0)]
    (tmp_path / "p2.csv.xz").write_bytes(lzma.compress(b"time,x,y,z\n2014-05-07 13:29:50.000000,1,2,3\n"))
    assert readers.read_recording(spark, str(tmp_path / "p2.csv.xz")).first().subject_id == "p2"
    tall = spark.createDataFrame([("a", "m", 1.0), ("b", "n", 2.0)], "subject_id string, metric string, value double")
    writers.write_summaries(summary.document(tall), str(tmp_path / "out"))
    (tmp_path / "own-outputSummary.json").write_text('{\n "k": 1,\n "m": 2\n}')
    assert sorted(readers.read_summaries(spark, str(tmp_path)).columns) == ["k", "m", "n"]


def test_csv_headers_of_a_glob_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x,y,z,more\n2014-05-07 13:29:50.000000,1,2,3,9\n")
    (tmp_path / "b.csv").write_text("time,x,y,z,other\n2014-05-07 13:29:50.000000,4,5,6,9\n")
    got = readers.read_csv(spark, str(tmp_path / "*.csv")).orderBy("subject_id").collect()
    assert [(r.subject_id, r.x, r.y, r.z) for r in got] == [("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)]
    (tmp_path / "c.csv").write_text("time,y,x,z,more\n2014-05-07 13:29:50.000000,1,2,3,9\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path / "*.csv")).collect()
    for name, axes in (("a", "x,y,z"), ("b", "y,x,z")):
        (tmp_path / f"{name}-late.csv").write_text(f"note\ntime,{axes}\n2014-05-07 13:29:50.000000,1,2,3\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(tmp_path / "*-late.csv"), start_row=2)


def test_recording_pipeline(spark):
    rng = random.Random(2)
    rows = [("a", int(i * S / 10), rng.gauss(0, 0.02), 0.0, 1.0 + (0.5 * rng.random() if i >= 600 else 0.0)) for i in range(1200)]
    samples = spark.createDataFrame(rows, "subject_id string, us long, x double, y double, z double")
    scorer = lambda w: w.withColumn("label", score.threshold_label("acc", [(50.0, "sleep")], "light"))
    got = score.predict_recording(samples, scorer, 30, 10, length=90, single_block=True).orderBy("us").collect()
    assert [r.label for r in got] == ["sleep", "sleep", "light", "light"]


def test_forest(spark):
    df = spark.createDataFrame([(float(i % 2) + i * 1e-3, "ab"[i % 2]) for i in range(60)], "f double, label string")
    model = score.fit_forest(df, ["f"], "label", trees=5, depth=3)
    assert score.predict_forest(model, df.drop("label"), "guess").join(df, "f").where("guess = label").count() == 60


def test_calibration_brings_still_means_to_the_sphere(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        v = rng.normal(size=3)
        v /= np.linalg.norm(v)
        for j in range(20):
            rows.append(("a", (k * 10) * S + j * S // 2, *(float(a * 1.05 + 0.03 + rng.normal() * 1e-4) for a in v)))
    df = spark.createDataFrame(rows, "subject_id string, us long, x double, y double, z double")
    off = lambda d: d.select(F.avg(F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 1))).first()[0]
    assert off(quality.calibrate(df)) < 0.005 < off(df)


def test_streaming_epochs(spark, tmp_path):
    src = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0), ("a", 40, 5.0)], "s string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    src.write.parquet(str(tmp_path / "in"))
    stream = stream_epochs(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts", "s", "v")
    q = stream.writeStream.format("memory").queryName("epochs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.mean) for r in spark.table("epochs").collect()) == [(1, 5.0), (2, 2.0)]


def test_resample_low_pass_and_augment(spark):
    df = series(spark, [("a", t * 10_000, math.sin(2 * math.pi * t / 100) + (0.5 if t % 2 else -0.5)) for t in range(400)])
    linear = signal.resample(series(spark, [("a", 0, 0.0), ("a", 10, 1.0), ("a", 25, None), ("a", 30, 5.0)]), ["value"], 5).orderBy("us").collect()
    assert [(r.us, r.value) for r in linear] == [(0, 0.0), (5, 0.5), (10, 1.0), (15, None), (20, None), (25, None), (30, 5.0)]
    smooth = [r.value for r in signal.low_pass(df, ["value"], 20, 100).orderBy("us").collect()]
    assert max(abs(v - math.sin(2 * math.pi * t / 100)) for t, v in enumerate(smooth) if 50 < t < 350) < 0.01
    w = spark.createDataFrame([("a", i, [1.0, 0.0, 2.0, 1.0], [0.0, 1.0, 2.0, 0.0], [0.0, 0.0, 1.0, 2.0]) for i in range(8)], "subject_id string, idx long, x array<double>, y array<double>, z array<double>")
    first = [(r.x[0] ** 2 + r.y[0] ** 2 + r.z[0] ** 2, len(r.x)) for r in signal.augment(w).collect()]
    assert all(n == pytest.approx(1.0) and k == 4 for n, k in first)


def test_ambiguous_hours(spark):
    end = 1414285200  # 2014-10-26 01:00 UTC: London repeats 01:00 to 02:00
    df = series(spark, [("a", (end + k * 1800) * S, 1.0) for k in range(-4, 5)])
    assert [r.us // S - end for r in signal.drop_ambiguous_hours(df, "Europe/London").orderBy("us").collect()] == [-7200, -5400, 3600, 5400, 7200]


def test_process_recordings(spark):
    still = (F.col("id") / 7200).cast("long") % 3 == 0
    samples = spark.range(30 * 3600).select(F.lit("a").alias("subject_id"), (F.col("id") * S).alias("us"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(still, 1.0).otherwise(1.2).alias("z"))
    scorer = lambda w: w.withColumn("label", score.threshold_label("acc", [(50.0, "sleep")], "light"))
    made = recording.process(samples, scorer, ["light", "sedentary", "sleep"], rate=1, epoch_s=60 * 30, least_sleep="30min", calibrate=False, nonwear=False)
    document = json.loads(made["summary"].orderBy("subject_id").first().summary)
    assert document["PredictOK"] == 1 and "light-hourOfWeekday-3-avg" in document and "acc-ecdf-2000mg" in document and made["daily"].count() == 2
    assert (document["Filename"], document["Device"], document["SampleRate"], document["ReadOK"], document["WearTime(days)"]) == ("a", "csv", 1, 1, 1.25)


def test_a_hole_is_not_worn_and_what_was_not_calibrated_says_so(spark):
    t = [k for k in range(3 * 3600) if not 3600 <= k < 7200]
    rng = np.random.default_rng(2)
    rows = [("a", k * S, *map(float, v)) for k, v in zip(t, rng.normal(0, 0.3, (len(t), 3)), strict=True)]
    scorer = lambda w: w.withColumn("label", score.threshold_label("acc", [(50.0, "sleep")], "light"))
    made = recording.process(spark.createDataFrame(rows, "subject_id string, us long, x double, y double, z double"), scorer, ["light", "sleep"], epoch_s=60, options={"scheme": "two"})
    document = json.loads(made["summary"].first().summary)
    assert document["NonwearTime(days)"] == pytest.approx(3599 / 86400, abs=3 / 86400) and document["WearTime(days)"] == pytest.approx(7201 / 86400, abs=3 / 86400)
    assert (document["CalibOK"], document["SampleRate"], document["ResampleRate"], document["Args"]) == (0, 1, 1, {"scheme": "two"})
    assert made["series"].where("acc is null").count() in (58, 59, 60)
    grid = signal.uniform(spark.createDataFrame([("a", 0, 1.0, 30), ("a", 40_000, 2.0, 30), ("a", 3_000_000, 3.0, 30)], "subject_id string, us long, v double, rate int"), ["v"], "rate").orderBy("us").collect()
    assert [r.us for r in grid] == [round(k * 1e6 / 30) for k in range(91)] and [r.v for r in grid[:3]] == [1.0, 2.0, 2.0] and grid[-1].v == 3.0
    assert [r.v for r in grid if 1_040_000 < r.us < 2_000_000] == [None] * sum(1_040_000 < r.us < 2_000_000 for r in grid)


def test_process_then_collate(spark, tmp_path):
    """Two recordings of different rates through the commands; one has two hours without wear."""
    rng = np.random.default_rng(8)
    for name, rate, hours in (("p1", 1, 9), ("p2", 2, 7)):
        n = rate * hours * 3600
        t, v = np.arange(n) / rate, rng.normal(0, 0.06, (n, 3)) + [0, 0, 1]
        if name == "p1":
            v[(t >= 3600) & (t < 3 * 3600)] = [0, 0, 1]
        stamps = np.datetime_as_string(np.datetime64("2024-03-01T10:00:00") + (t * 1e6).astype("timedelta64[us]"), unit="us")
        (tmp_path / f"{name}.csv").write_text("time,x,y,z\n" + "".join(f"{s.replace('T', ' ')},{a:.4f},{b:.4f},{c:.4f}\n" for s, (a, b, c) in zip(stamps, v, strict=True)))
    out = str(tmp_path / "out")
    cli.main(["process", f"{tmp_path}/*.csv", "-o", out, "--no-calibration", "-q"])
    cli.main(["collate", out, "-o", str(tmp_path / "all")])
    rows = {r.Filename: r for r in spark.read.option("header", True).csv(str(tmp_path / "all")).collect()}
    assert {k: (r.SampleRate, r.Device, r.ReadOK, r.PredictOK) for k, r in rows.items()} == {"p1": ("1", ".csv", "1", "1.0"), "p2": ("2", ".csv", "1", "1.0")}
    assert float(rows["p1"]["NonwearTime(days)"]) == pytest.approx(2 / 24, abs=1e-4) and float(rows["p2"]["NonwearTime(days)"]) == 0 and float(rows["p2"]["WearTime(days)"]) == pytest.approx(7 / 24, abs=1e-4)
    assert {"acc-overall-avg", "sleep-week-avg", "acc-ecdf-1mg"} <= set(rows["p1"].asDict())
    series = readers.read_series(spark, f"{out}/series", score.SCHEMES["four"])
    assert series.where("subject_id = 'p1' and acc is null").count() == 240 and series.where("subject_id = 'p2'").count() == 7 * 120
    cli.main(["panels", f"{out}/series", "-o", str(tmp_path / "panels")])
    assert spark.read.parquet(str(tmp_path / "panels")).count() == 2
    with pytest.raises(ValueError, match="six|four"):
        cli.main(["process", f"{tmp_path}/*.csv", "-o", out, "--scheme", "six"])


def test_chosen_blocks_leave_edges_out():
    assert sequence.choose_blocks([60, 90], [70, 199], 200, 100) == [0, 1]
    assert sequence.choose_blocks([0, 30, 60, 150], [20, 35, 80, 160], 300, 100) == [0, 2, 3]
    assert sequence.choose_blocks([], [], 50, 10) == [] and sequence.choose_blocks([0], [49], 50, 10) == [0]
    assert sequence.still_label(["light", "sit-stand", "sleep"]) == "sit-stand"
    with pytest.raises(ValueError):
        sequence.still_label(["light", "sleep"])


def test_smoother_matrices_in_another_order():
    hmm = sequence.HiddenMarkov(["a", "b", "c"], np.arange(3), np.arange(9).reshape(3, 3), np.arange(9).reshape(3, 3) + 10)
    made = hmm.ordered(["c", "a", "b"])
    assert made["prior"].tolist() == [2, 0, 1] and made["transition"].tolist() == [[18, 16, 17], [12, 10, 11], [15, 13, 14]] and "c, a, b" in hmm.pretty(["c", "a", "b"])
    with pytest.raises(ValueError):
        hmm.ordered(["a", "b"])


def test_low_pass_equals_a_sample_at_a_time():
    rng = np.random.default_rng(5)
    for n in (1, 255, 256, 1000):
        x = rng.normal(size=n)
        for b, a in signal.butterworth(8, 20, 100):
            want, s1, s2 = [], (1 - b[0]) * x[0], (b[2] - a[2]) * x[0]
            for v in x:
                want.append(b[0] * v + s1)
                s1, s2 = b[1] * v - a[1] * want[-1] + s2, b[2] * v - a[2] * want[-1]
            assert np.allclose(signal.Cascade([(b, a)]).run(x)[0], want, atol=1e-9)


def test_fit_with_smoother_and_cross_validation(spark):
    """Two forests on the same folds, and a smoother from held-out probabilities."""
    rng = np.random.default_rng(6)
    rows = []
    for s in range(12):
        state = 0
        for t in range(60):
            state = state if rng.random() < 0.9 else 1 - state
            rows.append((f"s{s}", t * 30 * S, float(state + rng.normal(0, 0.4)), float(rng.normal()), ["sedentary", "sleep"][state]))
    df = spark.createDataFrame(rows, "subject_id string, us long, f double, noise double, label string")
    good, bad = fit.forest(["f"], "label", 5, 4), fit.forest(["noise"], "label", 5, 4)
    made = fit.cross_validate(df, {"good": good, "bad": bad}, "subject_id", "label", 3).persist()
    assert made.count() == 2 * len(rows) and made.groupBy("subject_id", "model").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert made.select("subject_id", "fold").distinct().count() == 12 and made.where("model = 'good'").groupBy("fold").count().count() == 3
    table = fit.compare(made, "label").collect()
    assert [r.model for r in table] == ["good", "bad"] and table[0].accuracy > 0.75
    model, hmm = fit.fit_with_smoother(df, good, "subject_id", "label", ["sedentary", "sleep"], 30 * S, percent=30)
    assert hmm.transition.diagonal().min() > 0.75 and hmm.emission.diagonal().min() > 0.6
    guessed = hmm.smooth(score.predict_forest(model, df.drop("label"), "label"), "label", 30 * S).join(df.select("subject_id", "us", F.col("label").alias("y")), ["subject_id", "us"])
    right = lambda c: guessed.where(F.col(c) == F.col("y")).count()
    assert right("smoothed") > right("label")
    lacking = df.withColumn("f", F.when(F.col("us") > 0, F.col("f"))).drop("label")
    kept = score.predict_forest(model, lacking)
    assert kept.count() == len(rows) and kept.where("label is null and probability is null").count() == 12


def test_forest_in_the_recording_path(spark, tmp_path):
    """A saved forest over window features, loaded by name, scores samples."""
    rng = np.random.default_rng(9)
    rows = [("a", int(i * S / 10), *(float(x) for x in rng.normal(0, 0.02 if i < 1500 else 0.4, 3) + [0, 0, 1])) for i in range(3000)]
    samples = spark.createDataFrame(rows, "subject_id string, us long, x double, y double, z double")
    made = score.array_features(score.window_enmo(score.windows(samples, 30, 10))).withColumn("label", F.when(F.col("idx") < 5, "sleep").otherwise("light"))
    assert made.where(" or ".join(f"`{c}` is null" for c in score.FEATURES)).count() == 0
    score.fit_forest(made, ["sd", "enmoTrunc", "xyCov"], "label", 5, 3).write().overwrite().save(str(tmp_path / "forest"))
    got = score.predict_recording(samples, score.load("forest", "four", str(tmp_path / "forest")), 30, 10).orderBy("us").collect()
    assert [r.label for r in got] == ["sleep"] * 5 + ["light"] * 5
    for name, scheme in (("threshold", "six"), ("nothing", "four"), ("forest", "four")):
        with pytest.raises(ValueError):
            score.load(name, scheme)


def test_command_line(spark, tmp_path):
    args = cli.arguments(["process", "a.csv", "-e", "both", "-w", "12H", "--no-hmm"])
    assert args.exclude_first_last == "both" and args.csv_txyz == "time,x,y,z"
