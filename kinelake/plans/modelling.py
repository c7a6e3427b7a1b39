"""Queries of scoring, labelling, fitting and comparing, and of the scalar functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import scalar
from kinelake.functions.scalar import DAY, HOUR, MINUTE, SECOND
from kinelake.operators import bagging, epochs, evaluate, fit, network, quality, score, signal, spectral, summary
from kinelake.plans import recording
from kinelake.plans.registry import CLASSES, COLUMNS, DATE, DT, EP, EV, HR, IMP, M10L5, MARKS, MN, SIX, WD, _POWER, events, hourly, imputed, query, rounded, six_hours

#: Embeddings as recordings of three axes, a sample a second, with missing values and missing rows.
HOLES = "pt as (select vec_id as subject_id, i - 1 as t, case when (vec_id + i) % 5 = 0 and vec_id % 3 = 0 then null else 6.0::double * embedding[i]::double end as x, 6.0::double * embedding[i + 21]::double as y, 6.0::double * embedding[i + 42]::double as z from embeddings, range(1, 22) r(i) where not (vec_id % 7 = 0 and i > 11) and not (vec_id % 11 = 0 and i between 8 and 14))"


def samples(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    axes = [F.slice("embedding", 1 + 21 * k, 21).alias(c) for k, c in enumerate("xyz")]
    rows = e.select(F.col("vec_id").alias("subject_id"), F.posexplode(F.arrays_zip(*axes)).alias("t", "p"))
    rows = rows.where(~((F.col("subject_id") % 7 == 0) & (F.col("t") > 10)) & ~((F.col("subject_id") % 11 == 0) & F.col("t").between(7, 13)))
    hole = ((F.col("subject_id") + F.col("t") + 1) % 5 == 0) & (F.col("subject_id") % 3 == 0)
    x, y, z = (6.0 * F.col(f"p.{c}").cast("double") for c in "xyz")
    return rows.select("subject_id", (F.col("t").cast("long") * SECOND).alias("us"), F.when(~hole, x).alias("x"), y.alias("y"), z.alias("z"))


WINDOWS = f"""{HOLES}, pw as (select subject_id, t // 7 as idx, list(greatest(sqrt(x * x + y * y + z * z) - 1, 0) * 1000 * case when x is null then null else 1 end order by t) as e from pt group by all),
pg as (select subject_id, unnest(range(0, max(idx) + 1)) as idx from pw group by 1), pe as (select subject_id, idx, case when 2 * len(e) > 7 then list_transform(range(0, 7), lambda i: e[i % len(e) + 1]) end as e from pg left join pw using (subject_id, idx)),
pa as (select subject_id, idx * 7 * {SECOND} as us, case when len(list_filter(e, lambda v: v is null)) = 0 then list_avg(e) end as acc from pe)"""


@query(f"with {WINDOWS} select subject_id, us::bigint as us, round(acc, 6) as acc, case when acc < 300 then 'sleep' when acc < 700 then 'sedentary' when acc < 1100 then 'light' when acc is not null then 'moderate-vigorous' end as label from pa")
def predict_from_samples(spark, sf):
    """From samples to labelled epochs: anchored windows, fitted by wrapping, scored; windows with too few samples, a missing value or no sample stay, without a label."""
    scorer = lambda w: w.withColumn("label", score.threshold_label("acc", [(300.0, "sleep"), (700.0, "sedentary"), (1100.0, "light")], "moderate-vigorous"))
    return rounded(score.predict_recording(samples(spark, sf), scorer, 7, 1), "acc")


@query("""with v as (select vec_id, list_transform(range(1, 22), lambda i: embedding[i]::double) as x, list_transform(range(1, 22), lambda i: embedding[i + 21]::double) as y, list_transform(range(1, 22), lambda i: embedding[i + 42]::double) as z from embeddings),
r as (select vec_id, x, y, z, list_transform(range(1, 22), lambda i: sqrt(x[i] * x[i] + y[i] * y[i] + z[i] * z[i])) as r from v), m as (select *, list_avg(r) as mean, list_var_pop(r) as var, list_avg(x) as xm, list_avg(y) as ym from r)
select vec_id, round(mean, 6) as mean, round(list_stddev_samp(r), 6) as sd, round(list_min(r), 6) as min, round(list_max(r), 6) as max, round(list_median(r), 6) as median, round(list_aggregate(r, 'quantile_cont', 0.25), 6) as p25, round(list_aggregate(r, 'quantile_cont', 0.75), 6) as p75,
round(list_avg(list_transform(r, lambda a: abs(a - 1))), 6) as enmo_abs, round(list_avg(list_transform(r, lambda a: pow(a - mean, 3))) / pow(var, 1.5), 6) as skew, round(list_avg(list_transform(r, lambda a: pow(a - mean, 4))) / pow(var, 2) - 3, 6) as kurt, round(ym, 6) as y_mean, round(list_max(z) - list_min(z), 6) as z_range,
round(list_sum(list_transform(range(1, 22), lambda i: (x[i] - xm) * (y[i] - ym))) / 20, 6) as xy_cov, round(list_avg(list_transform(range(1, 21), lambda i: (r[i] - mean) * (r[i + 1] - mean))) / var, 6) as autocorr, round(list_sum(list_transform(r, lambda a: pow(a - mean, 2))) / 2, 6) as total_power from m""")
def window_array_features(spark, sf):
    """Features of whole windows of three axes; the power of all frequencies is half the sum of squares."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", *(F.slice("embedding", 1 + 21 * k, 21).alias(c) for k, c in enumerate("xyz")))
    made = score.array_features(e, 1.0)
    names = {"mean": "mean", "sd": "sd", "min": "min", "max": "max", "median": "median", "25thp": "p25", "75thp": "p75", "enmoAbs": "enmo_abs", "skew": "skew", "kurt": "kurt", "yMean": "y_mean", "zRange": "z_range", "xyCov": "xy_cov", "autocorr": "autocorr", "totalPower": "total_power"}
    return rounded(made.select("vec_id", *(F.col(f"`{a}`").alias(b) for a, b in names.items())), *names.values())


def _spectral_sql() -> str:
    """Sub-windows of 8 samples every 4, and the whole window of 21, by sums of sines and cosines; gravity as a mean of the nine nearest samples."""
    turn = "atan2({0}y, {0}z) as roll, atan2({0}x, {0}z) as pitch, atan2({0}y, {0}x) as yaw"
    power = lambda d, k, j, n: f"pow(sum({d} * cos(2 * pi() * {k} * {j} / {n})), 2) + pow(sum({d} * sin(2 * pi() * {k} * {j} / {n})), 2)"
    best = lambda source, where: f"(select vec_id, arg_max(hz, (p, -hz)) as f, max(p) as p from {source} where {where} group by 1)"
    return f"""with pt as (select vec_id, i - 1 as i, embedding[i]::double as x, embedding[i + 21]::double as y, embedding[i + 42]::double as z from embeddings, range(1, 22) t(i)), r as (select vec_id, i, sqrt(x * x + y * y + z * z) as r from pt),
sb as (select vec_id, s, i - 4 * s as j, r - avg(r) over (partition by vec_id, s) as d from r, range(0, 4) t(s) where i - 4 * s between 0 and 7), sp as (select vec_id, s, k, ({power("d * (0.5 - 0.5 * cos(2 * pi() * j / 8))", "k", "j", 8)}) / 3 as p from sb, range(1, 5) t(k) group by all),
av as (select vec_id, k::double as hz, avg(p) as p from sp group by all), wm as (select vec_id, i, r - avg(r) over (partition by vec_id) as d from r), wp as (select vec_id, k / 2.625 as hz, ({power("d", "k", "i", 21)}) / 21 as p from wm, range(1, 11) t(k) group by all),
gr as (select vec_id, {", ".join(f"{c} - avg({c}) over w as l{c}, avg({c}) over w as g{c}" for c in "xyz")} from pt window w as (partition by vec_id order by i rows between 4 preceding and 4 following)),
an as (select vec_id, {turn.format("l")} from gr), am as (select vec_id, {", ".join(f"avg({c}) as avg{c}, stddev_samp({c}) as sd{c}" for c in ("roll", "pitch", "yaw"))} from an group by 1),
gm as (select vec_id, {turn.format("g")} from (select vec_id, {", ".join(f"avg(g{c}) as g{c}" for c in "xyz")} from gr group by 1)), ff as (select vec_id, {", ".join(f"max(p) filter (hz = {k}) as fft{k}" for k in range(1, 5))} from av group by 1)
select vec_id, round(a.f, 6) as fmax, round(a.p, 6) as pmax, round(b.f, 6) as fmaxband, round(b.p, 6) as pmaxband, {", ".join(f"round(fft{k}, 6) as fft{k}" for k in range(1, 5))}, {", ".join(f"0::double as fft{k}" for k in range(5, 11))}, round(w.f, 6) as f625, round(w.p, 6) as p625,
{", ".join(f"round(am.{k}{c}, 6) as {k}{c}" for k in ("avg", "sd") for c in ("roll", "pitch", "yaw"))}, {", ".join(f"round(gm.{c}, 6) as {c}g" for c in ("roll", "pitch", "yaw"))}
from {best("av", "true")} a join {best("av", "hz between 0.3 and 3")} b using (vec_id) join {best("wp", "hz between 0.6 and 2.5")} w using (vec_id) join ff using (vec_id) join am using (vec_id) join gm using (vec_id)"""


@query(_spectral_sql())
def window_spectral_features(spark, sf):
    """The named spectral and posture features of windows of 21 samples at 8 Hz."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", *(F.slice("embedding", 1 + 21 * k, 21).alias(c) for k, c in enumerate("xyz")))
    return rounded(score.array_features(e, 0.125).select("vec_id", *spectral.MADE), *spectral.MADE)


@query()
def forest_feature_sets(spark, sf):
    """The forests' features of the four and the six classes, all of them: each window's values as an array in the order of the names."""
    made = score.array_features(_windows(spark, sf).drop("label"))
    return made.select("idx", *(F.array(*(F.round(F.col(f"`{c}`"), 6) for c in names)).alias(scheme) for scheme, names in spectral.NAMES.items()))


@query(f"""with {SIX}, {MARKS}, g as (select subject_id, idx from six group by 1, 2 having count(*) = 6 and count(acc) = 6 and count(label) > 0), v as (select subject_id, idx, d.label, count(*) as n from six join d on annotation = six.label semi join g using (subject_id, idx) group by all),
b as (select subject_id, idx, label from v qualify row_number() over (partition by subject_id, idx order by n desc, label nulls last) = 1) select s.subject_id, s.idx, b.label from (select distinct subject_id, idx from six) s left join b using (subject_id, idx)""")
def every_window_label(spark, sf):
    """Labels of all windows; those that are not whole or not annotated have none."""
    dictionary = spark.createDataFrame([("sleep", "rest"), ("sedentary", "rest"), ("light", "move"), ("moderate", None)], "annotation string, label string")
    return epochs.every_window_label(six_hours(spark, sf).withColumnRenamed("label", "annotation"), ["acc"], 6, dictionary, "annotation", "label")


@query(f"""with {EP}, p as (select subject_id, us, label from ep where us // {HOUR} % 6 = 0), f as (select subject_id, min(us) as f from p group by 1), t as (select subject_id, f + (us - f) // {6 * HOUR} * {6 * HOUR} as us, label, count(*) as n from ep join f using (subject_id) where label is not null and us >= f group by all),
b as (select subject_id, us, label as true from t qualify row_number() over (partition by subject_id, us order by n desc, label) = 1) select p.subject_id, p.us, p.label, b.true from p left join b using (subject_id, us)""")
def truth_on_predictions(spark, sf):
    """The commonest true label of each predicted epoch's time beside its prediction."""
    h = hourly(spark, sf)
    predicted = h.where(F.pmod(scalar.div("us", HOUR), F.lit(6)) == 0).select("subject_id", "us", "label")
    return epochs.with_truth(predicted, h.select("subject_id", "us", F.col("label").alias("annotation")), 6 * DT)


@query("with p as (select o_custkey, avg(case when o_orderstatus = 'O' then o_totalprice end) as a, avg(case when o_orderstatus = 'F' then o_totalprice end) as b from orders group by 1) select o_custkey, round(a, 6) as \"O\", round(b, 6) as \"F\", round(a - b, 6) as difference from p where a is not null and b is not null")
def paired_models(spark, sf):
    """A value under two models side by side, for the subjects that have both."""
    each = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("value"))
    made = evaluate.paired(each, ["o_custkey"], "o_orderstatus", "value", "O", "F")
    return rounded(made.withColumn("difference", F.col("O") - F.col("F")), "O", "F", "difference")


@query("select c_mktsegment, round(avg(c_acctbal) filter (c_nationkey % 2 = 0), 6) as even, round(avg(c_acctbal) filter (c_nationkey % 2 = 1), 6) as odd from customer group by 1 order by even desc nulls last, 1")
def performance_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").withColumn("side", F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd"))
    return rounded(evaluate.performance_table(rows, "c_mktsegment", "side", "c_acctbal", ["even", "odd"]), "even", "odd")


@query(f"with {EV}, u as (select subject_id, us, max(value) as value from ev group by 1, 2) select subject_id, us, value from u qualify row_number() over (partition by subject_id order by us) <= 5")
def head_per_subject(spark, sf):
    return quality.head(events(spark, sf).groupBy("subject_id", "us").agg(F.max("value").alias("value")), 5)


@query("""with cf as (select quality as t, toxic as p, count(*) as n from labels group by 1, 2), l as (select label, sum(s) as support, sum(p) as predicted, sum(h) as hit from (select t as label, n as s, 0 as p, case when t = p then n else 0 end as h from cf union all select p, 0, n, 0 from cf) group by 1)
select label, support::bigint as support, predicted::bigint as predicted, round(case when predicted > 0 then hit / predicted else 0 end, 6) as precision, round(case when support > 0 then hit / support else 0 end, 6) as recall, round(case when support + predicted > 0 then 2 * hit / (support + predicted) else 0 end, 6) as f1 from l""")
def classification_report(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))
    made = evaluate.label_report(evaluate.confusion(rows, []), [])
    return rounded(made.select("label", "support", "predicted", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(f"with {EV}, m as (select subject_id, us, case when subject_id = 'error' then null else value end as value from ev) select subject_id, case when count(value) > 0 then 1 else 0 end as predict_ok, round(count(value) / 24.0, 6) as wear_days from m group by 1")
def all_missing_subject(spark, sf):
    """A subject without any value has a row that says so."""
    rows = events(spark, sf).withColumn("value", F.when(F.col("subject_id") != "error", F.col("value")))
    made = quality.wear_stats(rows, ["value"], 3600.0)
    return rounded(made.select("subject_id", F.col("wear_start_us").isNotNull().cast("int").alias("predict_ok"), "wear_days"), "wear_days")


@query(f"with {EP}, d as (select subject_id, us // {DAY} as d, list(us order by us) as us, list(round(acc, 6) order by us) as acc from ep group by 1, 2) select subject_id, {DATE(f'd * {DAY}')} as date, ((d + 3) % 7)::int as weekday, len(us)::int as n, us[1] as first_us, round(list_sum(acc), 4) as total, acc[8] as eighth from d")
def day_panels(spark, sf):
    """Each day's arrays in time's order, for figures of one row a day."""
    made = summary.day_panels(hourly(spark, sf).withColumn("acc", F.round("acc", 6)), ["acc", *CLASSES])
    total = F.aggregate("acc", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    some = F.exists("acc", lambda x: x.isNotNull())
    return made.select("subject_id", "date", "weekday", F.size("us").alias("n"), F.element_at("us", 1).alias("first_us"), F.when(some, F.round(total, 4)).alias("total"), F.element_at("acc", 8).alias("eighth"))


@query("""with s as (select user_id as u, event_type as l, count(*) as n from events group by 1, 2), t as (select u, sum(n) as rows_, max({'n': n, 'l': l}).l as top from s group by 1), p as (select u, (row_number() over (partition by top order by rows_ desc, u) - 1) % 10 as place from t)
select u as user_id, (case when place < 5 then place else 9 - place end)::int as fold from p""")
def stratified_group_folds(spark, sf):
    """Whole subjects dealt to folds so that each has its share of every commonest label."""
    return fit.stratified_folds(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_type", 5)


def _majority(column: str):
    """A classifier of one rule, the commonest label by the value's sign of parity, to show the folds at work."""
    from pyspark.sql import Window

    def train(rows):
        votes = rows.groupBy("even", F.col(column).alias("label_pred")).count()
        return votes.withColumn("nth", F.row_number().over(Window.partitionBy("even").orderBy(F.col("count").desc(), "label_pred"))).where("nth = 1").select("even", "label_pred")

    return train, lambda model, rows: rows.join(model, "even", "left")


@query("""with s as (select user_id as u, event_type as l, count(*) as n from events group by 1, 2), t as (select u, sum(n) as rows_, max({'n': n, 'l': l}).l as top from s group by 1), p as (select u, (row_number() over (partition by top order by rows_ desc, u) - 1) % 6 as place from t),
f as (select u, case when place < 3 then place else 5 - place end as fold from p), e as (select event_id, event_type, event_id % 2 = 0 as even, fold from events join f on u = user_id), k(fold) as (values (0), (1), (2)),
v as (select k.fold, even, event_type, count(*) as n from e, k where e.fold <> k.fold group by all), m as (select fold, even, event_type as label_pred from v qualify row_number() over (partition by fold, even order by n desc, event_type) = 1),
a as (select event_id, event_type, e.fold::int as fold, label_pred from e left join m on m.fold = e.fold and m.even = e.even) select 'parity' as model, event_id, event_type, fold, label_pred from a union all select 'same', event_id, event_type, fold, label_pred from a""")
def cross_validated_models(spark, sf):
    """Two models on the same folds: each row is predicted once a model, by a fit on the other folds."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", (F.col("event_id") % 2 == 0).alias("even"))
    rule = _majority("event_type")
    made = fit.cross_validate(rows, {"parity": rule, "same": rule}, "user_id", "event_type", 3)
    return made.select("model", "event_id", "event_type", "fold", "label_pred")


@query("select n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || '(hours)' as title, 'v' || n_nationkey || '-' || n_regionkey || '-7' as version, (n_nationkey % 3 = 0) as yes, case n_nationkey % 4 when 0 then 1.5 when 1 then 2.5 else 0.0 end::double as hours, n_regionkey as code, case when n_nationkey % 5 > 1 then n_name end as usable from nation")
def text_functions(spark, sf):
    """Titles, versions, yes or no, a map's default, a label's place in its sorted list, usable labels."""
    n = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, regions = F.col("n_nationkey"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    says = F.when(k % 3 == 0, F.when(k % 2 == 0, " Yes").otherwise("TRUE")).otherwise("no")
    hours = F.create_map(F.lit("walk"), F.when(k % 4 == 0, 1.5).otherwise(2.5), F.lit("run"), F.lit(9.0))
    return n.select(
        "n_nationkey", F.concat(scalar.capitalised(F.col("n_name")), F.lit("(hours)")).alias("title"), scalar.version_tag(F.concat_ws(".", k.cast("string"), F.col("n_regionkey").cast("string"), F.lit("7+12"))).alias("version"), scalar.truth(says).alias("yes"),
        F.when(k % 4 < 2, scalar.get_or(hours, "walk")).otherwise(scalar.get_or(hours, "none")).alias("hours"), scalar.code_of(regions, F.col("r_name")).cast("int").alias("code"),
        scalar.usable(F.when(k % 5 == 0, "NaN").when(k % 5 == 1, " ").otherwise(F.col("n_name"))).alias("usable"),
    )


@query(f"with {EV} select event_id, strftime(make_timestamp(us // 1000 * 1000 + {HOUR}), '%Y-%m-%d %H:%M:%S.%g') as local_text, (us // 1000 * 1000 + {HOUR})::bigint as local_us, {int(scalar.seconds('1h30min'))}::double + event_id as waited from ev")
def zoned_times(spark, sf):
    """Zoned date texts to local clocks (Paris in winter is an hour ahead), and durations of texts."""
    ev = events(spark, sf).withColumn("text", F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+0000 [Europe/Paris]")))
    local = scalar.zoned_local(F.col("text"))
    return ev.select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS").alias("local_text"), F.unix_micros(local.cast("timestamp")).alias("local_us"), (F.lit(scalar.seconds("1h30min")) + F.col("event_id")).alias("waited"))


_END = 1_729_990_800_000_000  # 2024-10-27 01:00 UTC, when London's clocks go back


@query(f"with e as (select event_id, (epoch_us(ts) - 1704067200000000) // 60 + {_END - 6 * HOUR} as us from events) select event_id, us::bigint as us, (case when us < {_END} then us + {HOUR} else us end)::bigint as local_us from e where not us between {_END - HOUR} and {_END + HOUR - 1}")
def ambiguous_hours_dropped(spark, sf):
    """The local hour that comes twice when summer time ends is left out."""
    ev = events(spark, sf).select("event_id", (scalar.div(F.col("us") - 1_704_067_200_000_000, 60) + (_END - 6 * HOUR)).alias("us"))
    return signal.drop_ambiguous_hours(ev, "Europe/London").select("event_id", "us", "local_us")


@query(f"""with {EV}, u as (select subject_id, us, max(value) as v from ev group by 1, 2), n as (select *, lead(us) over w as nu, lead(v) over w as nv, min(us) over (partition by subject_id) as f from u window w as (partition by subject_id order by us)),
g as (select *, unnest(range((us - f + {10 * MINUTE} - 1) // {10 * MINUTE}, case when nu is null then (us - f) // {10 * MINUTE} else (nu - f + {10 * MINUTE} - 1) // {10 * MINUTE} - 1 end + 1)) as k from n)
select subject_id, f + k * {10 * MINUTE} as us, round(case when nu is null or 2 * (f + k * {10 * MINUTE} - us) < nu - us then v else nv end, 6) as value from g""")
def resample_nearest(spark, sf):
    some = events(spark, sf).groupBy("subject_id", "us").agg(F.max("value").alias("value"))
    return rounded(signal.resample(some, ["value"], 10 * MINUTE, linear=False), "value")


def _document_sql() -> str:
    """Every number of the summary document; the averages of each column from its weekday and hour cells."""
    level = ", ".join(map(str, summary.LEVELS))
    days = ", ".join(f"'{d}'" for d in recording.NAMES)
    tall = " union all ".join(f"select subject_id, us, '{c}' as c, {c} as v from imp" for c in COLUMNS)
    z = " ".join(f"when {c} = greatest({', '.join(CLASSES)}) then {1.0 if c == 'sleep' else -1.0}" for c in CLASSES)
    recorded = " union all ".join(f"select subject_id, 'day' || day || '-recorded-{c}(hrs)' as metric, {c} * {DT} / 3600 as value from rec" for c in CLASSES)
    return f"""with {IMP}, long as ({tall}), ends_ as (select subject_id, min(us) as lo, max(us) as hi from ep group by 1),
cells as (select subject_id, c, {WD} as weekday, {HR} as hour, avg(v) as mean from long group by all), wk as (select subject_id, c, weekday >= 5 as we, hour, avg(mean) as avg from cells group by all),
lv(level) as (select unnest([{level}])), ec as (select subject_id, level, {HR} as h, {MN} as mi, avg(case when acc is null or acc <= level then 1 else 0 end) as s from imp, lv group by all),
rd as (select subject_id, us // {DAY} as d, min(us) as us, {', '.join(f'coalesce(sum({c}), 0) as {c}' for c in CLASSES)} from ep group by 1, 2), rec as (select *, dense_rank() over (partition by subject_id order by d) - 1 as day from rd),
sg as (select subject_id, row_number() over (partition by subject_id order by us) - 1 as t, 2 * pi() * 3600 / 86400 as w, acc, case {z} else -1.0 end as z from imp), {M10L5},
m as (select subject_id, 'acc-ecdf-' || level || 'mg' as metric, avg(s) as value from ec group by subject_id, level union all {recorded}
union all select subject_id, 'FirstDay(0=mon,6=sun)', (min(us) // {DAY} + 3) % 7 from rd group by 1
union all select subject_id, c || '-overall-avg', avg(v) from long join ends_ using (subject_id) where us between lo and hi group by subject_id, c union all select subject_id, c || '-overall-sd', stddev_samp(v) from long join ends_ using (subject_id) where us between lo and hi group by subject_id, c
union all select subject_id, c || '-week-avg', avg(mean) from cells group by subject_id, c union all select subject_id, c || '-' || [{days}][weekday + 1] || '-avg', avg(mean) from cells group by subject_id, c, weekday
union all select subject_id, c || '-hourOfDay-' || hour || '-avg', avg(mean) from cells group by subject_id, c, hour
union all select subject_id, c || '-week' || case when we then 'end' else 'day' end || '-avg', avg(avg) from wk group by subject_id, c, we union all select subject_id, c || '-hourOfWeek' || case when we then 'end' else 'day' end || '-' || hour || '-avg', avg from wk
union all select subject_id, 'PSD_acc', {_POWER.format(v='acc')} from sg group by 1 union all select subject_id, 'PSD_sleep', {_POWER.format(v='z')} from sg group by 1 union all select subject_id, 'M10L5', (m10 - l5) / (m10 + l5) from ml)
select subject_id, metric, round(value, 9) + 0 as value from m"""


@query(_document_sql())
def summary_document(spark, sf):
    """All metrics of a recording's summary but the dominant frequencies, which have a query of their own."""
    made = recording.metrics(hourly(spark, sf), imputed(spark, sf), CLASSES, DT).where(~F.col("metric").startswith("fourier"))
    return rounded(made, "value", digits=9)


def _levels():
    """A stand-in for a trained network: logits from each axis' mean."""
    return lambda v: 4 * v.mean(axis=2, dtype="float64") + [0.0, 0.1, 0.2]


@query("""with v as (select vec_id, [4 * list_avg(list_transform(range(1, 22), lambda i: embedding[i]::double)), 4 * list_avg(list_transform(range(1, 22), lambda i: embedding[i + 21]::double)) + 0.1, 4 * list_avg(list_transform(range(1, 22), lambda i: embedding[i + 42]::double)) + 0.2] as l from embeddings),
p as (select vec_id, l, list_transform(l, lambda x: exp(x - list_max(l))) as e from v) select vec_id, case when vec_id % 9 > 0 then ['light', 'sedentary', 'sleep'][list_position(l, list_max(l))] end as label, case when vec_id % 9 > 0 then round(l[3], 6) end as logit, case when vec_id % 9 > 0 then round(e[1] / list_sum(e), 6) end as p_light from p""")
def batched_array_scorer(spark, sf):
    """A model over window arrays in batches: label, logits and probabilities; windows with a hole have none."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    w = e.select("vec_id", *(F.slice("embedding", 1 + 21 * k, 21).alias(c) for k, c in enumerate("xyz")))
    w = w.withColumn("x", F.when(F.col("vec_id") % 9 > 0, F.col("x")).when(F.col("vec_id") % 2 > 0, F.transform("x", lambda v, i: F.when(i > 0, v))))
    made = score.array_scorer(_levels, ["light", "sedentary", "sleep"], batch=64)(w)
    return rounded(made.select("vec_id", "label", F.element_at("logits", 3).alias("logit"), F.element_at("probability", 1).alias("p_light")), "logit", "p_light")


def _low_pass_sql() -> str:
    """Each section as a recursion over the samples, forwards, then all of them backwards."""
    parts, source = ["x0 as (select vec_id, i - 1 as t, embedding[i]::double as x from embeddings, range(1, 65) r(i))"], "x0"
    sections = signal.butterworth(8, 20, 100)
    for turn in (0, 1):
        for k, (b, a) in enumerate(sections):
            name, back = f"f{turn}{k}", turn == 1 and k == 0
            b, a = [f"({float(v)!r}::double)" for v in b], [f"({float(v)!r}::double)" for v in a]
            parts.append(f"q{name} as (select vec_id, {'63 - t' if back else 't'} as t, x from {source})")
            y0, y = f"({b[0]} * x + (1 - {b[0]}) * x)", f"({b[0]} * q.x + f.s1)"
            parts.append(f"""{name}(vec_id, t, x, s1, s2) as (select vec_id, t, {y0}, {b[1]} * x - {a[1]} * {y0} + ({b[2]} - {a[2]}) * x, {b[2]} * x - {a[2]} * {y0} from q{name} where t = 0
union all select q.vec_id, q.t, {y}, {b[1]} * q.x - {a[1]} * {y} + f.s2, {b[2]} * q.x - {a[2]} * {y} from {name} f join q{name} q on q.vec_id = f.vec_id and q.t = f.t + 1)""")
            source = name
    return "with recursive " + ", ".join(parts) + f" select vec_id, ((63 - t) * 10000)::bigint as us, round(x, 6) + 0 as value from {source}"


@query(_low_pass_sql())
def low_pass(spark, sf):
    """An eighth-order filter at 20 Hz of 64 samples a vector, forwards and backwards."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("subject_id"), F.posexplode("embedding").alias("t", "value"))
    made = signal.low_pass(e.select("subject_id", (F.col("t").cast("long") * 10_000).alias("us"), F.col("value").cast("double").alias("value")), ["value"], 20, 100)
    return rounded(made.select(F.col("subject_id").alias("vec_id"), "us", "value"), "value")


_TITLES = {c: c[:1].upper() + c[1:].lower() for c in CLASSES}


@query(f"""with {IMP}, w as (select subject_id, {DATE('us')} as date, round(count(acc) * 3600.0 / 3600, 2) as w from ep group by all), a as (select subject_id, {DATE('us')} as date, round(case when count(ep.acc) > 20 then avg(ep.acc) end, 9) as e, round(case when count(imp.acc) > 20 then avg(imp.acc) end, 9) as ea,
{', '.join(f'round(case when count(ep.{c}) > 20 then sum(ep.{c}) end, 9) as {c}, round(case when count(imp.{c}) > 20 then sum(imp.{c}) end, 9) as {c}_adj' for c in CLASSES)} from imp left join ep using (subject_id, us) group by all)
select subject_id, date, w as "WearTime(hours)", e as "ENMO(mg)", ea as "ENMO Adjusted(mg)", {', '.join(f'{c} as "{t}(hours)", {c}_adj as "{t} Adjusted(hours)"' for c, t in _TITLES.items())} from w full join a using (subject_id, date)""")
def daily_table(spark, sf):
    """Wear, intensity and class hours of each day in one table; days that only one side has are there."""
    made = recording.daily(hourly(spark, sf), imputed(spark, sf), CLASSES, DT, 20 * 60)
    return made.select("subject_id", "date", *(F.round(f"`{c}`", 9).alias(c) for c in made.columns[2:]))


@query(f"""with {EV}, u as (select subject_id, us // {MINUTE} * {MINUTE} as us, max(value) as v from ev group by 1, 2), f as (select subject_id, min(us) as f, max(us) as l from u group by 1),
g as (select subject_id, unnest(range(f, l + 1, {MINUTE})) as us from f), d as (select g.subject_id, g.us, arg_min(v, (abs(u.us - g.us), -u.us)) as v from g join u on u.subject_id = g.subject_id and abs(u.us - g.us) <= {10 * MINUTE} group by 1, 2)
select g.subject_id, count(*) as points, count(d.v) as worn, round(sum(d.v), 4) as total from g left join d using (subject_id, us) group by 1""")
def uniform_grid(spark, sf):
    """Events a minute as samples a second: the nearest value within ten seconds of each grid point, none inside longer gaps."""
    u = events(spark, sf).groupBy("subject_id", (scalar.div("us", MINUTE) * SECOND).alias("us")).agg(F.max("value").alias("v")).withColumn("rate", F.lit(1))
    made = signal.uniform(u, ["v"], "rate", 10 * SECOND)
    return rounded(made.groupBy("subject_id").agg(F.count("*").alias("points"), F.count("v").alias("worn"), F.sum("v").alias("total")), "total", digits=4)


@query(f"""with {HOLES}, w as (select subject_id, t // 7 as w, avg(x) as x, avg(y) as y, avg(z) as z, stddev_samp(x) as sx, stddev_samp(y) as sy, stddev_samp(z) as sz from pt group by all)
select subject_id, coalesce(count(*) filter (sx < 2 and sy < 2 and sz < 2 and sqrt(x * x + y * y + z * z) > 1e-8), 0) as still, round(avg(abs(sqrt(x * x + y * y + z * z) - 1)) filter (sx < 2 and sy < 2 and sz < 2), 6) as error_before, 0 as ok from w group by 1""")
def failed_calibration(spark, sf):
    """Recordings with too few still windows say so, and how far off they are."""
    found = quality.calibration(quality.window_stats(samples(spark, sf), ["x", "y", "z"], 7), sd=2)
    return rounded(found.select("subject_id", "still", "error_before", "ok"), "error_before")


def _windows(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    axes = [F.transform(F.slice("embedding", 1 + 21 * k, 21), lambda v: 6.0 * v.cast("double")).alias(c) for k, c in enumerate("xyz")]
    return e.select((F.col("vec_id") % 10).alias("subject_id"), F.col("vec_id").alias("idx"), *axes, F.concat(F.lit("c"), F.col("label") % 3).alias("label"))


@query()
def network_scored(spark, sf):
    """Windows through a residual convolutional network of seeded weights."""
    shape = network.Shape(("c0", "c1", "c2"), widths=(8, 16), kernel=5, pool=3, hidden=16)
    made = network.scorer(network.start(shape, 7), shape)(_windows(spark, sf).withColumnRenamed("label", "true"))
    return made.select("idx", "label", F.transform("logits", lambda v: F.round(v, 3)).alias("logits"))


@query()
def network_trained(spark, sf):
    """The same network after two epochs on the windows' labels, by gradients summed over partitions; its predictions."""
    from kinelake import session

    shape = network.Shape(("c0", "c1", "c2"), widths=(8, 16), kernel=5, pool=3, hidden=16)
    w, _ = network.train(_windows(spark, sf), shape, session.scratch(spark, "network"), epochs=2, batches=2, rate=0.01)
    made = network.scorer(w, shape)(_windows(spark, sf).withColumnRenamed("label", "true"))
    return made.select("idx", "true", "label")


@query()
def augmented_windows(spark, sf):
    """Windows with permuted axes, turned and thinned, as training sees them."""
    made = signal.augment(_windows(spark, sf))
    return made.select("idx", *(F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in "xyz"))


FEATURES = [f"e{k}" for k in range(8)]


def _rows(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", (F.col("vec_id") % 12).alias("subject_id"), (F.col("vec_id") * 30 * SECOND).alias("us"), F.concat(F.lit("c"), F.col("label") % 3).alias("label"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(FEATURES)))


@query()
def forest_out_of_bag(spark, sf):
    """A balanced forest's votes on each row by the trees that never drew it."""
    rows = _rows(spark, sf)
    model = bagging.fit(rows, FEATURES, "label", ["vec_id"], trees=10, depth=4, bins=16)
    made = bagging.predict(model, rows, ["vec_id"], label="label")
    return made.select("vec_id", "label", "label_pred", "trees", F.transform("probability", lambda v: F.round(v, 6)).alias("probability"))


@query()
def smoother_on_out_of_bag(spark, sf):
    """The forest with a smoother fitted on its out-of-bag shares: smoothed labels of each subject's epochs."""
    rows = _rows(spark, sf)
    model, smoother = fit.fit_out_of_bag(rows, FEATURES, "label", ["vec_id"], None, trees=8, depth=3, bins=16)
    made = bagging.predict(model, rows, ["vec_id"]).where("label_pred is not null").select("subject_id", "us", "label_pred")
    return smoother.smooth(made, "label_pred", None).select("subject_id", "us", "label_pred", "smoothed")


@query()
def two_forests_same_folds(spark, sf):
    """The balanced forest and the library's on the same balanced folds, compared."""
    rows = _rows(spark, sf)
    models = {"balanced": fit.bagged(FEATURES, "label", ["vec_id"], trees=8, depth=3, bins=16), "weighted": fit.forest(FEATURES, "label", trees=8, depth=3)}
    made = fit.cross_validate(rows, models, "subject_id", "label", 3, assigned=fit.balanced_folds(rows, "subject_id", "label", 3))
    return fit.compare(made, "label")


@query()
def balanced_group_folds(spark, sf):
    """Whole users in folds with like shares of every event type."""
    return fit.balanced_folds(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_type", 5)
