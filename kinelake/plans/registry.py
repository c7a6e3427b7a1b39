"""Every query of the engine over the test tables, each beside the DuckDB SQL that checks it.

The tables bind to the model so: a subject is an event type, an epoch an hour, intensity the mean value of the hour's events,
labels are cut points of it, window tensors are embeddings. Times are microseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake import session
from kinelake.functions.scalar import DAY, HOUR, MINUTE, div, enmo, micros
from kinelake.operators import circadian, epochs, evaluate, impute, quality, score, sequence, signal, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLASSES = ["light", "moderate", "sedentary", "sleep"]
CUTS = [(10.0, "sleep"), (35.0, "sedentary"), (100.0, "light")]
DT = 3600.0
#: What event types stand for.
KINDS = {"click": "active", "view": "active", "purchase": "busy", "signup": "busy"}

EV = "ev as (select event_type as subject_id, event_id, epoch_us(ts) as us, value from events)"
LABEL = "case when acc < 10 then 'sleep' when acc < 35 then 'sedentary' when acc < 100 then 'light' when acc is not null then 'moderate' end"
ONE_HOT = ", ".join(f"case when acc is not null then ({LABEL} = '{c}')::int::double end as {c}" for c in CLASSES)
EP = f"""{EV}, hr as (select subject_id, us // {HOUR} * {HOUR} as us, avg(value) as acc from ev group by all),
ends as (select subject_id, min(us) // {DAY} * {DAY} as lo, (max(us) + {DAY} - 1) // {DAY} * {DAY} as hi from hr group by all),
ep as (select g.subject_id, g.us, acc, {LABEL} as label, {ONE_HOT} from (select subject_id, unnest(range(lo, hi, {HOUR})) as us from ends) g left join hr using (subject_id, us))"""
WD, HR, MN = f"(us // {DAY} + 3) % 7", f"us % {DAY} // {HOUR}", f"us % {HOUR} // {MINUTE}"
COLUMNS = ["acc", *CLASSES]


def _filled(source: str, keys: str) -> str:
    return f"select subject_id, us, {', '.join(f'coalesce({c}, avg({c}) over (partition by subject_id, {keys})) as {c}' for c in COLUMNS)} from {source}"


IMP = f"{EP}, i1 as ({_filled('ep', f'{WD}, {HR}, {MN}')}), i2 as ({_filled('i1', f'({WD}) >= 5, {HR}, {MN}')}), imp as ({_filled('i2', f'{HR}, {MN}')})"
CELL = f"{IMP}, cell as (select subject_id, {WD} as weekday, {HR} as hour, avg(acc) as mean from imp group by all)"
DATE = lambda us: f"strftime(make_timestamp({us}), '%Y-%m-%d')"
PAIRS = """pairs as (select o_custkey, avg(case when o_orderpriority like '1%' then o_totalprice end) as a, avg(case when o_orderpriority like '2%' then o_totalprice end) as b from orders group by 1),
paired as (select c_mktsegment as segment, a, b from pairs join customer on c_custkey = o_custkey where a is not null and b is not null)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded for comparison; means of a few two-digit values take more digits, as theirs often end in a five at the seventh."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("subject_id"), "event_id", micros("ts").alias("us"), "value")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """subject_id, us, acc, label and a 0/1 column for each class, over whole days; empty hours are null."""
    hours = events(spark, sf).groupBy("subject_id", (div("us", HOUR) * HOUR).alias("us")).agg(F.avg("value").alias("acc"))
    made = epochs.day_grid(hours, DT).join(hours, ["subject_id", "us"], "left").withColumn("label", score.threshold_label("acc", CUTS, "moderate"))
    return made.withColumns({c: F.when(F.col("label").isNotNull(), (F.col("label") == c).cast("double")) for c in CLASSES})


def imputed(spark: SparkSession, sf: str) -> DataFrame:
    return impute.hierarchical(hourly(spark, sf), COLUMNS)


def ends(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("subject_id").agg((div(F.min("us"), HOUR) * HOUR).alias("lo"), (div(F.max("us"), HOUR) * HOUR).alias("hi"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return summary.cells(imputed(spark, sf), "acc")


def six_hours(spark: SparkSession, sf: str) -> DataFrame:
    return epochs.anchored(hourly(spark, sf), 6 * DT)


SIX = f"{EP}, six as (select *, (us - min(us) over (partition by subject_id)) // {6 * HOUR} as idx from ep)"
ANCHOR = f"{EV}, an as (select *, min(us) over (partition by subject_id) as first, (us - min(us) over (partition by subject_id)) // {MINUTE * 30} as idx from ev)"


@query(f"with {ANCHOR} select subject_id, idx, first + idx * {MINUTE * 30} as epoch_us, count(*) as n, round(avg(value), 9) as mean from an group by all")
def epoch_tumbling_anchored(spark, sf):
    return rounded(epochs.anchored(events(spark, sf), 1800).groupBy("subject_id", "idx", "epoch_us").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean", digits=9)


@query(f"""with {ANCHOR}, a as (select subject_id, idx, count(*) as n, avg(value) as mean from an group by all), g as (select subject_id, min(first) as first, unnest(range(0, max(idx) + 1)) as idx from an group by 1)
select g.subject_id, g.idx, first + g.idx * {MINUTE * 30} as epoch_us, coalesce(n, 0) as n, round(mean, 9) as mean from g left join a on g.subject_id = a.subject_id and g.idx = a.idx""")
def epoch_grid_with_gaps(spark, sf):
    return rounded(epochs.anchored_grid(events(spark, sf), 1800, "value"), "mean", digits=9)


@query(f"with {EV}, m as (select subject_id, us // {MINUTE} * {MINUTE} as us, event_id, value from ev) select subject_id, us, event_id, value from m qualify row_number() over (partition by subject_id, us order by event_id) = 1")
def dedupe_keep_first(spark, sf):
    return quality.dedupe_first(events(spark, sf).withColumn("us", div("us", MINUTE) * MINUTE), "event_id").select("subject_id", "us", "event_id", "value")


@query(f"""with {EV}, d as (select subject_id, us - lag(us) over (partition by subject_id order by us) as gap from ev), q as (select subject_id, quantile_cont(gap, 0.25) as lo, quantile_cont(gap, 0.75) as hi from d where gap is not null group by 1)
select subject_id, round(avg(gap) / 1e6, 6) as step_s from d join q using (subject_id) where gap between lo and hi group by 1""")
def infer_step(spark, sf):
    return rounded(quality.infer_step(events(spark, sf)), "step_s")


@query(f"""with {EP}, h as (select subject_id, {HR} as h, count(*) as n, count(acc) as ok, min(us) as lo, max(us) as hi, min(case when acc is not null then us end) as f, max(case when acc is not null then us end) as l from ep group by 1, 2)
select subject_id, min(lo) as start_us, max(hi) as end_us, min(f) as wear_start_us, max(l) as wear_end_us, round(sum(n) * 3600.0 / 86400 - sum(n - ok) * 3600.0 / 86400, 6) as wear_days, round(sum(n - ok) * 3600.0 / 86400, 6) as nonwear_days,
(count(*) = 24 and min(ok / n) >= 0.01)::int as covers_24h from h group by 1""")
def wear_stats(spark, sf):
    return rounded(quality.wear_stats(hourly(spark, sf), ["acc"], DT), "wear_days", "nonwear_days")


@query(f"with {EP} select subject_id, {DATE('us')} as date, round(count(acc) * 3600.0 / 3600, 2) as wear_hours from ep group by all")
def daily_wear_hours(spark, sf):
    return quality.daily_wear(hourly(spark, sf), ["acc"], DT)


@query(f"""with {EP}, d as (select subject_id, us, us // {DAY} as day, min(us // {DAY}) over (partition by subject_id) as lo, max(us // {DAY}) over (partition by subject_id) as hi from ep), m(mode) as (values ('first'), ('last'), ('both'))
select mode, subject_id, count(*) as n, min(us) as first_us, max(us) as last_us from d, m where (mode = 'last' or day > lo) and (mode = 'first' or day < hi) group by all""")
def drop_first_last_days(spark, sf):
    base, out = hourly(spark, sf), None
    for mode in ("first", "last", "both"):
        one = quality.drop_edge_days(base, mode).groupBy(F.lit(mode).alias("mode"), "subject_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {EP} select subject_id, us, round(case when count(acc) over (partition by subject_id, us // {DAY}) * 3600 >= 82800 then acc end, 9) as acc from ep")
def blank_low_wear_days(spark, sf):
    return rounded(quality.blank_low_wear_days(hourly(spark, sf), ["acc"], DT, 23 * 3600), "acc", digits=9).select("subject_id", "us", "acc")


@query(f"with {SIX} select subject_id, idx from six group by 1, 2 having count(*) = 6 and count(acc) = 6 and count(label) > 0")
def good_windows(spark, sf):
    return epochs.good_windows(six_hours(spark, sf), ["acc"], 6, "label")


MARKS = "d(annotation, label) as (values ('sleep', 'rest'), ('sedentary', 'rest'), ('light', 'move'), ('moderate', null))"


@query(f"""with {SIX}, {MARKS}, v as (select subject_id, idx, d.label, count(*) as n from six join d on annotation = six.label group by all)
select subject_id, idx, label from v qualify row_number() over (partition by subject_id, idx order by n desc, label nulls last) = 1""")
def window_label_mode(spark, sf):
    dictionary = epochs.relabel(spark.range(1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("annotation")), "annotation", {"sleep": "rest", "sedentary": "rest", "light": "move"}, "label")
    return epochs.window_label(six_hours(spark, sf).withColumnRenamed("label", "annotation"), dictionary, "annotation", "label")


@query("select event_id, event_type, case when event_type in ('click', 'view') then 'active' when event_type in ('purchase', 'signup') then 'busy' end as kind from events")
def dictionary_relabel(spark, sf):
    return epochs.relabel(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type"), "event_type", KINDS, "kind")


@query("""with v as (select vec_id, i, 5.0::double * embedding[i]::double as x, 5.0::double * embedding[i + 21]::double as y, 5.0::double * embedding[i + 42]::double as z from embeddings, range(1, 22) t(i))
select vec_id, round(avg(greatest(sqrt(x * x + y * y + z * z) - 1, 0) * 1000), 6) as enmo from v group by 1""")
def enmo_epochs(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("i"), "embedding")
    x, y, z = (5.0 * F.element_at("embedding", F.col("i") + k).cast("double") for k in (0, 21, 42))
    return rounded(v.groupBy("vec_id").agg(F.avg(enmo(x, y, z)).alias("enmo")), "enmo")


@query(f"""with {EP}, a as (select subject_id, us // {DAY} as day, list(acc order by us) filter (acc is not null) as v from ep where us % {DAY} // {HOUR} % 3 <> 1 or us // {DAY} % 2 = 0 group by 1, 2),
f as (select subject_id, day, len(v) as n, v, unnest(range(0, 20)) as i from a where 2 * len(v) > 20) select subject_id, day, n, i::int as i, round(v[i % n + 1], 9) as value from f""")
def window_fit_wrap(spark, sf):
    some = hourly(spark, sf).where("acc is not null").where((F.pmod(div(F.pmod("us", F.lit(DAY)), HOUR), F.lit(3)) != 1) | (F.pmod(div("us", DAY), F.lit(2)) == 0))
    a = some.groupBy("subject_id", div("us", DAY).alias("day")).agg(F.sort_array(F.collect_list(F.struct("us", "acc"))).alias("s"))
    fitted = a.select("subject_id", "day", F.size("s").cast("long").alias("n"), F.posexplode(epochs.fit(F.col("s.acc"), 20)).alias("i", "value"))
    return rounded(fitted, "value", digits=9)


@query("""with p as (select vec_id, embedding as e, i, i * 63 / 29.0::double as place from embeddings, range(0, 30) t(i)), q as (select *, floor(place)::bigint as low from p)
select vec_id, i::int as i, round(e[low + 1]::double + (e[least(low + 1, 63) + 1]::double - e[low + 1]::double) * (place - low), 6) as value from q""")
def window_resize_linear(spark, sf):
    return rounded(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode(epochs.resize(F.col("embedding"), 30)).alias("i", "value")), "value")


def _nearest_sql(step: int, tolerance: int) -> str:
    return f"""with {EV}, u as (select subject_id, us, max(value) as value from ev group by 1, 2), e as (select subject_id, min(us) // {DAY} * {DAY} as lo, (max(us) + {DAY} - 1) // {DAY} * {DAY} as hi from u group by 1),
g as (select subject_id, unnest(range(lo, hi, {step})) as us from e),
n as (select g.subject_id, g.us, u.value, row_number() over (partition by g.subject_id, g.us order by abs(u.us - g.us), u.us desc) as r from g join u on u.subject_id = g.subject_id and u.us between g.us - {tolerance} and g.us + {tolerance})
select g.subject_id, g.us, n.value from g left join n on n.subject_id = g.subject_id and n.us = g.us and r = 1"""


def _nearest(spark, sf, step_s, tolerance_s):
    some = events(spark, sf).groupBy("subject_id", "us").agg(F.max("value").alias("value"))
    return epochs.nearest(epochs.day_grid(some, step_s), some, "value", tolerance_s)


@query(_nearest_sql(10 * MINUTE, MINUTE))
def asof_nearest_grid(spark, sf):
    return _nearest(spark, sf, 600, 60)


@query(_nearest_sql(30 * MINUTE, 5 * MINUTE))
def asof_tolerance(spark, sf):
    return _nearest(spark, sf, 1800, 300)


@query(f"with {IMP} select subject_id, us, {', '.join(f'round({c}, 9) as {c}' for c in COLUMNS)} from imp")
def impute_hierarchical(spark, sf):
    return rounded(imputed(spark, sf).select("subject_id", "us", *COLUMNS), *COLUMNS, digits=9)


@query(f"""with {EP}, d as (select subject_id, us // {DAY} as d, min(us) as us, {', '.join(f'coalesce(sum({c}), 0) as {c}' for c in CLASSES)} from ep group by 1, 2),
r as (select subject_id, dense_rank() over (partition by subject_id order by d) - 1 as day, min(us) over (partition by subject_id) as first, {', '.join(CLASSES)} from d),
u as (unpivot r on {', '.join(CLASSES)} into name label value hours) select subject_id, day::int as day, ((first // {DAY} + 3) % 7)::int as first_weekday, label, round(hours, 6) as hours from u""")
def recorded_hours_by_day(spark, sf):
    return rounded(summary.recorded_hours(hourly(spark, sf), CLASSES, DT), "hours")


@query(f"with {IMP}, e as (select subject_id, min(us) // {HOUR} * {HOUR} as lo, max(us) // {HOUR} * {HOUR} as hi from ev group by 1) select subject_id, round(avg(acc), 6) as avg, round(stddev_samp(acc), 6) as sd from imp join e using (subject_id) where us between lo and hi group by 1")
def overall_mean_sd(spark, sf):
    return rounded(summary.overall(imputed(spark, sf), "acc", ends(spark, sf)), "avg", "sd")


@query(f"with {CELL} select subject_id, weekday::int as weekday, hour::int as hour, round(mean, 9) as mean from cell")
def weekday_hour_cells(spark, sf):
    return rounded(cells(spark, sf), "mean", digits=9)


@query(f"with {CELL} select subject_id, -1 as weekday, round(avg(mean), 9) as avg from cell group by 1 union all select subject_id, weekday::int, round(avg(mean), 9) from cell group by 1, 2")
def week_and_dow_avg(spark, sf):
    c = cells(spark, sf)
    return rounded(summary.week_average(c).select("subject_id", F.lit(-1).alias("weekday"), "avg").unionByName(summary.day_of_week_average(c)), "avg", digits=9)


@query(f"with {CELL} select subject_id, hour::int as hour, round(avg(mean), 9) as avg from cell group by 1, 2")
def hour_of_day_avg(spark, sf):
    return rounded(summary.hour_of_day_average(cells(spark, sf)), "avg", digits=9)


@query(f"with {CELL}, w as (select subject_id, (weekday >= 5)::int as is_weekend, hour, avg(mean) as avg from cell group by 1, 2, 3) select subject_id, is_weekend, -1 as hour, round(avg(avg), 9) as avg from w group by 1, 2 union all select subject_id, is_weekend, hour::int, round(avg, 9) from w")
def weekday_weekend_avg(spark, sf):
    c = cells(spark, sf)
    return rounded(summary.weekend_average(c).select("subject_id", "is_weekend", F.lit(-1).alias("hour"), "avg").unionByName(summary.weekend_hours(c)), "avg", digits=9)


@query(f"""with {EP}, l(level) as (select unnest([{', '.join(map(str, summary.LEVELS))}])), m(missing_below) as (values (1), (0)),
c as (select subject_id, level, missing_below, {HR} as h, {MN} as mi, avg(case when acc is null then missing_below when acc <= level then 1 else 0 end) as s from ep, l, m group by all)
select subject_id, level::int as level, missing_below, round(avg(s), 6) as share from c group by all""")
def ecdf_67_levels(spark, sf):
    both = summary.ecdf_both(hourly(spark, sf), "acc")
    each = F.explode(F.array(F.struct(F.lit(1).alias("missing_below"), F.col("share_missing_below").alias("share")), F.struct(F.lit(0).alias("missing_below"), "share"))).alias("s")
    return rounded(both.select("subject_id", "level", each).select("subject_id", "level", "s.missing_below", "s.share"), "share")


@query(f"""with {IMP}, c as (select subject_id, us // {DAY} as d, case when count(acc) * 60 > 1320 then avg(acc) end as enmo from ep group by 1, 2), a as (select subject_id, us // {DAY} as d, case when count(acc) * 60 > 1320 then avg(acc) end as adjusted from imp group by 1, 2)
select subject_id, {DATE(f'a.d * {DAY}')} as date, round(enmo, 9) as enmo, round(adjusted, 9) as adjusted from a left join c using (subject_id, d)""")
def daily_enmo(spark, sf):
    both = hourly(spark, sf).select("subject_id", "us", "acc").join(imputed(spark, sf).select("subject_id", "us", F.col("acc").alias("filled")), ["subject_id", "us"])
    return rounded(summary.daily_mean(both, {"acc": "enmo", "filled": "adjusted"}, DT, 22 * 60), "enmo", "adjusted", digits=9)


@query(f"with {IMP} select subject_id, {DATE('us')} as date, {', '.join(f'round(case when count(ep.{c}) * 60 > 1320 then sum(ep.{c}) end, 6) as {c}_hours, round(case when count(imp.{c}) * 60 > 1320 then sum(imp.{c}) end, 6) as {c}_adjusted' for c in CLASSES)} from ep join imp using (subject_id, us) group by all")
def daily_activity_hours(spark, sf):
    both = hourly(spark, sf).select("subject_id", "us", *CLASSES).join(imputed(spark, sf).select("subject_id", "us", *(F.col(c).alias(f"filled_{c}") for c in CLASSES)), ["subject_id", "us"])
    names = {c: f"{c}_hours" for c in CLASSES} | {f"filled_{c}": f"{c}_adjusted" for c in CLASSES}
    return rounded(summary.daily_hours(both, names, DT, 22 * 60), *names.values())


_POWER = "pow(sum({v} * cos(t * w)) / count(*), 2) + pow(sum({v} * sin(t * w)) / count(*), 2)"


@query(f"""with {IMP}, s as (select subject_id, row_number() over (partition by subject_id order by us) - 1 as t, 2 * pi() * 3600 / 86400 as w, acc,
case when light = greatest({', '.join(CLASSES)}) then -1.0 when moderate = greatest({', '.join(CLASSES)}) then -1.0 when sedentary = greatest({', '.join(CLASSES)}) then -1.0 when sleep = greatest({', '.join(CLASSES)}) then 1.0 else -1.0 end as z from imp)
select subject_id, round({_POWER.format(v='acc')}, 6) as psd_acc, round({_POWER.format(v='z')}, 6) as psd_sleep from s group by 1""")
def psd_daily(spark, sf):
    base = imputed(spark, sf)
    acc, sleep = (circadian.psd(base, v, DT).withColumnRenamed("psd", n) for v, n in ((F.col("acc"), "psd_acc"), (circadian.sleep_signal(CLASSES), "psd_sleep")))
    return rounded(acc.join(sleep, "subject_id"), "psd_acc", "psd_sleep")


_AT = "pow(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * ({k}) * (i - 1) / len(y)))), 2) + pow(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * ({k}) * (i - 1) / len(y)))), 2)"


@query(f"""with recursive {IMP}, fy as (select subject_id, list(acc order by us) as y from imp group by 1), fb as (select subject_id, y, k, {_AT.format(k='k')} as f from fy, range(1, 5000) r(k) where k <= len(y) // 2),
fk as (select subject_id, arg_max(k, (f, -k)) as k from fb group by 1), g as (select (1 + sqrt(5)) / 2 as g),
fz(subject_id, step, lo, hi) as (select subject_id, 0, k - 1.0::double, k + 1.0::double from fk union all
select subject_id, step + 1, case when {_AT.format(k='hi - (hi - lo) / g')} > {_AT.format(k='lo + (hi - lo) / g')} then lo else hi - (hi - lo) / g end, case when {_AT.format(k='hi - (hi - lo) / g')} > {_AT.format(k='lo + (hi - lo) / g')} then lo + (hi - lo) / g else hi end from fz join fy using (subject_id), g where step < 60)
select subject_id, round((lo + hi) / 2 / (len(y) * {DT} / 86400), 5) as frequency from fz join fy using (subject_id) where step = 60""")
def dominant_frequency(spark, sf):
    return rounded(circadian.dominant_frequency(imputed(spark, sf), "acc", DT), "frequency", digits=5)


M10L5 = f"""md as (select *, min(us) over (partition by subject_id) as first, (max(us) over (partition by subject_id) - min(us) over (partition by subject_id)) // {DAY} as days from imp), mw as (select subject_id, (us - first) // {DAY} as day, us, acc from md where (us - first) // {DAY} < days),
ms as (select *, row_number() over w as rn, count(*) over (partition by subject_id, day) as n, sum(acc) over (w rows between current row and 9 following) as s10, sum(acc) over (w rows between current row and 4 following) as s5 from mw window w as (partition by subject_id, day order by us)),
mb as (select subject_id, day, max(case when rn <= n - 10 then s10 / 10 end) as m10, min(case when rn <= n - 5 then s5 / 5 end) as l5 from ms group by 1, 2), ml as (select subject_id, avg(m10) as m10, avg(l5) as l5 from mb group by 1)"""


@query(f"with {IMP}, {M10L5} select subject_id, round(m10, 6) as m10, round(l5, 6) as l5, round((m10 - l5) / (m10 + l5), 6) as relative_amplitude, 'ok' as status from ml")
def m10_l5(spark, sf):
    return rounded(circadian.m10_l5(imputed(spark, sf), "acc", DT), "m10", "l5", "relative_amplitude")


@query(f"""with {EV}, f as (select *, min(us) over (partition by subject_id) as first from ev), r as (select subject_id, event_id, us, avg(value) over (partition by subject_id order by us range between 59999999 preceding and current row) as s from f where us < first + 7 * {DAY})
select subject_id, event_id, us, round(greatest(least(s, 300), 0), 6) as smooth from r""")
def rolling_minute_clip(spark, sf):
    return rounded(circadian.rolling_minute(circadian.first_days(events(spark, sf), 7), "value", 300.0).select("subject_id", "event_id", "us", "smooth"), "smooth")


RUNS = f"""{EP}, rc as (select *, case when row_number() over w = 1 or label is distinct from lag(label) over w then 1 else 0 end as new from ep window w as (partition by subject_id order by us)),
rr as (select *, sum(new) over (partition by subject_id order by us) as run from rc), rl as (select *, count(*) over (partition by subject_id, run) as run_length from rr)"""


@query(f"with {RUNS} select subject_id, us, label, run::bigint as run, run_length from rl")
def label_runs(spark, sf):
    return sequence.runs(hourly(spark, sf)).select("subject_id", "us", "label", "run", "run_length")


@query(f"with {RUNS} select subject_id, us, case when label = 'sleep' and run_length < 2 then 'sedentary' else label end as label from rl")
def short_sleep_removal(spark, sf):
    return sequence.remove_short_sleep(hourly(spark, sf), 2).select("subject_id", "us", "label")


@query(f"""with {EP}, i as (select *, row_number() over (partition by subject_id order by us) - 1 as i, count(*) over (partition by subject_id) as n from ep), s as (select *, case when i - lag(i) over (partition by subject_id order by us) > 6 then 1 else 0 end as new from i where label = 'sleep'),
b as (select *, sum(new) over (partition by subject_id order by us) as block from s), e as (select subject_id, block, min(i) as first, max(i) as last, max(n) as n from b group by 1, 2)
select subject_id, block::bigint as block, first::int as first, (case when n - 1 - last < 6 then n - 1 else last end)::bigint as last, (case when n - 1 - last < 6 then n - 1 else last end - first + 1)::bigint as length from e""")
def sleep_blocks(spark, sf):
    return sequence.sleep_blocks(hourly(spark, sf), 6)


BLOCKS = f"""{EP}, bi as (select *, row_number() over (partition by subject_id order by us) - 1 as i, count(*) over (partition by subject_id) as n from ep), bs as (select *, case when i - lag(i) over (partition by subject_id order by us) > 6 then 1 else 0 end as new from bi where label = 'sleep'),
bb as (select *, sum(new) over (partition by subject_id order by us) as block from bs), be as (select subject_id, min(i) as first, max(n) as n, case when max(n) - 1 - max(i) < 6 then max(n) - 1 else max(i) end as last from bb group by subject_id, block)"""


@query(f"""with recursive {BLOCKS}, inner_ as (select * from be where first <> 0 and last <> n - 1),
walk(subject_id, n, cursor, first, last) as (select subject_id, max(n), coalesce(max(last) filter (first = 0), 0), -1, -1 from be group by 1
union all select w.subject_id, w.n, case when max(b.last) is null then w.cursor + 24 else arg_max(b.last, (b.last - b.first) * 100000 - b.first) end, coalesce(arg_max(b.first, (b.last - b.first) * 100000 - b.first), -1), coalesce(arg_max(b.last, (b.last - b.first) * 100000 - b.first), -1)
from walk w left join inner_ b on b.subject_id = w.subject_id and b.first > w.cursor and b.first <= w.cursor + 24 where w.cursor + 24 < w.n group by w.subject_id, w.n, w.cursor),
keep as (select subject_id, first, last from walk where first >= 0 union select subject_id, first, last from be where first = 0 or last = n - 1)
select subject_id, us, case when label = 'sleep' and not exists (select 1 from keep k where k.subject_id = bi.subject_id and bi.i between k.first and k.last) then 'sedentary' else label end as label from bi""")
def single_sleep_block(spark, sf):
    return sequence.single_sleep_block(hourly(spark, sf), 6, 24).select("subject_id", "us", "label")


@query(f"with {EP}, k as (select *, acc / (acc + 50) as p from ep where label is not null) select label, round(count(*) / (select count(*) from k), 6) as share, round(avg(p), 6) as p_high, round(avg(1 - p), 6) as p_low from k group by 1")
def hmm_prior_emission(spark, sf):
    k = hourly(spark, sf).where("label is not null").withColumn("p_high", F.col("acc") / (F.col("acc") + 50)).withColumn("p_low", 1 - F.col("p_high"))
    return rounded(sequence.prior(k, "label").join(sequence.emission(k, "label", ["p_high", "p_low"]), "label"), "share", "p_high", "p_low")


STEPS = f"{EP}, kn as (select * from ep where label is not null), st as (select subject_id, label as source, lead(label) over w as target, lead(us) over w - us as gap from kn window w as (partition by subject_id order by us)), sc as (select subject_id, source, target, count(*) as n from st where gap = {HOUR} group by 1, 2, 3)"


@query(f"""with {STEPS}, w as (select distinct subject_id, source, target, 1 as n from ep, (values ('sleep', 'sedentary'), ('sedentary', 'sleep')) v(source, target)), p as (select 0 as pseudo, source, target, n from sc union all select 1, source, target, n from sc union all select 1, source, target, n from w anti join sc using (subject_id, source, target)),
t as (select pseudo, source, target, sum(n) as n from p group by 1, 2, 3) select pseudo, source, target, n::bigint as n, round(n / sum(n) over (partition by pseudo, source), 6) as share from t""")
def hmm_transitions(spark, sf):
    known = hourly(spark, sf).where("label is not null")
    parts = [sequence.transitions(known, "label", HOUR, p).select(F.lit(int(p is not None)).alias("pseudo"), "source", "target", "n", "share") for p in (None, ("sleep", "sedentary"))]
    return rounded(parts[0].unionByName(parts[1]), "share")


def smoother() -> sequence.HiddenMarkov:
    """A fixed smoother over the four classes: states stay, observations are right four times of five."""
    eye = np.eye(4)
    return sequence.HiddenMarkov(CLASSES, np.full(4, 0.25), eye * 0.75 + 0.0625, eye * 0.8 + 0.05)


def _viterbi_sql(log: str = "ln({}::double + 1e-16)") -> str:
    """Steps in time; a step holds the best score and path to each state. Ties go to the first state."""
    stay, move, right, wrong = (log.format(x) for x in ("(0.8::double + 0.05::double)", 0.05, 0.8125, 0.0625))
    through = lambda j: [f"(v[{i}] + {stay if i == j else move})" for i in range(1, 5)]
    emit = lambda j: f"case when code = {j} then {right} else {wrong} end"
    best = lambda j: f"list_position([{', '.join(through(j))}], greatest({', '.join(through(j))}))"
    first = ", ".join(f"{log.format(0.25)} + {emit(j)}" for j in range(1, 5))
    return f"""with recursive {EP}, vk as (select subject_id, us, label, list_position([{', '.join(f"'{c}'" for c in CLASSES)}], label) as code, row_number() over (partition by subject_id order by us) as t, us - lag(us) over (partition by subject_id order by us) as gap from ep where label is not null),
vw(subject_id, t, v, p) as (select subject_id, t, [{first}], [[1], [2], [3], [4]] from vk where t = 1 union all
select k.subject_id, k.t, [{', '.join(f"greatest({', '.join(through(j))}) + {emit(j)}" for j in range(1, 5))}], [{', '.join(f"list_append(p[{best(j)}], {j})" for j in range(1, 5))}] from vw join vk k on k.subject_id = vw.subject_id and k.t = vw.t + 1),
vl as (select subject_id, p[list_position(v, list_max(v))] as path from vw join (select subject_id, max(t) as t from vk group by 1) using (subject_id, t))
select e.subject_id, e.us, e.label, case when k.label is null then null when coalesce(k.gap, {HOUR}) <> {HOUR} then k.label else [{', '.join(f"'{c}'" for c in CLASSES)}][path[k.t]] end as smoothed from ep e left join vk k using (subject_id, us) left join vl on vl.subject_id = e.subject_id"""


@query(_viterbi_sql())
def viterbi_smooth(spark, sf):
    return smoother().smooth(hourly(spark, sf), "label", HOUR).select("subject_id", "us", "label", "smoothed")


@query(_viterbi_sql("round(ln({}::double + 1e-16) * 4294967296)::bigint"))
def viterbi_chunks(spark, sf):
    """The smoother over chunks of a day that are chained, by whole logarithms."""
    return smoother().smooth_chunks(hourly(spark, sf), "label", HOUR).select("subject_id", "us", "label", "smoothed")


@query(f"with {EP}, k as (select *, us - lag(us) over (partition by subject_id order by us) as gap from ep where label is not null) select subject_id, us, case when gap <> {HOUR} then label else 'light' end as label from k")
def gap_restore(spark, sf):
    known = hourly(spark, sf).where("label is not null").withColumn("smoothed", F.lit("light"))
    return known.select("subject_id", "us", sequence.restore_after_gaps(known, "label", "smoothed", HOUR).alias("label"))


TRUTH = "y as (select (doc_id % 4)::int as part, quality as y_true, toxic as y_pred from labels), cf as (select part, y_true, y_pred, count(*) as n from y group by 1, 2, 3)"


def _truth(spark, sf):
    return evaluate.confusion(spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") % 4).cast("int").alias("part"), F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred")), ["part"])


@query(f"with {TRUTH} select part, y_true, y_pred, n, round(n / sum(n) over (partition by part, y_true), 6) as share from cf")
def confusion_matrix(spark, sf):
    return rounded(_truth(spark, sf), "share")


@query(f"""with {TRUTH}, l as (select part, label, sum(s) as support, sum(p) as predicted, sum(h) as hit from (select part, y_true as label, n as s, 0 as p, case when y_true = y_pred then n else 0 end as h from cf union all select part, y_pred, 0, n, 0 from cf) group by 1, 2),
t as (select part, sum(hit) / sum(support) as accuracy, avg(2 * hit / (support + predicted)) as macro_f1, sum(support * predicted) / pow(sum(support), 2) as chance, avg(case when support > 0 then hit / support end) as balanced_accuracy from l group by 1)
select part, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round((accuracy - chance) / (1 - chance), 6) as kappa, round(balanced_accuracy, 6) as balanced_accuracy from t""")
def classification_metrics(spark, sf):
    return rounded(evaluate.metrics(_truth(spark, sf), ["part"]), "accuracy", "macro_f1", "kappa", "balanced_accuracy")


@query("select user_id, event_type as label, round(count(*) / 120.0, 6) as hours from events group by 1, 2")
def hours_per_class(spark, sf):
    return rounded(evaluate.hours_per_class(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_type"), "hours")


@query("select r_name as region, c_mktsegment as segment, round(avg(c_acctbal), 6) as mean, round(stddev_pop(c_acctbal), 6) as sd, round(stddev_samp(c_acctbal), 6) as sample_sd from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def metric_mean_sd_by_group(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    both = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    by = ["region", "segment"]
    pop, sample = evaluate.mean_sd(both, by, "c_acctbal"), evaluate.mean_sd(both, by, "c_acctbal", sample=True)
    return rounded(pop.drop("text").join(sample.select(*by, F.col("sd").alias("sample_sd")), by), "mean", "sd", "sample_sd")


@query("select l_returnflag as flag, round(avg(abs(l_tax * 600 - l_quantity)), 6) as mae, round(stddev_pop(abs(l_tax * 600 - l_quantity)), 6) as sd from lineitem group by 1")
def mae_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("y"), (F.col("l_tax") * 600).alias("p"))
    return rounded(evaluate.mae(rows, ["flag"], "y", "p"), "mae", "sd")


def pairs(spark, sf):
    mean = lambda p: F.avg(F.when(F.col("o_orderpriority").startswith(p), F.col("o_totalprice")))
    each = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(mean("1").alias("a"), mean("2").alias("b"))
    return each.join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).where("a is not null and b is not null").select(F.col("c_mktsegment").alias("segment"), "a", "b")


@query(f"with {PAIRS} select segment, count(*) as n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) as t from paired group by 1")
def paired_t_statistic(spark, sf):
    return rounded(evaluate.paired_t(pairs(spark, sf), ["segment"], "a", "b", p=False), "t")


@query(f"""with {PAIRS}, pt as (select segment, count(*) as n, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) as t from paired group by 1), pa as (select *, n - 1 as df, atan(t / sqrt(n - 1)) as x from pt),
pj as (select *, unnest(range(1, greatest(2, df // 2 + 2))) as j from pa), pf as (select *, case when j = 1 then 1.0 when df % 2 = 1 then (2.0 * j - 2) / (2 * j - 1) else (2.0 * j - 3) / (2 * j - 2) end as f from pj where j <= greatest(1, df // 2)),
pp as (select *, product(f) over (partition by segment order by j) as c from pf),
ps as (select segment, any_value(n) as n, any_value(t) as t, any_value(df) as df, any_value(x) as x, sum(c * pow(cos(x), case when df % 2 = 1 then 2 * j - 1 else 2 * j - 2 end)) as s from pp group by segment),
pv as (select segment, n, t, 1 - abs(case when df = 1 then 2 * x / pi() when df % 2 = 1 then 2 / pi() * (x + sin(x) * s) else sin(x) * s end) as p from ps)
select segment, n, round(t, 6) as t, round(p, 6) as p, case when p < 0.001 then '<0.001' else printf('%.3f', p) end as p_text from pv""")
def paired_t_p_value(spark, sf):
    """Student's t of a whole number of degrees of freedom as a finite series, in the SQL."""
    return rounded(evaluate.paired_t(pairs(spark, sf), ["segment"], "a", "b"), "t", "p")


@query(f"with {PAIRS} select segment, count(*) as n, round(corr(a, b), 8) as r, round(avg(a - b), 8) as mean_difference, round(stddev_samp(a - b), 8) as sd, round(avg((a + b) / 2), 8) as mean_of_means, round(avg(a - b) - 1.96 * stddev_samp(a - b), 8) as lower, round(avg(a - b) + 1.96 * stddev_samp(a - b), 8) as upper from paired group by 1")
def bland_altman(spark, sf):
    return rounded(evaluate.bland_altman(pairs(spark, sf), ["segment"], "a", "b"), "r", "mean_difference", "sd", "mean_of_means", "lower", "upper", digits=8)


@query(f"with {PAIRS} select segment, count(*) as n, round(quantile_cont(a - b, 0.25), 8) as q1, round(quantile_cont(a - b, 0.5), 8) as median, round(quantile_cont(a - b, 0.75), 8) as q3, round(avg(a - b), 8) as mean, round(stddev_samp(a - b), 8) as sd from paired group by 1")
def error_quartiles(spark, sf):
    return rounded(evaluate.error_quartiles(pairs(spark, sf), ["segment"], F.col("a") - F.col("b")), "q1", "median", "q3", "mean", "sd", digits=8)


FOLD = "(('0x' || substr(md5(user_id::varchar), 1, 8))::bigint % 5)::int"


@query(f"select event_id, user_id, {FOLD} as fold from events where {FOLD} = 0")
def group_folds_semi_join(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    held = evaluate.folds(ev.select("user_id").distinct(), "user_id", 5).where("fold = 0").select("user_id")
    return evaluate.folds(ev.join(held, "user_id", "left_semi"), "user_id", 5).select("event_id", "user_id", "fold")


@query("with c(label) as (values ('0'), ('1'), ('2')), n as (select quality::varchar as label, count(*) as n from labels group by 1) select label, round((select count(*) from labels) / coalesce(n, 1), 6) as weight from c left join n using (label)")
def class_weights(spark, sf):
    return rounded(evaluate.class_weights(spark.read.parquet(f"{sf}/labels.parquet"), "quality", ["0", "1", "2"]), "weight")


@query(f"select {FOLD} as fold, string_agg(distinct user_id::varchar, ', ' order by user_id::varchar) as members, count(distinct user_id) as n from events group by 1")
def fold_members(spark, sf):
    return evaluate.fold_members(evaluate.folds(spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct(), "user_id", 5), "user_id")


@query(f"with {SIX} select subject_id, idx, count(acc) as n, round(avg(acc), 9) as mean, round(stddev_samp(acc), 9) as sd, round(stddev_samp(acc) / avg(acc), 9) as cv, round(min(acc), 9) as min, round(max(acc), 9) as max, round(quantile_cont(acc, 0.25), 9) as p25, round(quantile_cont(acc, 0.5), 9) as median, round(quantile_cont(acc, 0.75), 9) as p75, round(avg(pow(acc - m, 3)) / pow(nullif(var_pop(acc), 0), 1.5), 9) + 0 as skew, round(avg(pow(acc - m, 4)) / pow(nullif(var_pop(acc), 0), 2) - 3, 9) + 0 as kurt from (select *, avg(acc) over (partition by subject_id, idx) as m from six) group by 1, 2")
def window_features(spark, sf):
    return rounded(epochs.window_features(six_hours(spark, sf), "acc"), "mean", "sd", "cv", "min", "max", "p25", "median", "p75", "skew", "kurt", digits=9)


@query(f"""with {EV}, s as (select subject_id, us // {HOUR} * {HOUR} as us from ev group by 1, 2 having coalesce(stddev_samp(value), 0) < 30), r as (select *, case when us - lag(us) over (partition by subject_id order by us) = {HOUR} then 0 else 1 end as new from s),
i as (select *, sum(new) over (partition by subject_id order by us) as run from r) select subject_id, min(us) as start_us, max(us) + {HOUR} as end_us from i group by subject_id, run having max(us) + {HOUR} - min(us) > {HOUR}""")
def nonwear_bouts(spark, sf):
    return quality.nonwear_bouts(events(spark, sf), ["value"], 3600, 30, 3600)


@query(f"""with {EV}, u as (select subject_id, us, max(value) as v from ev group by 1, 2), n as (select *, lead(us) over w as nu, lead(v) over w as nv, min(us) over (partition by subject_id) as f from u window w as (partition by subject_id order by us)),
g as (select subject_id, us, v, nu, nv, f, unnest(range((us - f + {10 * MINUTE} - 1) // {10 * MINUTE}, case when nu is null then (us - f) // {10 * MINUTE} else (nu - f + {10 * MINUTE} - 1) // {10 * MINUTE} - 1 end + 1)) as k from n)
select subject_id, f + k * {10 * MINUTE} as us, round(case when nu is null or f + k * {10 * MINUTE} = us then v else v + (nv - v) * ((f + k * {10 * MINUTE} - us) / (nu - us)) end, 6) as value from g""")
def resample_linear(spark, sf):
    some = events(spark, sf).groupBy("subject_id", "us").agg(F.max("value").alias("value"))
    return rounded(signal.resample(some, ["value"], 10 * MINUTE), "value")


@query("select event_id, user_id from events where ('0x' || substr(md5(user_id::varchar), 1, 8))::bigint % 10 < 3")
def subsample_users(spark, sf):
    return signal.subsample(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id"), "user_id", 3, 10)


@query(f"with {IMP} select subject_id, us, round(case when ep.acc is not null then imp.acc end, 6) as shown, round(case when ep.acc is not null then imp.acc else 0 end, 6) as shown_zero from ep join imp using (subject_id, us)")
def mask_imputed(spark, sf):
    both = imputed(spark, sf).select("subject_id", "us", "acc").join(hourly(spark, sf).select("subject_id", "us", F.col("acc").alias("raw")), ["subject_id", "us"])
    return rounded(both.select("subject_id", "us", signal.mask_imputed(both, "acc", "raw").alias("shown"), signal.mask_imputed(both, "acc", "raw", zero=True).alias("shown_zero")), "shown", "shown_zero")


def metrics(spark, sf):
    """subject_id, metric, value: the tall summary. The imputed series is written once; its cells are a small table that the averages share."""
    path = session.scratch(spark, "imputed")
    imputed(spark, sf).select("subject_id", "us", "acc").write.parquet(path)
    base = spark.read.parquet(path)
    cell = summary.cells(base, "acc")
    over, week, power, ten = summary.overall(base, "acc", ends(spark, sf)), summary.week_average(cell), circadian.psd(base, F.col("acc"), DT), circadian.m10_l5(base, "acc", DT)
    tall = lambda df, name, column: df.select("subject_id", F.lit(name).alias("metric"), F.col(column).alias("value"))
    both = over.select("subject_id", F.explode(F.array(F.struct(F.lit("acc-overall-avg").alias("metric"), F.col("avg").alias("value")), F.struct(F.lit("acc-overall-sd").alias("metric"), F.col("sd").alias("value")))).alias("m")).select("subject_id", "m.*")
    parts = [both, tall(week, "acc-week-avg", "avg"), tall(power, "PSD_acc", "psd"), tall(ten, "M10L5", "relative_amplitude")]
    parts.append(summary.hour_of_day_average(cell).select("subject_id", F.concat(F.lit("acc-hourOfDay-"), "hour", F.lit("-avg")), "avg"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_TALL = f"""with {CELL}, {M10L5}, e as (select subject_id, min(us) // {HOUR} * {HOUR} as lo, max(us) // {HOUR} * {HOUR} as hi from ev group by 1), o as (select subject_id, avg(acc) as a, stddev_samp(acc) as s from imp join e using (subject_id) where us between lo and hi group by 1),
s as (select subject_id, row_number() over (partition by subject_id order by us) - 1 as t, 2 * pi() * 3600 / 86400 as w, acc from imp),
tall as (select subject_id, 'acc-overall-avg' as metric, a as value from o union all select subject_id, 'acc-overall-sd', s from o union all select subject_id, 'acc-week-avg', avg(mean) from cell group by 1 union all select subject_id, 'PSD_acc', {_POWER.format(v='acc')} from s group by 1
union all select subject_id, 'M10L5', (m10 - l5) / (m10 + l5) from ml union all select subject_id, 'acc-hourOfDay-' || hour || '-avg', avg(mean) from cell group by subject_id, hour)"""


@query(f"{_TALL} select subject_id, metric, round(value, 6) as value from tall")
def summary_json_collate(spark, sf):
    parsed = F.from_json("summary", "map<string,double>")
    return rounded(summary.document(metrics(spark, sf)).select("subject_id", F.explode(parsed).alias("metric", "value")), "value")


@query(f"""{_TALL} select subject_id, {', '.join(f"round(max(value) filter (metric = '{m}'), 6) as {n}" for m, n in (('acc-overall-avg', 'overall_avg'), ('acc-overall-sd', 'overall_sd'), ('acc-week-avg', 'week_avg'), ('PSD_acc', 'psd_acc'), ('M10L5', 'm10_l5')))} from tall group by 1""")
def subject_summary(spark, sf):
    names = {"acc-overall-avg": "overall_avg", "acc-overall-sd": "overall_sd", "acc-week-avg": "week_avg", "PSD_acc": "psd_acc", "M10L5": "m10_l5"}
    wide = metrics(spark, sf).groupBy("subject_id").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(n) for m, n in names.items()))
    return rounded(wide, *names.values())


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return subject_summary(spark, sf)
