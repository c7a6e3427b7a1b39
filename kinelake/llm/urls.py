"""URL filter: rules first, then gradient-boosted trees on lexical features.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. Null
urls and urls without `://` have an empty host and path. Rules hold for a host and its subdomains where the path
starts with the rule's; the longest rule wins. Urls under a rule are the labelled urls: on a bounded sample of
them trees learn from length, depth, digit share, entropy, parameter counts and statistics of the host's
suffix and the path's first part, and judge the urls that no rule fits. Every row gives one row; without labelled urls, or with one label only, urls outside
the rules are allowed or get that label. Statistics (urls, and the block rate of the labelled ones) count all rows; a url that the
trees are fitted on sees those of the other folds alone. Repeated urls count once in the fit. Features are native, so a url may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, stored

#: About how many labelled urls the trees are fitted on, chosen by hash.
TRAIN_ROWS = 20_000
#: Folds of the labelled urls for statistics.
FOLDS = 5
#: Keys that more than one in HOT_KEYS urls hold, if of HOT_BYTES at most, are broadcast: fewer than HOT_KEYS, and 21 MB at most.
HOT_KEYS, HOT_BYTES = 20_000, 1000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 64, 5, 1.0
#: (host, path, verdict)
Rules = list[tuple[str, str, str]]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path, native."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match(pages: DataFrame, rules: Rules) -> DataFrame:
    """pages with url_host, url_path, url_rule and rule_verdict (null where no rule fits); rules are few and become one expression, longest first."""
    host, path = parts(F.col("url").cast("string"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last one that fits is the longest
        fits = ((F.col("url_host") == h) | F.col("url_host").endswith(f".{h}")) & F.col("url_path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return pages.withColumns({"url_host": host, "url_path": path}).withColumns({"url_rule": rule, "rule_verdict": verdict})


#: What urls are counted by: the last two labels of the host, and the first part of the path.
KEYS = {"suffix": "substring_index(url_host, '.', -2)", "head": "substring_index(substring(url_path, 2), '/', 1)"}
STATISTICS = [f"url_{what}_{kind}" for kind in KEYS for what in ("known", "bad")]


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(5)), F.lit(FOLDS)).cast("int")


def counts(matched: DataFrame) -> DataFrame:
    """url_kind, url_key, url_fold, url_n, url_ruled, url_blocked over all rows: counts of urls, of those that a rule labels and of the blocked ones among them."""
    bad = (F.col("rule_verdict") == "block").cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.expr(key).alias("key")) for kind, key in KEYS.items())))
    rows = matched.where("url is not null").select(each.alias("k"), fold_of(F.col("url")).alias("url_fold"), bad.alias("bad"))
    return rows.groupBy(F.col("k.kind").alias("url_kind"), F.col("k.key").alias("url_key"), "url_fold").agg(F.count("*").alias("url_n"), F.count("bad").alias("url_ruled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("url_blocked"))


def rates(counted: DataFrame, kind: str) -> DataFrame:
    """counted with url_known_kind (log count of urls) and url_bad_kind (the labelled ones' block rate less that of all, leaning to 0 by 20 urls)."""
    base = counted.agg(F.try_divide(F.sum("url_blocked"), F.sum("url_ruled")).alias("url_base"))  # one row
    bad = (F.col("url_blocked") + 20 * F.col("url_base")) / (F.col("url_ruled") + 20) - F.col("url_base")
    return counted.crossJoin(F.broadcast(base)).withColumns({f"url_known_{kind}": F.log1p("url_n"), f"url_bad_{kind}": F.coalesce(bad, F.lit(0.0))})


def met(out: DataFrame, stats: DataFrame, columns: list[str], total: int) -> DataFrame:
    """out with columns of stats by url_key. Keys that more than one in HOT_KEYS urls hold, fewer than HOT_KEYS, are broadcast; the rest meet by a shuffle, through which
    rows that have met go spread by their url."""
    many = (F.col("url_n") > total / HOT_KEYS) & (F.octet_length("url_key") <= HOT_BYTES)
    hot = stats.where(many).select("url_key", F.struct(*columns).alias("url_hot"))
    rest = stats.where(~many).select("url_key", F.lit(0).cast("long").alias("url_salt"), F.struct(*columns).alias("url_cold"))
    out = out.join(F.broadcast(hot), "url_key", "left")
    out = out.withColumns({"url_key": F.when(F.isnull("url_hot"), F.col("url_key")), "url_salt": F.when(F.isnull("url_hot"), F.lit(0).cast("long")).otherwise(F.xxhash64("url"))})
    out = out.join(rest, ["url_key", "url_salt"], "left")
    return out.withColumns({c: F.coalesce(F.col("url_hot")[c], F.col("url_cold")[c]) for c in columns}).drop("url_key", "url_salt", "url_hot", "url_cold")


def with_statistics(matched: DataFrame, counted: DataFrame, own_fold: bool = True) -> DataFrame:
    """matched with STATISTICS of its keys; without its own fold's urls unless own_fold, so that what is fitted on them doesn't see its own label."""
    out = matched.withColumn("url_fold", fold_of(F.col("url")))
    total = counted.agg(F.sum("url_n")).first()[0] or 0  # each url once for every kind of key
    for kind, key in KEYS.items():
        mine, columns = counted.where(F.col("url_kind") == kind).drop("url_kind"), [f"url_known_{kind}", f"url_bad_{kind}"]
        out = out.withColumn("url_key", F.expr(key))
        if own_fold:
            rows = mine.groupBy("url_key").agg(*(F.sum(c).alias(c) for c in ("url_n", "url_ruled", "url_blocked")))
            out = met(out, rates(rows, kind), columns, total // len(KEYS))
        else:
            whole = Window.partitionBy("url_key")  # FOLDS rows at most
            rows = mine.withColumns({"url_n": F.sum("url_n").over(whole)} | {c: F.sum(c).over(whole) - F.col(c) for c in ("url_ruled", "url_blocked")})
            out = out.join(rates(rows, kind).select("url_key", "url_fold", *columns), ["url_key", "url_fold"], "left").drop("url_key")
    return out.drop("url_fold").fillna(0.0, STATISTICS)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    return F.when(F.length(text) > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s - share(c) * F.log2(share(c))))).otherwise(0.0)


def features(matched: DataFrame) -> Column:
    """array<double> of what the trees see, of rows with STATISTICS; native."""
    url, host, path = F.coalesce(F.col("url").cast("string"), F.lit("")), F.col("url_host"), F.col("url_path")
    query = F.regexp_extract(url, r"^[^?]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    digits = lambda x: F.length(x) - F.length(F.translate(x, "0123456789", ""))
    last = F.substring_index(path, "/", -1)
    made = [
        F.length(url), F.length(host), F.length(path), F.length(query), _count(host, "."), _count(path, "/"), digits(host), digits(url) / F.greatest(F.length(url), F.lit(1)),
        _count(host, "-"), _count(path, "-") + _count(path, "_"), _entropy(host), _entropy(path), F.size(pairs), F.coalesce(F.array_max(F.transform(pairs, F.length)), F.lit(0)), _count(url, "%"),
        F.array_max(F.transform(F.split(host, r"\."), F.length)), F.length(F.substring_index(host, ".", 1)), url.startswith("https").cast("int"), url.contains("#").cast("int"),
        last.contains(".").cast("int"), path.endswith("/").cast("int"), *map(F.col, STATISTICS),
    ]
    return F.array(*(x.cast("double") for x in made))


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss, on histogram bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        self.trees, margin = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        inner = (1 << DEPTH) - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, BINS), np.zeros(len(grad), int)
        for n in range(inner):
            at = np.flatnonzero(node == n)
            g, h, best = grad[at].sum(), hess[at].sum(), 1e-6
            for f in range(binned.shape[1]):
                own = binned[at, f]
                gl, hl, nl = (np.cumsum(np.bincount(own, weights=w, minlength=BINS))[:-1] for w in (grad[at], hess[at], None))
                gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                gain[(nl < LEAST) | (len(at) - nl < LEAST)] = 0
                if len(gain) and gain.max() > best:
                    best, feature[n], cut[n] = gain.max(), f, int(gain.argmax())
            node[at] = 2 * n + 1 + (binned[at, feature[n]] > cut[n])
        leaf = node - inner
        total = np.bincount(leaf, weights=grad, minlength=inner + 1), np.bincount(leaf, weights=hess, minlength=inner + 1)
        return (feature, cut, -RATE * total[0] / (total[1] + RIDGE)), leaf

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        margin, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[row, feature[node]] > cut[node])
            margin += value[node - (1 << DEPTH) + 1]
        return 1 / (1 + np.exp(-margin))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(matched: DataFrame, counted: DataFrame, train_rows: int = TRAIN_ROWS):
    """The trees, from about train_rows different urls under a rule (at most twice as many), with statistics of the other folds; label 1 is block. Only features reach the driver, so long urls don't. With one label only, that label's rate; None without any."""
    known = matched.where("url is not null and rule_verdict is not null")
    every = max(1, known.count() // train_rows)
    picked = known.where(F.pmod(F.xxhash64("url"), F.lit(every)) == 0).select("url", "url_host", "url_path", (F.col("rule_verdict") == "block").cast("double").alias("url_y")).dropDuplicates(["url"])
    picked = picked.orderBy(F.xxhash64("url", F.lit(1)), "url").limit(2 * train_rows)
    rows = with_statistics(picked, counted, own_fold=False)
    rows = rows.select("url_y", features(rows).alias("url_x"), F.xxhash64("url", F.lit(1)).alias("url_order")).toArrow().sort_by("url_order")
    if not rows.num_rows:
        return None
    y = rows.column("url_y").to_numpy()
    return float(y[0]) if y.min() == y.max() else Boosted(_matrix(rows.column("url_x")), y)


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """pages with url_host, url_path, url_rule, verdict and block_score (the trees' probability); columns of those names, and any whose name begins with url_ and is used here, are replaced."""
    own = ("url_host", "url_path", "url_rule", "rule_verdict", "verdict", "block_score", "url_key", "url_fold", "url_x", "url_salt", "url_hot", "url_cold", *STATISTICS)
    matched = match(pages.drop(*own), rules)
    counted = stored(counts(matched), "url_counts")
    model = fit(matched, counted)
    made = with_statistics(matched, counted)
    made = made.withColumn("url_x", features(made)).drop(*STATISTICS)
    kept = [c for c in made.columns if c != "url_x"]

    def run(batches):
        for part in batches:
            n = part.num_rows
            p = np.full(n, 0.0 if model is None else model) if model is None or isinstance(model, float) else model(_matrix(part.column("url_x"))) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p)], [*kept, "block_score"])

    scored = made.mapInArrow(run, f"{ddl(made.select(*kept))}, block_score double")
    return scored.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))).drop("rule_verdict")
