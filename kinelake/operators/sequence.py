"""Label sequences: runs, sleep rules, the hidden Markov smoother. Series are (subject_id, us, label columns)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions.scalar import DAY, div


def by_subject() -> Window:
    return Window.partitionBy("subject_id")


def in_order() -> Window:
    return by_subject().orderBy("us")


def runs(df: DataFrame, label: str = "label") -> DataFrame:
    """df with run (from 1) and run_length; missing labels are runs of their own."""
    change = ~F.col(label).eqNullSafe(F.lag(label).over(in_order())) | (F.row_number().over(in_order()) == 1)
    made = df.withColumn("new_", change.cast("int")).withColumn("run", F.sum("new_").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return made.withColumn("run_length", F.count("*").over(Window.partitionBy("subject_id", "run"))).drop("new_")


def remove_short_sleep(df: DataFrame, least: int, label: str = "label", sleep: str = "sleep", sedentary: str = "sedentary") -> DataFrame:
    """Sleep runs of fewer than `least` epochs become sedentary."""
    short = (F.col(label) == sleep) & (F.col("run_length") < least)
    return runs(df, label).withColumn(label, F.when(short, F.lit(sedentary)).otherwise(F.col(label))).drop("run", "run_length")


def sleep_blocks(df: DataFrame, gap: int, label: str = "label", sleep: str = "sleep") -> DataFrame:
    """subject_id, block (from 0), first, last (epoch numbers), length: sleep with gaps of fewer than `gap` epochs; a block still open at the end runs to the last epoch."""
    numbered = df.withColumn("i", F.row_number().over(in_order()) - 1).withColumn("n", F.count("*").over(by_subject()))
    asleep = numbered.where(F.col(label) == sleep)
    new = F.coalesce((F.col("i") - F.lag("i").over(in_order()) > gap).cast("int"), F.lit(0))
    made = asleep.withColumn("new_", new).withColumn("block", F.sum("new_").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    ends = made.groupBy("subject_id", "block").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.max("n").alias("n"))
    last = F.when(F.col("n") - 1 - F.col("last") < gap, F.col("n") - 1).otherwise(F.col("last"))
    return ends.select("subject_id", "block", "first", last.alias("last")).withColumn("length", F.col("last") - F.col("first") + 1)


def choose_blocks(first: list[int], last: list[int], n: int, period: int) -> list[int]:
    """Blocks that stay: those at either edge, and of the others the longest that starts within each period after the last choice's end, the earliest of equals. A block at the start sets where the search begins."""
    edge = {k for k, (a, b) in enumerate(zip(first, last, strict=True)) if a == 0 or b == n - 1}
    kept, cursor = set(edge), max((last[k] for k in edge if first[k] == 0), default=0)
    while cursor + period < n:
        among = [k for k in range(len(first)) if k not in edge and cursor < first[k] <= cursor + period]
        if among:
            best = max(among, key=lambda k: (last[k] - first[k], -first[k]))
            kept.add(best)
            cursor = last[best]
        else:
            cursor += period
    return sorted(kept)


def still_label(labels: list[str]) -> str:
    """What sleep that doesn't count becomes: sedentary, or sit-stand where a scheme has none; schemes without sleep or either are an error."""
    for name in ("sedentary", "sit-stand"):
        if "sleep" in labels and name in labels:
            return name
    raise ValueError("sleep rules need the labels sleep, and sedentary or sit-stand")


def single_sleep_block(df: DataFrame, gap: int, period: int, label: str = "label", sleep: str = "sleep", sedentary: str = "sedentary") -> DataFrame:
    """Sleep outside the chosen blocks becomes sedentary. The choice walks each subject's small block table; the edit is a join."""
    blocks = sleep_blocks(df, gap, label, sleep).join(df.groupBy("subject_id").agg(F.count("*").alias("n")), "subject_id")
    kind = dict(df.dtypes)["subject_id"]

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first").reset_index(drop=True)
        return part.loc[choose_blocks(part["first"].tolist(), part["last"].tolist(), int(part["n"].iloc[0]), period), ["subject_id", "first", "last"]]

    chosen = blocks.groupBy("subject_id").applyInPandas(choose, f"subject_id {kind}, first int, last int")
    held = chosen.select("subject_id", F.explode(F.sequence("first", "last")).alias("i_"), F.lit(True).alias("held_"))
    numbered = df.withColumn("i_", F.row_number().over(in_order()) - 1)
    edit = (F.col(label) == sleep) & F.col("held_").isNull()
    return numbered.join(held, ["subject_id", "i_"], "left").withColumn(label, F.when(edit, F.lit(sedentary)).otherwise(F.col(label))).drop("i_", "held_")


def prior(df: DataFrame, label: str) -> DataFrame:
    """label, share."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).select(F.col(label).alias("label"), "share")


def emission(df: DataFrame, label: str, probabilities: list[str]) -> DataFrame:
    """label and the mean predicted probability of each class."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*(F.avg(p).alias(p) for p in probabilities))


def transitions(df: DataFrame, label: str, interval_us: int | None, pseudo: tuple[str, str] | None = None) -> DataFrame:
    """source, target, n, share: pairs of successive labels of a subject, interval_us apart if given. pseudo: subjects without a step between these two labels get one, either way."""
    pair = df.select("subject_id", F.col(label).alias("source"), F.lead(label).over(in_order()).alias("target"), (F.lead("us").over(in_order()) - F.col("us")).alias("gap"))
    steps = pair.where("source is not null and target is not null" + (f" and gap = {interval_us}" if interval_us is not None else ""))
    counts = steps.groupBy("subject_id", "source", "target").agg(F.count("*").alias("n"))
    if pseudo:
        a, b = pseudo
        ways = F.explode(F.array(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")), F.struct(F.lit(b).alias("source"), F.lit(a).alias("target")))).alias("w")
        wanted = df.select("subject_id").distinct().select("subject_id", ways).select("subject_id", "w.source", "w.target", F.lit(1).cast("long").alias("n"))
        counts = counts.union(wanted.join(counts.select("subject_id", "source", "target"), ["subject_id", "source", "target"], "left_anti").select(counts.columns))
    total = counts.groupBy("source", "target").agg(F.sum("n").alias("n"))
    return total.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


#: Codes that are decoded at once.
SEGMENT = 4096
#: Less than any sum of logarithms: no way between two states.
_NEVER = -(1 << 62)


def _scan(items: np.ndarray, join) -> np.ndarray:
    """The joins of items 0 to t for each t, in about log2(n) rounds of whole arrays."""
    step = 1
    while step < len(items):
        items = np.concatenate((items[:step], join(items[:-step], items[step:])))
        step *= 2
    return items


def _through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores over two steps: the max-plus product of matrices, pair by pair."""
    out = a[..., :, 0, None] + b[..., 0, None, :]
    for i in range(1, a.shape[-1]):
        np.maximum(out, a[..., :, i, None] + b[..., i, None, :], out=out)
    return out


def _moves(codes: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(states, states): the best score of observing `codes` from the state before them to the last; without codes, staying costs nothing and nothing else is possible."""
    k = len(move)
    if not len(codes):
        return np.where(np.eye(k, dtype=bool), 0, _NEVER)
    items = move + emit[:, codes].T[:, None, :]
    while len(items) > 1:
        odd = items[-1:] if len(items) % 2 else items[:0]
        items = np.concatenate((_through(items[:-1:2], items[1::2]), odd))
    return items[0]


def _forward(codes: np.ndarray, before: np.ndarray | None, start: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores of the states after the last code, the best as 0, and (codes, states) the best state before each; `before`: the scores before the first code, none where a series starts."""
    seen = emit[:, codes].T
    opened = (start if before is None else (before[:, None] + move).max(axis=0)) + seen[0]
    ways = _scan(move + seen[1:, None, :], _through)
    scores = np.concatenate((opened[None], (opened[:, None] + ways).max(axis=1)))
    back = (scores[:-1, :, None] + move).argmax(axis=1)
    first = np.arange(len(move)) if before is None else (before[:, None] + move).argmax(axis=0)
    return scores[-1] - scores[-1].max(), np.concatenate((first[None], back))


def _trace(back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, states): where the best path to each last state is at every code; and where it came from."""
    k = back.shape[1]
    chained = _scan(np.concatenate((np.arange(k)[None], back[::-1])), lambda a, b: np.take_along_axis(b, a, axis=1))
    return chained[-2::-1], chained[-1]


class HiddenMarkov:
    """Prior, emission and transition over sorted labels; matrices have every configured label."""

    def __init__(self, labels: list[str], prior: np.ndarray, emission: np.ndarray, transition: np.ndarray, uniform: bool = True):
        self.labels, self.prior, self.emission, self.transition, self.uniform = sorted(labels), np.asarray(prior, float), np.asarray(emission, float), np.asarray(transition, float), uniform

    @classmethod
    def fit(cls, df: DataFrame, labels: list[str], true: str, probabilities: list[str], interval_us: int | None, pseudo: tuple[str, str] | None = None) -> HiddenMarkov:
        """probabilities: the column of each sorted label's predicted probability."""
        names = sorted(labels)
        share = {r["label"]: r["share"] for r in prior(df, true).collect()}
        rows = {r["label"]: [r[p] for p in probabilities] for r in emission(df, true, probabilities).collect()}
        steps = {(r["source"], r["target"]): r["share"] for r in transitions(df, true, interval_us, pseudo).collect()}
        if not share:
            raise ValueError("no labelled rows")
        return cls(names, np.array([share.get(x, 0.0) for x in names]), np.array([rows.get(x, [0.0] * len(names)) for x in names]), np.array([[steps.get((a, b), 0.0) for b in names] for a in names]))

    def decode(self, codes: np.ndarray, uniform: bool = False) -> np.ndarray:
        """The likeliest states of observed label codes; ties to the lowest code."""
        log = lambda x: np.log(x + 1e-16)
        k = len(self.labels)
        start = log(np.full(k, 1 / k) if self.uniform or uniform else self.prior)
        emit, move = log(self.emission), log(self.transition)
        back, score = np.zeros((len(codes), k), np.int8), start + emit[:, codes[0]]
        for t in range(1, len(codes)):
            through = score[:, None] + move
            back[t] = through.argmax(axis=0)
            score = through.max(axis=0) + emit[:, codes[t]]
        out = np.empty(len(codes), int)
        out[-1] = score.argmax()
        for t in range(len(codes) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def smooth(self, df: DataFrame, label: str, interval_us: int | None, out: str = "smoothed") -> DataFrame:
        """df with `out`: the decoded labels of each subject's labelled rows; the first after a gap keeps its own. Missing labels stay missing."""
        model, kind = self, dict(df.dtypes)["subject_id"]

        def kernel(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("us")
            known = part[part[label].notna()]
            made = pd.Series(None, index=part.index, dtype=object)
            if len(known):
                codes = known[label].map({x: i for i, x in enumerate(model.labels)})
                if codes.isna().any():
                    raise ValueError("unknown label")
                made[known.index] = [model.labels[i] for i in model.decode(codes.to_numpy(int))]
                if interval_us is not None:
                    gap = known["us"].diff().fillna(interval_us) != interval_us
                    made[known.index[gap]] = known.loc[gap, label]
            return pd.DataFrame({"subject_id": part["subject_id"], "us": part["us"], out: made})

        smoothed = df.select("subject_id", "us", label).groupBy("subject_id").applyInPandas(kernel, f"subject_id {kind}, us long, {out} string")
        return df.join(smoothed, ["subject_id", "us"])

    def _logs(self, uniform: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, emission and transition as whole numbers of 2^-32 of a natural logarithm: their sums are exact, so series may be cut anywhere."""
        log = lambda x: np.rint(np.log(x + 1e-16) * 2.0**32).astype(np.int64)
        k = len(self.labels)
        return log(np.full(k, 1 / k) if self.uniform or uniform else self.prior), log(self.emission), log(self.transition)

    def decode_segments(self, codes: np.ndarray, uniform: bool = False) -> np.ndarray:
        """The likeliest states of observed label codes by whole logarithms: paths of equal score are told apart by the lowest code, where the rounding of `decode` chooses. Segments of SEGMENT codes are joined exactly."""
        start, emit, move = self._logs(uniform)
        cuts = [codes[i : i + SEGMENT] for i in range(0, len(codes), SEGMENT)]
        if not cuts:
            return np.zeros(0, int)
        before, back = None, []
        for part in cuts:
            before, arrows = _forward(part, before, start, emit, move)
            back.append(arrows)
        out, state = [], int(before.argmax())
        for arrows in reversed(back):
            states, came = _trace(arrows)
            out.append(states[:, state])
            state = int(came[state])
        return np.concatenate(out[::-1])

    def smooth_chunks(self, df: DataFrame, label: str, interval_us: int | None, out: str = "smoothed", chunk_us: int = DAY) -> DataFrame:
        """`smooth` for series of any length, decoded by `decode_segments`: df with `out`, the labels of each subject's labelled rows, whose times are unique; the first after a gap keeps its own. Missing labels stay missing, and rows without a subject get none. The work's groups are a subject's chunks of time: each says how it moves
        the scores of the states, a subject's chunks (a row each) are chained, each finds its paths from the scores before it, and the chain back picks one of them."""
        start, emit, move = self._logs()
        names, kind = self.labels, dict(df.dtypes)["subject_id"]
        k = len(names)
        code = F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
        row = F.struct("us", F.when(code >= 0, code).otherwise(F.raise_error(F.lit("unknown label"))).cast("int").alias("code"))
        chunks = df.where(F.col(label).isNotNull() & F.col("subject_id").isNotNull()).groupBy("subject_id", div("us", chunk_us).alias("chunk_")).agg(F.sort_array(F.collect_list(row)).alias("s_")).select("subject_id", "chunk_", F.col("s_.us").alias("us_"), F.col("s_.code").alias("code_"))

        def told(parts):
            for part in parts:
                part["moves_"] = [_moves(c[1:], emit, move).ravel().tolist() for c in part["code_"]]
                yield part[["subject_id", "chunk_", "first_", "last_", "open_", "moves_"]]

        def chain(part: pd.DataFrame) -> pd.DataFrame:
            rows, before, last = [], None, None
            for r in part.sort_values("chunk_").itertuples():
                rows.append((r.subject_id, r.chunk_, before if before is None else before.tolist(), last))
                opened = (start if before is None else (before[:, None] + move).max(axis=0)) + emit[:, r.open_]
                before, last = (opened[:, None] + np.array(r.moves_).reshape(k, k)).max(axis=0), r.last_
                before -= before.max()
            return pd.DataFrame({c: pd.Series(v, dtype="Int64" if c == "last_" else object) for c, v in zip(("subject_id", "chunk_", "before_", "last_"), zip(*rows, strict=True), strict=True)})

        def paths(parts):
            for part in parts:
                made = []
                for codes, before in zip(part["code_"], part["before_"], strict=True):
                    after, arrows = _forward(codes, None if before is None else np.asarray(before), start, emit, move)
                    states, came = _trace(arrows)
                    made.append((states.T.ravel().astype("int8").tobytes(), came.tolist(), int(after.argmax())))
                part["paths_"], part["came_"], part["best_"] = zip(*made, strict=True) if made else ([], [], [])
                yield part[["subject_id", "chunk_", "us_", "code_", "last_", "paths_", "came_", "best_"]]

        def chain_back(part: pd.DataFrame) -> pd.DataFrame:
            part, state, ends = part.sort_values("chunk_", ascending=False), None, []
            for r in part.itertuples():
                ends.append(r.best_ if state is None else state)
                state = r.came_[ends[-1]]
            return pd.DataFrame({"subject_id": part["subject_id"], "chunk_": part["chunk_"], "end_": ends})

        key, rows = ["subject_id", "chunk_"], f"subject_id {kind}, chunk_ long"
        summary = chunks.select(*key, "code_", F.element_at("us_", 1).alias("first_"), F.element_at("us_", -1).alias("last_"), F.element_at("code_", 1).alias("open_"))
        moves = summary.mapInPandas(told, f"{rows}, first_ long, last_ long, open_ int, moves_ array<long>")
        states = moves.groupBy("subject_id").applyInPandas(chain, f"{rows}, before_ array<long>, last_ long")
        found = chunks.join(states, key).mapInPandas(paths, f"{rows}, us_ array<long>, code_ array<int>, last_ long, paths_ binary, came_ array<int>, best_ int")
        ends = found.select(*key, "came_", "best_").groupBy("subject_id").applyInPandas(chain_back, f"{rows}, end_ int")

        def told_rows(parts):
            for part in parts:
                for subject, us, codes, last, ways, end in part[["subject_id", "us_", "code_", "last_", "paths_", "end_"]].itertuples(index=False):
                    us, states = np.asarray(us), np.frombuffer(ways, np.int8).reshape(k, -1)[end]
                    if interval_us is not None:
                        gap = np.diff(us, prepend=us[0] - interval_us if pd.isna(last) else int(last)) != interval_us
                        states = np.where(gap, codes, states)
                    yield pd.DataFrame({"subject_id": [subject] * len(us), "us": us, out: np.array(names, object)[states]})

        smoothed = found.join(ends, key).mapInPandas(told_rows, f"subject_id {kind}, us long, {out} string")
        return df.join(smoothed, ["subject_id", "us"], "left")

    def ordered(self, labels: list[str]) -> dict[str, np.ndarray]:
        """prior, emission and transition with rows and columns in the order of `labels`, each of which must be known once."""
        if sorted(labels) != self.labels:
            raise ValueError(f"not the labels {self.labels}: {labels}")
        at = [self.labels.index(x) for x in labels]
        return {"prior": self.prior[at], "emission": self.emission[np.ix_(at, at)], "transition": self.transition[np.ix_(at, at)]}

    def pretty(self, labels: list[str] | None = None, digits: int = 3) -> str:
        """The matrices as text, in an order of labels."""
        labels = labels or self.labels
        parts = (f"{name}\n{np.array2string(x.round(digits), suppress_small=True)}" for name, x in self.ordered(labels).items())
        return "\n\n".join((", ".join(labels), *parts))

    def to_json(self) -> str:
        return json.dumps({"labels": self.labels, "prior": self.prior.tolist(), "emission": self.emission.tolist(), "transition": self.transition.tolist(), "uniform": self.uniform})

    @classmethod
    def from_json(cls, text: str) -> HiddenMarkov:
        return cls(**json.loads(text))


def restore_after_gaps(df: DataFrame, raw: str, smoothed: str, interval_us: int) -> Column:
    """The smoothed label, but the raw one on the first epoch after a gap."""
    gap = F.col("us") - F.lag("us").over(in_order()) != interval_us
    return F.when(F.coalesce(gap, F.lit(False)), F.col(raw)).otherwise(F.col(smoothed))
