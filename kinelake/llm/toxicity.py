"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

On a bounded sample of labelled training rows, words and word beginnings that mark toxic texts are mined and
dealt to lexicon voters; pattern voters look at density, nearness, shouting (capitals among the whole text's characters) and their absence. A generative
model finds each voter's accuracies by expectation maximisation and discounts voters that agree beyond what
the label explains. The given label is one voter more, with an accuracy of its own. A logistic classifier over lexicon and pattern features is trained on the posterior
labels, and isotonic regression on the same rows makes its output a probability. All of this is one task over the sample; scoring covers every
row. Null and empty texts score as a text without any sign. Every row gives one row.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, fold, map_slices, mix64, release
from .language import Words

#: About how many labelled rows the model is fitted on, chosen by hash.
TRAIN_ROWS = 12_000
#: Lexicon entries at most, and the voters they are dealt to.
LEXICON, VOTERS = 384, 12
#: Letters of word beginnings and of whole words that may become entries.
BEGINNINGS, WHOLE = range(3, 8), 12
THRESHOLD = 0.7


def word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): a key for each beginning (even) and for the whole of each word (odd), as 64-bit hashes."""
    size, h = words.end - words.start, np.full(len(words.start), 1469598103934665603, np.uint64)
    who, keys = [], []
    for k in range(1, WHOLE + 1):
        on = np.flatnonzero(size >= k)
        if not len(on):
            break
        h[on] = mix64(h[on] ^ words.text[words.first[on] + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if k in BEGINNINGS:
            who.append(on)
            keys.append(h[on] & ~np.uint64(1))
        whole = on[size[on] == k]
        who.append(whole)
        keys.append(~h[whole] | np.uint64(1))
    return (np.concatenate(who), np.concatenate(keys)) if who else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


@cache
def upper() -> np.ndarray:
    """Which code points are capitals, as str.isupper() tells."""
    return np.array([chr(i).isupper() for i in range(0x110000)], bool)


class Signs:
    """What the voters and the classifier see of each text: hits of lexicon entries and patterns."""

    PATTERNS = 6

    def __init__(self, texts: list[str], lexicon: np.ndarray):
        words, n = Words(texts), len(texts)
        who, keys = word_keys(words)
        slot = np.minimum(np.searchsorted(lexicon, keys), max(0, len(lexicon) - 1))
        hit = lexicon[slot] == keys if len(lexicon) else np.zeros(len(keys), bool)
        who, slot = who[hit], slot[hit]
        self.present = np.zeros((n, len(lexicon)), bool)
        self.present[words.doc[who], slot] = True
        marked = np.unique(who)
        owner = words.doc[marked]
        hits = np.bincount(owner, minlength=n)
        count = np.bincount(words.doc, minlength=n)
        near = np.zeros(n, bool)
        if len(marked) > 1:
            near[owner[1:][(owner[1:] == owner[:-1]) & (np.diff(marked) <= 6)]] = True
        long = np.diff(words.stops, prepend=0)
        capitals = np.r_[0, np.cumsum(upper()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)])][np.r_[0, words.stops].astype(np.int64)]
        loud = np.diff(capitals) > 0.3 * np.maximum(20, long)
        cries = np.array([x.count("!") >= 3 for x in texts], bool)
        self.hits = hits
        self.patterns = np.stack([hits > 0, hits > 1, near, hits > 0.02 * np.maximum(count, 1), loud, cries], axis=1)

    def features(self) -> np.ndarray:
        return np.concatenate([self.present, self.patterns, np.log1p(self.hits)[:, None]], axis=1).astype(np.float64)


def chunks(texts: list[str], most: int = 1 << 18):
    """(first, texts) of runs of texts with about `most` characters."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > most or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0


def _key_pairs(texts: list[str], rows: np.ndarray, wanted: np.ndarray | None = None):
    """Distinct (keys, rows) of texts, of wanted (sorted) keys only if given; arrays for a run of texts at a time, in the order of keys."""
    for lo, some in chunks(texts):
        words = Words(some)
        who, keys = word_keys(words)
        if wanted is not None and len(wanted):
            hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
            who, keys = who[hit], keys[hit]
        doc = rows[lo + words.doc[who]]
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])] if len(keys) else np.zeros(0, bool)
        yield keys[new], doc[new]


def _pairs(texts: list[str], rows: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All of _key_pairs in the order of keys, then rows."""
    key, doc = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *_key_pairs(texts, rows, wanted), strict=True))
    order = np.lexsort((doc, key))
    return key[order], doc[order]


def mine(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Keys that stand in toxic rows far more than in others, strongest first. Keys are counted a run of texts at a time; only those that pass keep their rows."""
    marked = np.flatnonzero(toxic)
    key, held = np.unique(_pairs([texts[i] for i in marked], marked)[0], return_counts=True)
    wanted = key[held >= max(4, 0.004 * toxic.sum())]
    if not len(wanted):
        return wanted
    total, bad = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for key, doc in _key_pairs(texts, np.arange(len(texts)), wanted):
        slot = np.searchsorted(wanted, key)
        total += np.bincount(slot, minlength=len(wanted))
        bad += np.bincount(slot[toxic[doc]], minlength=len(wanted))
    base = max(1e-3, toxic.mean())
    ok = (bad + 0.5) / (total + 1) >= min(0.9, max(0.6, 3 * base))
    key, total, bad = wanted[ok], total[ok], bad[ok]
    if not len(key):
        return key
    precision = (bad + 0.5) / (total + 1)
    gain = bad * np.log(precision / base) + (total - bad) * np.log((1 - precision) / (1 - base))
    _, rows = _pairs(texts, np.arange(len(texts)), key)
    first = np.cumsum(total) - total
    covered, chosen, seen = np.zeros(len(texts), np.int64), [], set()
    held = np.add.reduceat(mix64(rows.astype(np.uint64) + np.uint64(1)), first)
    for i in np.lexsort((key, 1 - (key & np.uint64(1)).astype(np.int64), -gain)):
        if held[i] in seen:  # the same rows as an entry before; whole words come first
            continue
        seen.add(held[i])
        docs = rows[first[i] : first[i] + total[i]]
        docs = docs[toxic[docs]]
        if (covered[docs] < 6).any():  # what only repeats many chosen entries adds nothing
            covered[docs] += 1
            chosen.append(key[i])
        if len(chosen) == LEXICON:
            break
    return np.array(chosen, np.uint64)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row of binary votes: EM for the voters' accuracies under either label, each voter's weight discounted by its correlation with the others given the label."""
    post = start.clip(0.02, 0.98)
    for _ in range(rounds):
        prior = post.mean().clip(1e-3, 1 - 1e-3)
        yes = (votes * post[:, None]).sum(0) / max(post.sum(), 1e-9)
        no = (votes * (1 - post)[:, None]).sum(0) / max((1 - post).sum(), 1e-9)
        yes, no = yes.clip(1e-3, 1 - 1e-3), no.clip(1e-3, 1 - 1e-3)
        rest = votes - np.where(post[:, None] > 0.5, yes, no)
        spread = np.sqrt((rest**2).mean(0)).clip(1e-6)
        corr = rest.T @ rest / len(votes) / spread / spread[:, None]
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + corr.clip(0).sum(0))
        odds = np.log(prior / (1 - prior)) + (votes * np.log(yes / no) + (1 - votes) * np.log((1 - yes) / (1 - no))) @ weight
        new = 1 / (1 + np.exp(-odds.clip(-30, 30)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return new, {"prior": float(prior), "yes": yes.tolist(), "no": no.tolist(), "weight": weight.tolist()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the intercept last) by Newton steps on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of raw that fits the labels best, as places and values to interpolate between; each step leans to one half by a row."""
    at, where = np.unique(np.round(raw, 6), return_inverse=True)
    n, hit = np.bincount(where).astype(float), np.bincount(where, weights=label)
    blocks: list[list[float]] = []  # rows, hits, weighted place
    for a, b, c in zip(n, hit, at * n, strict=True):
        blocks.append([a, b, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    made = np.array(blocks)
    values = np.maximum.accumulate((made[:, 1] + 0.5) / (made[:, 0] + 1))
    return made[:, 2] / made[:, 0], values


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability of label 1 of feature rows; among equal steps the classifier's own order shows in the last digits."""
    weights = np.array(model["weights"])
    raw = x @ weights[:-1] + weights[-1]
    own = 1 / (1 + np.exp(-raw.clip(-30, 30)))
    return 0.999 * np.interp(raw, model["steps"], model["values"]) + 0.001 * own if "steps" in model else own


def fit_sample(texts: list[str], toxic: np.ndarray) -> dict:
    """The model of a labelled sample; the prior alone if it has one class only."""
    if not len(texts) or toxic.all() or not toxic.any():
        rate = (toxic.sum() + 0.5) / (len(texts) + 1)
        return {"lexicon": [], "weights": [0.0] * (Signs.PATTERNS + 1) + [float(np.log(rate / (1 - rate)))], "voters": {}}
    strong = mine(texts, toxic)
    dealt = np.arange(len(strong)) % VOTERS
    order = np.argsort(strong)
    lexicon, dealt = strong[order], dealt[order]
    signs = [Signs(some, lexicon) for _, some in chunks(texts)]
    present, patterns, x = (np.concatenate(y) for y in zip(*((z.present, z.patterns, z.features()) for z in signs), strict=True))
    votes = np.stack([*(present[:, dealt == v].any(axis=1) for v in range(VOTERS)), *patterns.T, toxic], axis=1).astype(np.float64)
    posterior, voters = label_model(votes, votes[:, [VOTERS, -1]].mean(axis=1))  # starts from the first pattern and the given label
    weights = logistic(x, posterior)
    steps, values = isotonic(x @ weights[:-1] + weights[-1], toxic.astype(float))
    return {"lexicon": [int(k) for k in lexicon], "weights": weights.tolist(), "steps": steps.tolist(), "values": values.tolist(), "voters": voters}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model from at most about train_rows ids of docs that labels.toxic (not null) covers, chosen by hash; ids with several labels count as toxic if one says so, of ids with several texts the least one counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    every = max(1, known.count() // train_rows)
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(every)) == 0)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")  # about train_rows ids
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # combined before the shuffle: one row an id, however often it stands

    def run(batches):
        texts, toxic = [], []
        for part in batches:
            texts += part.column("text").to_pylist()
            toxic += part.column("toxic").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], toxic[i]))  # the same whatever order tasks deliver
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(fit_sample([texts[i] for i in order], np.array([toxic[i] == 1 for i in order], bool)))]})
        release()

    found = sample.select("text", "toxic").repartition(1).mapInArrow(run, "model string").collect()
    return json.loads(found[0]["model"]) if found else fit_sample([], np.zeros(0, bool))


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability of label 1; a column of that name is replaced."""
    docs = docs.drop(out)
    lexicon = np.array(model["lexicon"], np.uint64)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        p = probability(model, Signs(part.column(text).fill_null("").to_pylist(), lexicon).features())
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, out])

    return map_slices(docs, text, kernel, f"{ddl(docs)}, {out} double", most=1 << 19)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned where crc32 of the id mod 3 is not 1, scored everywhere."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(rows, labels.where(fold(of=3) != 1))
    return score(rows, model).select("doc_id", F.coalesce(fold(of=3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
