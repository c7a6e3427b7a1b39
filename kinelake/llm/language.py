"""Language identification with spans: script ranges, per-word n-gram scores, Viterbi with a switching penalty.

A word is a run of letters. Its script leaves the languages that were seen with that script in training; each of
those scores the word by its smoothed character n-grams of one to four, the word's ends included. Viterbi over a
document's words charges SWITCH for each change of language, so that spans of mixed texts come out. Long
documents run in segments at once: a max-plus transfer matrix for each segment, chained exactly.

Texts that are null, empty or without letters are `und` with score 0 and no spans. Languages are those of the training rows;
null languages are never learned. Every row gives one row. A word's script is that of most of its letters. Only doc_id, text and lang are
read for the fit, and other columns stay as they are unless they have the name of a new one.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .common import ddl, fold, map_slices, slices

#: About how many labelled rows the model is fitted on, chosen by hash.
TRAIN_ROWS = 20_000
BITS = 17
#: Nats that a change of language costs.
SWITCH = 12.0
#: Words of a segment.
SEGMENT = 256
#: Share of a language's letters from which on a script is one of its scripts.
SCRIPT_SHARE = 0.005
NEVER = -1e6

#: First and last code point of scripts, from the Unicode blocks; what is in none counts as script 0.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(x for x, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form and script of each code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(classes() == LETTER).tolist():
        if len(x := chr(i).lower()) == 1:
            low[i] = ord(x)
    script = np.zeros(0x110000, np.uint8)
    for name, lo, hi in SCRIPTS:
        script[lo : hi + 1] = SCRIPT_NAMES.index(name)
    return low, script


class Words:
    """The words of texts: first and last code point, document, script; and the n-gram buckets that start at each code point."""

    def __init__(self, texts: list[str]):
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.stops = np.cumsum([len(x) for x in texts])
        low, script = letters()
        inside = np.zeros(len(chars) + 2, bool)
        inside[1:-1] = classes()[chars] == LETTER
        cut = np.zeros(len(chars) + 1, bool)
        cut[np.concatenate(([0], self.stops))] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.doc = np.searchsorted(self.stops, self.start, "right")
        self.script = self.scripts(script[chars], inside[1:-1]) if len(self.start) else np.zeros(0, np.uint8)
        # each word with a mark before and after it, one after another
        size = self.end - self.start
        self.first = np.cumsum(size + 2) - (size + 2)
        self.count = size + 2
        at = np.repeat(self.start - 1 - self.first, size + 2) + np.arange((size + 2).sum())
        marks = np.concatenate((self.first, self.first + size + 1))
        at[marks] = 0
        self.text = low[chars[at]] if len(chars) else np.zeros(0, np.uint32)
        self.text[marks] = 0
        self.last = np.repeat(self.first + size + 1, size + 2)

    def scripts(self, script: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The script of most letters of each word, the first in SCRIPT_NAMES of equals."""
        first = script[self.start]
        change = np.r_[(script[1:] != script[:-1]) & letter[1:] & letter[:-1], False]
        for i in np.flatnonzero(np.logical_or.reduceat(change, self.start)).tolist():
            first[i] = np.bincount(script[self.start[i] : self.end[i]]).argmax()
        return first

    def grams(self):
        """For n from 1 to 4: where n-grams start among the marked words, and their buckets."""
        x, place = self.text * np.uint32(0x9E3779B1), np.arange(len(self.text))
        h = x
        for n in range(1, 5):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[n - 1 :]
            ok = place[: len(h)] + n - 1 <= self.last[: len(h)]
            yield place[: len(h)][ok], ((h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))[ok]


#: Places in a language's counts: n-gram buckets, then letters by script. They are summed in blocks.
PLACES, COUNT_BLOCK = (4 << BITS) + len(SCRIPT_NAMES), 1 << 13


def counted(picked: DataFrame) -> DataFrame:
    """lang, block, n: n-gram counts, and letters by script, of each language, as arrays of COUNT_BLOCK places. Tasks count what they have, then each block is summed on its own."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", 1 << 19):
            words = Words(part.column("text").to_pylist())
            names, code = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            own = code[words.doc]
            owner = np.repeat(own, words.count)
            for name in names:
                counts.setdefault(name, np.zeros(-(-PLACES // COUNT_BLOCK) * COUNT_BLOCK, np.int64))
            for n, (place, bucket) in enumerate(words.grams()):
                for i, name in enumerate(names):
                    counts[name][n << BITS : (n + 1) << BITS] += np.bincount(bucket[owner[place] == i], minlength=1 << BITS)
            for i, name in enumerate(names):
                counts[name][4 << BITS : PLACES] += np.bincount(words.script[own == i], weights=(words.end - words.start)[own == i], minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for name, every in counts.items():
            blocks = every.reshape(-1, COUNT_BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(used), "block": pa.array(used, pa.int32()), "n": [zlib.compress(blocks[k].astype("<i8").tobytes(), 1) for k in used]})

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for raw in part.column("n").to_pylist():
            total += np.frombuffer(zlib.decompress(raw), "<i8")
        return pa.table({"lang": part.column("lang")[:1], "block": part.column("block")[:1], "n": [zlib.compress(total.tobytes(), 1)]})

    kind = "lang string, block int, n binary"
    return picked.mapInArrow(run, kind).groupBy("lang", "block").applyInArrow(add, kind)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict | None:
    """The model, from at most about train_rows rows of docs with text and language, chosen by a hash of id and text; None if there are none. Rows that repeat another count once."""
    known = docs.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    every = max(1, known.select("lang").count() // train_rows)
    picked = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(every)) == 0) if every > 1 else known
    counts: dict[str, np.ndarray] = {}
    for row in counted(picked.dropDuplicates(["doc_id", "text", "lang"])).collect():  # 65 rows a language
        every = counts.setdefault(row["lang"], np.zeros(-(-PLACES // COUNT_BLOCK) * COUNT_BLOCK))
        every[row["block"] * COUNT_BLOCK :][:COUNT_BLOCK] = np.frombuffer(zlib.decompress(row["n"]), "<i8")
    if not counts:
        return None
    names = sorted(counts)
    table = np.zeros((4 << BITS, len(names)), np.float32)
    for i, name in enumerate(names):
        for n in range(4):
            own = counts[name][n << BITS : (n + 1) << BITS]
            table[n << BITS : (n + 1) << BITS, i] = np.log((own + 0.1) / (own.sum() + 0.1 * (1 << BITS)))
    scripts = np.array([counts[x][4 << BITS : PLACES] for x in names])
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))  # (language, script)
    allowed[:, ~allowed.any(axis=0)] = True  # a script that nobody has narrows nothing
    return {"langs": names, "table": table, "allowed": allowed}


def viterbi(score: np.ndarray, doc: np.ndarray, switch: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """The best language of each word; words of a document stand together. Ties go to staying, then to the first language."""
    n, k = score.shape
    code = np.int8 if k < 128 else np.int32
    if not n:
        return np.zeros(0, code)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.r_[first, n])
    parts = -(-sizes // segment)
    seg_doc = np.repeat(np.arange(len(first)), parts)
    nth = np.arange(len(seg_doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[seg_doc] + nth * segment
    size = np.minimum(sizes[seg_doc] - nth * segment, segment)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    seg_first = np.cumsum(parts) - parts
    live = np.searchsorted(-size, -np.arange(segment), "left")  # how many segments have more than t words
    steps = int(size[0])

    def step(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = v.argmax(axis=-1)[..., None]
        jump = np.take_along_axis(v, best, -1) - switch
        return np.maximum(v, jump), np.where(jump > v, best, np.arange(k))

    enter = np.zeros((len(start), k))  # scores on entering a segment
    longest = int(parts.max())
    if longest > 1:
        many = np.flatnonzero(np.repeat(parts > 1, parts)[order])
        few = np.searchsorted(many, live)
        v = np.where(np.eye(k, dtype=bool), 0.0, NEVER * 1e3)[None].repeat(len(many), 0)
        for t in range(steps):
            m = int(few[t]) if t < segment else 0
            if not m:
                break
            w, _ = step(v[:m])
            v[:m] = w + score[start[many[:m]] + t][:, None, :]
        slot = np.full(len(start), -1)
        slot[many] = np.arange(len(many))
        for i in range(1, longest):
            docs = np.flatnonzero(parts > i)
            before, now = place[seg_first[docs] + i - 1], place[seg_first[docs] + i]
            enter[now] = (enter[before][:, :, None] + v[slot[before]]).max(axis=1)
    back = np.empty((n, k), code)
    v = enter.copy()
    for t in range(steps):
        m = int(live[t])
        w, b = step(v[:m])
        back[start[:m] + t] = b
        v[:m] = w + score[start[:m] + t]
    # backwards from every last language of each segment, then the right one is chosen
    at = np.arange(k, dtype=code)[None].repeat(len(start), 0)
    paths = np.empty((n, k), code)
    for t in range(steps - 1, -1, -1):
        m = int(live[t])
        paths[start[:m] + t] = at[:m]
        at[:m] = np.take_along_axis(back[start[:m] + t], at[:m], 1)
    chosen = np.empty(len(start), np.int64)
    ends = place[seg_first + parts - 1]
    chosen[ends] = v[ends].argmax(axis=1)
    for i in range(longest - 1, 0, -1):
        docs = np.flatnonzero(parts > i)
        now, before = place[seg_first[docs] + i], place[seg_first[docs] + i - 1]
        chosen[before] = at[now, chosen[now]]
    owner = np.repeat(np.arange(len(seg_doc)), size[place])
    return paths[np.arange(n), chosen[place[owner]]]


def word_scores(words: Words, model: dict) -> np.ndarray:
    """Log-likelihood of each word under each language; NEVER where its script rules the language out."""
    k = len(model["langs"])
    total = np.zeros((len(words.text), k), np.float32)
    for n, (place, bucket) in enumerate(words.grams()):
        total[place] += model["table"][(n << BITS) + bucket]
    score = np.add.reduceat(total, words.first, axis=0) / 4 if len(words.first) else np.zeros((0, k))
    return score.astype(np.float64) + np.where(model["allowed"].T[words.script], 0.0, NEVER)


def label(texts: list[str], model: dict, spans: bool = False) -> tuple[list[str], np.ndarray, list | None]:
    """Language, score (its share of the letters) and spans of each text."""
    words = Words(texts)
    best = viterbi(word_scores(words, model), words.doc)
    k = len(model["langs"])
    share = np.bincount(words.doc * k + best.astype(np.int64), weights=words.end - words.start, minlength=len(texts) * k).reshape(len(texts), k)
    total = share.sum(axis=1)
    lang = [model["langs"][i] if n else "und" for i, n in zip(share.argmax(axis=1).tolist(), total.tolist(), strict=True)]
    score = share.max(axis=1) / np.maximum(total, 1)
    if not spans:
        return lang, score, None
    found: list[list] = [[] for _ in texts]
    base = np.concatenate(([0], words.stops[:-1]))
    if len(best):
        new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (words.doc[1:] != words.doc[:-1])])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(best)], strict=True):
            d = int(words.doc[a])
            found[d].append({"start": int(words.start[a] - base[d]), "end": int(words.end[b - 1] - base[d]), "lang": model["langs"][best[a]]})
    return lang, score, found


def identify(docs: DataFrame, model: dict | None, spans: bool = False, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and, if asked, spans (in characters); their names begin with prefix. Columns of those names are replaced."""
    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "spans")[: 2 + spans]]
    kinds = ("string", "double", "array<struct<start:int,end:int,lang:string>>")
    docs = docs.drop(*names)
    if model is None:  # nothing could be learned
        return docs.withColumns({n: F.lit("und" if k == "string" else 0.0 if k == "double" else None).cast(k) for n, k in zip(names, kinds, strict=False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        made = label(part.column(text).fill_null("").to_pylist(), shared.value, spans)
        kinds_ = (pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
        return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(made[: len(names)], kinds_, strict=False))], [*part.schema.names, *names])

    return map_slices(docs, text, kernel, ", ".join([ddl(docs), *(f"{n} {k}" for n, k in zip(names, kinds, strict=False))]), most=1 << 19)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned where crc32 of the id mod 4 is not 2, predicted everywhere."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(rows.where(fold(of=4) != 2))
    return identify(rows.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(of=4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
