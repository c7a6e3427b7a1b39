"""Byte-level BPE encoding and decoding with length-bucketed NumPy matrices.

Texts of a slice are cut into pieces by their characters' classes, all at once; a piece is found by a
64-bit hash and then compared byte by byte, so that pieces alike by hash alone never share ids. Pieces that are new to a worker are laid into padded matrices,
one for each power-of-two length. In each round every row merges its leftmost pair of minimum rank;
ranks come from an open-addressing hash table over id pairs, and rows without a mergeable pair leave
the matrix. Pieces over LONG_PIECE bytes, of which a text seldom has one, take a heap instead: same
merges, n log n. Null and empty texts have no ids. Every row gives one row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_slices, mix64

LONG_PIECE = 512
#: Pieces that a worker remembers; then it starts anew.
CACHE_ENTRIES = 300_000
NONE = np.int32(np.iinfo(np.int32).max)
OTHER, LETTER, NUMBER, SPACE = range(4)
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point as the split patterns see it."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


#: Bytes that one prefix sum covers; longer texts go block by block.
BLOCK = 1 << 21
#: Spans over this many bytes are hashed one at a time.
LONG_SPAN = 512


@lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse's powers modulo 2**64, for i below 2**bits."""
    ups, downs = np.empty(1 << bits, np.uint64), np.empty(1 << bits, np.uint64)
    ups[0] = downs[0] = 1
    ups[1:], downs[1:] = BASE, pow(BASE, -1, 1 << 64)
    return np.multiply.accumulate(ups, out=ups), np.multiply.accumulate(downs, out=downs)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of data with rising powers, and the powers that bring a difference of two of them to one scale."""
    up, down = powers(max(22, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time, each mixed into what came before, so that no algebra of sums makes two spans alike; long spans by BLAKE2b. Lanes are independent of each other."""
    size = (ends - starts).astype(np.int64)
    out = mix64(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 * (lane + 1) % 2**64))
    spread = np.uint64((0xD6E8FEB86659FD93 + 2 * lane) % 2**64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left = size[live] - at
        chunk = eight[starts[live] + at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix64(out[live] * spread ^ chunk)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_lo: np.ndarray, b: np.ndarray, b_lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[a_lo : a_lo + size] equals b[b_lo : b_lo + size], byte by byte, of each span."""
    out, has = np.ones(len(size), bool), np.flatnonzero(size > 0)
    first = 0
    upto = np.cumsum(size[has])
    while first < len(has):  # about a block of bytes at a time
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + BLOCK, "right")))
        own = has[first:last]
        differ = gather(a, a_lo[own], size[own]) != gather(b, b_lo[own], size[own])
        out[own] = ~np.logical_or.reduceat(differ, np.cumsum(size[own]) - size[own])
        first = last
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` neighbouring bytes, by prefix sums: for choosing places by content, not for telling strings alike."""
    parts = []
    for first in range(0, max(0, len(data) - gram + 1), BLOCK):
        sums, down = prefix_sums(data[first : first + BLOCK + gram - 1])
        parts.append(mix64((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each span, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PairTable:
    """(left id, right id) -> number of the merge, by open addressing over two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.mask = np.uint64((1 << int(max(4, np.ceil(np.log2(max(1, len(keys)) * 3))))) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(2**64 - 1))
        self.ranks = np.full(int(self.mask) + 1, NONE, np.int32)
        slot, todo = mix64(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.ranks[slot[todo]] == NONE]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot, out, todo = mix64(keys) & self.mask, np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            hit = self.keys[s] == keys[todo]
            out[todo[hit]] = self.ranks[s[hit]]
            todo = todo[~hit & (self.ranks[s] != NONE)]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        return out


class ByteBPE:
    """Coder for a vocabulary: merge number -> id, and the ids of single bytes."""

    def __init__(self, tokens: dict[int, bytes], pairs: PairTable, made: np.ndarray, single: np.ndarray, last: np.ndarray, whole: dict[bytes, int], spaces: bool):
        """pairs number the merges by rank, `made` has their ids; `last`: ids of bytes that end a piece; `whole`: pieces with an id of their own; spaces: whether white space is kept."""
        self.pairs, self.made, self.single, self.last, self.whole, self.spaces = pairs, made, single, last, whole, spaces
        self.tokens = tokens
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for i, token in tokens.items():
            self.sizes[i] = len(token)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.raw, self.raw_at, self.wide = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, chars: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces among the code points of texts that begin at `firsts`."""
        kind, n = classes()[chars], len(chars)
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        first = np.zeros(n + 1, bool)
        first[firsts] = first[n] = True
        start |= first
        lead = np.flatnonzero(start[:n] & (kind != SPACE) & ~first[:n])
        lead = lead[kind[lead - 1] == SPACE]
        if self.spaces:
            start[lead - 1] = True
            start[lead[chars[lead - 1] == 32]] = False
        else:
            start[:n] |= kind == NUMBER
        quote = np.flatnonzero(start[:n] & (chars == 39))
        quote = quote[~first[quote + 1]]
        quote = quote[kind[quote + 1] == LETTER]
        one = chars[quote + 1]
        two = np.where(first[np.minimum(quote + 2, n)], 0, chars[np.minimum(quote + 2, n - 1)])
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, np.where((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] = True
        at = np.flatnonzero(start)
        starts, ends = at[:-1], at[1:]
        if not self.spaces:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(x) for x in texts])
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        firsts = np.concatenate(([0], stops[:-1]))
        starts, ends = self.pieces(chars, firsts[firsts < len(chars)])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        place = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000), out=place[1:])
        lo, hi = place[starts], place[ends]
        hashes, where, back = np.unique(span_hashes(data, lo, hi), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_ENTRIES:
            self.forget()
        slot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(slot, len(self.known) - 1)] != hashes
        if new.any():
            first, last = lo[where[new]], hi[where[new]]
            at, size = self.learn(data, first, last)
            self.known = np.insert(self.known, slot[new], hashes[new])
            self.at, self.size = np.insert(self.at, slot[new], at), np.insert(self.size, slot[new], size)
            self.raw_at, self.wide = np.insert(self.raw_at, slot[new], len(self.raw) + np.cumsum(last - first) - (last - first)), np.insert(self.wide, slot[new], last - first)
            self.raw = np.concatenate((self.raw, gather(data, first, last - first)))
            slot = np.searchsorted(self.known, hashes)
        use = slot[back]
        at, size = self.at[use], self.size[use]
        same = self.wide[use] == hi - lo
        same[same] = equal_spans(data, lo[same], self.raw, self.raw_at[use[same]], (hi - lo)[same])
        if not same.all():  # alike by hash only
            at[~same], size[~same] = self.learn(data, lo[~same], hi[~same])
        ids = gather(self.pool, at, size)
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, upto[np.searchsorted(starts, stops)]

    def learn(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes the pieces data[lo:hi] into the pool; where their ids are and how many."""
        at, size = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        wide, parts, filled = hi - lo, [self.pool], len(self.pool)
        todo = np.ones(len(lo), bool)
        single = [i for i in np.flatnonzero(wide > LONG_PIECE).tolist()]
        for i in single:
            raw = data[lo[i] : hi[i]].tobytes()
            ids = np.array([self.whole[raw]] if raw in self.whole else self.heap_merge(raw), np.int32)
            at[i], size[i], todo[i] = filled, len(ids), False
            parts.append(ids)
            filled += len(ids)
        if self.whole:
            short = np.flatnonzero(todo & (wide <= self.longest))
            up = np.searchsorted(self.whole_keys, keys := span_hashes(data, lo[short], hi[short]))
            hit = self.whole_keys[np.minimum(up, len(self.whole_keys) - 1)] == keys
            short, ids = short[hit], self.whole_ids[up[hit]]
            hit = wide[short] == self.sizes[ids]
            hit[hit] = equal_spans(data, lo[short[hit]], self.flat, self.starts[ids[hit]], wide[short[hit]])
            short, ids = short[hit], ids[hit]
            at[short], size[short], todo[short] = filled + np.arange(len(short)), 1, False
            parts.append(ids)
            filled += len(ids)
        for width in (4, 8, 12, 16, 32, 64, 128, 256, LONG_PIECE):
            rows = np.flatnonzero(todo & (wide <= width))
            todo[rows] = False
            for k in range(0, len(rows), step := max(1, (1 << 18) // width)):
                own = rows[k : k + step]
                for who, ids, n in self.merge(data, lo[own], wide[own], width):
                    at[own[who]], size[own[who]] = filled + np.cumsum(n) - n, n
                    parts.append(ids)
                    filled += len(ids)
        self.pool = np.concatenate(parts)
        return at, size

    def merge(self, data: np.ndarray, lo: np.ndarray, size: np.ndarray, width: int):
        """Yields (rows, their ids one after another, how many each) as rows come to their end."""
        col, size = np.arange(width), size.copy()
        inside = col < size[:, None]
        ids = np.zeros((len(lo), width), np.int32)
        ids[inside] = self.single[gather(data, lo, size)]
        row = np.arange(len(lo))
        ids[row, size - 1] = self.last[data[lo + size - 1]]
        rank = np.full((len(lo), width), NONE, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
        who = row
        while len(who):
            best = rank.argmin(axis=1)
            low = rank[row, best]
            if (over := low == NONE).any():
                yield who[over], ids[over][col < size[over][:, None]], size[over]
                keep = ~over
                who, ids, rank, size, best, low = who[keep], ids[keep], rank[keep], size[keep], best[keep], low[keep]
                row = np.arange(len(who))
                if not len(who):
                    return
            take = np.minimum(col + (col > best[:, None]), len(col) - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[row, best] = self.made[low]
            size -= 1
            for j in (best - 1, best):
                ok = (j >= 0) & (j + 1 < size)
                rank[row, np.maximum(j, 0)] = np.where(ok, NONE, np.where(j >= 0, NONE, rank[row, 0]))
                rank[row[ok], j[ok]] = self.pairs(ids[row[ok], j[ok]], ids[row[ok], j[ok] + 1])

    def heap_merge(self, raw: bytes) -> list[int]:
        ids, after, before, alive = self.single[np.frombuffer(raw, np.uint8)].tolist(), list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1)), [True] * len(raw)
        ids[-1] = int(self.last[raw[-1]])
        met: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            if after[i] >= len(raw):
                return int(NONE)
            pair = ids[i], ids[after[i]]
            if pair not in met:
                met[pair] = int(self.pairs(np.array([pair[0]]), np.array([pair[1]]))[0])
            return met[pair]

        queue = [(r, i, ids[i], ids[i + 1]) for i in range(len(raw) - 1) if (r := rank(i)) != NONE]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= len(raw) or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] < len(raw):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) != NONE:
                    heapq.heappush(queue, (r, k, ids[k], ids[after[k]]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each row's bytes end."""
        sizes = self.sizes[ids]
        return gather(self.flat, self.starts[ids], sizes), np.concatenate(([0], np.cumsum(sizes)))[ends]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """A worker's coder for a rank file of base64 tokens and ranks, with the split pattern of public_tokenizers.PATTERN."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    triples = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    left, right, rank = np.array(triples, np.int64).reshape(-1, 3).T
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    coder = ByteBPE({v: k for k, v in ranks.items()}, PairTable(left, right, rank.astype(np.int32)), np.arange(max(ranks.values()) + 1, dtype=np.int32), single, single, ranks, True)
    names = list(ranks)
    flat = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(x) for x in names])
    keys = span_hashes(flat, np.concatenate(([0], ends[:-1])), ends)
    order = np.argsort(keys)
    coder.whole_keys, coder.whole_ids, coder.longest = keys[order], np.array(list(ranks.values()), np.int32)[order], max(map(len, names))
    return coder


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in JSON vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    """Coder for a JSON vocabulary with word ends, lower case and dropped white space; texts with special tokens go through the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab, letters = spec["model"]["vocab"], byte_letters()
        end = spec["model"]["end_of_word_suffix"]
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]), np.arange(len(merges), dtype=np.int32))
        of = {b: c for c, b in letters.items()}
        single, last = (np.array([vocab[of[b] + tail] for b in range(256)], np.int32) for tail in ("", end))
        tokens = {i: bytes(letters[c] for c in t.removesuffix(end)) if t not in self.special else t.encode() for t, i in vocab.items()}
        self.coder = ByteBPE(tokens, pairs, made, single, last, {}, False)

    @cached_property
    def library(self):
        """The library's own coder, loaded when a text has a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        odd = {i for i, x in enumerate(texts) if any(s in x for s in self.special)}
        plain = [x if x.isascii() else unicodedata.normalize("NFC", x).replace("\u03a3", "\u03c3") for x in texts]
        ids, ends = self.coder.encode(["" if i in odd else x.lower() for i, x in enumerate(plain)])
        if odd:
            rows = np.split(ids, ends[:-1])
            for i in sorted(odd):
                rows[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
            ids, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
        return ids, ends


@lru_cache(maxsize=4)
def load_words(path: str) -> WordBPE:
    return WordBPE(path)


def _rows(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [flat[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`, the token ids (array<int>) of its text column; a column of that name is replaced."""
    docs = docs.drop(ids)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = load(path).encode(part.column(text).fill_null("").to_pylist())
        made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, ids])

    return map_slices(docs, text, kernel, f"{ddl(docs)}, {ids} array<int>")


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with `out`, the bytes that its ids stand for; null ids stand for none; a column of that name is replaced."""
    coded = coded.drop(out)

    def run(batches):
        for part in batches:
            rows = [x or [] for x in part.column(ids).to_pylist()]
            flat, ends = load(path).decode(np.array([i for x in rows for i in x], np.int64), np.cumsum([len(x) for x in rows]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_rows(flat, ends), pa.binary())], [*part.schema.names, out])

    return coded.mapInArrow(run, f"{ddl(coded)}, {out} binary")


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes and digests in one pass, so that ids never leave the worker."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        coder = load(path)
        ids, ends = coder.encode(part.column("text").fill_null("").to_pylist())
        digests = [[hashlib.sha256(x).hexdigest() for x in rows] for rows in (_rows(ids.astype("<u4"), ends), _rows(*coder.decode(ids, ends)))]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends, prepend=0)), *map(pa.array, digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", most=1 << 20)
