"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a byte-fallback piece BPE (B) cover the same bytes of a text.

A encodes space+text, B encodes text and adds the space itself; neither takes special tokens out of a text. Both then cover the same bytes. All tokens of a slice of texts are sorted
by start at once; the running maximum of their ends breaks them into groups where a start reaches it, that is at offsets where a token of A and one of B both end. Within
groups overlapping tokens are expanded into pairs; those that end together are links.

Texts are cut at single spaces between other characters, where both vocabularies always end a token (A's pattern starts one there; of B no piece holds a space after another character,
which is checked when it is loaded), and each distinct part of a slice is encoded and aligned once. A link's shorter token is a suffix of the longer one, so the
id pairs that can be linked (`pairs`) follow from the vocabularies, at most `most_pairs`, whatever the corpus: a stored link is a place among them, four bytes. Each slice counts its
pairs, Spark sums these counts, and the table of them goes to every task.

Null and empty texts, and texts whose joined token bytes of A or B differ from space+text, have no tokens: zeros and an empty digest. Every row gives one row, equal rows equal
ones. Only doc_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, release, slices, stored, utf8

SPACE = "▁"
#: Single spaces between other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that is neither space nor line feed.
WHITE = re.compile(r"[^\S \n]")
#: Characters that are encoded at once.
BLOCK = 1 << 13
#: Bytes of texts whose distinct parts are encoded together.
SLICE = 2 << 20
#: Bytes of stored links that are looked up at once: Spark's batches hold 10,000 documents.
LOOKUP = 1 << 20
SHIFT = np.int64(32)
LINKS = "doc_id {id}, n_a long, n_b long, n_groups long, a_ids array<int>, b_ids array<int>, groups_sha256 string"
PACKED = "doc_id {id}, n_a long, n_b long, n_groups long, links binary, pair array<int>, pair_n array<long>, groups_sha256 string"
SUMS = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Entries(dict):
    """The ids of each entry's bytes."""

    def __init__(self, entries: list[bytes]):
        super().__init__()
        for i, x in enumerate(entries):
            self.setdefault(x, []).append(i)


class Vocabularies:
    """Both tokenizers, and the bytes of each of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, entries = byte_letters(), self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(entries.values()) + 1)
        for piece, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object) for end in ",|;")

    def most_pairs(self) -> int:
        """A bound of the distinct linked id pairs: every suffix of every entry, and two entries at most share their bytes."""
        return 2 * int(self.a_len.sum() + self.b_len.sum())

    @cached_property
    def pairs(self) -> np.ndarray:
        """The codes of all id pairs that can be linked, ascending: one's bytes end with the other's."""
        a_named, b_named = Entries(self.a_bytes), Entries(self.b_bytes)
        codes = [j << 32 | i for i, x in enumerate(self.a_bytes) for k in range(len(x)) for j in b_named.get(x[k:], ())]
        codes += [j << 32 | i for j, x in enumerate(self.b_bytes) for k in range(1, len(x)) for i in a_named.get(x[k:], ())]
        return np.sort(np.array(codes, np.int64))

    def places(self, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
        """Where the pairs of links stand among `pairs`."""
        code = (b_ids << SHIFT) | a_ids
        at = np.searchsorted(self.pairs, code)
        assert np.array_equal(self.pairs.take(at, mode="clip"), code), "a linked pair that is no suffix"
        return at

    def parts(self, text: str) -> list[str]:
        """What B encodes piece by piece, and A with a space before each."""
        if not self.cuts:
            return [text]
        if WHITE.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return CUT.split(text)
        return text.split(" ")  # then every space is a cut

    def blocks(self, parts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Places of parts, and their text: many that neither start nor end with white space joined by spaces, which both cut again; others alone."""
        at, size = [], 0
        for i, p in enumerate(parts):
            if not self.cuts or p[0].isspace() or p[-1].isspace():
                if at:
                    yield at, " ".join([parts[k] for k in at])
                    at, size = [], 0
                yield [i], p
                continue
            at.append(i)
            size += len(p)
            if size > BLOCK:
                yield at, " ".join([parts[k] for k in at])
                at, size = [], 0
        if at:
            yield at, " ".join([parts[k] for k in at])

    def agree(self, text: str) -> bool:
        """Whether the token bytes of both (left in `last`) are those of space+text."""
        a, b, whole = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text), b" " + text.encode()
        self.last, self.sound = (a, b), b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return self.sound


@lru_cache(2)
def loaded(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: groups break where a start reaches the running maximum of the ends before it."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens that share a byte; both sides tile the same bytes from 0."""
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    lo, hi = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    many = hi - lo
    left = np.repeat(np.arange(len(a_ends)), many)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)


class Numbers(dict):
    """Numbers new keys from 0 on as they are asked for; of equal texts one is held."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Aligned:
    """Distinct parts, encoded by both and aligned in one go. For each part: whether its bytes came back (ok), tokens, groups, links and the text of its groups."""

    def __init__(self, parts: list[str], voc: Vocabularies):
        self.ok = np.ones(len(parts), bool)
        a, b, length = [], [], np.array([len(p.encode()) + 1 for p in parts], np.int64)
        for at, joined in voc.blocks(parts):
            if voc.agree(joined):
                a.append(voc.last[0]), b.append(voc.last[1])
                continue
            for i in at:  # a block with unsound parts goes part by part
                self.ok[i] = len(at) > 1 and voc.agree(parts[i])
                if self.ok[i]:
                    a.append(voc.last[0]), b.append(voc.last[1])
        self.a_ids, self.b_ids = (np.concatenate([np.array(x, np.int64) for x in s]) if s else np.zeros(0, np.int64) for s in (a, b))
        a_ends, b_ends = np.cumsum(voc.a_len[self.a_ids]), np.cumsum(voc.b_len[self.b_ids])  # parts lie end to end, so groups never cross them
        self.a_ends, self.b_ends = a_ends, b_ends
        part_ends = np.cumsum(length * self.ok)
        a_part, b_part = np.searchsorted(part_ends, a_ends), np.searchsorted(part_ends, b_ends)
        self.n_a, self.n_b = np.bincount(a_part, minlength=len(parts)), np.bincount(b_part, minlength=len(parts))
        group = coalesced(np.r_[a_ends - voc.a_len[self.a_ids], b_ends - voc.b_len[self.b_ids]], np.r_[a_ends, b_ends])
        self.a_group, self.b_group = group[: len(a_ends)], group[len(a_ends) :]
        left, right = overlaps(a_ends, b_ends)
        ends = a_ends[left] == b_ends[right]
        self.left, self.right = self.a_ids[left[ends]], self.b_ids[right[ends]]
        self.n_links = np.bincount(a_part[left[ends]], minlength=len(parts))
        a_last, b_last = (np.r_[g[1:] != g[:-1], np.ones(min(1, len(g)), bool)] for g in (self.a_group, self.b_group))
        self.n_groups = np.bincount(a_part[a_last], minlength=len(parts))
        words = np.r_[np.where(a_last, voc.bar[self.a_ids], voc.comma[self.a_ids]), np.where(b_last, voc.semicolon[self.b_ids], voc.comma[self.b_ids])]
        side = np.repeat(np.array([0, 1], np.int8), [len(self.a_ids), len(self.b_ids)])
        ordered = words[np.lexsort((side, group))].tolist()
        at = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        self.texts = ["".join(ordered[lo:hi])[:-1] for lo, hi in zip(at, at[1:], strict=False)]  # `a1,a2|b1;a3|b2,b3` of each part


def decoded(column: pa.Array) -> tuple[list[str], list[bool]]:
    """Texts, and whether they are sound UTF-8; unsound ones are empty."""
    body, at = utf8(column)
    raw, at = body.tobytes(), at.tolist()
    texts, sound = [], []
    for lo, hi in zip(at, at[1:], strict=False):
        try:
            texts.append(raw[lo:hi].decode())
            sound.append(True)
        except UnicodeDecodeError:
            texts.append("")
            sound.append(False)
    return texts, sound


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at[i], at[i] + 1, ... (size[i] of them) for each i."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)


def kernel(batch: pa.RecordBatch, voc: Vocabularies, packed: bool) -> pa.RecordBatch:
    """The rows of `align`, or of `pack`, for a slice."""
    texts, _ = decoded(batch.column("text"))
    number = Numbers()
    parts = [np.fromiter(map(number.__getitem__, p := voc.parts(t)), np.int64, len(p)) if t else np.zeros(0, np.int64) for t in texts]
    made = Aligned(list(number), voc)
    size, flat = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), size)
    keep = np.bincount(doc, ~made.ok[flat], len(parts)) == 0
    flat, doc, size = flat[keep[doc]], doc[keep[doc]], size * keep
    total = lambda per: np.bincount(doc, per[flat], len(parts)).astype(np.int64)  # noqa: E731 - sums of counts, exact
    many = made.n_links[flat]
    take = spread((np.cumsum(made.n_links) - made.n_links)[flat], many)
    at = np.r_[0, np.cumsum(total(made.n_links))]
    listed = lambda x, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x))
    if packed:
        links = voc.places(made.left, made.right).astype("<i4")[take]
        pair, n = np.unique(links, return_counts=True)
        first = np.minimum(np.arange(len(parts) + 1), 1) * len(pair)  # a slice's counts stand in its first row
        binary = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.array(at * 4, pa.int32()).buffers()[1], pa.py_buffer(links)])
        own = {"links": binary, "pair": listed(pair, first), "pair_n": listed(n.astype(np.int64), first)}
    else:
        own = {k: listed(x[take].astype(np.int32), at) for k, x in (("a_ids", made.left), ("b_ids", made.right))}
    bounds, lines = np.r_[0, np.cumsum(size)].tolist(), list(map(made.texts.__getitem__, flat.tolist()))
    sha = [hashlib.sha256(";".join(lines[lo:hi]).encode()).hexdigest() if hi > lo else "" for lo, hi in zip(bounds, bounds[1:], strict=False)]
    counts = {k: pa.array(total(x)) for k, x in (("n_a", made.n_a), ("n_b", made.n_b), ("n_groups", made.n_groups))}
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **counts, **own, "groups_sha256": pa.array(sha)})


def aligned_rows(docs: DataFrame, a_path: str, b_path: str, packed: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = kernel(batch, loaded(a_path, b_path), packed)
        release()  # after each slice: what many small objects leave behind would else add up
        return out

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_slices(rows, "text", run, (PACKED if packed else LINKS).format(id=dict(rows.dtypes)["doc_id"]), SLICE)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, the linked ids a_ids and b_ids (place by place, in order), groups_sha256."""
    return aligned_rows(docs, a_path, b_path, False)


def pack(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """As align, but links are their pairs' places among `pairs` (little-endian, 32 bits), and one row of each slice holds how many links of the slice hold each place (pair, pair_n)."""
    return aligned_rows(docs, a_path, b_path, True)


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each group of each document: doc_id, group (from 0), start and end (bytes of space+text), a_ids, b_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = loaded(a_path, b_path)
        for batch in slices(batches, "text"):
            ids, rows = batch.column("doc_id"), []
            for i, text in enumerate(decoded(batch.column("text"))[0]):
                made = Aligned(voc.parts(text), voc) if text else None
                if made is None or not made.ok.all():
                    continue
                a_at, b_at = (np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] for g in (made.a_group, made.b_group))
                ends = made.a_ends[a_at[1:] - 1]
                rows += [(i, k, s, e, made.a_ids[p:q], made.b_ids[u:v]) for k, (s, e, p, q, u, v) in enumerate(zip(np.r_[0, ends[:-1]], ends, a_at, a_at[1:], b_at, b_at[1:], strict=False))]
            if rows:
                own, *rest = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), *(pa.array(list(x), k) for x, k in zip(rest, kinds, strict=True))], ["doc_id", "group", "start", "end", "a_ids", "b_ids"])
        release()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, `group` long, start long, `end` long, a_ids array<int>, b_ids array<int>")


def pair_counts(packed: DataFrame) -> DataFrame:
    """pair (its place), n: how many links of the corpus hold each id pair linked. Reads no links, only each slice's counts."""
    return packed.select(F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).groupBy("x.pair").agg(F.sum("x.pair_n").alias("n"))


def summed(batches: Iterator[pa.RecordBatch], n: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of `counted`: each link's count looked up, a bounded number of links at once."""
    for batch in slices(batches, "links", LOOKUP):
        body, at = utf8(batch.column("links"))
        links, at = body.view("<i4"), at // 4
        sums = {k: pa.array(np.diff(np.r_[0, np.cumsum(x[links], dtype=np.int64)][at])) for k, x in (("n_best", best), ("count_sum", n))}
        kept = {k: batch.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups")}
        yield pa.RecordBatch.from_pydict({**kept, "n_links": pa.array(np.diff(at)), **sums, "groups_sha256": batch.column("groups_sha256")})


def counted(packed: DataFrame, pairs: np.ndarray) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of stored, packed alignments. pairs: those of the vocabularies."""
    table = pair_counts(packed).toArrow()  # at most len(pairs) rows, by the vocabularies alone
    n = np.zeros(len(pairs), np.int64)
    n[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    own = pairs >> SHIFT
    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.r_[heads, len(n)]))
    shared = packed.sparkSession.sparkContext.broadcast((n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(batches, *shared.value)
        release()

    rows = packed.select("doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256")
    return rows.mapInArrow(run, SUMS.format(id=dict(rows.dtypes)["doc_id"]))


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment of every document with corpus-wide counts of its links; encoded once, stored, links read once."""
    return counted(stored(pack(docs, a_path, b_path), "links"), loaded(a_path, b_path).pairs)
