"""MinHash near-duplicates with an LSH forest.

Documents with equal shingle sets are one node from the start, so copies never meet in pairs. Each node has a
signature of TREES x LEVELS one-byte minima. The forest sorts nodes once for each tree by its part of the signature;
nodes with a longest common prefix of at least SHALLOW values stand in one region, which is split by the next value where it has more than FULL nodes. In a region of up to FULL
nodes all pairs whose whole signatures agree enough are candidates; in a larger one the sorted order is
taken deeper, in stretches of up to STRETCH neighbours with the longest common prefixes, and each node is a candidate with
its NEAREST by signature and with the stretch's centre. Stretches follow the sort order, so no key gathers an unbounded
group. Candidates are confirmed on full shingle sets, computed anew from the texts (a shingle is two independent 64-bit hashes of its words), and components come from
confirmed links alone by FastSV (Zhang, Azad and Buluc 2020) over stored tables.

A second pass then takes the regions of more than FULL nodes, and those that a task's edge may have split, where roots still differ: it
deals each to blocks of about BLOCK nodes of like size and compares every two blocks, exactly and on whole sets, so that each region is
worked through in full. A block's texts are shipped once for each block it meets; block pairs with one root, or too different in size to reach the threshold, are left out.

Null, empty and blank texts have no shingles and link with nothing. Rows with one doc_id count as documents of their own that
share an id; the id's rows with equal sets share a component. A null id gives null for component_id, unless its group has another. Only doc_id and
text of docs are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import span_hashes
from .common import drop_stored, map_slices, mix64, stored, utf8

TREES, LEVELS = 16, 8
#: Values of a common prefix that make a region: the first, where it has up to FULL nodes, else the second.
SHALLOW, LEAST_LEVEL = 3, 4
FULL, STRETCH, NEAREST = 128, 1024, 8
#: Nodes and shingles of a block of the second pass, about.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Shingles in more sets than this are counted by a matrix product.
HEAVY = 16
#: Standard errors of a signature's estimate that a candidate may lie below the threshold.
SLACK = 3.5
#: Candidates of one node that one task confirms, about.
FAN = 500
#: Bytes of text that one task confirms, about, and bytes of a shingle's part of its text.
CELL_BYTES, SHINGLE_BYTES = 32 << 20, 8
#: Links that one task thins to a spanning forest, about.
FOREST = 200_000
#: Tasks that the rows of one region are dealt to.
SALTS = 32
#: Stands for a null id.
NO_ID = -(1 << 63)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text as two independent 64-bit hashes (sorted by the first), and how many each text has; fewer than k words are one shingle."""
    n = len(at) - 1
    data = LOWER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~BLANK[data]
    start, end = np.flatnonzero(inside[1:] & (~inside[:-1] | cut)), np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    doc = np.searchsorted(at[1:], start, "right")
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < k))
    whole = doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]
    lanes = []
    for lane in (0, 1):
        word = span_hashes(data, start, end, lane)
        made = np.zeros(len(whole), np.uint64)
        for j in range(k):
            made = mix64(made * np.uint64(31) + word[j : j + len(made)])
        one = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            on = count[short] > j
            one[on] = mix64(one[on] * np.uint64(31) + word[first[short[on]] + j])
        lanes.append(np.concatenate((made[whole], ~(one + count[short].astype(np.uint64)))))
    docs = np.concatenate((doc[: len(whole)][whole], short))
    order = np.lexsort((lanes[0], docs))
    docs, a, b = docs[order], lanes[0][order], lanes[1][order]
    again = (docs[1:] == docs[:-1]) & (a[1:] == a[:-1])
    if (b[1:] != b[:-1])[again].any():  # alike in one hash only
        order = np.lexsort((b, a, docs))
        docs, a, b = docs[order], a[order], b[order]
        again = (docs[1:] == docs[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    keep = np.r_[True, ~again] if len(docs) else np.zeros(0, bool)
    return a[keep], b[keep], np.bincount(docs[keep], minlength=n)


def shared(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, equal in both hashes."""
    _, i, j = np.intersect1d(p[0], q[0], return_indices=True)
    return int((p[1][i] == q[1][j]).sum())


def signatures(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, TREES * LEVELS) bytes of minima; texts without shingles have zeros."""
    rng = np.random.default_rng(20_240_229)
    width = TREES * LEVELS
    odd, add = rng.integers(0, 1 << 32, width, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, width, np.uint64).astype(np.uint32)
    out = np.zeros((len(count), width), np.uint8)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    first = (np.cumsum(count) - count)[has]
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for j in range(width):
        x = (low ^ add[j]) * odd[j]
        x ^= high
        x *= odd[j - 1]
        least = np.minimum.reduceat(x, first)
        out[has, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def sets(rows: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (digest of the set; null if empty) and signature of rows with doc_id, text_key, text."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, check, count = shingles(*utf8(part.column("text")), k)
        ends = np.cumsum(count)
        raw = np.stack((hashes, check), axis=1).tobytes()
        node = [hashlib.blake2b(raw[16 * (e - n) : 16 * e], digest_size=16).digest() if n else None for n, e in zip(count.tolist(), ends.tolist(), strict=True)]
        signed = [x.tobytes() for x in signatures(hashes, count)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(count), pa.array(node, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "signature"])

    return map_slices(rows, "text", kernel, "doc_id long, text_key long, n_shingles long, node binary, signature binary", most=2 << 20)


def _stretch_pairs(sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of a stretch of more than FULL neighbours."""
    n = len(sig)
    spread = np.stack([np.bincount(c, minlength=256) for c in sig.T])
    centre = int((sig == spread.argmax(axis=1)).sum(axis=1).argmax())
    a, b = [], []
    for i in range(n):
        same = (sig == sig[i]).sum(axis=1)
        same[i] = -1
        near = np.argpartition(-same, min(NEAREST, n - 1))[:NEAREST]
        near = near[same[near] >= least]
        a.append(np.full(len(near), i))
        b.append(near)
    rest = np.flatnonzero(((sig == sig[centre]).sum(axis=1) >= least) & (np.arange(n) != centre))
    return np.concatenate([*a, np.full(len(rest), centre)]), np.concatenate([*b, rest])


def _regions(keys: np.ndarray, level: int) -> np.ndarray:
    """Where regions of a common prefix of `level` begin in the sort order, and its end."""
    return np.flatnonzero(np.r_[True, (keys[1:, :level] != keys[:-1, :level]).any(axis=1), True])


def forest_pairs(keys: np.ndarray, sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among nodes in the sort order of one tree; keys: (n, LEVELS). Regions go as deep as they are full."""
    edge = _regions(keys, SHALLOW)
    full = np.flatnonzero(np.diff(edge) > FULL)
    deep = _regions(keys, LEAST_LEVEL)
    edge = np.unique(np.concatenate((edge, *(deep[(deep > edge[r]) & (deep < edge[r + 1])] for r in full))))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.diff(edge)
    for lo, n in zip(edge[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
        if n <= FULL:
            i, j = np.triu_indices(n, 1)
            ok = (sig[lo + i] == sig[lo + j]).sum(axis=1) >= least
            left.append(lo + i[ok])
            right.append(lo + j[ok])
        else:
            for a in range(lo, lo + n, STRETCH // 2):  # stretches overlap by half
                b = min(a + STRETCH, lo + n)
                i, j = _stretch_pairs(sig[a:b], least)
                left.append(a + i)
                right.append(a + j)
                if b == lo + n:
                    break
    return np.concatenate(left), np.concatenate(right)


def marked(keys: np.ndarray) -> np.ndarray:
    """Places of the sort order in regions of more than FULL nodes, and in the first and the last region, which may go on elsewhere."""
    edge = _regions(keys, LEAST_LEVEL)
    size = np.diff(edge)
    on = size > FULL
    on[[0, -1]] = True
    return np.flatnonzero(np.repeat(on, size))


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of nodes (node, signature) that the forest brings together (tree is null), and the nodes a of each tree's marked regions (b is null)."""
    width, s = TREES * LEVELS, percent / 100
    least = int(width * (s - SLACK * (s * (1 - s) / width) ** 0.5))
    rows = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "node", "signature")
    rows = rows.withColumn("key", F.expr(f"substring(signature, tree * {LEVELS} + 1, {LEVELS})")).select("tree", "key", "node", "signature")
    n = max(12, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def pairs(tree, key, node, signature):
        keys = np.frombuffer(b"".join(key), np.uint8).reshape(len(key), LEVELS)
        sig = np.frombuffer(b"".join(signature), np.uint8).reshape(len(key), width)
        a, b = forest_pairs(keys, sig, least)
        found = {(node[i], node[j]) if node[i] < node[j] else (node[j], node[i]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        left, right, at = [x for x, _ in found], [y for _, y in found], marked(keys).tolist()
        return pa.RecordBatch.from_arrays([pa.array(left + [node[i] for i in at], pa.binary()), pa.array(right + [None] * len(at), pa.binary()), pa.array([None] * len(left) + [tree[i] for i in at], pa.int32())], ["a", "b", "tree"])

    def run(batches):
        held: list[list] = [[], [], [], []]
        for part in batches:
            for k in range(4):
                held[k] += part.column(k).to_pylist()
            prefix = lambda i: (held[0][i], held[1][i][:SHALLOW])
            last = len(held[0]) - 1
            if last < 20_000 or prefix(0) == prefix(last) and last < 100_000:
                continue
            cut = last
            while cut > 0 and prefix(cut - 1) == prefix(last):
                cut -= 1
            cut = cut or last + 1 - STRETCH  # one region fills what is held: go on from its last stretch
            for lo, hi in _runs(held[0][:cut]):
                yield pairs(*(c[lo:hi] for c in held))
            held = [c[cut:] for c in held]
        for lo, hi in _runs(held[0]):
            yield pairs(*(c[lo:hi] for c in held))

    return rows.mapInArrow(run, "a binary, b binary, tree int").distinct()


def _runs(tree: list[int]):
    edge = np.flatnonzero(np.r_[True, np.diff(tree) != 0, True]) if tree else [0]
    return zip(edge[:-1], edge[1:], strict=True)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. reps: node, doc_id, text_key and size (shingles) of one document of each node. The more text the pairs have, the more cells they are dealt to."""
    mean = reps.agg(F.avg("size")).first()[0] or 0
    many = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * pairs.count() * mean * SHINGLE_BYTES / CELL_BYTES))
    fan = pairs.groupBy("a").agg(F.floor(F.count("*") / FAN).cast("int").alias("fan"))
    cells = pairs.join(fan, "a").select("a", "b", F.xxhash64("a", F.pmod(F.hash("b"), F.col("fan") + 1)).alias("group"))
    cells = cells.withColumn("cell", F.pmod("group", F.lit(many)))
    cells = stored(cells.select("cell", "a", "b"), "cells")
    need = cells.select(F.col("cell").alias("at"), F.col("a").alias("node")).union(cells.select("cell", "b")).distinct()
    wanted = need.join(reps.drop("size"), "node")
    texts = docs.join(wanted, ["doc_id", "text_key"]).select("at", "node", "text")

    def check(edges: pa.Table, held: pa.Table) -> pa.Table:
        a, b = edges.column("a").to_pylist(), edges.column("b").to_pylist()
        names = held.column("node").to_pylist()
        own: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for lo in range(0, len(names), 500):
            hashes, second, count = shingles(*utf8(held.column("text").slice(lo, 500)), k)
            cut = np.cumsum(count)[:-1]
            own |= dict(zip(names[lo : lo + 500], zip(np.split(hashes, cut), np.split(second, cut), strict=True), strict=True))
        ok = []
        for x, y in zip(a, b, strict=True):
            p, q = own[x], own[y]
            n, m = len(p[0]), len(q[0])
            if 100 * min(n, m) < percent * max(n, m):
                ok.append(False)
                continue
            both = shared(p, q)
            ok.append(100 * both >= percent * (n + m - both))
        return edges.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = stored(cells.groupBy("cell").cogroup(texts.groupBy("at")).applyInArrow(check, "a binary, b binary"), "links")
    drop_stored(cells)
    return links


def apart_links(hashes: np.ndarray, second: np.ndarray, count: np.ndarray, root: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different roots (two hashes a shingle, one set after another), of all pairs: as many as join what they join."""
    n = len(count)
    code = np.unique(np.array([r.hex() for r in root]), return_inverse=True)[1]
    _, first, token, df = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if (second[first[token]] != second).any():  # alike in one hash only
        token, df = np.unique(np.stack((hashes, second), axis=1), axis=0, return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), count)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    light = (df[token] > 1) & (df[token] <= HEAVY)
    few, who, both = token[light], owner[light], np.zeros(n * n, np.int64)
    for d in range(1, HEAVY):
        on = np.flatnonzero(few[d:] == few[:-d])
        if not len(on):
            break
        both += np.bincount(who[on] * n + who[on + d], minlength=n * n)
    both = both.reshape(n, n).astype(np.float32)
    both += both.T
    place = np.cumsum(df > HEAVY) - 1
    heavy = df[token] > HEAVY
    many, who = place[token[heavy]], owner[heavy]
    for lo in range(0, int((df > HEAVY).sum()), 4096):
        a, b = np.searchsorted(many, [lo, lo + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[who[a:b], many[a:b] - lo] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    close = np.triu(100 * both >= percent * (count[:, None] + count[None, :] - both), 1) & (code[:, None] != code[None, :])
    up, kept = list(range(n)), []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(close)), strict=True):
        if (p := find(code[i])) != (q := find(code[j])):
            up[p] = q
            kept.append((i, j))
    return kept


def met_by(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with table, a row a key, so that a key of many rows is dealt over SALTS tasks."""
    salted = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt_"]).drop("salt_")


def apart(marks: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different roots (a, b: roots) whose nodes share one of the marked regions. marks: node, tree; nodes: node, doc_id, text_key, signature, size."""
    rows = marks.join(nodes.select("node", "signature", "size"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.withColumn("prefix", F.expr(f"substring(signature, tree * {LEVELS} + 1, {LEAST_LEVEL})")).select("tree", "prefix", "node", "root", "size")
    rows = marked_rows = stored(rows, "marked")
    top = rows.groupBy("tree", "prefix", "root").agg(F.count("*").alias("n")).groupBy("tree", "prefix").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    rows = met_by(rows, top.where("roots > 1").select("tree", "prefix", F.col("top.root").alias("top")), ["tree", "prefix"])
    kind = ["tree", "prefix", "rest", "class"]
    rows = stored(rows.withColumn("rest", F.col("root") != F.col("top")).withColumn("class", F.floor(F.log("size") / math.log(100 / min(percent, 99)))).drop("top"), "parted")
    parts = rows.groupBy(*kind).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    name = F.xxhash64(F.concat_ws("-", *kind[:1], F.hex("prefix"), *kind[2:], F.pmod(F.xxhash64("node"), F.col("parts"))))
    blocks = stored(met_by(rows, parts, kind).select("tree", "prefix", "node", "root", "size", name.alias("block")), "blocks")
    heads = blocks.groupBy("tree", "prefix", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("root").alias("least"), F.max("root").alias("most"))
    p, q = heads.alias("p"), heads.alias("q")
    met = p.join(q, (F.col("p.tree") == F.col("q.tree")) & (F.col("p.prefix") == F.col("q.prefix")) & (F.col("p.block") <= F.col("q.block")))
    met = met.where((100 * F.least("p.high", "q.high") >= percent * F.greatest("p.low", "q.low")) & (F.least("p.least", "q.least") != F.greatest("p.most", "q.most")))
    met = met.select(F.struct(F.col("p.block").alias("p"), F.col("q.block").alias("q")).alias("at"), F.explode(F.array_distinct(F.array("p.block", "q.block"))).alias("block"))
    wanted = met.join(blocks.select("block", "node", "root"), "block").join(nodes.select("node", "doc_id", "text_key"), "node").select("at", "node", "root", "doc_id", "text_key")
    texts = docs.join(wanted, ["doc_id", "text_key"]).select("at", "node", "root", "text")

    def check(held: pa.Table) -> pa.Table:
        names, at = np.unique(np.array([x.hex() for x in held.column("node").to_pylist()]), return_index=True)
        held = held.take(pa.array(at))
        parts = [shingles(*utf8(held.column("text").slice(lo, 500)), k) for lo in range(0, len(names), 500)]
        root = held.column("root").to_pylist()
        kept = apart_links(*(np.concatenate(x) for x in zip(*parts, strict=True)), root, percent)
        ends = [(root[i], root[j]) if root[i] < root[j] else (root[j], root[i]) for i, j in kept]
        return pa.table({"a": pa.array([x for x, _ in ends], pa.binary()), "b": pa.array([y for _, y in ends], pa.binary())})

    links = stored(texts.groupBy("at").applyInArrow(check, "a binary, b binary").distinct(), "links")
    for table in (marked_rows, rows, blocks):
        drop_stored(table)
    return links


def thinned(links: DataFrame) -> DataFrame:
    """Links that join the same nodes: a spanning forest of each partition of about FOREST links, so that dense groups leave about as many links as nodes."""

    def run(batches):
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[up]
            return x

        for part in batches:
            kept = []
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                if (p := find(a)) != (q := find(b)):
                    root[max(p, q)] = min(p, q)
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.binary()), pa.array([y for _, y in kept], pa.binary())], ["a", "b"])

    return links.coalesce(max(1, -(-links.count() // FOREST))).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches. links: a, b."""
    links = thinned(links)
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("u", "v"), "edges")
    parent = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "parents")
    while True:
        grand = parent.alias("p").join(parent.alias("q"), F.col("p.root") == F.col("q.node")).select(F.col("p.node").alias("node"), F.col("p.root").alias("root"), F.col("q.root").alias("grand"))
        grand = stored(grand, "grand")
        least = both.join(grand, both["v"] == grand["node"]).groupBy("u").agg(F.min("grand").alias("least"))
        hooks = least.join(grand, least["u"] == grand["node"]).select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("least").alias("root")), F.struct(F.col("u").alias("node"), F.col("least").alias("root")))).alias("x")).select("x.*")
        now = grand.select("node", F.col("grand").alias("root"), F.col("root").alias("old")).unionByName(hooks, allowMissingColumns=True)
        new = stored(now.groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), "parents")  # one old root a node
        changed = not new.where("root != old").isEmpty()
        drop_stored(grand)
        drop_stored(parent)
        parent = new.drop("old")
        if not changed:
            drop_stored(both)
            return parent


def group(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key and root (the group; null without words) of each row; links where percent * union size <= 100 * intersection size of k-word shingle sets. Groups whose ids are all null have a null component_id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    made = stored(sets(rows, k), "sets")
    nodes = made.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    nodes = stored(nodes.select("node", "rep.doc_id", "rep.text_key", "signature", "size"), "nodes")
    reps = nodes.select("node", "doc_id", "text_key", "size")
    pairs = stored(candidates(nodes.select("node", "signature"), percent), "pairs")
    links = confirmed(pairs.where("tree is null").select("a", "b"), reps, rows, k, percent)
    roots = components(links)
    more = apart(pairs.where("tree is not null").select(F.col("a").alias("node"), "tree"), nodes, roots, rows, k, percent)
    if not more.isEmpty():
        higher = components(more).withColumnRenamed("root", "top")  # of the roots alone
        roots = roots.union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
        roots = stored(roots.join(higher.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    for table in (pairs, links, more):
        drop_stored(table)
    labelled = nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = labelled.select("node", "root")
    known = F.nullif(F.col("doc_id"), F.lit(NO_ID))
    lowest = made.where("node is not null").groupBy("node").agg(F.min(known).alias("low")).join(labelled, "node")
    lowest = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = labelled.join(lowest, "root")
    return made.drop("signature").join(labelled, "node", "left").select(known.alias("doc_id"), "n_shingles", F.coalesce("component_id", known).alias("component_id"), "text_key", "root")


def group_sql(k: int, percent: int) -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id and kept (doc_id = component_id; false for null ids), of all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"""
with recursive d as materialized (select r, doc_id, case when w = [''] then [] else w end as w from (select row_number() over () as r, doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') as w from documents)),
s as materialized (select distinct r, sh from (select r, md5_number(concat_ws(' ', {parts})) as sh from (select r, w, unnest(range(1, len(w) - {k - 1} + 1)) as i from d where len(w) >= {k}) union all select r, md5_number('short ' || array_to_string(w, ' ')) from d where len(w) between 1 and {k - 1})),
n as materialized (select r, count(*) as n from s group by r),
u as materialized (select r, sh, count(*) over (partition by sh) as df from s),
met as materialized (select a.r as a, b.r as b, count(*) as c from u a join u b on a.sh = b.sh and a.r < b.r where a.df > 1 and b.df > 1 group by all),
link as materialized (select a, b from met join n x on x.r = a join n y on y.r = b where 100 * c >= {percent} * (x.n + y.n - c)),
edge as materialized (select a, b from link union select b, a from link),
reach(r, root) as (select r, r from d union select e.b, reach.root from reach join edge e on e.a = reach.r),
comp as (select r, min(d2.doc_id) as component_id from (select distinct r, root from reach) q join (select r as rr, doc_id from d) d2 on d2.rr = q.root group by r)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, comp.component_id, coalesce(d.doc_id = comp.component_id, false) as kept from d left join n using (r) join comp using (r)"""
