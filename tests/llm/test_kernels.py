"""Kernels against libraries and brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kinelake.llm import bpe, language, neardup, neighbours, packing, repeats, telephony, toxicity, urls

ODD = ["", " ", "\n\n x", "a" * 3000, "é中" * 700, "abc" * 400, "'s 'll\t\t 123 \U0001f600\U0001f600", "'", "it's ''s '", "É'RE'rex", "x ", "\x1c\x85　a", "<|endoftext|>"]


def texts(n=800, seed=1):
    r = random.Random(seed)
    return ODD + ["".join(r.choice("abcdeths in the éßü1 2.'''\nllvé") for _ in range(r.randrange(60))) for _ in range(n)]


def test_byte_bpe_equals_tiktoken():
    coder = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids, ends = coder.encode(texts())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.whole, special_tokens={})
    rows = np.split(ids, ends[:-1])
    assert all(row.tolist() == library.encode_ordinary(t) for row, t in zip(rows, texts(), strict=True))
    data, at = coder.decode(ids, ends)
    assert [bytes(data[a:b]) for a, b in zip([0, *at[:-1]], at, strict=True)] == [t.encode() for t in texts()]


def test_word_bpe_equals_tokenizers():
    coder = bpe.load_words(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*texts(), "İstanbul ΣΑΣ <|x|> Ǆ é ½ ٣"]
    ids, ends = coder.encode(rows)
    assert all(a.tolist() == coder.library.encode(t, add_special_tokens=False).ids for a, t in zip(np.split(ids, ends[:-1]), rows, strict=True))


def test_hashes_of_long_texts_equal_those_of_short_ones(monkeypatch):
    data = np.random.default_rng(6).integers(0, 256, 5000).astype(np.uint8)
    starts = np.random.default_rng(7).integers(0, 4900, 300)
    ends = starts + np.arange(300) % 90
    whole, grams = bpe.span_hashes(data, starts, ends), bpe.gram_hashes(data, 33)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    assert (bpe.span_hashes(data, starts, ends) == whole).all() and (bpe.gram_hashes(data, 33) == grams).all() and len(grams) == 4968


def thue_morse(size):
    """Two words of a and b that every sum of powers modulo 2**64 takes for one."""
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


def test_words_alike_by_sums_of_powers_stay_apart(monkeypatch):
    coder = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.whole, special_tokens={})
    for size in (256, 1024, 2048):
        pair = list(thue_morse(size))
        ids, ends = coder.encode(pair)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode_ordinary(x) for x in pair]
        data, at = np.frombuffer("".join(pair).encode(), np.uint8), np.array([0, size, 2 * size])
        hashes, _, count = neardup.shingles(data, at, 3)
        assert count.tolist() == [1, 1] and hashes[0] != hashes[1]
    # even where all hashes are alike
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends, lane=0: np.zeros(len(starts), np.uint64))
    coder.forget()
    some = ["one two two three", "three one"]
    ids, ends = coder.encode(some)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode_ordinary(x) for x in some]
    coder.forget()


def test_companding_tables():
    assert telephony.MULAW[0xFF] == 0 and telephony.MULAW[0x80] == 32124 and telephony.MULAW[0x00] == -32124
    assert telephony.ALAW[0xD5] == 8 and telephony.ALAW[0xAA] == 32256 and telephony.ALAW[0x2A] == -32256


def test_adpcm_equals_a_sample_at_a_time():
    blocks = np.random.default_rng(0).integers(0, 256, (5, 32)).astype(np.uint8)
    got = telephony.decode_adpcm(blocks)
    for block, row in zip(blocks.tolist(), got.tolist(), strict=True):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
        want = [value]
        for code in (x for b in block[4:] for x in (b & 15, b >> 4)):
            step = int(telephony.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(telephony.MOVES[code & 7])))
            want.append(value)
        assert row == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm", "pcm"])
def test_wav_round_trip(codec):
    assert telephony.read_wav(telephony.wav(b"abcd" * 64, codec, block=64)) == (codec, 8000, b"abcd" * 64)


@pytest.mark.parametrize(("segment", "langs"), [(4, 3), (7, 3), (64, 3), (7, 200)])
def test_viterbi_equals_a_word_at_a_time(segment, langs):
    """Also with more languages than a byte has codes."""
    rng = np.random.default_rng(segment)
    doc = np.repeat(np.arange(7), rng.integers(1, 60, 7))
    score = rng.normal(size=(len(doc), langs)) * 2
    got = language.viterbi(score, doc, 3.0, segment)
    for d in range(7):
        v, back = np.zeros(langs), []
        for row in score[doc == d]:
            jump = v.max() - 3.0
            back.append(np.where(jump > v, v.argmax(), np.arange(langs)))
            v = np.maximum(v, jump) + row
        path = [int(v.argmax())]
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        assert got[doc == d].tolist() == path[::-1]


@pytest.mark.parametrize(("length", "gram"), [(200, 96), (20, 9), (31, 12)])
def test_suffix_sort_equals_brute_force(length, gram):
    rng = np.random.default_rng(length)
    for trial in range(8):
        base = [bytes(rng.integers(97, 99 if trial % 2 else 123, rng.integers(0, 4 * length)).astype(np.uint8)) for _ in range(6)]
        docs = [b"".join(base[j][rng.integers(0, 30) :] for j in rng.integers(0, 6, rng.integers(0, 4))) for _ in range(12)] + [b"a" * 3 * length]
        data, at = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
        h, doc, start, windows = repeats.cells(data, at, length, gram)
        seen = Counter((int(d), int(s) + i) for d, s, n in zip(doc, start, windows, strict=True) for i in range(n))
        assert set(seen.values()) <= {1} and len(seen) == sum(max(0, len(x) - length + 1) for x in docs)
        count = Counter(x[i : i + length] for x in docs for i in range(len(x) - length + 1))
        size = windows + length - 1
        first = np.cumsum(size) - size
        mask = repeats.repeated(bpe.gather(data, at[doc] + start, size), first, windows, length)
        where: dict[bytes, int] = {}
        for hash_, d, s, n, f in zip(h, doc, start, windows, first, strict=True):
            for i in range(n):
                window = docs[d][s + i : s + i + length]
                assert mask[f + i] == (count[window] > 1)
                assert where.setdefault(window, hash_) == hash_


def test_suffix_sort_with_many_names():
    """Over 2**21 names: windows that differ in one byte aren't repeated, equal ones are."""
    rng = np.random.default_rng(11)
    text = rng.integers(0, 256, 3_700_000).astype(np.uint8)
    starts = np.arange(0, len(text) - 600, 400)
    text = np.concatenate((text, *(text[i : i + 200] for i in starts[:400])))
    second = len(text) - 400 * 200 + 200 * np.arange(400)
    text[second[::2] + 150] ^= 1
    at = np.concatenate((starts, second))
    mask = repeats.repeated(text, at, np.ones(len(at), np.int64), 200)
    twin = np.zeros(len(starts), bool)
    twin[1:400:2] = True
    assert (mask[starts] == twin).all() and (mask[second] == twin[:400]).all()


@pytest.mark.parametrize("bits", [1, 5])
def test_suffix_sort_with_long_names(bits, monkeypatch):
    monkeypatch.setattr(repeats, "NAME_BITS", bits)
    rng = np.random.default_rng(bits)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[3000:3700] = text[100:800]
    windows = [text[i : i + 31].tobytes() for i in range(3970)]
    count = Counter(windows)
    mask = repeats.repeated(text, np.array([0]), np.array([3970]), 31)
    assert mask[:3970].tolist() == [count[w] > 1 for w in windows]


def test_cells_alike_by_hash_only_stay_apart():
    text = np.frombuffer(b"abcabdabcxyzabd", np.uint8)
    lo, size, same = np.arange(0, 15, 3), np.full(5, 3), np.zeros(5, np.uint64)
    order, new = repeats._alike(same, same, text, lo, size)
    found = [sorted(x.tolist()) for x in np.split(order, np.flatnonzero(new)[1:])]
    assert sorted(found) == [[0, 2], [1, 4], [3]]


def test_packing_keeps_every_piece_and_nears_the_bound():
    r = random.Random(3)
    counts = Counter(min(2048, int(r.lognormvariate(6.3, 0.9)) + 1) for _ in range(4000))
    first = packing.first_fill(counts, 2048)
    bins = packing.local_search(first, 2048)
    assert Counter(x for p, n in bins.items() for x in p for _ in range(n)) == counts and all(sum(p) <= 2048 for p in bins)
    least = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert least <= sum(bins.values()) <= sum(first.values()) <= least * 1.01
    plan = packing.Plan(bins)
    length = np.array([x for x in counts for _ in range(counts[x])])
    rank = np.concatenate([np.arange(counts[x]) for x in counts])
    sequence, offset = plan(length, rank)
    for s in np.unique(sequence)[:200]:
        own = sorted(zip(offset[sequence == s], length[sequence == s], strict=True))
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))


def test_exchange_moves_swaps_and_pairs():
    assert packing._exchange((5,), (3, 2), 5) == ((5,), ())
    assert packing.local_search(Counter({(6,): 1, (5, 4): 1, (4, 1): 1}), 10) and sum(packing.local_search(Counter({(6, 1): 1, (7, 2): 1, (3, 1): 1}), 10).values()) == 2


def test_shingles_and_signatures():
    docs = [b"A b c d", b"a\tb c", b"x", b"", b"  ", b"a b", b"a b c a b c"]
    hashes, check, count = neardup.shingles(np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)]), 3)
    assert count.tolist() == [2, 1, 1, 0, 0, 1, 3]
    rows = np.split(hashes, np.cumsum(count)[:-1])
    assert rows[1][0] in rows[0] and rows[1][0] in rows[6] and rows[5][0] not in rows[0]
    assert (neardup.signatures(hashes, count)[3] == 0).all()


def test_forest_finds_near_neighbours_in_dense_regions():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, neardup.TREES * neardup.LEVELS).astype(np.uint8)
    sig = np.where(rng.random((600, len(base))) < 0.05, rng.integers(0, 256, (600, len(base))), base).astype(np.uint8)
    sig[:, : neardup.LEVELS] = base[: neardup.LEVELS]
    a, b = neardup.forest_pairs(sig[:, : neardup.LEVELS], sig, 90)
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    assert len({find(i) for i in range(600)}) == 1 and len(a) < 600 * 3 * (neardup.NEAREST + 1)


def test_regions_go_as_deep_as_they_are_full(monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 3)
    keys = np.array([[1, 1, 1, v, 0, 0, 0, 0] for v in (1, 2)] + [[1, 1, 2, v, 0, 0, 0, 0] for v in (1, 1, 2, 3)] + [[2] * 8], np.uint8)
    sig = np.zeros((7, neardup.TREES * neardup.LEVELS), np.uint8)
    assert sorted(zip(*(x.tolist() for x in neardup.forest_pairs(keys, sig, 1)), strict=True)) == [(0, 1), (2, 3)]
    assert [len(x) for x in neardup.forest_pairs(keys[:0], sig[:0], 1)] == [0, 0]


def test_second_pass_links_what_is_apart():
    rng = np.random.default_rng(7)
    base = np.arange(200)
    held = [np.unique(np.where(rng.random(200) < 0.04 * (i % 5), rng.integers(1000, 1300, 200), base)).astype(np.uint64) for i in range(150)]
    root = [bytes([i % 40]) for i in range(150)]
    group = {r: r for r in root}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(held):
        for j, y in enumerate(held[:i]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                group[find(root[i])] = find(root[j])
    want = {frozenset(r for r in set(root) if find(r) == top) for top in map(find, root)}
    group = {r: r for r in root}
    for i, j in neardup.apart_links(np.concatenate(held), np.concatenate(held), np.array([len(x) for x in held]), root, 85):
        assert find(root[i]) != find(root[j])
        group[find(root[i])] = find(root[j])
    assert {frozenset(r for r in set(root) if find(r) == top) for top in map(find, root)} == want


def test_collision_counting_recall():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(4000, 32))
    block = neighbours.Block(np.arange(4000), vectors)
    hit = 0
    for q in range(0, 4000, 100):
        distance = np.sqrt(np.square(vectors - vectors[q]).sum(axis=1))
        distance[q] = np.inf
        hit += len({i for i, _ in block.nearest(vectors[q], q, 10)} & set(np.argsort(distance)[:10].tolist()))
    assert hit / 400 >= 0.9


def test_scripts_of_words():
    words = language.Words(["abc дом дoм", "ab漢字漢", ""])
    names = [language.SCRIPT_NAMES[i] for i in words.script]
    assert names == ["latin", "cyrillic", "cyrillic", "han"]


def test_trees_and_label_model():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((urls.Boosted(x, y)(x) > 0.5) == y).mean() > 0.95
    truth = rng.random(3000) < 0.3
    votes = np.stack([np.where(rng.random(3000) < a, truth, ~truth) for a in (0.9, 0.85, 0.8, 0.8)], axis=1).astype(float)
    post, model = toxicity.label_model(votes, votes.mean(axis=1))
    assert ((post > 0.5) == truth).mean() > 0.9 and model["yes"][0] > model["yes"][3] - 0.05


def test_shouting_counts_the_whole_text():
    shout, calm = "STOP \u00c9\U0001d400 " * 600, "quiet words " * 400
    texts = [calm + shout * 3, shout + calm * 10, shout, calm, "", "\U0001f600" * 30, "AB"]
    want = [sum(c.isupper() for c in x) > 0.3 * max(20, len(x)) for x in texts]
    assert toxicity.Signs(texts, np.zeros(0, np.uint64)).patterns[:, 4].tolist() == want and want[:4] == [True, False, True, False]
    assert toxicity.Signs(["", ""], np.zeros(0, np.uint64)).patterns[:, 4].tolist() == [False, False]


@pytest.mark.parametrize("buckets", [1, 64, 3750, 1_000_000])
def test_packs_of_many_buckets(buckets):
    """Every cell comes to its bucket, and many buckets make packs hardly larger."""
    rng = np.random.default_rng(1)
    n = 200_000
    h, ids = rng.integers(0, 1 << 63, n).astype(np.uint64), np.sort(rng.integers(0, 4000, n))
    keys = rng.integers(0, 1 << 62, 4000)[ids]
    start, windows = rng.integers(0, 5000, n).astype(np.int32), rng.integers(1, 105, n).astype(np.uint16)
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    batch = repeats._spread(["bucket", "pack"], repeats.CELL, bucket, h, ids, keys, start, windows)
    homes, packs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    assert len(set(homes)) == len(homes) and sum(map(len, packs)) <= 32 * n
    got = [repeats._joined([p], repeats.CELL) for p in packs[:50]]
    assert all((g[0] % np.uint64(buckets) == b).all() for g, b in zip(got, homes, strict=False))
    back = repeats._joined(packs, repeats.CELL)
    order, want = np.argsort(back[0], kind="stable"), np.argsort(h, kind="stable")
    assert all((a[order] == b[want]).all() for a, b in zip(back, (h, ids, keys, start, windows), strict=True))
    none = repeats._spread(["bucket", "pack"], repeats.CELL, bucket[:0], *(x[:0] for x in (h, ids, keys, start, windows)))
    assert none.num_rows == 0


def test_local_search_ends_only_where_no_pair_gains():
    r = random.Random(5)
    for trial in range(30):
        capacity = r.choice([10, 40, 100])
        counts = Counter(r.randint(1 + trial % 3 * capacity // 5, capacity) for _ in range(60))
        bins = packing.local_search(packing.first_fill(counts, capacity), capacity)
        assert Counter(x for p, n in bins.items() for x in p for _ in range(n)) == counts
        if sum(bins.values()) == -(-sum(x * n for x, n in counts.items()) // capacity):
            continue
        for a in bins:
            for b in bins:
                if sum(a) <= sum(b) < capacity and (a != b or bins[a] > 1):
                    assert packing._exchange(a, b, capacity - sum(b)) is None


def test_masks_tell_what_exchange_finds():
    r = random.Random(6)
    for _ in range(3000):
        a, b = (tuple(sorted(r.randint(1, 30) for _ in range(r.randint(1, 5)))) for _ in range(2))
        capacity = max(sum(a), sum(b)) + r.randint(1, 6)
        own, other = packing._masks(a, capacity), packing._masks(b, capacity)
        assert bool(own[0] & other[2] or own[1] & other[3]) == (packing._exchange(a, b, capacity - sum(b)) is not None)
