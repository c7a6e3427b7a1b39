"""The smoother's segments and chunks against a step at a time."""

import random

import numpy as np
import pytest

from kinelake.operators import sequence

S, DAY = 1_000_000, 86_400_000_000


def plain(hmm, codes, uniform=False):
    """The likeliest states, an epoch at a time, of the same whole logarithms."""
    start, emit, move = (x.tolist() for x in hmm._logs(uniform))
    k, score, back = len(start), None, []
    for c in codes:
        if score is None:
            score = [start[j] + emit[j][c] for j in range(k)]
            continue
        best = [max(range(k), key=lambda i: (score[i] + move[i][j], -i)) for j in range(k)]
        back.append(best)
        score = [score[best[j]] + move[best[j]][j] + emit[j][c] for j in range(k)]
    out = [max(range(k), key=lambda i: (score[i], -i))]
    for best in reversed(back):
        out.append(best[out[-1]])
    return out[::-1]


def model(seed, k, rough=False):
    rng = np.random.default_rng(seed)
    deal = lambda *size: rng.dirichlet(np.full(k, 0.3), size).reshape(*size, k) if not rough else np.eye(k)[rng.integers(0, k, size)]
    return sequence.HiddenMarkov([f"s{i}" for i in range(k)], deal(1)[0], deal(k), deal(k) if rough else 0.3 * deal(k) + 0.7 * np.eye(k), uniform=bool(seed % 2))


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 64, 4096])
@pytest.mark.parametrize("rough", [False, True])
def test_decode_equals_a_step_at_a_time(monkeypatch, segment, rough):
    """Segments of any size, ties and impossible steps (rough) included."""
    monkeypatch.setattr(sequence, "SEGMENT", segment)
    for seed in range(6):
        hmm = model(seed, 2 + seed, rough)
        codes = np.random.default_rng(seed + 50).integers(0, 2 + seed, 1 + 37 * seed)
        assert hmm.decode_segments(codes).tolist() == plain(hmm, codes)
    assert hmm.decode_segments(np.zeros(0, int)).tolist() == []


def test_ties_go_to_the_first_state():
    flat = sequence.HiddenMarkov(["a", "b", "c"], np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.full((3, 3), 1 / 3))
    assert set(flat.decode_segments(np.arange(9000) % 3)) == {0}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_chunks_equal_whole_series(spark, kind):
    """Chunks of some epochs, of one epoch, and a subject with most rows; missing labels, gaps, subjects of one epoch, clashing names."""
    hmm, draw, rows = model(4, 4), random.Random(8), []
    for who, n in ((1, 700), (2, 40), (3, 1), (4, 3)):
        us = 10**15
        for _ in range(n):
            us += draw.choice([30, 30, 30, 30, 30, 90]) * S
            rows.append((who, us, None if who == 4 or draw.random() < 0.1 else f"s{draw.randrange(4)}", "old"))
    rows.append((None, 5, "s1", "old"))
    df = spark.createDataFrame(rows, "subject_id long, us long, label string, chunk_ string").withColumn("subject_id", sequence.F.col("subject_id").cast(kind))
    want = {}
    for who in (1, 2, 3):
        known = sorted((u, x) for w, u, x, _ in rows if w == who and x)
        states = plain(hmm, [int(x[1]) for _, x in known])
        for i, ((u, x), state) in enumerate(zip(known, states, strict=True)):
            want[str(who), u] = x if i and u - known[i - 1][0] != 30 * S else f"s{state}"
    for chunk in (DAY, 600 * S, 30 * S):
        got = hmm.smooth_chunks(df, "label", 30 * S, chunk_us=chunk).collect()
        assert len(got) == len(rows) and got[0].chunk_ == "old"
        assert {(str(r.subject_id), r.us): r.smoothed for r in got if r.smoothed is not None} == want
    assert all(r.smoothed is None for r in hmm.smooth_chunks(df.where("subject_id = 4"), "label", None).collect())
    assert hmm.smooth_chunks(df.where("us < 0"), "label", None).columns == ["subject_id", "us", "label", "chunk_", "smoothed"]
    assert hmm.smooth_chunks(df.where("us < 0"), "label", None).count() == 0


def test_unknown_labels_are_errors(spark):
    df = spark.createDataFrame([("a", 0, "s0"), ("a", 1, "s9")], "subject_id string, us long, label string")
    with pytest.raises(Exception, match="unknown label"):
        model(1, 3).smooth_chunks(df, "label", None).collect()
