"""Each operator on awkward rows: nulls, empty, blank and very long texts, repeated rows, ties, empty tables, columns with clashing names."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import bpe, language, licenses, neardup, neighbours, packing, queries, repeats, telephony, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, stage_score string, ids string, block_score int, text_key string, node int"
WORDS = " ".join(f"word{i} und{i % 7} the{i % 5}" for i in range(90))
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(40_000))


def row(i, text, lang="en"):
    return (i, text, lang, "s", None, 1.0, "x", "y", 2, "k", 3)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, LONG, "de"), row(5, WORDS), row(5, WORDS), row(6, WORDS), row(7, WORDS + " tail"), row(None, "lone words of nobody here", None), row(None, None, None), row(8, "Mit-License MIT LICENSE apache"), row(9, "é\U0001f600 123", "fr"), row(10, "x" * 450)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.round_trip_digest(docs, path)
    want = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()), key=repr)
    assert pairs(got, "doc_id", "decoded_sha256") == want
    back = bpe.decode(bpe.encode(docs, path), path)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect()) and back.columns[:-2] == [c for c in docs.columns if c != "ids"]
    assert bpe.round_trip_digest(none, path).count() == 0


def test_audio(docs, none):
    got = {(r.doc_id, r.n_bytes): r for r in telephony.digest(docs).collect()}
    assert got[2, 0].payload_bytes == 64 and got[2, 0].payload_sha256 == hashlib.sha256(b"\0" * 64).hexdigest() and got[1, 0].feature == got[2, 0].feature
    for codec in ("mulaw", "alaw", "adpcm"):
        kept = telephony.to_pcm(telephony.store(docs, codec=codec)).where("doc_id = 9").first()
        raw = kept.text.encode()
        assert telephony.read_wav(bytes(kept.media))[2][: len(raw)] == raw and telephony.read_wav(bytes(kept.pcm))[:2] == ("pcm", 16000)
    assert telephony.digest(none).count() == 0


def test_licenses(spark, docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs.where("doc_id is not null")).collect()}
    assert (got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels, got[8].score) == (2, 0, 2, "mit", 1.0)
    assert got[1].n_words == 0 and got[1].labels == "" and licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0
    held = spark.createDataFrame([(1, "so\nThis work is licensed, under the GNU general public licence version 3!\nend")], "doc_id long, text string")
    assert licenses.scan(held).first().labels == "gpl"


def test_wrapped_licenses(spark):
    texts = [
        "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files",
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0",
        "permission " + "far words " * 30 + "\nis hereby granted free of charge\n" + "far words " * 30 + "to any person obtaining a copy of this",
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("mpl", 1.0), 3: ("", 0.0)}


def test_license_blocks_meet_each_template_once(spark):
    """Against all runs of words, wherever in the text the statement stands and however many windows hold it."""
    assert all(2 * licenses.all_words(t) <= licenses.WINDOW for _, t in licenses.TEMPLATES)
    statements = [t for _, t in licenses.TEMPLATES]
    texts = [f"{'x ' * (7 * i)}{'\n'.join(statements[i % 12].split())}{' y' * (11 * i % 100)}" for i in range(36)] + ["\n".join(statements), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.matches(licenses.prepared(docs, ["doc_id"]), ["doc_id"]).collect()
    assert len({(r.doc_id, r.kind, r.block, r.template) for r in found}) == len(found)
    got = {(r.doc_id, r.template): max(x.containment for x in found if (x.doc_id, x.template) == (r.doc_id, r.template)) for r in found if r.kind == "window"}
    want = {}
    for i, text in enumerate(texts):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        for j, statement in enumerate(statements):
            own, n = set(licenses.template_words(statement)), licenses.all_words(statement)
            best = max((len(own & set(words[k : k + n])) for k in range(max(1, len(words) - n + 1))), default=0)
            if best >= licenses.needed(list(own), licenses.CONTAINMENT):
                want[i, j] = best / len(own)
    assert got == pytest.approx(want)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.example.ORG/es/x?q"), (4, "http://a.org"), (5, "ftp://x.com/de/?a=1#z"), (6, "http://x.net/p"), (6, "http://x.net/p"), (7, "http://org/en"), (8, "a://b.com/fr/://c.com/de/")]
    pages = spark.createDataFrame([(*r, 0, "v") for r in rows], "page_id int, url string, block_score int, verdict string")
    got = {r.page_id: (r.url_host, r.url_path, r.url_rule, r.verdict) for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4] == ("a.org", "", None, got[4][3]) and got[7] == ("org", "/en", "org/", "allow")
    assert got[5] == ("x.com", "/de/", "com/de/", "block") and got[8][:3] == ("b.com", "/fr/://c.com/de/", "com/fr/")
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_statistics_count_all_rows(spark):
    rows = [f"http://h{i % 50}.s{i % 5}.org/{'es/' if i % 3 else 'en/2'}{i}" for i in range(600)] + ["http://rare.net/x", "http://rare.net/y", "plain", None]
    matched = urls.match(spark.createDataFrame([(x,) for x in rows], "url string"), [("org", "/", "allow"), ("s1.org", "/es/", "block")])
    counted = urls.counts(matched)
    made = urls.with_statistics(matched, counted)
    got = {r.url: (r.url_known_suffix, r.url_bad_suffix) for r in made.collect()}
    blocked = sum(i % 5 == 1 and i % 3 > 0 for i in range(600))
    assert made.count() == len(rows) and got["http://rare.net/x"] == pytest.approx((np.log1p(2), 0)) and got["plain"][0] == pytest.approx(np.log1p(1))
    assert got[rows[1]] == pytest.approx((np.log1p(120), (blocked + 20 * blocked / 600) / 140 - blocked / 600))
    assert urls.fit(matched, counted, train_rows=50) is not None
    # without the own fold
    fold = {r.url: r.fold for r in matched.select("url", urls.fold_of(F.col("url")).alias("fold")).collect()}
    held = {r.url: r.url_bad_suffix for r in urls.with_statistics(matched, counted, own_fold=False).collect()}
    for url in rows[1:600:97]:
        others = [i for i in range(600) if i % 5 == int(url.split(".s")[1][0]) and fold[rows[i]] != fold[url]]
        every = [i for i in range(600) if fold[rows[i]] != fold[url]]
        assert len(others) < 120 and len(every) < 600
        hit, n = sum(i % 5 == 1 and i % 3 > 0 for i in others), len(others)
        assert (held[url] > 0) == (hit > 0) and abs(held[url] - hit / n) < 0.3


def test_url_features(spark):
    url = "https://a-b.c.example.org/x_1/y-2.html?p=1&&qq=%20z#f"
    made = urls.match(spark.createDataFrame([(url,), (None,), ("x://" + "h" * 5000 + "." * 3000 + "/" + "p1" * 50_000,)], "url string"), []).selectExpr("*", *(f"0.5D as {x}" for x in urls.STATISTICS))
    got = [r.x for r in made.select(urls.features(made).alias("x")).collect()]
    host, path = "a-b.c.example.org", "/x_1/y-2.html"
    bits = lambda t: -sum(t.count(c) / len(t) * np.log2(t.count(c) / len(t)) for c in set(t))
    want = [len(url), len(host), len(path), 12, 3, 2, 0, 5 / len(url), 1, 2, bits(host), bits(path), 2, 7, 1, 7, 3, 1, 1, 1, 0] + [0.5] * 4
    assert got[0] == pytest.approx(want) and got[1][:13] == [0.0] * 13 and all(np.isfinite(x) for row in got for x in row) and {len(x) for x in got} == {25}


def test_language_and_toxicity(spark, docs, none):
    got = {r.doc_id: r for r in language.held_out_predictions(docs.where("doc_id is not null")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and 0 <= got[4].score <= 1
    assert language.held_out_predictions(none).count() == 0
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        scored = toxicity.held_out_scores(docs, table).collect()
        assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.held_out_scores(none, labels).count() == 0


def test_toxicity_with_one_id_for_most_rows(spark):
    """An id that most rows share teaches with one text, so the fit stays as large as its ids; a very long text is scored whole."""
    rows = [(7, f"plain words number {i}") for i in range(300)] + [(i, "you awful zlorp go" if i % 3 == 0 else f"nice day number {i}") for i in range(10, 90)] + [(500, "calm words " * 60_000 + "you awful zlorp go " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), *((i, int(i % 3 == 0)) for i in range(10, 90))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and min(s for (i, _), s in got.items() if 10 <= i < 90 and i % 3 == 0) > 0.7 > max(s for (i, _), s in got.items() if i == 7)
    assert got[rows[-1]] > got[7, "plain words number 1"]


def test_near_duplicates_with_null_ids(spark):
    docs = spark.createDataFrame([(None, WORDS), (None, WORDS), (4, WORDS), (None, "lone words of nobody at all"), (None, "")], "doc_id long, text string")
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in neardup.group(docs, 3, 85).collect()) == [("4", "4"), ("None", "4"), ("None", "4"), ("None", "None"), ("None", "None")]


def test_url_suffixes_of_odd_hosts(spark):
    rows = ["http://10.0.0.1:8080/x", "http://host:80/", "http://[::1]/p", "http:///p", "http://a.b.c.org:81/q", "://", "http://..../"]
    made = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), queries.URL_RULES)
    got = {r.page_id: (r.url_host, r.verdict) for r in made.collect()}
    assert len(got) == len(rows) and got[0][0] == "10.0.0.1:8080" and got[3][0] == "" and got[4] == ("a.b.c.org:81", got[4][1])


def test_mixed_language_spans(spark):
    en, de = ("the house with that and which other", "das haus mit dem und welches andere")
    rows = [(i, f"{en} " * 8, "en") for i in range(0, 40, 2)] + [(i, f"{de} " * 8, "de") for i in range(1, 40, 2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, score, spans = language.label([f"{en} {en} {de} {de} {de}"], model, spans=True)
    assert lang == ["de"] and [s["lang"] for s in spans[0]] == ["en", "de"] and 0.5 < score[0] < 0.7


def test_packing(docs, none):
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(cut).collect()
    assert len(got) == cut.count() and Counter(r.doc_id for r in got)[1] == 1
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048
    assert len(bins) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(packing.pieces(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_repeats(docs, none):
    got = repeats.cut(docs).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() >= set(docs.columns)
    texts = [(r.text or "").encode() for r in docs.collect()]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                mask[i : i + 200] = True
        want.append((len(t), int(mask.sum())))
    assert sorted((r.repeat_bytes, r.repeat_removed) for r in got) == sorted(want)
    assert {r.doc_id: r.text for r in got if r.doc_id in (1, 2)} == {1: None, 2: ""} and repeats.cut(none).count() == 0


def test_hot_cells_take_single_windows(docs, monkeypatch):
    want = pairs(repeats.cut(docs), "doc_id", "repeat_removed", "repeat_sha256")
    monkeypatch.setattr(repeats, "HOT", 1)
    assert pairs(repeats.cut(docs), "doc_id", "repeat_removed", "repeat_sha256") == want


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.group(docs, 3, 85).collect()}
    assert {c for (i, n), c in got.items() if i in (5, 6, 7)} == {5} and got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[4, 39_998 if (4, 39_998) in got else next(n for i, n in got if i == 4)] == 4
    assert neardup.group(none, 3, 85).count() == 0


def test_near_duplicates_in_large_regions_lack_no_link(spark, monkeypatch):
    for name, value in (("FULL", 4), ("NEAREST", 1), ("BLOCK", 8)):
        monkeypatch.setattr(neardup, name, value)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[: 200 + 4 * i]) for i in range(40)] + [" ".join(f"v{i * j % 1009}" for i in range(60)) for j in range(1, 30)]
    got = {r.doc_id: r.root for r in neardup.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert len({got[i] for i in range(40)}) == 1 and len(set(got.values())) == 30


def test_second_pass_joins_roots_of_a_region(spark):
    rows = [(bytes([i]) * 16, i, i, bytes(128), 58) for i in range(6)]
    nodes = spark.createDataFrame(rows, "node binary, doc_id long, text_key long, signature binary, size long")
    docs = spark.createDataFrame([(i, i, " ".join(f"w{j + 2 * (i // 3) * 50}" for j in range(60)) + f" {i}") for i in range(6)], "doc_id long, text_key long, text string")
    marks = spark.createDataFrame([(r[0], 0) for r in rows], "node binary, tree int")
    roots = spark.createDataFrame([(rows[0][0], rows[0][0]), (rows[1][0], rows[0][0])], "node binary, root binary")
    links = [(bytes(r.a)[0], bytes(r.b)[0]) for r in neardup.apart(marks, nodes, roots, docs, 3, 80).collect()]
    assert sorted((a // 3, b // 3) for a, b in links) == [(0, 0), (1, 1), (1, 1)] and (0, 2) in links and len(set(links)) == 3


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = pairs(neighbours.search(df, F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 2**0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 2**0.5)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_with_repeated_ids(spark, monkeypatch):
    """Equal rows count once; rows that share an id with different vectors are candidates of their own and ask on their own."""
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (0, [5.0, 0.0]), *((i, [float(i), 1.0]) for i in range(1, 15)), (7, [7.0, 1.0]), (8, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", 1)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") % 100 == 0, k=5).collect())
    want = []
    for query in ([0.0, 1.0], [5.0, 0.0]):
        near = sorted((np.hypot(query[0] - v[0], query[1] - v[1]), i) for i, v in {(i, tuple(v)) for i, v in rows} if i)
        want += [(0, n + 1, i, d) for n, (d, i) in enumerate(near[:5])]
    assert got == sorted(want)


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = kept.count()
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns and kept.count() <= before
        ids = {r.doc_id for r in kept.collect()}
        assert ids == ({4, 8, 9, 10, 5, None} & ids if start is docs else set()) and corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == kept.count() + (kept.where("doc_id = 4").count() and packing.pieces(kept.where("doc_id = 4"), public_tokenizers.path("word_bpe_49k.json")).count() - 1)


def test_long_templates_widen_the_window(spark, monkeypatch):
    """A template of 70 words, wrapped after each seventh, lies whole in a window."""
    words = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    monkeypatch.setattr(licenses, "TEMPLATES", [*licenses.TEMPLATES, ("long", " ".join(words))])
    assert licenses.window() == 140
    lines = "\n".join(" ".join(words[i : i + 7]) for i in range(0, 70, 7))
    texts = [(1, f"{'other words here ' * 31}\n{lines}\nend"), (2, "\n".join(lines.split("\n")[:6]))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "long", 2: ""}


@pytest.mark.parametrize("keys, size", [(3, 1000), (1, 1000), (20_000, 0), (20_000, 9)])
def test_url_statistics_meet_alike(spark, monkeypatch, keys, size):
    """Statistics are the same whether keys are broadcast, shuffled or both; null urls and empty paths among them."""
    made = [f"https://a{i % 7}.site{i % 5}.{'org' if i % 3 else 'com'}/{['fr', 'de', '', 'x'][i % 4]}/{i}" for i in range(300)] + [None, "", "no host", "https://h.net"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")
    matched = urls.match(pages, queries.URL_RULES)
    counted = urls.counts(matched)
    want = sorted(urls.with_statistics(matched, counted).select("page_id", *urls.STATISTICS).collect())
    monkeypatch.setattr(urls, "HOT_KEYS", keys)
    monkeypatch.setattr(urls, "HOT_BYTES", size)
    assert sorted(urls.with_statistics(matched, counted).select("page_id", *urls.STATISTICS).collect()) == want and len(want) == len(made)
    assert any(r.url_bad_head for r in want) and any(r.url_known_suffix for r in want)
