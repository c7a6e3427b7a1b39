"""License scans: an exact set-similarity join of text blocks with license templates, and phrase positions. DataFrame functions only.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Text blocks are lines, and windows of `window()` words over line ends, each half
over the next. A template is found in a line that holds at least CONTAINMENT of its distinct words, and in a window of which as many
consecutive words as the template has hold them: so wrapped ones are found. Tokens are ordered by how
many documents hold them, rarest first. A block of b tokens can only reach an overlap of o with a template of t tokens if
it has o tokens (length filter), shares one of the template's t - o + 1 rarest (prefix filter), and the
rarest shared token, at which the two meet once, leaves enough tokens after it on both sides (positional filter); survivors are counted exactly.
Templates are a fixed short list: their tokens' frequencies are all that reaches the driver, and their side of the join is
broadcast. Null and empty texts have no words, no labels and score 0. Every row gives one row; equal rows
give equal rows. Only doc_id and text are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

CONTAINMENT = 0.8
#: Words of a block that crosses lines, if no template has more than half as many.
WINDOW = 64
#: Runs of anything but word characters, of lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The distinguishing statement of public licenses, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def spaced(text: Column) -> Column:
    """Words joined by single spaces. lower() differs from lower-casing A-Z in words' letters, not in where words are, and makes an ASCII letter of the Kelvin sign alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(low, GAP, " "))


def word_count(spaced_text: Column) -> Column:
    return F.when(spaced_text == "", 0).otherwise(F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit(""))) + 1).cast("long")


def template_words(text: str) -> list[str]:
    """The distinct words of an ASCII template, in order."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in template_words(t)})


def prepared(docs: DataFrame, keys: list[str], containment: float = CONTAINMENT) -> DataFrame:
    """What one pass over the texts leaves, written to the shared folder: keys, the phrase columns, held (distinct template words), lines (block and
    tokens of those with enough template words for some template) and words (all, of texts that hold enough words of some template; else null)."""
    known, least = F.array(*map(F.lit, vocabulary())), min(needed(template_words(t), containment) for _, t in TEMPLATES)
    tokens = lambda words: F.array_intersect(words, known)
    rows = docs.select(*keys, F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), spaced).alias("lines"))
    rows = rows.withColumn("whole", F.array_join(F.filter("lines", lambda x: x != ""), " "))  # a line's end is no part of a word
    rows = rows.select(*keys, "lines", "whole", *(c.alias(n) for n, c in phrase_columns(F.col("whole")).items()), tokens(F.split("whole", " ")).alias("held"))
    blocks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("block"), tokens(F.split(x, " ")).alias("tokens"))), lambda b: F.size(b["tokens"]) >= least)  # length filter against the shortest template
    enough = F.exists(kinds(containment), lambda t: F.size(F.array_intersect("held", t["own"])) >= t["need"])  # what the whole text lacks, no window holds
    ready = rows.withColumns({"lines": F.when(F.size("held") >= least, blocks).otherwise(F.array().cast("array<struct<block:int,tokens:array<string>>>")), "words": F.when(enough, F.split("whole", " "))})
    return stored(ready.drop("whole"), "licenses")


def frequencies(ready: DataFrame) -> dict[str, int]:
    """How many documents hold each template word, over all documents: the global order."""
    held = ready.select(F.explode("held").alias("token"))
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # a row for each template word at most


def all_words(text: str) -> int:
    """How many words an ASCII template has."""
    return len("".join(c if c.isalnum() else " " for c in text).split())


def window() -> int:
    """Words of a block that crosses lines: WINDOW, or twice those of the longest template, so that each lies whole in one of the windows."""
    return max(WINDOW, 2 * max(all_words(t) for _, t in TEMPLATES))


def needed(own: list[str], containment: float) -> int:
    """How many of a template's distinct words a block must hold."""
    return max(1, math.ceil(len(own) * containment - 1e-9))


def ranked(ready: DataFrame) -> dict[str, int]:
    """The place of each template word in the order of document frequency, rarest first."""
    seen = frequencies(ready)
    return {w: i for i, w in enumerate(sorted(vocabulary(), key=lambda w: (seen.get(w, 0), w)))}


def prefixes(spark: SparkSession, rank: dict[str, int], containment: float) -> DataFrame:
    """A row for each prefix token of each template: template, label, size, need, own (its ranks), at_template, rank."""
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        own = sorted(rank[w] for w in template_words(text))
        need = needed(own, containment)
        for at, r in enumerate(own[: len(own) - need + 1]):
            rows.append(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(len(own)).alias("size"), F.lit(need).alias("need"), F.array(*map(F.lit, own)).alias("own"), F.lit(at).alias("at_template"), F.lit(r).alias("rank")))
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def kinds(containment: float) -> Column:
    """An array of the templates: template, label, length (words), own (distinct words), need (of them)."""
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        own = template_words(text)
        rows.append(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(all_words(text)).alias("length"), F.array(*map(F.lit, own)).alias("own"), F.lit(needed(own, containment)).alias("need")))
    return F.array(*rows)


def joined(blocks: DataFrame, rank: dict[str, int], containment: float) -> DataFrame:
    """blocks (with tokens, their distinct template words) joined with the templates that they contain: one row for each block and template, with template, label, size, overlap."""
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    right = prefixes(blocks.sparkSession, rank, containment)
    held = blocks.withColumn("held", F.array_sort(F.transform("tokens", lambda t: F.element_at(ranks, t)))).drop("tokens")
    met = held.select("*", F.posexplode("held").alias("at_block", "rank")).join(F.broadcast(right), "rank")
    met = met.where(F.col("rank") == F.array_min(F.array_intersect("held", "own")))  # a block and template meet at their rarest shared token alone
    left_over = F.least(F.size("held") - F.col("at_block"), F.col("size") - F.col("at_template"))
    met = met.where((F.size("held") >= F.col("need")) & (left_over >= F.col("need")))
    met = met.withColumn("overlap", F.size(F.array_intersect("held", "own"))).where(F.col("overlap") >= F.col("need"))
    return met.drop("held", "at_block", "rank", "at_template", "own", "need")


def matches(ready: DataFrame, keys: list[str], containment: float = CONTAINMENT) -> DataFrame:
    """keys, kind (line or window), block (its number), template, label, containment: one row for each block and template whose containment reaches the threshold. ready: what `prepared` made.

    Lines are blocks as they are. Windows of `window()` words, each half over the next, are blocks of texts that hold enough words of
    some template; there the best run of as many words as the template counts. No run that a template fits is longer than half a window.
    """
    known, rank = F.array(*map(F.lit, vocabulary())), ranked(ready)
    least = min(needed(template_words(t), containment) for _, t in TEMPLATES)
    lines = joined(ready.select(*keys, F.inline("lines")), rank, containment).select(*keys, F.lit("line").alias("kind"), "block", "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))

    half = window() // 2
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / half) - 2, F.lit(0))), lambda i: (i * half + 1).cast("int"))
    windows = ready.where("words is not null").select(*keys, F.posexplode(F.transform(starts, lambda i: F.slice("words", i, 2 * half))).alias("block", "words"))
    windows = windows.withColumn("tokens", F.array_intersect("words", known)).where(F.size("tokens") >= least)
    windows = joined(windows, rank, containment).withColumn("own", F.element_at(kinds(containment), F.col("template") + 1))
    runs = F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("own.length") + 1, F.lit(1)))
    best = F.array_max(F.transform(runs, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("own.length")), F.col("own.own")))))
    windows = windows.withColumn("best", best).where(F.col("best") >= F.col("own.need"))
    return lines.union(windows.select(*keys, F.lit("window").alias("kind"), "block", "template", "label", (F.col("best") / F.col("size")).alias("containment")))


def phrase_columns(text: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base (labels) of spaced text."""
    total = word_count(text)
    n, first, last, flags = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        pieces = F.split(text, f"(?<![^ ]){phrase}(?![^ ])", -1)
        found = F.when(text.contains(phrase), F.size(pieces) - 1).otherwise(0)
        n = n + found
        first.append(F.when(found > 0, word_count(F.trim(pieces[0]))))
        last.append(F.when(found > 0, total - word_count(F.trim(F.element_at(pieces, -1))) - len(phrase.split(" "))))
        flags.append(F.when(found > 0, F.lit(label)))
    return {"n_words": total, "n_base": n, "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_compact(F.array(*flags))}


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment, 1 for a phrase, else 0)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    keys = ["doc_id", "text_key"]
    ready = prepared(rows, keys)
    found = matches(ready, keys).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = ready.drop("held", "lines", "words").join(found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"}), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_sql() -> str:
    """DuckDB SQL for the rows of scan()."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    words = lambda text: f"string_split(trim(regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{GAP}', ' ', 'g'), ' '), ' ')"
    places = " union all ".join(f"select k, i - 1 as pos, '{label}' as label from (select k, w, unnest(range(1, len(w) + 1)) as i from d) where " + " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split(" "))) for p, label in PHRASES.items())
    values = ", ".join(f"('{label}', {all_words(t)}, {needed(template_words(t), CONTAINMENT)}, {quoted(template_words(t))})" for label, t in TEMPLATES)
    return f"""
with d as (select row_number() over () as k, doc_id, case when w = [''] then [] else w end as w, text from (select doc_id, text, {words('text')} as w from documents)),
p as ({places}),
t(label, n, need, w) as (values {values}),
b as (select k, list_distinct({words('line')}) as w from (select k, unnest(string_split(coalesce(text, ''), chr(10))) as line from d)),
m as (select k, label, len(list_intersect(b.w, t.w)) / len(t.w)::double as c from b, t where len(list_intersect(b.w, t.w)) >= need
  union all select k, label, max(len(list_intersect(words[i:i + n - 1], w))) / max(len(w))::double as c
  from (select k, label, n, need, t.w as w, d.w as words, unnest(range(1, greatest(len(d.w) - n + 1, 1) + 1)) as i from d, t where len(list_intersect(d.w, t.w)) >= need) group by k, label, n, w having max(len(list_intersect(words[i:i + n - 1], w))) >= any_value(need)),
base as (select k, count(*) as n, min(pos) as f, max(pos) as l, string_agg(distinct label, ',' order by label) as labels from p group by k),
every as (select k, string_agg(distinct label, ',' order by label) as labels, max(c) as c from (select k, label, 1.0::double as c from p union all select k, label, c from m) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word, coalesce(base.labels, '') as base_labels,
  coalesce(every.labels, '') as labels, coalesce(every.c, 0.0)::double as score
from d left join base using (k) left join every using (k)"""
