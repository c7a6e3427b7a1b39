"""Benchmark decontamination: a positional inverted index of the documents, searched for the phrases of benchmark items. DataFrame functions only.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. The index holds a posting (term, document, position) for every document word that some
item has, and one with the term END at each document's end, whose position is its number of words. An item's windows are its runs of `window` consecutive words; an
item of fewer words, but not none, is one window.

Search: each window's rarest two terms (by postings, over all documents) are its anchors. Postings of anchor terms, less the anchor's place in the item,
give the diagonals (document, item, shift) on which a window can lie; those with both anchors of a window go on. On these the lists of the windows' other terms are intersected,
offset-adjusted, by one equi-join with the postings; consecutive places that all meet, `window` or more, are an exact match. So work follows the rarest terms'
postings, and a frequent word costs only where rarer ones already met. `near_matches` finds windows whose words stand within a span, in any order.

A document is its id and the hash of its text; equal rows give equal rows. Null and empty texts have no words and are not hit; documents with a null id are rows
like any other. Items without words are never found; items with a null id mark words but count as no item. Equal items are searched once. Only doc_id, text and item_id are
read, so extra columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

WINDOW = 10
#: Anchors of a window: the rarest of its terms.
ANCHORS = 2
#: The term of the posting at a document's end.
END = -1
#: Bytes of items, terms or anchors up to which they are sent to every task; beyond, they are joined by shuffle.
BROADCAST = 32 << 20
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters beyond ASCII that lower() may change; texts without them take it, as it is much faster than translate().
CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
DOC = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    """The words of a text, in order."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.rlike(CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, GAP), "")


def small(df: DataFrame, row_bytes: int, rows: int) -> DataFrame:
    """df to be broadcast if its `rows` rows of about `row_bytes` bytes are within BROADCAST; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST else df


class Items:
    """Benchmark items in stored tables: `texts` (item, item_ids, length), `places` (item, at, term), `terms` (term, word)."""

    def __init__(self, benchmark: DataFrame):
        split = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
        own = split.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.monotonically_increasing_id().alias("item"), "item_ids", "words")
        own = stored(own, "items")
        self.terms = stored(own.select(F.explode("words").alias("word")).distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "item_terms")
        self.texts = own.select("item", "item_ids", F.size("words").alias("length"))
        at = own.select("item", F.posexplode("words").alias("at", "word"))
        self.places = stored(at.join(self.terms, "word").select("item", "at", "term"), "item_places")
        self.n_terms, self.n_places, self.bytes = self.terms.count(), self.places.count(), self.terms.agg(F.sum(F.octet_length("word"))).first()[0] or 0


def index(docs: DataFrame, items: Items) -> DataFrame:
    """The stored postings of the items' terms in all documents: term, doc_id, text_key, pos; each part of the documents ordered by term."""
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.array_append(words(F.col("text")), F.lit("")).alias("words"))
    rows = rows.select(*DOC, F.posexplode("words").alias("pos", "word"))  # the key made before, so that texts aren't copied a word
    known = items.terms.union(docs.sparkSession.range(1).select(F.lit(END).cast("long"), F.lit("")))
    known = small(known, 64 + items.bytes // max(1, items.n_terms), items.n_terms)
    return stored(rows.join(known, "word").select("term", *DOC, "pos").sortWithinPartitions("term"), "postings")


def anchors(postings: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """A row for each window that can occur: item, start, length, rare (the places in the item of its rarest terms, rarest first). Windows with a term that no document has are left out."""
    count = postings.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    place = items.places.join(items.texts.select("item", "length"), "item").join(count, "term", "left").fillna(0, ["n"])
    wide = F.least(F.col("length"), F.lit(window))
    first, last = F.greatest(F.lit(0), F.col("at") - wide + 1), F.least(F.col("at"), F.col("length") - wide)
    each = place.select("item", "at", "n", wide.alias("wide"), F.explode(F.sequence(first, last)).alias("start"))  # a place is in `window` windows at most
    ranked = each.groupBy("item", "start", "wide").agg(F.array_sort(F.collect_list(F.struct("n", "at"))).alias("by"))
    return ranked.where(F.col("by")[0]["n"] > 0).select("item", "start", F.col("wide").alias("length"), F.transform(F.slice("by", 1, ANCHORS), lambda x: x["at"]).alias("rare"))


def joined_places(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_key, item, shift, at of the wanted places at which a posting stands."""
    left = postings.select("term", "pos", *(F.col(c).alias(f"{c}_") for c in DOC))
    return left.join(wanted, ["term", "pos"]).where(F.col("doc_id_").eqNullSafe(F.col("doc_id")) & (F.col("text_key_") == F.col("text_key"))).select(*DOC, "item", "shift", "at").distinct()


def phrase_matches(postings: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """Exact matches: doc_id, text_key, item, start (in the document), at (in the item), length: maximal runs of equal words of at least one window."""
    able = stored(anchors(postings, items, window), "anchors")
    n = able.count()
    rare = items.places.join(able.select("item", F.explode("rare").alias("at")).distinct(), ["item", "at"])
    hits = postings.join(small(rare, 48, n * ANCHORS), "term").select(*DOC, "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    # the anchors met, as a bitmap of their places modulo 63: it may pass a diagonal too many, never one too few
    lines = hits.groupBy(*DOC, "item", "shift").agg(F.bit_or(F.expr("shiftleft(1L, at % 63)")).alias("met"))
    able = able.withColumn("bits", F.aggregate("rare", F.lit(0).cast("long"), lambda m, at: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at % 63))))
    lines = lines.join(small(able, 96, n), "item").where(F.col("met").bitwiseAND(F.col("bits")) == F.col("bits"))
    lines = lines.where(F.col("shift") + F.col("start") >= 0)
    places = stored(lines.select(*DOC, "item", "shift", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct(), "diagonals")
    wanted = places.join(small(items.places, 40, items.n_places), ["item", "at"]).select(*DOC, "item", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    n = places.count()
    read = postings
    if n * 80 > BROADCAST:  # then postings go through a shuffle: those of documents without a diagonal needn't
        held = places.select(*DOC).distinct()
        read = postings.join(small(held, 40, held.count()), [postings[c].eqNullSafe(held[c]) for c in DOC], "left_semi")
    met = joined_places(read, small(wanted, 80, n))
    by = Window.partitionBy(*DOC, "item", "shift")  # an item's places at most
    runs = met.withColumn("run", F.col("at") - F.row_number().over(by.orderBy("at"))).groupBy(*DOC, "item", "shift", "run").agg(F.min("at").alias("at"), F.count("*").alias("length"))
    runs = runs.join(small(items.texts.select("item", F.least("length", F.lit(window)).alias("least")), 40, items.n_places), "item").where("length >= least")
    return runs.select(*DOC, "item", (F.col("shift") + F.col("at")).alias("start"), "at", "length")


def near_matches(postings: DataFrame, items: Items, span: int, window: int = WINDOW) -> DataFrame:
    """Proximity matches: doc_id, text_key, item, at (the window's place in the item), start, end: stretches of at most `span` document words that hold every distinct word of a window, in any order; the
    first of each place of its rarest term. Terms join from the rarest on, and each join keeps the places that still have them all nearby."""
    able = stored(anchors(postings, items, window), "anchors")
    count = postings.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    own = able.select("item", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).join(items.places, ["item", "at"]).select("item", "start", "term").distinct().join(count, "term")
    terms = own.groupBy("item", F.col("start").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))
    first = postings.join(terms.withColumn("term", F.col("terms")[0]), "term")
    found = first.select(*DOC, "item", "at", "terms", F.col("pos").alias("place"), F.array(F.struct(F.lit(0).alias("k"), "pos")).alias("hits"))
    most = terms.agg(F.max(F.size("terms"))).first()[0] or 0
    block = postings.withColumn("block", F.floor(F.col("pos") / span))
    for k in range(1, most):
        done, rest = found.where(F.size("terms") <= k), found.where(F.size("terms") > k)
        rest = rest.withColumn("term", F.col("terms")[k]).withColumn("block", F.explode(F.array(*[F.floor(F.col("place") / span) + d for d in (-1, 0, 1)])))
        rest = rest.join(block.withColumnsRenamed({"doc_id": "other_id"}), (F.col("doc_id").eqNullSafe(F.col("other_id"))) & (rest.text_key == block.text_key) & (rest.term == block.term) & (rest.block == block.block) & (F.abs(F.col("pos") - F.col("place")) < span)).select(*(rest[c] for c in DOC), "item", "at", "terms", "place", "hits", "pos")
        rest = rest.groupBy(*DOC, "item", "at", "terms", "place", "hits").agg(F.collect_set(F.struct(F.lit(k).alias("k"), "pos")).alias("more"))
        found = stored(done.unionByName(rest.withColumn("hits", F.concat("hits", "more")).drop("more")), "near")
    kinds = lambda s: F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: (h["pos"] >= s) & (h["pos"] < s + span)), lambda h: h["k"])))
    starts = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["pos"]), lambda s: (s <= F.col("place")) & (F.col("place") < s + span))))
    found = found.withColumn("start", F.array_min(F.filter(starts, lambda s: kinds(s) == F.size("terms")))).where("start is not null")
    # the stretch's end: the last of the first places, from its start on, of each term
    ends = F.array_max(F.transform(F.sequence(F.lit(0), F.size("terms") - 1), lambda k: F.array_min(F.transform(F.filter("hits", lambda h: (h["k"] == k) & (h["pos"] >= F.col("start"))), lambda h: h["pos"]))))
    return found.select(*DOC, "item", "at", "start", F.greatest(ends, F.col("place")).alias("end"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words in occurrences of windows), n_items, items_sha256 (of the items' ids, sorted as strings), contaminated."""
    items = Items(benchmark)
    postings = index(docs, items)
    found = stored(phrase_matches(postings, items, window), "matches")
    before = F.max(F.col("start") + F.col("length")).over(Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = found.withColumn("new", new).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    names = found.select(*DOC, "item").distinct().join(small(items.texts, 96, items.n_places), "item").select(*DOC, F.explode("item_ids").alias("item_id"))
    names = names.groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    ends = postings.where(F.col("term") == END).select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    for side in (hit, names):
        side = side.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
        ends = ends.join(side, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").drop("hit_id", "hit_key")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return ends.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def scan_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the rows of scan(): every window of every document against those of the items."""
    cut = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x != '')"
    return f"""
with d as (select row_number() over () as k, doc_id, {cut} as w from documents),
b as (select item_id, w, least(len(w), {window}) as n from (select item_id, {cut} as w from benchmark) where len(w) > 0),
v as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from b)),
g as (select k, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from v) where len(w) >= n)),
m as (select k, i, g.n, item_id from g join v on g.s = v.s and g.n = v.n),
h as (select k, count(*) as n_hit from (select distinct k, unnest(range(i, i + n)) as p from m) group by k),
e as (select k, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct k, item_id from m where item_id is not null) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (k) left join e using (k)"""
