"""Benchmark decontamination with a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.llm.shared import UPPER, checked, pin

#: ASCII characters that end a word; capitals are lower-cased first.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Rarest terms of a window whose lists are intersected.
RAREST = 2
#: Rows of one 8-byte key that may be broadcast.
SMALL_KEYS = 500_000


def words(text: str = "text") -> Column:
    """The lower-cased words of a text: runs of ASCII letters and digits and of other characters than ASCII."""
    plain = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _hashes(text: str, key: str) -> list[Column]:
    own = [F.col(f"`{c}`").cast("string") for c in (key, text)]
    return [F.xxhash64(*own).alias("_doc"), F.xxhash64(F.lit(1), *own).alias("_more")]


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Documents with their words and two hashes of id and text. The index holds the first; results go by both."""
    return docs.select("*", *_hashes(text, key), words(text).alias("_words"))


def phrases(items: DataFrame, docs: DataFrame, window: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """The windows of test items with their rarest terms: _item, item, words, start, length, anchors [(at, term)].

    A term's rarity is its count over all training documents. A window with a term that no document has is left out.
    """
    rows = items.select(F.col(f"`{item}`").cast("string").alias("item"), words(text).alias("words"))
    rows = pin(rows.filter(F.size("words") > 0).distinct().withColumn("_item", F.monotonically_increasing_id()))
    terms = rows.select("_item", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    wanted = checked(pin(terms.select("term").distinct()))
    counts = docs.select(F.explode(words(text)).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("seen"))
    terms = terms.join(checked(pin(counts)), "term")
    span = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - span + 1), F.least(F.col("at"), F.col("n") - span))
    spread = terms.withColumn("start", F.explode(starts))
    grouped = spread.groupBy("_item", "start").agg(
        F.array_sort(F.collect_list(F.struct("seen", "at", "term"))).alias("_terms"), F.first(span).alias("length")
    )
    grouped = grouped.filter(F.size("_terms") == F.col("length"))
    anchors = F.transform(F.slice("_terms", 1, RAREST), lambda x: F.struct(x["at"].alias("at"), x["term"].alias("term")))
    return pin(grouped.select("_item", "start", "length", anchors.alias("anchors")).join(rows, "_item"))


def index(docs: DataFrame, wanted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store the positional index of training documents for the terms ``wanted``: (term, _doc, pos), in that order.

    Lists lie side by side by term; a term with very many postings is split over files by document.
    """
    postings = _keyed(docs, text, key).select("_doc", F.posexplode("_words").alias("pos", "term"))
    order = [F.col(c) for c in ("term", "_doc", "pos")]
    few = postings.join(checked(wanted), "term", "left_semi").select(*order)
    return pin(few.repartitionByRange(*order).sortWithinPartitions(*order))


def aligned(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """Intersect lists after taking each term's place in its item off: (_doc, _item, shift, terms).

    Postings of an item's anchors that agree on _doc and on position minus place lie on one line; ``terms`` are the
    places of the item found on it. Only lines that hold all anchors of some window stay.
    """
    anchors = windows.select("_item", F.explode("anchors").alias("a")).select("_item", "a.*").distinct()
    hits = postings.join(checked(pin(anchors)), "term")
    lines = hits.groupBy("_doc", "_item", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("terms"))
    needed = windows.groupBy("_item").agg(F.collect_set(F.col("anchors.at")).alias("_needed"))
    lines = lines.join(checked(pin(needed)), "_item")
    whole = F.exists("_needed", lambda w: F.forall(w, lambda at: F.array_contains("terms", at)))
    return lines.filter(whole).select("_doc", "_item", "shift", "terms")


def near(postings: DataFrame, windows: DataFrame, slop: int = 20) -> DataFrame:
    """Proximity matches: the two rarest terms of a window at most ``slop`` words apart, in any order.

    Returns _doc, item, start (of the window in the item), from and to (word positions in the document), one row per
    neighbouring pair of postings.
    """
    terms = windows.filter(F.size("anchors") == 2).select("_item", "item", "start", F.posexplode("anchors").alias("which", "a"))
    hits = postings.join(checked(pin(terms.select("_item", "item", "start", "which", "a.term"))), "term")
    line = Window.partitionBy("_doc", "_item", "start").orderBy("pos", "which")
    hits = hits.withColumn("from", F.lag("pos").over(line)).withColumn("_before", F.lag("which").over(line))
    pairs = hits.filter((F.col("_before") != F.col("which")) & (F.col("pos") - F.col("from") <= slop))
    return pairs.select("_doc", "item", "start", "from", F.col("pos").alias("to"))


def find(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The documents with a match, by their two hashes: _doc, _more, ``matches``, ``n_hit``, ``items``."""
    windows = phrases(items, docs, window, text, item)
    wanted = pin(windows.select(F.explode("anchors.term").alias("term")).distinct())
    lines = pin(aligned(index(docs, wanted, text, key), windows).select("_doc", "_item", "shift"))
    spans = windows.groupBy("_item").agg(
        F.first("item").alias("item"), F.first("words").alias("words"), F.first("length").alias("length")
    )
    lines_of = lines.join(checked(pin(spans)), "_item")
    keys = pin(lines.select("_doc").distinct())
    few = keys.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS
    texts = docs.select(*_hashes(text, key), F.col(f"`{text}`").alias("_text"))
    texts = texts.join(F.broadcast(keys) if few else keys, "_doc", "left_semi").dropDuplicates(["_doc", "_more"])
    texts = texts.select("_doc", "_more", words("_text").alias("_words"))
    equal = F.transform("words", lambda w, i: F.coalesce(F.get("_words", F.col("shift") + i) == w, F.lit(False)))
    pairs = texts.join(lines_of, "_doc").withColumn("_equal", equal)
    places = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    whole = F.filter(places, lambda s: F.forall(F.slice("_equal", s + 1, F.col("length")), lambda ok: ok))
    pairs = pairs.select("_doc", "_more", "item", "length", F.transform(whole, lambda s: s + F.col("shift")).alias("_at"))
    pairs = pairs.filter(F.size("_at") > 0)
    heads = F.filter("_at", lambda s: ~F.array_contains("_at", s - 1))
    tails = F.filter("_at", lambda s: ~F.array_contains("_at", s + 1))
    match = F.zip_with(
        heads, tails, lambda a, b: F.struct(F.col("item"), a.alias("from"), (b + F.col("length")).alias("to"))
    )
    hit = F.array_distinct(F.flatten(F.transform("_at", lambda s: F.sequence(s, s + F.col("length") - 1))))
    pairs = pairs.select("_doc", "_more", "item", match.alias("_match"), hit.alias("_hit"))
    return pairs.groupBy("_doc", "_more").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_match")))).alias("matches"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Find test items in training documents: the columns ``keep``, ``n_words``, ``matches``, ``n_hit``, ``items``.

    A match is a whole window of an item, ``window`` consecutive words or the whole of a shorter item, in a document's
    words: ``matches`` lists (item, from, to) in word positions, ``to`` excluded, one per stretch of windows, ``n_hit``
    counts the words inside any, ``items`` lists the items found, sorted as strings.

    The rarest terms of the windows choose the lists to read; their intersection gives exact places to compare, so a
    match is never missed and never false. Null texts have no words, items without words have no window, null item ids
    match but have no name in ``items``, repeated rows each get their result, equal items count once, empty tables give
    documents without matches. Columns named like the results are replaced.
    """
    results = ("n_words", "matches", "n_hit", "items")
    found = find(docs, items, window, text, key, item)
    own = [c for c in (keep or docs.columns) if c not in results]
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_kept"), F.col(f"`{key}`"), F.col(f"`{text}`")), text, key)
    rows = rows.select("_kept", "_doc", "_more", F.size("_words").cast("long").alias("n_words"))
    none = F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit")
    return rows.join(found, ["_doc", "_more"], "left").select(
        "_kept.*", "n_words", F.coalesce("matches", F.array()).alias("matches"), none, F.coalesce("items", F.array()).alias("items")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The documents without a match, as they are; see :func:`contaminated`."""
    bad = pin(find(docs, items, window, text, key, item).select("_doc", "_more"))
    rows = docs.select("*", *_hashes(text, key))
    return rows.join(checked(bad, SMALL_KEYS), ["_doc", "_more"], "left_anti").drop("_doc", "_more")
