"""Benchmark decontamination by a positional inverted index of the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a window is ten
consecutive words of an item (all its words if it has fewer).  The search goes from the rarest
term of every window:

1. the corpus is cut into words once: the postings (word, document, position) of the items'
   words are stored, and every later step reads them;
2. counts of the words, reduced before the shuffle; a window with a word the corpus lacks
   cannot occur;
3. the postings of each window's ``LISTS`` rarest words, moved by their offsets in the item, are
   intersected: an alignment of item and document stays if some window has them all;
4. every alignment left compares the windows of the item with the document's words at their
   places, which stands for the lists of all other words.

A posting list is never gathered in one place: postings stay rows up to the document they
belong to.  Only the texts of documents with an alignment are shuffled.  The items' words, the
rarest words and the ids of those documents are broadcast only after a count shows that they are
few (``BROADCAST_TERMS``, ``BROADCAST_IDS``); beyond that the same plan runs as shuffled joins,
and all postings are stored.  Items are cut into segments of at most ``SEGMENT`` windows, in which
no window of the item is missing and none that equals an earlier one is looked for again: so an
alignment compares a bounded number of words, and an item (or a text) of one repeated word has as
many alignments as the text has words.  Only DataFrame functions are used.  Everywhere words are compared
in exact ASCII lower case.

Defined results: a null, empty or wordless text has no words and no hits; a wordless item has
no window; repeated rows, rows that share an id and rows without one are each compared by
their own text (rows are told apart by id and 64 bits of the text); repeated item ids count once; items
without an id hit like others, count as one item and are left out of the joined ids; an empty benchmark hits
nothing; other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import computed, discard, documents, packed, row_key, same_row, stored, stored_at, unpacked

SIZE = 10
LISTS = 2
SEGMENT = 64
#: Rows of at most some 40 bytes each that may be broadcast.
BROADCAST_TERMS, BROADCAST_IDS = 100_000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAPS_OF_BOTH_CASES = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def exact_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAPS, -1), "")


def raw_words(text: Column) -> Column:
    """The words as they stand; :func:`exact_lower` of them are the words."""
    return F.array_remove(F.split(text, GAPS_OF_BOTH_CASES, -1), "")


def exact_lower(word: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that to ASCII, and much faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _few(rows: DataFrame, limit: int) -> bool:
    return rows.limit(limit + 1).count() <= limit


def _items(benchmark: DataFrame, size: int, item_id: str, item_text: str) -> DataFrame:
    """``item, item_id, item_words``: the segments of the items, each with a number of its own; stored, as they are read again and again."""
    text = F.col(f"`{item_text}`")
    whole = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), exact_words(text).alias("words")).where("size(words) > 0").dropDuplicates(["item_id", "words"])
    whole = stored(whole.withColumn("item", F.monotonically_increasing_id()))
    windows = whole.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))).alias("start"))
    firsts = windows.groupBy("item", F.slice("words", F.col("start") + 1, size).alias("window")).agg(F.min("start").alias("start"))
    own = Window.partitionBy("item").orderBy("start")  # of one item
    begins = F.coalesce((F.col("start") - F.lag("start").over(own) > 1).cast("int"), F.lit(1))
    runs = firsts.select("item", "start", begins.alias("begins")).withColumn("run", F.sum("begins").over(own))
    part = F.floor((F.col("start") - F.min("start").over(Window.partitionBy("item", "run"))) / SEGMENT)
    bounds = runs.withColumn("part", part).groupBy("item", "run", "part").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    cut = bounds.join(whole, "item").select("item_id", F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + size).alias("item_words"))
    return stored(cut.withColumn("item", F.monotonically_increasing_id()))


def tokens_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, pos, word`` of every word."""
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(text).alias("key"), text.alias("text"))  # beside the generator the key would be made for every word
    return rows.select("doc_id", "key", F.posexplode(raw_words(F.col("text"))).alias("pos", "word")).withColumn("word", exact_lower(F.col("word")))


def positional_index(df: DataFrame, items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``word, doc_id, key, pos`` of the corpus' words, stored, and the path; only words that items have, where these are few."""
    tokens = tokens_of(df, id_col, text_col)
    terms = items.select(F.explode("item_words").alias("word")).distinct()
    if _few(terms, BROADCAST_TERMS):
        tokens = tokens.join(F.broadcast(terms), "word", "left_semi")
    return stored_at(tokens.select("word", "doc_id", "key", "pos"))


def alignments(index: DataFrame, items: DataFrame, size: int, lists: int = LISTS) -> DataFrame:
    """``doc_id, key, item, delta``: the segment's word i may stand at document word ``delta + i``; the
    ``lists`` rarest words of some window do."""
    counts = index.groupBy("word").count()
    if _few(items.select(F.explode("item_words").alias("word")).distinct(), BROADCAST_TERMS):
        counts = F.broadcast(counts)  # a row for each word of the items; else a common word's places in them meet in one task
    n = F.size("item_words")
    windows = items.select("item", "item_words", F.explode(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).alias("start"))
    words = windows.select("item", "start", F.posexplode(F.slice("item_words", F.col("start") + 1, size)).alias("offset", "word"))
    each = F.struct(F.coalesce("count", F.lit(0)).alias("count"), (F.col("start") + F.col("offset")).alias("place"), "word")
    rarest = words.join(counts, "word", "left").groupBy("item", "start").agg(F.sort_array(F.collect_list(each)).alias("rarest"))  # of a window
    # Stored: they are counted and joined; no more than a few times the items' words.
    chosen = stored(rarest.where("rarest[0].count > 0").select("item", F.slice("rarest", 1, lists).alias("rarest")))
    anchors = chosen.select("item", F.explode("rarest").alias("r")).select("item", "r.place", "r.word").distinct()
    wanted = chosen.groupBy("item").agg(F.collect_set("rarest.place").alias("wanted"))
    if _few(anchors, BROADCAST_TERMS):
        anchors, wanted = F.broadcast(anchors), F.broadcast(wanted)
    moved = index.join(anchors, "word").select("doc_id", "key", "item", (F.col("pos") - F.col("place")).alias("delta"), "place")
    met = moved.groupBy("doc_id", "key", "item", "delta").agg(F.collect_set("place").alias("places"))  # places of one segment
    whole = F.exists("wanted", lambda w: F.size(F.array_except(w, F.col("places"))) == 0)
    return met.join(wanted, "item").where(whole).select("doc_id", "key", "item", "delta")


def matched(df: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``row, doc_id, n_words, matches`` for every input row: all its columns as a struct, its words,
    and an array of (item_id, start, length) with the 0-based word where a window of an item occurs.

    With ``slop`` above 0 these are proximity matches: every word of the window within ``slop``
    words of its place, as counted from the window's rarest word."""
    items = _items(benchmark, size, item_id, item_text)
    index, path = positional_index(df, items, id_col, text_col)
    found = stored(alignments(index, items, size, 1 if slop else LISTS))
    discard(df.sparkSession, path)
    places = found.groupBy("doc_id", "key", "item").agg(F.collect_list("delta").alias("deltas"))  # a segment's words are sent once
    by_doc = places.join(items, "item").groupBy("doc_id", "key").agg(F.collect_list(F.struct("item_id", "deltas", "item_words")).alias("candidates"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = packed(df, id_col, text_col).withColumn("key", row_key(F.col("text")))
    # Only rows that have an alignment go through the shuffle.
    ids = found.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), F.lit(True).alias("_found")).distinct()
    own = same_row(F.col("doc_id"), F.col("_id"), F.col("key"), F.col("_key"))
    if _few(ids, BROADCAST_IDS):
        marked = rows.join(F.broadcast(ids), same_row(F.col("doc_id"), F.col("_i"), F.col("key"), F.col("_k")), "left")
        clean, texts = marked.where("_found is null"), marked.where("_found").join(by_doc, own)
        clean = clean.select("row", "doc_id", F.size(raw_words(F.col("text"))).alias("n_words"))
    else:
        clean, texts = None, rows.join(by_doc, own, "left")
    texts = computed(texts, words=exact_words(F.col("text"))).select("row", "doc_id", "words", "candidates")

    # Inside a lambda only get() takes constant time; slice() would copy all words each time.
    def stands(place: Column, word: Column) -> Column:
        if not slop:
            return F.coalesce(F.get("words", place) == word, F.lit(False))
        return F.exists(F.sequence(place - slop, place + slop), lambda p: F.coalesce(F.get("words", p) == word, F.lit(False)))

    def occurrences(c: Column) -> Column:
        m = F.size(c["item_words"])
        length = F.least(m, F.lit(size))

        def at(delta: Column) -> Column:
            # Words that do not stand at their places; a window occurs between two of them that are far enough apart.
            gaps = F.filter(F.sequence(F.lit(0), m - 1), lambda i: ~stands(delta + i, F.get(c["item_words"], i)))
            bounds = F.concat(F.array(F.lit(-1)), gaps, F.array(m))
            runs = F.filter(F.zip_with(bounds, F.slice(bounds, 2, F.size(bounds)), lambda a, b: F.struct((a + 1).alias("first"), b.alias("end"))), lambda r: r["end"] - r["first"] >= length)
            starts = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["end"] - length)))
            return F.transform(starts, lambda i: F.struct(c["item_id"].alias("item_id"), (delta + i).alias("start"), length.alias("length")))

        return F.flatten(F.transform(c["deltas"], at))

    every = F.array_distinct(F.flatten(F.transform("candidates", occurrences)))
    texts = computed(texts, matches=F.when(F.col("candidates").isNotNull(), every)).select("row", "doc_id", F.size("words").alias("n_words"), "matches")
    both = texts if clean is None else texts.unionByName(clean.withColumn("matches", F.lit(None).cast(texts.schema["matches"].dataType)))
    return both.select("row", "doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), "matches")


def phrase_matches(df: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = 0, **columns: str) -> DataFrame:
    """``doc_id, matches`` of the rows that have any; see :func:`matched`."""
    return matched(df, benchmark, size, slop, **columns).where("size(matches) > 0").select("doc_id", "matches")


def contamination(df: DataFrame, benchmark: DataFrame, size: int = SIZE, **columns: str) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (item ids as sorted strings) for every input row."""
    covered = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1)))))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return matched(df, benchmark, size, **columns).select(
        "doc_id", "n_words", F.greatest(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items, F.array().cast("array<string>")).alias("items")
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``df`` without any occurrence of a window; all columns stay."""
    return unpacked(matched(df, benchmark, **columns).where("matches is null or size(matches) = 0"), df.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM wins), spots AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)
), hits AS (
    SELECT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN wins x ON x.n = s.n AND x.win = s.win
), covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) AS u(j) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
