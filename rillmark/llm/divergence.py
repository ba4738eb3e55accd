"""Source divergence audit: how far the words of each source lie from those of its language.

1. Every task counts the terms of what it reads by language and source, with the documents that
   hold them, and gives them out whenever ``HELD`` of them are held: (lang, term, source, document,
   df, count), ``document`` being the least id counted.  These rows are stored, as they are read
   twice (once for the borders of ranges).
2. They are dealt by ranges of (lang, term, source, document) and sorted, so a term that a third of
   all documents hold is split over tasks, and one scan adds up the runs of equal (lang, term,
   source).  Runs cut by a border meet again in one sum.
3. Terms that enough documents of their language hold are kept and stored; sums, and the number of
   kept terms, give every source its shares, in exact decimals.
4. A second scan over the kept runs, in the order of (lang, term), adds the distances of all pairs
   of sources of a language to one matrix a task and gives out what it has per language: partial
   pairs, which are then added.  A term's over-represented sources are ranked by a window whose
   groups are cut to the ranks wanted before the shuffle.

Held at once: the terms of a task up to ``HELD``, and a matrix of a language's sources (the result
has a row for each of its cells).

Defined results: null text, lang and source read as empty strings, which are values like others;
every row is a document, also rows that share an id or have none, and repeated ones; a text without
a term makes its (lang, source) a group none the less; a language without a kept term has distances
of zero; a language with one source has no pair; texts of any length are read whole; equal values
rank by item in UTF-8 order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import discard, documents, ship_code, stored, stored_at

MIN_DOCUMENTS, TOP, SMOOTHING, ONE = 30, 50, 5, 1_000_000_000
#: Entries that a task counts before it gives them out; cells of a matrix worked on at once.
HELD, CELLS = 500_000, 1 << 20
#: What stands between terms becomes a blank, A-Z lower case; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PARTS = "lang string, term string, source string, document long, df long, count long"
RUNS = "lang string, term string, source string, df long, count long"


def term_counts(df: DataFrame, held: int = HELD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, term, source, document, df, count``: counts of each task's terms, several rows a term."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        groups: dict[tuple, tuple[Counter, Counter]] = {}
        first, size = None, 0

        def rows() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(5)]
            for (lang, source), (dfs, counts) in groups.items():
                n = len(counts)
                for column, values in zip(columns, ([lang] * n, counts.keys(), [source] * n, dfs.values(), counts.values()), strict=True):
                    column.extend(values)
            lang, term, source, dfs, counts = columns
            text = lambda v: pa.array(v, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [text(lang), text(term), text(source), pa.array([first] * len(term), pa.int64()), pa.array(dfs, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "term", "source", "document", "df", "count"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts, langs, sources = (batch.column(k).cast(pa.binary()).to_pylist() for k in (1, 2, 3))
            for key, text, lang, source in zip(ids, texts, langs, sources, strict=True):
                words = (text or b"").translate(FOLD).split()
                if not words:
                    continue
                dfs, counts = groups.setdefault((lang or b"", source or b""), (Counter(), Counter()))
                before, own = len(counts), Counter(words)
                counts.update(own)
                dfs.update(own.keys())  # both get new terms in one order
                first = key if first is None else first if key is None else min(first, key)
                size += len(counts) - before
                if size >= held:
                    yield rows()
                    groups, first, size = {}, None, 0
        if groups:
            yield rows()

    return df.select(*[F.col(f"`{c}`") for c in (id_col, text_col, lang_col, source_col)]).mapInArrow(run, PARTS)


def _run_lengths(batches: Iterator) -> Iterator:
    """Sums of the runs of equal (lang, term, source) in sorted rows; a run may go on over batches."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names, open_run = ["lang", "term", "source", "df", "count"], None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        if not len(table):
            continue
        if open_run is not None:
            table = pa.concat_tables([open_run, table])
        changes = np.zeros(len(table), bool)
        changes[0] = True
        for name in names[:3]:
            column = table.column(name).combine_chunks()
            changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(changes)
        sums = [pa.array(np.add.reduceat(table.column(n).to_numpy(), starts)) for n in names[3:]]
        runs = pa.table([*[table.column(n).take(pa.array(starts)) for n in names[:3]], *sums], names=names)
        open_run = runs.slice(len(runs) - 1)
        yield from runs.slice(0, len(runs) - 1).combine_chunks().to_batches()
    if open_run is not None:
        yield from open_run.combine_chunks().to_batches()


def kept_terms(parts: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang, term, source, count, total, leads``: terms that at least ``least`` documents of the language hold; ``total``
    is the count in the language, ``leads`` marks one row of each term."""
    keys = ["lang", "term", "source", "document"]
    runs = parts.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_run_lengths, RUNS)
    whole = runs.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("count").alias("count"))
    term = Window.partitionBy("lang", "term")  # at most one row a source
    placed = whole.withColumns({"held": F.sum("df").over(term), "total": F.sum("count").over(term), "lead": F.min("source").over(term)})
    return placed.where(F.col("held") >= least).select("lang", "term", "source", "count", "total", (F.col("source") == F.col("lead")).cast("long").alias("leads"))


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(ONE * (count + SMOOTHING) / (n + SMOOTHING * v)), exact for any counts; null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = wide(F.lit(ONE)) * wide(count + SMOOTHING)
    return F.when(v > 0, F.lit(1) + F.call_function("div", top, wide(n + SMOOTHING * v)))


def _pair_sums(batches: Iterator) -> Iterator:
    """Partial sums of |p - q| over the terms read, for all pairs of sources (by number) of a language; rows come by language."""
    import numpy as np
    import pyarrow as pa

    lang, bases, sums = None, None, None

    def rows() -> pa.RecordBatch:
        a, b = np.triu_indices(len(bases), 1)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + 1, pa.int32()), pa.array(b + 1, pa.int32()), pa.array(sums[a, b], pa.int64())], names=["lang", "a", "b", "value"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        at = 0
        while at < len(langs):
            if langs[at] != lang:
                if bases is not None:
                    yield rows()
                lang, bases = langs[at], np.array(batch.column(1)[at].as_py(), np.int64)
                sums = np.zeros((len(bases), len(bases)), np.int64)
            end, step = at, max(1, CELLS // len(bases))
            while end < len(langs) and langs[end] == lang and end - at < step:
                end += 1
            lists = batch.column(2).slice(at, end - at)
            places, flat = lists.value_lengths().to_numpy(), lists.flatten()
            shares = np.tile(bases, (end - at, 1))
            shares[np.repeat(np.arange(end - at), places), flat.field(0).to_numpy() - 1] = flat.field(1).to_numpy()
            for k in range(len(bases) - 1):
                sums[k, k + 1 :] += np.abs(shares[:, k + 1 :] - shares[:, k : k + 1]).sum(axis=0)
            at = end
    if bases is not None:
        yield rows()


def divergence(df: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP, held: int = HELD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: for every (lang, source) the distance to each other source of the language
    (``pair``), and the ``top`` terms it has more of than the language (``term``)."""
    parts, path = stored_at(term_counts(df, held, id_col, text_col, lang_col, source_col))
    kept = stored(kept_terms(parts, least))
    discard(df.sparkSession, path)
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    groups = df.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("n_lang"), F.sum("leads").alias("v"))
    zero = F.lit(0).cast("long")
    # One row a group: numbered within its language, with the share of a term that it lacks.
    numbered = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "n_lang", "v"])
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).withColumn("base", _share(zero, F.col("n"), F.col("v")))
    profile = stored(numbered)

    shares = kept.join(profile, ["lang", "source"]).select("lang", "term", "source", "number", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = more.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)

    bases = profile.where("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("number", "base")))["base"].alias("bases"))
    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p")).alias("held")).sortWithinPartitions("lang", "term")
    scanned = by_term.join(bases, "lang").sortWithinPartitions("lang", "term").select("lang", "bases", "held")
    partial = scanned.mapInArrow(_pair_sums, "lang string, a int, b int, value long")
    halves = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = halves.unionByName(halves.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # Every ordered pair of sources of a language is a row of the result, with or without kept terms.
    mine, other = profile.select("lang", F.col("number").alias("a"), "source"), profile.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    pairs = mine.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranks))
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
    SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p
    FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // ((SELECT sum(x.n) FROM c AS x WHERE x.lang = c.lang) + 5 * any_value(v.v)) AS q
    FROM c JOIN v USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM p AS x JOIN p AS y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
