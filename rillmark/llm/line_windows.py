"""Line dedup on overlapping windows of three lines.

Every three consecutive lines of a text (cut at line feeds) are hashed; a hash that occurs
more than once in the table keeps its first occurrence, by (doc_id, line), and every later
occurrence covers its three lines.  Covered lines are merged into spans and removed.  Windows
are judged on the input, not on what is left.  Only DataFrame functions are used.

The table is shuffled as hashes and positions, never as text.  The group of a hash is reduced
to its first and last position before the shuffle; hashes found twice are stored, so that both
sides of their join with the windows come straight from an exchange and a passage that a third
of the rows share is split over tasks.  The positions of one document meet in one task, nothing
more.

Defined results: windows of blank lines only never count; texts of fewer than three lines
stay as they are; a null text stays null; rows are told apart by id and 64 bits of the text
(XXH64, seed 42), so rows that share an id or have none are documents of their own, ordered by
those bits within an id; repeated rows (same id and text) are one document
to the search, so none is the later one of the other; null ids sort first; an empty table
gives an empty result; other columns are passed through by :func:`dedup_lines` and ignored
by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import computed, documents, packed, row_key, same_row, stored, unpacked

SIZE = 3
NOT_BLANK = "[^\\x09-\\x0D\\x20]"


def later_spans(df: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, spans``: sorted disjoint ranges of 0-based line numbers to remove, for documents that have any."""
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lines = computed(texts.withColumn("key", row_key(F.col("text"))), lines=F.split("text", "\n", -1)).drop("text")
    windows = (
        lines.where(F.size("lines") >= size)
        .select(
            "doc_id",
            "key",
            # get() takes constant time inside a lambda; slice() would copy all lines each time
            F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: F.concat_ws("\n", *[F.get("lines", i + k) for k in range(size)]))).alias("line", "window"),
        )
        .where(F.col("window").rlike(NOT_BLANK))
        .select("doc_id", "key", "line", F.unhex(F.md5("window")).alias("hash"))
    )
    place = F.struct("doc_id", "key", "line")
    firsts = stored(windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    later = windows.join(firsts, "hash").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "line").distinct()
    own = Window.partitionBy("doc_id", "key").orderBy("line")
    begins = F.coalesce((F.col("line") - F.lag("line").over(own) > size).cast("int"), F.lit(1))
    merged = later.withColumn("begins", begins).withColumn("span", F.sum("begins").over(own))
    spans = merged.groupBy("doc_id", "key", "span").agg(F.min("line").alias("first"), (F.max("line") + (size - 1)).alias("last"))
    return spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def cut_lines(df: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all input columns), ``doc_id, text`` (cut), ``n_lines, n_removed, n_spans`` for every input row."""
    spans = later_spans(df, size, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    joined = packed(df, id_col, text_col).join(spans, same_row(F.col("doc_id"), F.col("_id"), row_key(F.col("text")), F.col("_key")), "left")
    lines, n = F.split("text", "\n", -1), F.size("spans")

    def marks(i):
        before = F.when(i == 0, 0).otherwise(F.get(F.col("spans.last"), i - 1) + 1)
        first, last = F.get(F.col("spans.first"), i), F.get(F.col("spans.last"), i)
        return F.concat(F.array_repeat(F.lit(False), first - before), F.array_repeat(F.lit(True), last - first + 1))

    joined = computed(joined, covered=F.when(F.col("spans").isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), n - 1), marks))))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("covered", i), F.lit(False))), "\n")
    gone = F.aggregate("spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.greatest(n, F.lit(0)).cast("long").alias("n_spans"),
    )


def dedup_lines(df: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with its texts cut; all other columns stay."""
    return unpacked(cut_lines(df, size, id_col, text_col), df.columns, **{text_col: "text"})


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS line, l[i] AS content, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS win
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)
), windows AS (
    SELECT doc_id, line, win FROM lines WHERE win IS NOT NULL AND regexp_matches(win, '[^\x09-\x0D\x20]')
), later AS (
    SELECT DISTINCT doc_id, line FROM (
        SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS k FROM windows) WHERE k > 1
), covered AS (
    SELECT DISTINCT doc_id, line + j AS line FROM later, unnest([0, 1, 2]) AS u(j)
), starts AS (
    SELECT c.doc_id, count(*) AS n_spans FROM covered c ANTI JOIN covered p ON p.doc_id = c.doc_id AND p.line = c.line - 1 GROUP BY c.doc_id
), kept AS (
    SELECT l.doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
           coalesce(string_agg(l.content, chr(10) ORDER BY l.line) FILTER (WHERE c.line IS NULL), '') AS text
    FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       coalesce(s.n_spans, 0) AS n_spans, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN starts s USING (doc_id)
"""
