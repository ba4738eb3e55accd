"""Quality rules with suffix-array repetition.

The words of a block of texts become one integer string in which no word of one text equals
a word of another.  Positions whose five-word window occurs once in its text cannot begin a
repeat of five words; the others are sorted as suffixes by prefix doubling, and the common
prefixes of neighbours in that order are found from the ranks of the doublings.  The LCP
intervals of at least five words are the maximal repeats; the longest one that begins at a
word covers that word and those behind it, and the union of these spans is what repeats.

``n_repeat_words`` is the size of that union.  The verdict rejects a text whose repeats of at
least ``MIN_REPEAT`` words cover more than ``MAX_COVERED`` of its word characters or whose
longest repeat is more than ``MAX_LONGEST`` of its words (and ``LONG_WORDS`` words at least).

Defined results: a null, empty or wordless text has zero counts and fails the base rule;
repeated rows are judged each by itself; an empty table gives an empty result; other columns
are ignored; a very long text is a block of its own and takes some 150 bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import blocks, documents, id_and_text, ship_code

WINDOW = 5
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, LONG_WORDS = 8, 0.2, 0.3, 20
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long, covered_chars long"
)


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(lines) - len(set(lines))


def longest_repeats(codes, ends, window: int = WINDOW):
    """For every position the longest repeat (in symbols, at least ``window``, else 0) that begins there.

    ``codes``: non-negative integers; ``ends``: for every position the end of its text.  Codes
    of different texts must differ.  Repeats never leave their text."""
    import numpy as np

    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n <= window:
        return out
    # Exact classes of five-symbol windows, built from pairs of classes.
    _, one = np.unique(codes, return_inverse=True)
    classes, width = one.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - step] = classes[step:]
        _, classes = np.unique(classes * (n + 1) + nxt + 1, return_inverse=True)
        classes, width = classes.astype(np.int64), width + step
    whole = np.arange(n) + window <= ends
    counts = np.bincount(classes[whole], minlength=n + 1)
    candidates = np.nonzero(whole & (counts[classes] > 1))[0]
    if not len(candidates):
        return out
    # Suffixes of the string of window classes; a position that is no candidate is unlike any other.  A level holds
    # the ranks of candidates and -1 for all others, four bytes a word.
    def level_of(ranks):
        out = np.full(n + 1, -1, dtype=np.int32)
        out[candidates] = ranks
        return out

    fresh = np.unique(classes[candidates], return_inverse=True)[1]
    levels, step = [level_of(fresh)], 1
    while True:
        rank, ahead = levels[-1], np.minimum(candidates + step, n)
        behind = np.where(rank[ahead] >= 0, rank[ahead], n + candidates)
        _, fresh = np.unique(fresh.astype(np.int64) * (2 * n + 2) + behind, return_inverse=True)
        if fresh.max() + 1 == len(candidates) or 2 * step > n:
            break
        levels.append(level_of(fresh))
        step *= 2
    order = candidates[np.argsort(fresh, kind="stable")]
    left, right = order[:-1], order[1:]
    common = np.zeros(len(left), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = levels[level][np.minimum(left + common, n)], levels[level][np.minimum(right + common, n)]
        common += np.where((a == b) & (a >= 0), 1 << level, 0)
    common = np.where(common > 0, common + window - 1, 0)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def covered(begins, lengths, n: int):
    """Boolean array of the positions under any span ``[begin, begin + length)``."""
    import numpy as np

    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def judge_block(texts: list[str]) -> list[tuple]:
    import numpy as np
    import pyarrow as pa

    split = [WORDS.findall(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flat = [w for words in split for w in words]
    chars = np.fromiter(map(len, flat), dtype=np.int64, count=total)
    if total:
        codes = pa.array(flat, pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
        codes += np.repeat(np.arange(len(texts)), sizes) * (int(codes.max()) + 1)
        longest = longest_repeats(codes, np.repeat(ends, sizes))
    else:
        longest = np.zeros(0, dtype=np.int64)
    at = np.nonzero(longest)[0]
    repeated = covered(at, longest[at], total) if total else np.zeros(0, dtype=bool)
    at = np.nonzero(longest >= MIN_REPEAT)[0]
    long_covered = covered(at, longest[at], total) if total else repeated
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (chars, repeated, np.where(long_covered, chars, 0))]
    word_chars, n_repeat, covered_chars = (s[ends] - s[starts] for s in sums)
    rows = []
    for i, text in enumerate(texts):
        n = int(sizes[i])
        top = int(longest[starts[i] : ends[i]].max()) if n else 0
        failed = n < 10 or 100 * int(n_repeat[i]) > 20 * n
        bad = covered_chars[i] > MAX_COVERED * word_chars[i] or (top >= LONG_WORDS and top > MAX_LONGEST * n)
        rows.append((n, int(word_chars[i]), len(SYMBOLS.findall(text)), duplicate_lines(text), int(n_repeat[i]), failed, not failed and not bad, top, int(covered_chars[i])))
    return rows


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, with the counts, both verdicts, the longest repeat and the covered characters."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for ids, texts in blocks(batches, 1_000_000):
            columns = [ids, *zip(*judge_block(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("longest_repeat")


#: The same by counting windows: spans of repeats of at least n words are those of the windows of n words found twice,
#: and the longest repeat exceeds a bound if a window one word longer than the bound is found twice.
OP8_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sized AS (
    SELECT *, greatest({LONG_WORDS}, floor({MAX_LONGEST}::DOUBLE * len(w))::BIGINT + 1) AS n_long FROM d
), windows AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM sized, unnest([{WINDOW}, {MIN_REPEAT}, n_long]) AS s(n), unnest(range(1, len(w) - n + 2)) AS r(i)
), twice AS (
    SELECT DISTINCT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, win) AS k FROM windows) WHERE k > 1
), covered AS (
    SELECT DISTINCT doc_id, n, i + j AS i FROM twice, unnest(range(0, n)) AS u(j) WHERE n IN ({WINDOW}, {MIN_REPEAT})
), counts AS (
    SELECT doc_id, count(*) FILTER (WHERE n = {WINDOW}) AS n_repeat_words, sum(length(w[i])) FILTER (WHERE n = {MIN_REPEAT}) AS covered_chars
    FROM covered JOIN d USING (doc_id) GROUP BY doc_id
), long AS (
    SELECT DISTINCT doc_id FROM twice JOIN sized USING (doc_id) WHERE n = n_long
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(covered_chars, 0)::BIGINT AS covered_chars, long.doc_id IS NOT NULL AS long
    FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN long USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (covered_chars > {MAX_COVERED}::DOUBLE * word_chars OR long) AS kept, covered_chars
FROM base
"""
