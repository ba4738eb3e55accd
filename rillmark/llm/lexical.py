"""Ranked lexical search: WAND per shard of documents, the shards' heaps merged.

1. The terms of the items are dealt into portions of at most ``PORTION_TERMS`` terms or so (by a hash
   of the item), each searched by itself, so what is sent to the tasks does not grow with the items.
2. Every task cuts its documents into shards of ``SHARD_CHARS`` characters and stores, one row a
   shard, its number of documents and terms, and for every item term the documents that hold it and
   how often, in the order of their ids.
3. Shard counts add up to N, L and the documents of every item term, which give weights and lengths.
4. Every task goes through its shards.  For an item it takes the terms of the shard with the largest
   impact that each can have in it, and walks their lists by WAND: the pivot is the first document
   at which the impacts of the lists up to it reach the tenth score so far; lists before it jump
   there, and only a document that all of them stand at is scored.  The heap of an item lives as
   long as the task, so later shards are mostly skipped.
5. The heaps of the tasks, at most ``top`` rows an item each, are merged by two ranked windows, the
   first over a bounded part of the tasks.

Held at once: the lists of one shard, and a heap of ``top`` entries an item.

Defined results: a null or empty text has no terms, and is in no count; rows that share an id, or have
none, are documents of their own (null ids rank before others of their score); an item's terms count
once, those of all rows that share its id taken together (null is an id as well); an item without
terms, or without a document above 0, has no row; very long texts are read whole; an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import discard, documents, ship_code, stored_at

TOP, ONE, BASE, SLOPE = 10, 1_000_000_000, 100, 90
PORTION_TERMS, SHARD_CHARS, MERGE_PARTS = 100_000, 4_000_000, 64
#: What stands between terms becomes a blank, A-Z lower case; digits and bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, places array<int>, times array<int>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def item_terms(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, term``, each pair once."""
    ship_code(items.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(key, term) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for term in set(words(text))]
            keys, terms = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(terms, pa.binary())], names=["item_id", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


def shards(df: DataFrame, codes: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per shard (``SHARD``): documents with a coded term, by id, and the list of each such term."""
    shared = df.sparkSession.sparkContext.broadcast(codes)  # of one portion

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = shared.value

        def row(n_docs: int, n_terms: int, held: list[tuple]) -> pa.RecordBatch:
            held.sort(key=lambda d: (d[0] is not None, d[0] or 0))
            lists: dict[int, tuple[list, list]] = {}
            for place, (_, _, own) in enumerate(held):
                for code, times in own:
                    docs, counts = lists.setdefault(code, ([], []))
                    docs.append(place)
                    counts.append(times)
            terms = sorted(lists)
            values = [[d[0] for d in held], [d[1] for d in held], terms, [len(lists[t][0]) for t in terms], [p for t in terms for p in lists[t][0]], [c for t in terms for c in lists[t][1]]]
            wide, narrow = pa.list_(pa.int64()), pa.list_(pa.int32())
            columns = [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *(pa.array([v], wide if k < 2 else narrow) for k, v in enumerate(values))]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SHARD.split(", ")])

        n_docs = n_terms = size = 0
        held: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = words(text)
                if not found:
                    continue
                n_docs, n_terms, size = n_docs + 1, n_terms + len(found), size + len(text)
                counts = Counter(found)
                if own := [(known[w], counts[w]) for w in counts.keys() & known.keys()]:
                    held.append((key, len(found), own))
                if size >= SHARD_CHARS:
                    yield row(n_docs, n_terms, held)
                    n_docs = n_terms = size = 0
                    held = []
        if n_docs:
            yield row(n_docs, n_terms, held)

    return df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, SHARD)


class Postings:
    """The lists of a shard, with the impact of every posting and the largest of each list."""

    def __init__(self, ids: list, lengths: list, terms: list, sizes, places, times, weights: dict[int, int], n: int, total: int):
        import numpy as np

        self.ids = ids
        norm = np.array([BASE - SLOPE + SLOPE * length * n // total for length in lengths], np.int64)  # Python's integers do not overflow
        places, times, sizes = (x.astype(np.int64) for x in (places, times, sizes))
        weight = np.repeat(np.array([weights[t] for t in terms], np.int64), sizes)
        impacts = weight * (ONE * times // (1000 * times + 8 * norm[places]))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        most = np.maximum.reduceat(impacts, starts[:-1]) if len(sizes) else sizes
        self.lists = {t: (a, b, m) for t, a, b, m in zip(terms, starts[:-1].tolist(), starts[1:].tolist(), most.tolist(), strict=True) if m > 0}
        self.places, self.impacts = places.tolist(), impacts.tolist()


def _before(key: int | None, other: int | None) -> bool:
    """Whether ``key`` ranks before ``other`` among equal scores."""
    return key is None and other is not None or key is not None and other is not None and key < other


def wand(shard: Postings, terms: list[int], heap: list[tuple], top: int = TOP) -> int:
    """Puts the documents of a shard that belong into an item's heap there; the number of documents scored.

    The heap holds (score, rank of the id among equal scores, id); its least entry goes first."""
    places, impacts, ids = shard.places, shard.impacts, shard.ids
    cursors = [[places[a], a, b, most] for a, b, most in (shard.lists[t] for t in terms if t in shard.lists)]
    scored = 0
    while cursors:
        cursors.sort()
        full = len(heap) == top
        least = heap[0][0] if full else 1
        bound = 0
        for pivot, cursor in enumerate(cursors):
            bound += cursor[3]
            # A document that can only draw level counts if its id ranks before that of the heap's least.
            if bound > least or bound == least and (not full or _before(ids[cursor[0]], heap[0][2])):
                break
        else:
            # Later documents of the shard have larger ids, so a draw cannot become a place any more.
            return scored
        place = cursors[pivot][0]
        if cursors[0][0] == place:
            score = 0
            for cursor in cursors:
                if cursor[0] != place:
                    break
                at = cursor[1]
                score += impacts[at]
                cursor[1] = at = at + 1
                cursor[0] = places[at] if at < cursor[2] else -1
            scored += 1
            key = ids[place]
            entry = (score, (0 if key is not None else 1, -(key or 0)), key)
            if not full:
                if score:
                    heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
        else:
            for cursor in cursors[:pivot]:
                if cursor[0] < place:
                    cursor[1] = at = bisect_left(places, place, cursor[1], cursor[2])
                    cursor[0] = places[at] if at < cursor[2] else -1
        if any(c[0] < 0 for c in cursors):
            cursors = [c for c in cursors if c[0] >= 0]
    return scored


def _searched(stored: DataFrame, items: list[tuple], weights: dict[int, int], n: int, total: int, kind: DataType, top: int) -> DataFrame:
    """``item_id, doc_id, score``: the heaps of every task."""
    shared = stored.sparkSession.sparkContext.broadcast((items, weights))  # of one portion
    key_type = to_arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own_items, own_weights = shared.value
        heaps: list[list] = [[] for _ in own_items]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths, terms, *lists = (c[k].values for c in batch.columns)
                shard = Postings(ids.to_pylist(), lengths.to_pylist(), terms.to_pylist(), *(x.to_numpy() for x in lists), own_weights, n, total)
                for heap, (_, terms) in zip(heaps, own_items, strict=True):
                    wand(shard, terms, heap, top)
        rows = [(key, doc, score) for heap, (key, _) in zip(heaps, own_items, strict=True) for score, _, doc in heap]
        if rows:
            keys, docs, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])

    columns = [c.split()[0] for c in SHARD.split(", ")[2:]]
    return stored.select(*columns).mapInArrow(run, f"item_id {kind.simpleString()}, doc_id long, score long")


def _portions(terms: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """Items with their terms, in portions of about ``limit`` terms by a hash of the item."""
    n = -(-terms.count() // limit)
    for k in range(n):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else terms
        yield [tuple(r) for r in own.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()]


def ranked(df: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", portion_terms: int = PORTION_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` highest-scoring documents of every item."""
    spark = df.sparkSession
    kind, found = items.schema[item_id].dataType, None
    terms, terms_path = stored_at(item_terms(items, item_id, item_text))
    for portion in _portions(terms, portion_terms):
        codes = {t: k for k, t in enumerate(sorted({bytes(t) for _, own in portion for t in own}))}
        own_items = [(key, sorted(codes[bytes(t)] for t in own)) for key, own in portion]
        index, path = stored_at(shards(df, codes, id_col, text_col))
        n, total = (v or 0 for v in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        # At most a row a coded term, all of one portion.
        held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df")).collect()
        weights = {code: math.floor(1000 * math.log((2 * n + 2) / (2 * count + 1))) for code, count in held}
        heaps, _ = stored_at(_searched(index, own_items, weights, n, total, kind, top))
        discard(spark, path)
        found = heaps if found is None else found.unionByName(heaps)
    discard(spark, terms_path)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return whole.select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
scored AS (
    SELECT i.item_id, tf.r, d.doc_id, sum(weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * len(d.w) * c.n) // c.l))))::BIGINT AS score
    FROM i JOIN tf USING (term) JOIN weights USING (term) JOIN d ON d.r = tf.r, c GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
