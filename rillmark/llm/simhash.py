"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles of
three words joined by spaces (repeats count; fewer words make one shingle, none the
fingerprint zero), XXH64 with seed 42 of each shingle, and a majority vote for each bit.

Links: fingerprints that differ in at most ``MAX_BITS`` = 3 bits.  The 64 bits are cut into
five bands; two fingerprints within three bits agree on two bands at least, so each distinct
fingerprint is sent to ten groups, one for each pair of bands.  A group sorts its fingerprints
(a binary trie in array form), walks pairs of trie nodes together from the root, adds up the
differing bits on the way and drops a pair of nodes once the budget is spent.  What a group
returns is a spanning forest of its links, never its pairs.  A group of more than
``HOT_GROUP`` fingerprints is first dealt into finer groups: the remaining bits are cut into
four pieces, one of which must agree, so no link is lost.  This is done again to groups that are
still too large; after ``LEVELS`` times no more than 12 bits are left, so no group is.

Components: minimum labels by alternating star contraction on DataFrames; each pass is stored
in the shared folder and the one before it deleted.

Defined results: null, empty and wordless texts have the fingerprint zero and link like any
other; repeated rows each give a row with the same result; a null id never becomes a component
id unless the whole component has none; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import KEY, blocks, discard, documents, id_and_text, ship_code, stored, stored_at

MAX_BITS = 3
HOT_GROUP, LEVELS = 4096, 4
#: Bit positions (from the lowest) where the five bands begin, and the end.
BANDS = (0, 13, 26, 39, 52, 64)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text: str, size: int = 3) -> int:
    """The fingerprint of one text; the plain form that :func:`simhash_block` follows."""
    return simhash_block([text], size)[0]


def simhash_block(texts: list[str], size: int = 3) -> list[int]:
    import numpy as np
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts: list[int] = []
    for text in texts:
        words = WORDS.findall(text.translate(UPPER)) if text else []
        if not words:
            counts.append(0)
            continue
        shingles = list(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False))) if len(words) >= size else [" ".join(words)]
        hashes += [xxh64_intdigest(s, 42) for s in shingles]
        counts.append(len(shingles))
    out: list[int] = []
    values, at = np.array(hashes, dtype=np.uint64), 0
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for n in counts:
        if not n:
            out.append(0)
            continue
        own = np.ascontiguousarray(values[at : at + n]).view(np.uint8).reshape(n, 8)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, n, 65536):
            ones += np.unpackbits(own[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(weights[2 * ones > n].sum(dtype=np.uint64)))
        at += n
    return out


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a long), one row per input row."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for ids, texts in blocks(batches, 1_000_000):
            found = np.array(simhash_block(texts, size), dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def trie_links(values, budget: int = MAX_BITS):
    """Indices (a, b) of a spanning forest of the links among the sorted distinct ``values``.

    The sorted array is the trie: a node is the range of values that share a prefix.  Pairs of
    nodes of one depth are walked together, all pairs of a depth at a time; the bits by which
    two nodes differ add up, and pairs over the budget go.  A node paired with itself yields
    its two children with themselves and with each other.  Once a node holds one value, the
    pair is settled by the whole values.
    """
    import numpy as np

    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n < 2:
        return np.zeros((0, 2), dtype=np.int64)
    parent = np.arange(n)

    forest: list = []

    def settle(left, right) -> None:
        """Links of close pairs whose ends are not linked yet: every root is hung on a smaller one, all at a time."""
        close = np.bitwise_count(values[left] ^ values[right]) <= budget
        left, right = left[close], right[close]
        while len(left):
            while True:  # every node points at its root
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up
            x, y = parent[left], parent[right]
            apart = x != y
            left, right, x, y = left[apart], right[apart], x[apart], y[apart]
            high, at = np.unique(np.maximum(x, y), return_index=True)
            parent[high] = np.minimum(x, y)[at]
            forest.append(np.stack([left[at], right[at]], 1))

    # Pairs of nodes as ranges [a0, a1) and [b0, b1) with the bits spent so far.
    stack = [(np.array([[0, n, 0, n, 0]], dtype=np.int64), 63)]
    while stack:
        pairs, depth = stack.pop()
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        done = pairs[single]
        done = done[done[:, 0] != done[:, 2]]
        if len(done):
            settle(done[:, 0], done[:, 2])
        pairs = pairs[~single]
        if depth < 0 or not len(pairs):
            continue
        if len(pairs) > 200_000:  # bounded memory: depth first beyond this width
            half = len(pairs) // 2
            stack += [(pairs[half:], depth), (pairs[:half], depth)]
            continue
        bit = ((values >> np.uint64(depth)) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate(([0], np.cumsum(bit)))
        a0, a1, b0, b1, spent = pairs.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones begin
        same = a0 == b0
        children = np.concatenate([
            np.stack([a0, am, b0, bm, spent], 1),
            np.stack([am, a1, bm, b1, spent], 1),
            np.stack([a0, am, bm, b1, spent + 1], 1),
            np.stack([am, a1, b0, bm, spent + 1], 1)[~same],
        ])
        children = children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= budget)]
        stack.append((children, depth - 1))
    return np.concatenate([np.zeros((0, 2), dtype=np.int64), *forest])


def _forest(keys: list[str]):
    """For applyInArrow: edges (a, b) of the spanning forest of one group's links."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        links = trie_links(values)
        ends = values.view(np.int64)
        return pa.table({"a": pa.array(ends[links[:, 0]], pa.int64()), "b": pa.array(ends[links[:, 1]], pa.int64())})

    return run


def _mask(low: int, high: int) -> int:
    value = ((1 << high) - 1) ^ ((1 << low) - 1)
    return value - (1 << 64) if value >> 63 else value


def band_masks() -> list[int]:
    """Ten masks, one for each pair of bands; two values within three bits agree under one of them."""
    bands = [_mask(a, b) for a, b in zip(BANDS, BANDS[1:], strict=False)]
    return [bands[i] | bands[j] for i in range(5) for j in range(i)]


def finer_masks(mask: int, pieces: int = 4) -> list[int]:
    """The mask with one of four pieces of the bits it leaves out."""
    rest = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(k * len(rest) / pieces) for k in range(pieces + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        more = sum(1 << i for i in rest[a:b])
        value = (mask | more) & ((1 << 64) - 1)
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def links(fps: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links among the distinct values of ``fp``."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = band_masks()
    groups = fps.select("fp").distinct().withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    found = None
    for level in range(LEVELS + 1):
        groups = groups.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = groups.groupBy("mask", "bits").count().where(F.col("count") > 1)
        kept = groups.join(sizes, ["mask", "bits"])
        small = kept.where(F.col("count") <= hot_group) if level < LEVELS else kept
        small = small.select("fp", "mask", "bits")
        found = small if found is None else found.unionByName(small)
        if level == LEVELS or sizes.where(F.col("count") > hot_group).isEmpty():
            break
        finer = spark.createDataFrame([(m, x) for m in masks for x in finer_masks(m)], "mask long, finer long")  # ten times four to the level
        hot = stored(kept.where(F.col("count") > hot_group).select("fp", "mask"))
        groups = hot.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct()
        masks = sorted({x for m in masks for x in finer_masks(m)})
    dealt = found.repartition(parts, "mask", "bits")  # few bytes, much work: not to be coalesced
    return dealt.groupBy("mask", "bits").applyInArrow(_forest(["mask", "bits"]), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each component, for every node with an edge.

    Alternates large and small stars (each node points its neighbours at its least neighbour)
    until nothing changes; every pass needs one minimum per node and one join.
    """
    spark = edges.sparkSession
    current, path = stored_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old = path
        current, path = stored_at(small.select("e.u", "e.v").where("u <> v").distinct())
        discard(spark, old)
        row = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # Done when every node has one edge, to its root, and the pass changed nothing.
        if row[0] == row[2] and tuple(row) == before:
            break
        before = tuple(row)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, size: int = 3, hot_group: int = HOT_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every input row.  A component id is the least document id in it."""
    docs = stored(fingerprints(df, size, id_col, text_col))
    owner = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(docs, hot_group))
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    named = owner.join(roots, owner.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.where("root is not null").join(least, "root").select("fp", "component_id")
    return docs.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, near: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose document is the first of its component; all columns stay.

    Rows without an id stay if any of them is in a component of its own kind."""
    first = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(KEY)).distinct()
    return df.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col(KEY)), "left_semi")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
