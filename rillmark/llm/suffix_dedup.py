"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else in the
table.  Sorting every suffix of a large table is not possible, and not needed:

1. Every window of ``LENGTH`` bytes names its anchor, the seed of ``SEED`` bytes of least hash
   in it (leftmost on ties), so equal windows name equal seeds at equal places.  The windows
   that share one anchor occurrence make a segment of at most 2 * LENGTH - SEED bytes.
   Anchors whose seed occurs once in the table are dropped: nothing at them repeats.
2. Segments with equal seed and equal content (64 bits of hash each) are counted; those that
   occur twice are covered as they stand, and one of them represents the rest.
3. Different segments around one seed meet in one task.  Segments that share no
   string of nearly the length of a window are left out.  Of the others a suffix array is built
   in two stages: suffixes smaller than their successors are sorted directly, the others are induced
   by scanning the buckets in order.  The common prefix of neighbouring suffixes tells which
   windows occur in two segments.
4. Seeds with more than ``HOT_SEGMENTS`` different segments (the edge of a passage that a great
   many documents share) would make that task large; their windows are hashed and counted one
   by one instead, which gives the same answer from rows that any number of tasks can share.

All shuffles carry hashes and positions; the text is dealt out by document once, and segments
of repeated seeds once.  What is repeated is stored before it is joined back to its places, so
that both sides of such a join come straight from an exchange and the copies of one passage are
split over tasks.

Defined results: texts below ``LENGTH`` bytes lose nothing by themselves; null counts as
empty; rows are told apart by id and 64 bits of the text, so rows that share an id or have none
are texts of their own; repeated rows (same id and text) remove each other like any copies; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, documents, row_key, same_row, ship_code, stored, stored_at

LENGTH, SEED = 200, 32
HOT_SEGMENTS = 2_000
#: Bytes of text whose anchors are found at once, and of segments in one suffix array.
BLOCK_BYTES, ARRAY_BYTES = 1_000_000, 500_000
_B = 0x9E3779B97F4A7C15 | 1
_PLACE = 24
#: An anchor occurrence as one long: first window start, number of further ones, and how far behind the first the seed stands.
_BITS = 12


def seed_hashes(data, seed: int = SEED):
    """Hash of each ``seed`` bytes (a power of two) of ``data``; the last ones run into zeros."""
    import numpy as np

    h = data.astype(np.uint64) + np.uint64(1)
    power, width = _B, 1
    while width < seed:
        shifted = np.zeros_like(h)
        shifted[:-width] = h[width:]
        h = h * np.uint64(power) + shifted
        power, width = power * power % (1 << 64), width * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data, starts, ends, length: int = LENGTH, seed: int = SEED):
    """Arrays (text, hash, first, last, place): for each anchor occurrence its text, the seed's hash, the
    first and last window start that name it and the seed's own start (places in ``data``).  Texts are ``[starts, ends)``."""
    import numpy as np

    n = len(data)
    h = seed_hashes(data, seed)
    key = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
    span, width = length - seed + 1, 1
    while width * 2 <= span:
        key[: n - width] = np.minimum(key[: n - width], key[width:])
        width *= 2
    rest = span - width
    if rest:
        key[: n - rest] = np.minimum(key[: n - rest], key[rest:])
    counts = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    if not len(at):
        return text, h[:0], at, at, at
    place = (key[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    change = np.nonzero((np.diff(place) != 0) | (np.diff(text) != 0))[0]
    first, last = np.concatenate(([0], change + 1)), np.concatenate((change, [len(at) - 1]))
    return text[first], h[place[first]], at[first], at[last], place[first]


def pieces(ids: list, texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Blocks of (id, offset, bytes); a text above the block size comes in parts that overlap by ``length`` - 1."""
    keys, offsets, parts, size = [], [], [], 0
    for key, text in zip(ids, texts, strict=True):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, BLOCK_BYTES):
            part = text[at : at + BLOCK_BYTES + length - 1]
            if parts and size + len(part) > BLOCK_BYTES:
                yield keys, offsets, parts
                keys, offsets, parts, size = [], [], [], 0
            keys.append(key)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield keys, offsets, parts


def suffix_array(data: bytes, depth: int = LENGTH):
    """Suffixes of ``data`` in the order of their first ``depth`` bytes (equal ones in any order), in two stages."""
    import numpy as np

    t = np.frombuffer(data, dtype=np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # rising: smaller than the successor, which the first byte behind the run of equal bytes decides.
    change = np.concatenate((np.nonzero(t[1:] != t[:-1])[0], [n - 1]))
    follows = np.concatenate((t[change[:-1] + 1].astype(np.int64), [-1]))
    run_rises = follows > t[change]
    rising = np.repeat(run_rises, np.diff(np.concatenate(([-1], change))))
    direct = np.nonzero(rising)[0].tolist()
    direct.sort(key=lambda i: data[i : i + depth])
    direct = np.array(direct, dtype=np.int64)
    # t[direct] is in order now, so each bucket is a slice.
    bounds = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, dtype=np.int64)
    pending: list[list] = [[] for _ in range(256)]
    pending[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        falling = pending[c]
        frontier = np.concatenate(falling) if falling else np.zeros(0, dtype=np.int64)
        whole = [frontier]
        while len(frontier):  # runs of one byte
            before = frontier[frontier > 0] - 1
            frontier = before[(t[before] == c) & ~rising[before]]
            whole.append(frontier)
        order = np.concatenate([*whole, direct[bounds[c] : bounds[c + 1]]])
        pending[c] = []
        if not len(order):
            continue
        out.append(order)
        before = order[order > 0] - 1
        before = before[t[before] > c]
        heads = t[before]
        by = np.argsort(heads, kind="stable")
        before, heads = before[by], heads[by]
        cuts = np.concatenate(([0], np.nonzero(np.diff(heads))[0] + 1, [len(heads)])) if len(heads) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pending[heads[a]].append(before[a:b])
    return np.concatenate(out)


def equal_neighbours(data: bytes, order, depth: int = LENGTH):
    """For neighbours in ``order``: is the common prefix at least ``depth``?  All have ``depth`` bytes left."""
    import numpy as np

    t = np.frombuffer(data, dtype=np.uint8)
    alive = np.arange(len(order) - 1)
    for at in range(0, depth, 8):
        width = min(8, depth - at)
        left, right = order[alive] + at, order[alive + 1] + at
        same = np.ones(len(alive), dtype=bool)
        for k in range(width):
            same &= t[left + k] == t[right + k]
        alive = alive[same]
    out = np.zeros(max(len(order) - 1, 0), dtype=bool)
    out[alive] = True
    return out


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list:
    """For each segment, which of its windows also occur at another place of the block (boolean arrays)."""
    import numpy as np

    data = b"".join(segments)  # no separators: only windows within a segment are looked at
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    windows = np.zeros(len(data), dtype=bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        windows[a : max(a, b - length + 1)] = True
    order = suffix_array(data, length)
    order = order[windows[order]]
    hit = np.zeros(len(data), dtype=bool)
    if len(order) > 1:
        equal = equal_neighbours(data, order, length)
        hit[order[:-1][equal]] = True
        hit[order[1:][equal]] = True
    return [hit[a : max(a, b - length + 1)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def sharing(group: list[tuple], length: int = LENGTH, seed: int = SEED, steps: int = 8) -> list[tuple]:
    """The segments (..., bytes, place of the seed) around one seed that may have a window in common with another one.

    A window holds ``length - seed`` bytes around the seed.  However they lie on its two sides, it holds one of the
    ``steps`` + 1 strings of nearly that length that are compared here."""
    around = length - seed
    step = -(-around // steps)
    shared = [False] * len(group)
    for left in range(0, around + 1, step):
        right = max(0, around - left - step + 1)
        seen: dict[bytes, int] = {}
        for i, row in enumerate(group):
            data, at = row[-2], row[-1]
            if at >= left and len(data) >= at + seed + right:
                other = seen.setdefault(data[at - left : at + seed + right], i)
                if other != i:
                    shared[i] = shared[other] = True
    return [row for row, s in zip(group, shared, strict=True) if s]


def spans_of(hits, offset: int) -> list[tuple[int, int]]:
    """Runs of true values as (first, last), moved by ``offset``."""
    import numpy as np

    edges = np.diff(np.concatenate(([0], hits.astype(np.int8), [0])))
    return list(zip((np.nonzero(edges == 1)[0] + offset).tolist(), (np.nonzero(edges == -1)[0] - 1 + offset).tolist(), strict=True))


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, key, seed, content, run`` of each anchor occurrence; ``run`` holds the window starts that name it and where in the first of them it stands."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for keys, offsets, parts in pieces(rows, batch.column(1).to_pylist(), length):
                data = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                starts = ends - np.array([len(p) for p in parts])
                text, h, first, last, place = anchors(np.frombuffer(data, dtype=np.uint8), starts, ends, length)
                view = memoryview(data)
                own = [xxh3_64_intdigest(view[a : b + length], n) for a, b, n in zip(first.tolist(), last.tolist(), (last - first).tolist(), strict=True)]
                at = first + (np.array(offsets)[text] - starts[text])
                ids, hashes = (pa.array([k[i] for k in keys], pa.int64()).take(pa.array(text)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, hashes, pa.array(h.view(np.int64)), pa.array(np.array(own, dtype=np.uint64).view(np.int64)), pa.array((at << 2 * _BITS) + ((last - first) << _BITS) + (place - first))],
                    names=["doc_id", "key", "seed", "content", "run"],
                )

    return docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key long, seed long, content long, run long")


def removed_windows(df: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, key, first, last``: ranges of window starts (bytes) to remove; ``df`` has ``doc_id``, ``key`` and binary ``text``."""
    if length >= 1 << _BITS:
        raise ValueError(f"length must be below {1 << _BITS}")
    spark = df.sparkSession
    first, low = F.shiftright("run", 2 * _BITS), (1 << _BITS) - 1
    bounds = [first.alias("first"), (first + F.shiftright("run", _BITS).bitwiseAND(low)).alias("last")]
    found, found_path = stored_at(anchor_rows(df, length))
    # Stored, so that both sides of the join come straight from an exchange and hot seeds can be split.
    twice, twice_path = stored_at(found.groupBy("seed").count().where(F.col("count") > 1).select("seed"))
    again = stored(found.join(twice, "seed"))
    discard(spark, found_path)
    discard(spark, twice_path)
    kinds = stored(again.groupBy("seed", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "run")).alias("one")))
    same = again.join(kinds.where("copies > 1").select("seed", "content"), ["seed", "content"]).select("doc_id", "key", *bounds)
    several = kinds.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1")
    ones = kinds.join(several, "seed").select("seed", "one.*", (F.col("kinds") > hot_segments).alias("hot")).select("doc_id", "key", "seed", "hot", *bounds, F.col("run").bitwiseAND(low).cast("int").alias("place"))
    wanted = ones.groupBy("doc_id", "key").agg(F.collect_list(F.struct("seed", "first", "last", "place", "hot")).alias("segments")).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    place = "doc_id long, key long, first long"

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "key", "first", "seed", "place", "hot", "bytes"]
        for batch in batches:
            for i in range(batch.num_rows):
                doc, key, text, own = (c[i].as_py() for c in batch.columns)
                for at in range(0, len(own), 2000):
                    part = own[at : at + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(part), pa.int64()),
                            pa.array([key] * len(part), pa.int64()),
                            pa.array([s["first"] for s in part], pa.int64()),
                            pa.array([s["seed"] for s in part], pa.int64()),
                            pa.array([s["place"] for s in part], pa.int32()),
                            pa.array([s["hot"] for s in part], pa.bool_()),
                            pa.array([text[s["first"] : s["last"] + length] for s in part], pa.binary()),
                        ],
                        names=names,
                    )

    segments = df.join(wanted, same_row(df.doc_id, F.col("_id"), df.key, F.col("_key"))).select("doc_id", "key", "text", "segments").mapInArrow(cut, f"{place}, seed long, place int, hot boolean, bytes binary")

    def sort_block(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def block(rows: list) -> pa.RecordBatch:
            hits = repeated_windows([r[3] for r in rows], length)
            spans = [(r[0], r[1], *s) for r, hit in zip(rows, hits, strict=True) for s in spans_of(hit, r[2])]
            return pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], pa.int64()) for k in range(4)], names=["doc_id", "key", "first", "last"])

        rows: list = []
        group: list = []
        size, last = 0, None
        for batch in batches:
            for doc, key, first, seed, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seed != last:
                    left = sharing(group, length)
                    rows, size = rows + left, size + sum(len(r[3]) for r in left)
                    group, last = [], seed
                    if size > ARRAY_BYTES:
                        yield block(rows)
                        rows, size = [], 0
                group.append((doc, key, first, data, at))
        rows += sharing(group, length)
        if rows:
            yield block(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = segments.where("not hot").drop("hot").repartition(parts, "seed").sortWithinPartitions("seed")
    sorted_spans = cold.mapInArrow(sort_block, f"{place}, last long")

    def windows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for doc, key, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - length + 1
                own = [xxh3_128_intdigest(data[i : i + length]) for i in range(n)]
                low, high = (np.array([(x >> s) & ((1 << 64) - 1) for x in own], dtype=np.uint64).view(np.int64) for s in (0, 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(np.arange(first, first + n)), pa.array(low), pa.array(high)], names=["doc_id", "key", "first", "low", "high"]
                )

    each = segments.where("hot").select("doc_id", "key", "first", "bytes").mapInArrow(windows, f"{place}, low long, high long")
    common = stored(each.groupBy("low", "high").count().where(F.col("count") > 1).select("low", "high"))
    hot_spans = each.join(common, ["low", "high"]).select("doc_id", "key", "first", F.col("first").alias("last"))
    return same.unionByName(sorted_spans).unionByName(hot_spans)


def dedup_bytes(df: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every input row."""
    ship_code(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    docs = docs.withColumn("key", row_key(F.col("text")))
    ranges = removed_windows(docs, length, hot_segments).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"doc_id": "_id", "key": "_key"})

    def keep(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                rows = []
                for text, own in zip(piece.column(1).to_pylist(), piece.column(2), strict=True):
                    text = text or b""
                    n, gone = len(text), np.zeros(len(text) + 1, dtype=np.int64)
                    if own.is_valid and len(own):
                        first, last = own.values.field("first").to_numpy(), own.values.field("last").to_numpy()
                        np.add.at(gone, np.minimum(first, n), 1)
                        np.add.at(gone, np.minimum(last + length, n), -1)
                        mask = np.cumsum(gone)[:n] > 0
                        kept = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                        rows.append((n, n - len(kept), int((np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1).sum()), kept))
                    else:
                        rows.append((n, 0, 0, text))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = docs.join(ranges, same_row(docs.doc_id, F.col("_id"), docs.key, F.col("_key")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by counting all windows, for tables that fit one machine.
OP3_SQL = f"""
WITH d AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
    SELECT doc_id, i, md5(b[i:i + {LENGTH} - 1]) AS h FROM d, unnest(range(1, octet_length(b) - {LENGTH} + 2)) AS r(i)
), starts AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM windows) WHERE k > 1
), marked AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS begins FROM starts
), numbered AS (
    SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
    SELECT doc_id, min(i) AS a, max(i) + {LENGTH} - 1 AS z FROM numbered GROUP BY doc_id, span
), gaps AS (
    SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM spans
    UNION ALL SELECT doc_id, max(z) + 1, 1099511627776 FROM spans GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(hex(b[a:least(z, octet_length(b))]), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) WHERE a <= least(z, octet_length(b)) GROUP BY doc_id
), removed AS (
    SELECT doc_id, sum(z - a + 1) AS n, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
