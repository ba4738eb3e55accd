"""Byte-level BPE by DuckDB recursive queries inside each task.

A task gathers the words (matches of the split pattern) of a block of documents.  The words
its Python worker does not remember become token-position rows ``(word, position, token)``; a
recursive query joins neighbouring rows to the merge table and contracts the leftmost pair of
least rank of every word until no word has a pair left.  An ordered aggregation turns token
rows back into bytes.

A word of more than ``LONG`` bytes would need as many steps as it has merges.  It is encoded
in pieces, by the same query, which are then mended.  A row of tokens is the encoding of its
bytes exactly if every two neighbours are the encoding of theirs (a merge across a border of two
tokens would be the first one across in both), so only the seams are checked, and where one does
not hold the tokens around it are encoded anew, in ever wider windows.  Windows beyond ``WIDE``
bytes contract all non-overlapping places of their least pair at once; all neighbours of such a
result are checked, and if any two fail the leftmost contraction runs over the whole window.

Only distinct words go through DuckDB, in portions of bounded size; a document is the
concatenation of its words.  Nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows are
encoded each by itself; an empty table gives an empty result; other columns are ignored.  A text
of one word of a million letters takes seconds.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, documents, id_and_text, ship_code

#: Bytes of a word that is encoded as it stands, of the pieces of longer ones, and of windows that are contracted from the left.
LONG, PIECE, WIDE = 64, 32, 256
#: Bytes of words and rows of all steps (estimated) in one recursive query, and words a task remembers.
PORTION_BYTES, PORTION_ROWS, MEMO_WORDS, MEMO_BYTES, MEMO_PAIRS = 1_000_000, 8_000_000, 500_000, 64, 200_000
#: Tokens on either side of a seam that are encoded anew at first.
REACH = 4

ENCODE = """
WITH RECURSIVE state(w, p, t, next_p, next_t, r, step) AS (
    SELECT w, p, t, next_p, next_t, coalesce(m.id, 1073741823), 0
    FROM seed LEFT JOIN merges m ON m.pair = (t::BIGINT << 32) | next_t
    UNION ALL
    (
    WITH leftmost AS (
        SELECT w, min((r << 32) | p) AS least FROM state GROUP BY w HAVING min(r) < 1073741823
    ), place AS (
        SELECT l.w, least >> 32 AS best, s.p AS spot, s.next_p AS eaten
        FROM leftmost l JOIN state s ON s.w = l.w AND s.p = least & 4294967295
    ), moved AS (
        SELECT w, p,
               CASE WHEN p = eaten THEN best ELSE t END AS t,
               CASE WHEN next_p = spot THEN eaten ELSE next_p END AS next_p,
               CASE WHEN next_p = spot THEN best ELSE next_t END AS next_t,
               r, p = eaten OR next_p = spot AS changed, step
        FROM state JOIN place USING (w) WHERE p <> spot
    )
    SELECT w, p, t::INTEGER, next_p, next_t::INTEGER, CASE WHEN changed THEN coalesce(m.id, 1073741823) ELSE r END, step + 1
    FROM moved LEFT JOIN merges m ON m.pair = CASE WHEN changed THEN (t::BIGINT << 32) | next_t ELSE -1 END
    )
), last AS (
    SELECT w, max(step) AS step FROM state GROUP BY w
)
SELECT w, p, t FROM state JOIN last USING (w, step)
"""

ENCODE_WIDE = """
WITH RECURSIVE state(w, p, t, live) AS (
    SELECT w, p, t, true FROM seed
    UNION ALL
    (
    WITH pairs AS (
        SELECT w, p, t,
               lead(t) OVER (PARTITION BY w ORDER BY p) AS nt,
               row_number() OVER (PARTITION BY w ORDER BY p) AS i
        FROM state WHERE live
    ), ranked AS (
        SELECT pairs.w, pairs.p, pairs.t, pairs.i, m.id, min(m.id) OVER (PARTITION BY pairs.w)::INTEGER AS best
        FROM pairs LEFT JOIN merges m ON m.pair = (pairs.t::BIGINT << 32) | pairs.nt
    ), runs AS (
        SELECT *, i - row_number() OVER (PARTITION BY w, coalesce(id = best, false) ORDER BY p) AS run FROM ranked
    ), chosen AS (
        SELECT *, coalesce(id = best, false)
                  AND row_number() OVER (PARTITION BY w, coalesce(id = best, false), run ORDER BY p) % 2 = 1 AS hit
        FROM runs
    ), marked AS (
        SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS eaten FROM chosen
    )
    SELECT w, p, CASE WHEN hit THEN best ELSE t END, best IS NOT NULL FROM marked WHERE NOT eaten
    )
)
SELECT w, p, t FROM state WHERE NOT live
"""

DECODE = """
SELECT w, string_agg(t::VARCHAR, ' ' ORDER BY p) AS ids, string_agg(vocab.bytes, '' ORDER BY p) AS decoded
FROM finals JOIN vocab ON vocab.id = t GROUP BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class DuckBpe:
    """Encoder and decoder of one task; every byte of the vocabulary appears as one Latin-1 character."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        ranks = load_ranks(ranks_path)
        self.np, self.pa = np, pa
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.tokens = {k: t for t, k in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        scratch = os.path.join(tempfile.gettempdir(), f"rillmark-duckdb-{os.getpid()}")  # of this worker alone
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": scratch})
        self.db.execute("SET enable_progress_bar = false")
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]})
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.db.unregister("vocab_in")
        merges = [(ranks[t[:i]] << 32 | ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pair, merged = (pa.array(c, pa.int64()) for c in zip(*merges, strict=True))
        self.db.register("merges_in", pa.table({"pair": pair, "id": merged}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.unregister("merges_in")

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, tuple[str, bytes]]]:
        """Each distinct word with its ids as text and the bytes decoded from them."""
        data = [word.encode("utf-8") for word in words]
        short = [i for i, d in enumerate(data) if len(d) <= LONG]
        for part in self._portions([data[i] for i in short]):
            names = [words[short[i]] for i in part]
            yield from zip(names, self._decode(self._query(ENCODE, [data[short[i]] for i in part]), len(part)), strict=True)
        long = [i for i, d in enumerate(data) if len(d) > LONG]
        if long:
            rows = self._rows(self._mended([data[i] for i in long]))
            yield from zip((words[i] for i in long), self._decode(rows, len(long)), strict=True)

    @staticmethod
    def _portions(items: list[bytes]) -> Iterator[list[int]]:
        """Indices of the items in portions of bounded size, items of like length together: they need a like number of steps."""
        part: list[int] = []
        size = rows = 0
        for i in sorted(range(len(items)), key=lambda i: len(items[i])):
            n = len(items[i])
            if part and (size + n > PORTION_BYTES or rows + n * n // 2 > PORTION_ROWS):
                yield part
                part, size, rows = [], 0, 0
            part.append(i)
            size, rows = size + n, rows + n * n // 2
        if part:
            yield part

    def _query(self, query: str, items: list[bytes]):
        """Rows (w, p, t) of the items' tokens, w being the index of the item."""
        np, pa = self.np, self.pa
        sizes = np.array([len(d) for d in items])
        ids = self.byte_ids[np.frombuffer(b"".join(items), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        p = (np.arange(len(ids)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        following = np.roll(ids, -1)
        following[ends - 1] = -1
        seed = pa.table({"w": np.repeat(np.arange(len(items), dtype=np.int32), sizes), "p": p, "t": ids, "next_p": p + 1, "next_t": following})
        self.db.register("seed", seed)
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("seed")
        return found

    def _rows(self, ids: list[list[int]]):
        np, pa = self.np, self.pa
        sizes = np.array([len(x) for x in ids])
        p = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"w": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "p": p.astype(np.int32), "t": np.concatenate([np.array(x, dtype=np.int32) for x in ids])})

    def _decode(self, rows, n: int) -> list[tuple[str, bytes]]:
        """Ids as text and decoded bytes of the words 0 to n - 1."""
        self.db.register("finals", rows)
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("finals")
        out: list[tuple[str, bytes]] = [("", b"")] * n
        for w, ids, decoded in zip(*(c.to_pylist() for c in found.columns), strict=True):
            out[w] = ids, decoded.encode("latin-1")
        return out

    # --- long words ---

    def _lists(self, query: str, items: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(items)
        for part in self._portions(items) if query is ENCODE else [[i] for i in range(len(items))]:
            found = self._query(query, [items[i] for i in part])
            order = self.np.lexsort((found.column("p").to_numpy(), found.column("w").to_numpy()))
            w, t = found.column("w").to_numpy()[order], found.column("t").to_numpy()[order]
            for i, ids in zip(part, self.np.split(t, self.np.nonzero(self.np.diff(w))[0] + 1), strict=True):
                out[i] = ids.tolist()
        return out

    def _hold(self, pairs: Iterable[tuple[int, int]]) -> dict[tuple[int, int], bool]:
        """Whether each two tokens are the encoding of their bytes."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        wanted = set(pairs)
        fresh = [x for x in wanted if x not in self.pairs]
        if fresh:
            found = self._lists(ENCODE, [self.tokens[a] + self.tokens[b] for a, b in fresh])
            self.pairs.update((x, tuple(ids) == x) for x, ids in zip(fresh, found, strict=True))
        return {x: self.pairs[x] for x in wanted}

    def _windows(self, items: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of byte strings of any length up to that of a word."""
        distinct = sorted(set(items))
        small = [d for d in distinct if len(d) <= WIDE]
        out = dict(zip(small, self._lists(ENCODE, small), strict=True))
        for d in distinct:
            if len(d) > WIDE:
                (ids,) = self._lists(ENCODE_WIDE, [d])
                if not all(self._hold(pairwise(ids)).values()):
                    (ids,) = self._lists(ENCODE, [d])
                out[d] = ids
        return out

    def _mended(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of long words: of their pieces, with every seam mended."""
        pieces = [[d[i : i + PIECE] for i in range(0, len(d), PIECE)] for d in words]
        known = self._windows([x for own in pieces for x in own])
        rows, seams = [], []
        for own in pieces:
            ids: list[int] = []
            edges = []
            for x in own:
                edges.append(len(ids))
                ids += known[x]
            rows.append(ids)
            seams.append(edges[1:])
        live, reach = range(len(words)), REACH
        while live:
            hold = self._hold((rows[k][s - 1], rows[k][s]) for k in live for s in seams[k])
            torn = {k: [s for s in seams[k] if not hold[rows[k][s - 1], rows[k][s]]] for k in live}
            live = [k for k in live if torn[k]]
            spans = {}
            for k in live:
                merged: list[list[int]] = []
                for s in torn[k]:
                    a, b = max(0, s - reach), min(len(rows[k]), s + reach)
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = b
                    else:
                        merged.append([a, b])
                spans[k] = merged
            known = self._windows([b"".join(map(self.tokens.__getitem__, rows[k][a:b])) for k in live for a, b in spans[k]])
            for k in live:
                old, ids, edges, at = rows[k], [], [], 0
                for a, b in spans[k]:
                    ids += old[at:a]
                    edges.append(len(ids))
                    ids += known[b"".join(map(self.tokens.__getitem__, old[a:b]))]
                    edges.append(len(ids))
                    at = b
                ids += old[at:]
                rows[k], seams[k] = ids, sorted({e for e in edges if 0 < e < len(ids)})
            reach *= 2
        return rows

    def encode_block(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text the number of ids, the ids as decimal text joined by spaces, and their decoded bytes."""
        memo, split = self.memo, [self.split(t) for t in texts]
        if len(memo) > MEMO_WORDS:  # the older half goes
            for word in list(islice(memo, len(memo) // 2)):
                del memo[word]
        fresh = [word for word in set().union(*split) if word not in memo]
        memo.update(self.encode_words(fresh))
        for words in split:
            if not words:
                yield 0, "", b""
                continue
            ids, decoded = zip(*map(memo.__getitem__, words), strict=True)
            ids = " ".join(ids)
            yield ids.count(" ") + 1, ids, b"".join(decoded)
        for word in fresh:
            if len(word) > MEMO_BYTES:
                del memo[word]


_ENCODERS: dict[tuple[str, str], DuckBpe] = {}


def encoder(ranks_path: str, pattern: str) -> DuckBpe:
    """The encoder of this Python worker; tasks that follow each other in it share tables and words."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = DuckBpe(ranks_path, pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``ids`` (array of int)."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = encoder(ranks_path, pattern)
        for keys, texts in blocks(batches):
            ids = [[int(i) for i in s.split()] for _, s, _ in bpe.encode_block(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``doc_id``, ``decoded`` (binary): the bytes of the ids in order.

    Null or no ids decode to nothing; an id outside the vocabulary raises an error."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            bpe.db.register("given", pa.table({"d": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column(1)}))
            rows = bpe.db.execute(
                "SELECT g.d AS d, string_agg(CASE WHEN v.id IS NULL THEN error('unknown id') ELSE v.bytes END, '' ORDER BY g.p) AS x "
                "FROM (SELECT d, unnest(ids) AS t, generate_subscripts(ids, 1) AS p FROM given) g "
                "LEFT JOIN vocab v ON v.id = g.t GROUP BY g.d"
            ).fetchall()
            bpe.db.unregister("given")
            found = dict(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([found.get(i, "").encode("latin-1") for i in range(batch.num_rows)], pa.binary())], names=["doc_id", "decoded"]
            )

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_decoded_bytes``."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = encoder(ranks_path, pattern)
        for keys, texts in blocks(batches):
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest(), len(data)) for n, ids, data in bpe.encode_block(texts)]
            n, ids, decoded, size = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(size, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_decoded_bytes"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded_bytes long")


def production(df: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production(documents(spark, sf_dir))
