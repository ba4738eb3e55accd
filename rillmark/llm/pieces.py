"""SentencePiece encoding and decoding by tables of distinct chunks.

In a vocabulary whose pieces hold a word mark at their beginning only, and no line feed, no merge
crosses a word mark that follows another character, nor a line feed: the text (behind the dummy
prefix) falls apart into chunks there (see ``token_counts.unlike``, which refuses other models).
Every task cuts the texts of a block into chunks, puts each distinct one into a table, has the
library segment those that the table lacks, once, and decode their ids, and joins ids and decoded
texts back by position.

The table is a task's own, kept by its Python worker for later blocks and emptied beyond
``TABLE_ENTRIES``; chunks longer than ``TABLE_CHARS`` stay in it for their block only.  Nothing is
shuffled, so a lost executor costs its tasks and no more.  A table shared by all tasks was not
chosen, because joining it back needs a row for every distinct chunk of every block: of the 27
million words of 168 million characters of text, 1.6 million are distinct, and blocks of 8 million
characters still hold 5.1 million, which would be shuffled twice.

Defined results: a null or empty text has the end id alone and decodes to an empty text; strings
that name control pieces are ordinary text; a word mark in the text decodes to a blank, as in the
library; very long texts and words are encoded whole; repeated rows are encoded each by itself; an
empty table gives an empty result; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .common import blocks, documents, id_and_text, ship_code
from .token_counts import MARK, unlike

CHUNKS = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
TABLE_ENTRIES, TABLE_CHARS = 300_000, 64
BLOCK_CHARS = 2_000_000


class ChunkTable:
    """Ids (decimal, each behind a blank) and decoded texts of distinct chunks."""

    def __init__(self, model_path: str, entries: int = TABLE_ENTRIES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            spec.ParseFromString(file.read())
        if problem := unlike(spec):
            raise ValueError(f"{model_path}: {problem}")
        spec.normalizer_spec.add_dummy_prefix = False  # the mark of the first chunk is put in below
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.end, self.entries = f" {self.model.eos_id()}", entries
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def add(self, chunks: list[str]) -> None:
        """Chunks that are not there yet, each once."""
        found = self.model.encode(chunks, num_threads=1)
        self.ids.update(zip(chunks, ["".join([f" {i}" for i in ids]) for ids in found], strict=True))
        self.decoded.update(zip(chunks, self.model.decode(found, num_threads=1), strict=True))

    def block(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids (decimal, joined by blanks, the end id last) and decoded text of each text."""
        cut = [CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids) > self.entries:
            self.ids.clear()
            self.decoded.clear()
        distinct = set().union(*cut)
        fresh = [c for c in distinct if c not in self.ids]
        if fresh:
            self.add(fresh)
        ids_of, text_of = self.ids.__getitem__, self.decoded.__getitem__
        for chunks in cut:
            ids = "".join(map(ids_of, chunks)) + self.end
            yield ids.count(" "), ids[1:], "".join(map(text_of, chunks))[1:]  # without the blank of the dummy prefix
        for chunk in fresh:
            if len(chunk) > TABLE_CHARS:
                del self.ids[chunk], self.decoded[chunk]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """The table of this Python worker, shared by the tasks that follow each other in it."""
    if model_path not in _TABLES:
        _TABLES.clear()
        _TABLES[model_path] = ChunkTable(model_path)
    return _TABLES[model_path]


def _mapped(df: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    """One row per input row; ``columns`` makes Arrow arrays of what a block of texts gave."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = chunk_table(model_path)
        for ids, texts in blocks(batches, BLOCK_CHARS):
            values = columns(pa, table.block(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *values], names=[f.split()[0] for f in schema.split(", ")])

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every text, the end id last."""

    def columns(pa, rows):
        return [pa.array([[int(i) for i in ids.split(" ")] for _, ids, _ in rows], pa.list_(pa.int32()))]

    return _mapped(df, model_path, id_col, text_col, "doc_id long, ids array<int>", columns)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids, those of other encoders too; null ids decode to an empty text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return id_and_text(df, id_col, ids_col).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding every text."""

    def columns(pa, rows):
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        counted = [(n, sha(ids), sha(text)) for n, ids, text in rows]
        return [pa.array([r[k] for r in counted], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _mapped(df, model_path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
