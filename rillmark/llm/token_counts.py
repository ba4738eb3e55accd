"""Token counts: pieces are counted once per distinct pre-token and joined to each document's
pre-token frequencies.

The vocabulary has no piece with a word mark behind another character and none with a line
feed, and the model neither normalises nor drops white space, so the text (behind the dummy
prefix) falls apart before each run of word marks and around each line feed without changing a
single merge.  A model of another kind is refused with an error.  Every task keeps the piece counts of
the pre-tokens it has met, looks up the distinct ones of a document, and sums count times
frequency; ids are never materialised and nothing is shuffled.

Defined results: a null or empty text has no tokens; repeated rows are counted each by
itself; an empty table gives an empty result; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

from pyspark.sql import DataFrame, SparkSession

from .common import blocks, documents, id_and_text, ship_code

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MARK = "▁"
PRETOKENS = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+")
#: The memo of a task is emptied beyond so many entries; longer pre-tokens are not kept in it.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64


def unlike(spec) -> str | None:
    """What keeps the texts of a model from being counted by pre-tokens."""
    rules = spec.normalizer_spec
    if spec.trainer_spec.model_type != 2:
        return "not a BPE model"
    if rules.precompiled_charsmap or rules.normalization_rule_tsv or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
        return "texts are normalised"
    if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in spec.pieces if p.type in (1, 4)):  # normal and user-defined ones
        return "pieces cross the borders of pre-tokens"
    return None


class PieceCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            spec.ParseFromString(file.read())
        if problem := unlike(spec):
            raise ValueError(f"{model_path}: {problem}")
        spec.normalizer_spec.add_dummy_prefix = False  # the mark of the first word is put in here
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        freq = Counter(PRETOKENS.findall(MARK + text.replace(" ", MARK)))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        fresh = [token for token in freq if token not in self.memo]
        if fresh:
            self.memo.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1)), strict=True))
        total = text.count("\n") + sum(map(mul, map(self.memo.__getitem__, freq), freq.values()))
        for token in fresh:
            if len(token) > MEMO_CHARS:
                del self.memo[token]
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def piece_counter(model_path: str) -> PieceCounter:
    """The counter of this Python worker, shared by the tasks that follow each other in it."""
    if model_path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = piece_counter(model_path)
        for ids, texts in blocks(batches):
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
