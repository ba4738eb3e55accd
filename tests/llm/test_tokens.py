import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from helpers import rows_of  # noqa: E402

from rillmark.llm import byte_bpe, token_counts  # noqa: E402

ODD = ["a" * 300, "ab" * 200 + "\r\n'll", "日本語" * 60, " " * 90, "x" * 3_000, "'s't I'll  \t\n x", "<s>hi</s> <|endoftext|>", "▁a ▁ b", "a\x00b", " \n \n"]


@pytest.fixture(scope="module")
def texts(edge_rows):
    rng = random.Random(2)
    return [t or "" for _, t in edge_rows] + ODD + ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(400)), "".join(rng.choice("abcdefgh") for _ in range(2_000))]


def test_ids_equal_the_library_and_decode_to_the_text(texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for text, (n, ids, decoded) in zip(texts, byte_bpe.DuckBpe(path, P.PATTERN).encode_block(texts), strict=True):
        wanted = library.encode_ordinary(text)
        assert (n, ids) == (len(wanted), " ".join(map(str, wanted))) and decoded == text.encode()


def test_memo_and_portions_do_not_matter(texts, monkeypatch):
    bpe = byte_bpe.DuckBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    wanted = list(bpe.encode_block(texts))
    for name, value in (("PORTION_BYTES", 50), ("MEMO_WORDS", 10), ("MEMO_BYTES", 4)):
        monkeypatch.setattr(byte_bpe, name, value)
    for text, row in list(zip(texts, wanted, strict=True))[:25]:
        assert list(bpe.encode_block([text])) == [row]


def test_round_trip_query(spark, edge, edge_rows, no_rows):
    got = rows_of(byte_bpe.production(edge), "doc_id", "decoded_sha256", "n_decoded_bytes")
    assert got == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode())) for i, t in edge_rows), key=repr)
    assert byte_bpe.production(no_rows).count() == 0


def test_encode_then_decode_frames(edge, edge_rows):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(edge.where("doc_id between 1 and 18"), path, P.PATTERN)
    got = byte_bpe.decode(ids, path, P.PATTERN).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in got) == sorted((i, (t or "").encode()) for i, t in edge_rows if i and 1 <= i <= 18)


def test_counts_equal_the_library(texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PieceCounter(path)
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_count_query(edge, edge_rows, no_rows):
    path = P.path("piece_bpe_32k.model")
    counter = token_counts.PieceCounter(path)
    wanted = [(i, len((t or "").encode()), counter.count(t or ""), counter.count(t or "") > 4096) for i, t in edge_rows]
    assert rows_of(token_counts.token_counts(edge, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(wanted, key=repr)
    assert token_counts.token_counts(no_rows, path).count() == 0


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def long_word(rng):
    n = rng.randint(60, 600)
    unit = "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 9)))
    return rng.choice([
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), rng.choice("abx") + rng.choice("xyzab") * n, rng.choice(["", "q", "the"]) + unit * (n // len(unit)),
        "".join(chr(rng.randint(0x4E00, 0x4E60)) for _ in range(n // 3)), "".join(rng.choice(["the", "ing", "tion", "er", "un", "ab", "straße", "ñ"]) for _ in range(n // 3)),
        "=" * rng.randint(40, 200) + "-" * rng.randint(1, 200), " " * n, "".join(rng.choice("aab") for _ in range(n)),
    ])


@pytest.mark.parametrize(("piece", "wide"), [(32, 256), (3, 8)])
def test_long_words_are_encoded_in_pieces_and_mended(library, monkeypatch, piece, wide):
    for name, value in (("LONG", 8 if piece == 3 else 64), ("PIECE", piece), ("WIDE", wide)):
        monkeypatch.setattr(byte_bpe, name, value)
    rng = random.Random(piece)
    words = list(dict.fromkeys(long_word(rng) for _ in range(150)))
    found = dict(byte_bpe.DuckBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_words(words))
    for word in words:
        assert found[word] == (" ".join(map(str, library._core_bpe.encode_single_piece(word.encode()))), word.encode())


def test_a_very_long_word_takes_seconds(library):
    import time

    rng = random.Random(6)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    bpe, began = byte_bpe.DuckBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), time.perf_counter()
    ((n, ids, decoded),) = bpe.encode_block([word])
    assert time.perf_counter() - began < 30 and decoded == word.encode()
    head = library._core_bpe.encode_single_piece(word[:20_000].encode())
    assert ids.split(" ")[: len(head) - 20] == [str(i) for i in head[:-20]]


def test_query_equals_the_library_on_the_whole_table(spark, sf_dir, library):
    docs = {r["doc_id"]: library.encode_ordinary(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    wanted = {i: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()) for i, ids in docs.items()}
    got = byte_bpe.op2_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == wanted and len(got) == len(wanted)


def test_count_query_equals_the_library_on_the_whole_table(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = [(i, len(t.encode()), len(model.encode(t))) for i, t in docs]
    got = rows_of(token_counts.op10_token_counts(spark, sf_dir), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((*row, row[2] > 4096) for row in counts), key=repr)


@pytest.mark.parametrize("change", ["model_type", "remove_extra_whitespaces", "piece"])
def test_models_that_cannot_be_counted_by_pre_tokens_are_refused(tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as file:
        spec.ParseFromString(file.read())
    if change == "model_type":
        spec.trainer_spec.model_type = 1
    elif change == "piece":
        spec.pieces.add(piece="a▁b", score=-1.0)
    else:
        spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="m.model"):
        token_counts.PieceCounter(str(tmp_path / "m.model"))
