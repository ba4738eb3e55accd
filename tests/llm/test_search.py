import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import rows_of

from rillmark.llm import divergence, lexical, pieces

LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS_DIGITS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text, pattern=LETTERS_DIGITS):
    return [w.translate(UPPER) for w in pattern.findall(text or "")]


# --- source divergence ---


def plain_divergence(rows, least, top):
    """(lang, source, part, item, value, rank) from (text, lang, source), by the definition."""
    df, counts, groups = defaultdict(int), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = Counter(terms(text, LETTERS))
        groups.add((lang, source))
        counts[lang, source].update(own)
        for t in own:
            df[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", more, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:cut], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(9)
    words = ["the", "The", "of", "Ünï", "straße", "日本", "a1b", "x_y", *["".join(rng.choice("abcde") for _ in range(3)) for _ in range(40)]]
    rows = [(" ".join(rng.choice(words[: 10 + 8 * k]) for _ in range(rng.randint(0, 40))), lang, f"s{k}") for k in range(5) for lang in ("en", "de", None) for _ in range(12)]
    rows += [(None, "en", "s0"), ("", "fr", "s1"), ("the " * 5_000, "en", "s9"), ("12 34 ..", "fr", None), ("the", "en", None), ("the the", "en", "s0"), ("the the", "en", "s0")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "top", "held"), [(3, 50, 200_000), (30, 4, 7), (10_000, 50, 50), (1, 1_000, 1)])
def test_divergence_equals_the_definition(spark, audited, least, top, held):
    rows = [(7 if i % 9 else None, t, lang, s, "clash", 1) for i, (t, lang, s) in enumerate(audited)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, count long").repartition(3)
    assert rows_of(divergence.divergence(df, least, top, held), "lang", "source", "part", "item", "value", "rank") == plain_divergence(audited, least, top)


def test_divergence_of_nothing(spark, no_rows):
    assert divergence.divergence(no_rows).count() == 0


def test_one_term_in_every_document_is_split(spark):
    """A hot term's rows come from many tasks and are added from several ranges."""
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("the hot term").alias("text"), F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source")).repartition(8)
    found = divergence.kept_terms(divergence.term_counts(df, held=1), 30)
    assert rows_of(found, "term", "source", "count", "total") == sorted([(t, s, 2_000, 4_000) for t in ("the", "hot", "term") for s in ("0", "1")], key=repr)


def test_shares_are_exact_for_counts_beyond_64_bits(spark):
    count, n, v = 9_000_000_000_000, 90_000_000_000_007, 1_000_003
    got = spark.range(1).select(divergence._share(F.lit(count).cast("long"), F.lit(n).cast("long"), F.lit(v).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (count + 5) // (n + 5 * v)


def test_divergence_query_equals_sql(same):
    same(divergence.op11_divergence, divergence.OP11_SQL)


# --- ranked search ---


def plain_ranking(docs, items, top):
    """(item_id, rank, doc_id, score) by scoring every document."""
    found = [(key, Counter(terms(text))) for key, text in docs]
    found = [(key, own, sum(own.values())) for key, own in found if own]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for _, own, _ in found for t in own)
    out, wanted = [], defaultdict(set)
    for key, text in items:
        wanted[key] |= set(terms(text))
    for key, own_terms in wanted.items():
        scores = []
        for doc, own, length in found:
            m = 100 - 90 + 90 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in own_terms if t in own)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(key, k, x[3], -x[0]) for k, x in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched(edge_rows):
    rng = random.Random(4)
    words = ["the", "of", *["".join(rng.choice("abcdefg1") for _ in range(rng.randint(1, 4))) for _ in range(150)]]
    pick = lambda: words[min(int(rng.expovariate(0.04)), len(words) - 1)]
    docs = [*edge_rows, *[(1_000 + i if i % 7 else None, " ".join(pick() for _ in range(rng.randint(0, 60)))) for i in range(600)]]
    docs += [(5_000 - i, "ax of the bx") for i in range(40)] + [(77, "the")] * 3
    items = [(i, " ".join(pick() for _ in range(rng.randint(0, 30)))) for i in range(25)]
    items += [(100, "ax bx"), (101, None), (102, ""), (103, "nothingofthekind"), (104, "The THE of"), (104, "ax"), (None, "bx the"), (105, "ÄÖÜ 日本語"), (100, "ax bx")]
    return docs, items


@pytest.mark.parametrize(("top", "shard", "portion"), [(10, 4_000_000, 100_000), (10, 900, 100_000), (3, 1, 40), (1_000, 5_000, 100)])
def test_ranking_equals_scoring_everything(spark, searched, top, shard, portion, monkeypatch):
    docs, items = searched
    monkeypatch.setattr(lexical, "SHARD_CHARS", shard)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item_id string").repartition(3)
    found = lexical.ranked(df, spark.createDataFrame(items, "item_id long, text string"), top, portion_terms=portion)
    assert rows_of(found, "item_id", "rank", "doc_id", "score") == plain_ranking(docs, items, top)


def test_wand_skips_documents(searched):
    """Most documents that hold one of the terms are never scored, and the heap is the same."""
    docs, _ = searched
    import numpy as np

    rng = random.Random(1)
    lists = {t: sorted(rng.sample(range(20_000), n)) for t, n in enumerate((20_000, 15_000, 9_000, 40, 15))}
    places, sizes = np.concatenate([lists[t] for t in lists]), np.array([len(v) for v in lists.values()])
    shard = lexical.Postings(list(range(20_000)), [rng.randint(5, 500) for _ in range(20_000)], list(lists), sizes, places, np.ones(len(places), int), {0: 1, 1: 290, 2: 800, 3: 6_000, 4: 7_000}, 20_000, 20_000 * 250)
    heap: list = []
    scored = lexical.wand(shard, list(lists), heap)
    scores = Counter()
    for t, (a, b, _) in shard.lists.items():
        for k in range(a, b):
            scores[shard.places[k]] += shard.impacts[k]
    assert sorted((s, d) for s, _, d in heap) == sorted((s, d) for d, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10])
    assert scored < 2_000


def test_ranking_of_nothing(spark, no_rows):
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert lexical.ranked(no_rows, items).count() == 0
    some = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert lexical.ranked(some, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.ranked(some, items).collect()] == [("a", 1, 1, 287 * (10**9 // (1000 + 8 * 100)))]


def test_ranking_query_equals_sql(same):
    same(lexical.op12_lexical, lexical.OP12_SQL)


# --- sentencepiece ---


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model_path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def test_ids_and_text_equal_the_library(model_path, library, edge_rows):
    rng = random.Random(3)
    bits = [*"abc  \n\t▁é日 �\x00<s>/🙂", "</s>", "<s>", "<unk>", "<0x41>", " the"]
    texts = [t or "" for _, t in edge_rows] + ["\n", "▁", "▁▁a", " " * 500, "x" * 3_000, "日本語" * 500]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    texts += ["".join(chr(rng.choice((rng.randint(1, 0x2FFF), rng.randint(0x1F300, 0x1F9FF), rng.randint(32, 126)))) for _ in range(rng.randint(0, 40))) for _ in range(1_000)]
    for table in (pieces.ChunkTable(model_path), pieces.ChunkTable(model_path, entries=3)):
        for at in range(0, len(texts), 700):
            block = texts[at : at + 700]
            for text, (n, ids, decoded) in zip(block, table.block(block), strict=True):
                wanted = library.encode(text, add_eos=True)
                assert (n, ids, decoded) == (len(wanted), " ".join(map(str, wanted)), library.decode(wanted)), repr(text)


def test_distinct_chunks_are_segmented_once(model_path):
    table, asked = pieces.ChunkTable(model_path), []
    add = table.add
    table.add = lambda chunks: asked.extend(chunks) or add(chunks)
    list(table.block(["one two one", "two\nthree", ""]))
    list(table.block(["one three two"]))
    assert sorted(asked) == sorted({"▁one", "▁two", "\n", "three", "▁three"}) and len(asked) == len(set(asked))


def test_digests_and_frames(model_path, library, edge, edge_rows, no_rows):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = [(i, library.encode(t or "", add_eos=True)) for i, t in edge_rows]
    got = rows_of(pieces.digests(edge, model_path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))) for i, ids in wanted), key=repr)
    encoded = pieces.encode(edge, model_path)
    assert rows_of(encoded, "doc_id", "ids") == sorted(((i, ids) for i, ids in wanted), key=repr)
    assert rows_of(pieces.decode(encoded, model_path), "doc_id", "text") == sorted(((i, library.decode(ids)) for i, ids in wanted), key=repr)
    assert pieces.digests(no_rows, model_path).count() == 0


def test_other_models_are_refused(tmp_path, model_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        spec.ParseFromString(file.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="normalised"):
        pieces.ChunkTable(str(tmp_path / "other.model"))
