import random
import re

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from rillmark.llm import decontamination as D


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, size=10):
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for item, itext in items:
            w = words(itext)
            n = min(len(w), size)
            for i in range(max(len(w) - size, 0) + 1) if w else []:
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == w[i : i + n]:
                        hit.update(range(s, s + n))
                        found.add(str(item))
        out.append((key, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark(spark, edge_rows):
    texts = dict(edge_rows)
    rng = random.Random(8)
    one = texts[1].split()
    items = [
        (0, " ".join(one[20:45])), (1, " ".join(one[:10]).upper() + "!"), (2, "one"), (3, None), (4, ""), (5, "straße, ÉTÉ ñandú"), (6, "Straße été"), (7, "a b c d e a b c d e a"),
        (8, " ".join(texts[10].split()[-30:])), (9, " ".join(rng.sample(one, 12))), (10, "one"), (10, "one"), (11, " ".join(one[100:109] + ["other"] + one[110:125])), (12, "x" * 5_000),
    ]
    return items, spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, word string")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_matches_equal_brute_force(edge, edge_rows, benchmark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(D, "BROADCAST_IDS", limit)
    items, frame = benchmark
    got = rows_of(D.contamination(edge, frame), "doc_id", "n_words", "n_hit", "items")
    assert got == plain(edge_rows, items)


def test_rows_that_share_an_id_are_compared_by_their_own_text(spark, benchmark):
    items, frame = benchmark
    rows = [(1, items[0][1]), (1, "nothing here"), (None, "before " + items[0][1]), (None, "clean")]
    assert rows_of(D.contamination(spark.createDataFrame(rows, "doc_id long, text string"), frame), "doc_id", "n_words", "n_hit", "items") == plain(rows, items)


def test_items_without_an_id_hit(spark, benchmark):
    items, _ = benchmark
    items = [(None, items[0][1]), (None, "one two three"), (7, items[1][1]), (7, "x y z"), (None, None)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "so " + items[0][1]), (2, "one two three x y z"), (3, items[2][1]), (None, "nothing")]
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()}
    assert got == {1: (len(words(items[0][1])), [None]), 2: (6, ["7", None]), 3: (10, ["7"]), None: (0, [])}


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_segments_lose_no_window(spark, edge, edge_rows, benchmark, monkeypatch, segment):
    monkeypatch.setattr(D, "SEGMENT", segment)
    items, frame = benchmark
    assert rows_of(D.contamination(edge, frame), "doc_id", "n_words", "n_hit", "items") == plain(edge_rows, items)


def test_one_word_repeated_in_text_and_item(spark):
    """As many alignments as words, not as many as pairs of places."""
    docs = spark.createDataFrame([(1, "la " * 20_000), (2, "la " * 9 + "lu la"), (3, "lu " + "la " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 20_000), (2, "la " * 300 + "lu " + "la " * 300), (3, "la lu " * 5_000)], "item_id long, text string")
    assert rows_of(D.contamination(docs, items), "doc_id", "n_words", "n_hit", "items") == [(1, 20_000, 20_000, ["1", "2"]), (2, 11, 11, ["2"]), (3, 31, 31, ["1", "2"])]


def test_greek_words_match_whatever_stands_around_them(spark):
    items = [(0, "ΟΔΟΣ Α"), (1, "ΟΔΟΣ.Β"), (2, "οδος γ"), (3, "ΣΣ")]
    docs = [(1, "x ΟΔΟΣ.Α y"), (2, "x ΟΔΟΣ Β"), (3, "οδοσ γ"), (4, "ΣΣ.Σ"), (5, "οδος γ"), (6, "ΟΔΟΣ Α")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), frame), "doc_id", "n_words", "n_hit", "items") == plain(docs, items)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_only_a_to_z_are_made_lower(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(D, "BROADCAST_IDS", limit)
    items = [(0, "ΟΔΟΣ alpha beta"), (1, "İstanbul ISTANBUL"), (2, "\u212A kelvin"), (3, "straSSe ẞ"), (4, "ﬀ Ǆ Ω")]
    docs = [
        (1, "x ΟΔΟΣ.alpha beta y"), (2, "οδος alpha beta"), (3, "İSTANBUL istanbul İstanbul iStAnBuL"), (4, "i̇stanbul istanbul"), (5, "\u212A KELVIN k kelvin"), (6, "STRASSE ẞ strasse ß"),
        (7, "ﬀ Ǆ Ω ﬀ ǅ Ω ff Ǆ Ω ﬀ Ǆ \u2126"), (8, "ΟΔΟΣ ALPHA-BETA"),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), frame), "doc_id", "n_words", "n_hit", "items") == plain(docs, items)


def test_texts_without_an_alignment_are_not_shuffled(edge, benchmark):
    plan = D.matched(edge, benchmark[1]).select("doc_id", "matches")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and "LeftOuter, " in plan.replace("broadcast", "") and "strategy=broadcast" in plan


def test_filter_keeps_columns_and_clean_rows(edge, edge_rows, benchmark, no_rows):
    items, frame = benchmark
    kept = D.drop_contaminated(edge, frame)
    assert kept.columns == edge.columns
    assert rows_of(kept, "doc_id") == sorted(((r[0],) for r in plain(edge_rows, items) if not r[2]), key=repr)
    assert D.contamination(no_rows, frame).count() == 0
    assert D.drop_contaminated(edge, frame.limit(0)).count() == edge.count()


def test_proximity_tolerates_moved_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (2, "alpha gamma beta delta epsilon zeta eta iota theta kappa"), (3, "alpha x x x beta gamma delta epsilon zeta eta theta iota kappa")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    near = lambda slop: [r[0] for r in rows_of(D.phrase_matches(docs, bench, slop=slop), "doc_id")]
    assert near(0) == [1] and near(1) == [1, 2] and near(12) == [1, 2, 3]


def test_the_key_of_a_row_is_made_once_not_for_every_word(edge):
    plan = D.tokens_of(edge, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")


def test_query_equals_its_sql(same):
    same(D.op7_decontamination, D.OP7_SQL)


def test_main_path_has_no_python(edge, benchmark):
    plan = D.contamination(edge, benchmark[1]).select(F.sum("n_hit"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
