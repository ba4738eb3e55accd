import random

import pytest

CLASHING = "lang string, source string, n_chars long, fp long, word string, lines array<string>, spans string, matches int, row int, words string, count long, _id long, text2 string"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, ids of any order."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(400)
    shared = "\n".join(prose(12) for _ in range(4))
    return [
        (1, base), (2, base), (3, base.replace(words[3], "other", 1)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, base), (9, base),
        (None, prose(60)), (-5, "ÄÖÜ straße été ñandú 日本語 " * 40), (10, prose(20_000)), (11, "x" * 5_000), (12, "a b c d e " * 80),
        (13, prose(30) + "\n" + shared + "\n" + prose(30)), (14, shared), (15, prose(10) + "\n" + shared), (16, "\n\n\n\n\n"), (17, "# $ % & | < > *"), (18, "tab\tand\x0bvertical\x0cform\r\nfeed\x00nul"),
        *[(100 + i, prose(50)) for i in range(30)],
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The rows with further columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "w", ["l"], "s", 2, 3, "ws", 4, 5, "t2") for i, t in edge_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


@pytest.fixture(scope="session")
def no_rows(edge):
    return edge.limit(0)

