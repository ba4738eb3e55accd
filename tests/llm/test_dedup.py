import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import rows_of
from xxhash import xxh64_intdigest

from rillmark.llm import line_windows, simhash, suffix_dedup

# --- suffix arrays ---


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_equals_sorting(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 80)))
    assert suffix_dedup.suffix_array(data, 100).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def repeated_bytes(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for key, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removal(df, **options):
    got = suffix_dedup.dedup_bytes(df, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=repr)


@pytest.fixture(scope="module")
def byte_rows():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij é") for _ in range(3_000))
    noise = lambda: "".join(rng.choice("klmn") for _ in range(150))
    return [
        (1, base), (2, base[500:900] + "x" * 300), (3, "y" * 700), (4, None), (5, ""), (6, "short"), (7, base), (7, base), (8, "ab" * 400), (9, base[100:299]),
        (10, base[100:400] + "q" + base[401:800]), (None, base[1000:1300]), (None, "z1" * 50 + base[40:90]), (7, "w" + base[2000:2150] + noise()), (11, "m" + noise() + noise()), (11, base[2500:2900]), *[(20 + i, noise() + base[1500:1750] + noise()) for i in range(12)],
    ]


@pytest.mark.parametrize("options", [{}, {"hot_segments": 3}])
def test_removed_bytes_equal_brute_force(spark, byte_rows, options):
    assert removal(spark.createDataFrame(byte_rows, "doc_id long, text string"), **options) == repeated_bytes(byte_rows)


def test_bytes_of_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh") for _ in range(600)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (None, a), (None, c), (3, c[:100] + b[:150]), (3, c[:100] + b[:150]), (4, c[:199])]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string")) == repeated_bytes(rows)


def test_bytes_of_edge_rows(edge, edge_rows, no_rows):
    assert removal(edge) == repeated_bytes(edge_rows)
    assert suffix_dedup.dedup_bytes(no_rows).count() == 0


def test_long_texts_in_parts(byte_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    texts = [t.encode() for _, t in byte_rows if t]
    windows = Counter()
    for keys, offsets, parts in suffix_dedup.pieces(list(range(len(texts))), texts):
        for k, at, part in zip(keys, offsets, parts, strict=True):
            assert texts[k][at : at + len(part)] == part
            windows.update((k, at + i) for i in range(len(part) - 199))
    assert windows == Counter((k, i) for k, t in enumerate(texts) for i in range(max(0, len(t) - 199)))


def test_suffix_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(suffix_dedup.op3_suffix_dedup(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeated_bytes(docs)


def test_suffix_query_equals_its_sql(same):
    same(suffix_dedup.op3_suffix_dedup, suffix_dedup.OP3_SQL)


# --- SimHash ---


def plain_fingerprint(text, lower=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_trie_join_finds_every_component():
    rng = np.random.default_rng(1)
    values = set()
    for b in rng.integers(0, 2**63, 60):
        for _ in range(5):
            x = int(b)
            for j in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(j)
            values.add(x)
    values = sorted(values)
    parent = list(range(len(values)))
    for a, b in simhash.trie_links(np.array(values, dtype=np.uint64)).tolist():
        assert bin(values[a] ^ values[b]).count("1") <= 3
        old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
        parent = [new if p == old else p for p in parent]
    assert parent == components(values)


def test_dense_groups_are_settled_together():
    import time

    rng = np.random.default_rng(2)
    cube = np.unique(rng.integers(0, 1 << 16, 16_384).astype(np.uint64) * np.uint64(0x0001_0001_0001) & np.uint64(0x00FF_00F0_0F0F) ^ (np.uint64(1) << np.uint64(40)))
    began = time.perf_counter()
    found = simhash.trie_links(cube)
    assert time.perf_counter() - began < 20
    parent = list(range(len(cube)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in found.tolist():
        assert bin(int(cube[a]) ^ int(cube[b])).count("1") <= 3 and root(a) != root(b)  # a forest
        parent[max(root(a), root(b))] = min(root(a), root(b))
    every = {int(v): i for i, v in enumerate(cube)}
    for v, i in every.items():
        for x in range(64):
            j = every.get(v ^ (1 << x))
            assert j is None or root(i) == root(j)


def test_groups_are_split_until_they_are_small_enough(spark):
    rng = random.Random(12)
    base, free = rng.getrandbits(64), rng.sample(range(64), 7)
    dense = [base ^ sum(1 << b for k, b in enumerate(free) if i >> k & 1) for i in range(128)]
    values = sorted({v - (v >> 63 << 64) for v in dense + [rng.getrandbits(64) for _ in range(50)]})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for hot_group in (4096, 9):
        edges = simhash.links(fps, hot_group)
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in map(tuple, edges.collect()))
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        least = min(v - (v >> 63 << 64) for v in dense)
        assert {roots.get(v - (v >> 63 << 64), least) for v in dense} == {least} and len(roots) == 127


def test_simhash_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = components(prints)
    least = {}
    for (i, _), q in zip(docs, roots, strict=True):
        least[q] = min(i, least.get(q, i))
    wanted = sorted(((i, f"{p:016x}", least[q]) for (i, _), p, q in zip(docs, prints, roots, strict=True)), key=repr)
    assert rows_of(simhash.op4_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id") == wanted


def test_bands_lose_no_pair():
    rng = random.Random(4)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        agree = [m for m in simhash.band_masks() if (x ^ y) & m == 0]
        assert agree and all(any((x ^ y) & f == 0 for f in simhash.finer_masks(m)) for m in agree)


@pytest.mark.parametrize("hot_group", [4096, 2])
def test_components_of_edge_rows(edge, edge_rows, hot_group):
    prints = [plain_fingerprint(t) for _, t in edge_rows]
    roots = components(prints)
    least = {r: min((i for (i, _), q in zip(edge_rows, roots, strict=True) if q == r and i is not None), default=None) for r in set(roots)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    wanted = sorted(((i, p, least[r]) for (i, _), p, r in zip(edge_rows, signed, roots, strict=True)), key=repr)
    assert rows_of(simhash.near_duplicates(edge, hot_group=hot_group), "doc_id", "fp", "component_id") == wanted


def test_chain_of_links_is_one_component(spark):
    chain = [(1 << (3 * i)) - 1 for i in range(20)]
    edges = spark.createDataFrame([(chain[i], chain[i + 1]) for i in range(19)] + [(10**15, 10**15 + 1)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {roots[v] for v in chain[1:]} == {0} and roots[10**15 + 1] == 10**15


def test_keep_one_and_no_rows(edge, no_rows):
    near = simhash.near_duplicates(edge)
    kept = simhash.keep_one(edge, near)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids and 10 in ids
    assert simhash.near_duplicates(no_rows).count() == 0


# --- lines ---


def plain_lines(rows, size=3):
    first, places = {}, {}
    signed = lambda t: (h := xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    for key, text in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        lines = text.split("\n")
        for n in range(len(lines) - size + 1):
            window = "\n".join(lines[n : n + size])
            if re.search(r"[^\x09-\x0D\x20]", window) and first.setdefault(window, (key, text, n)) != (key, text, n):
                places.setdefault((key, text), set()).update(range(n, n + size))
    out = []
    for key, text in rows:
        lines = [] if text is None else text.split("\n")
        gone = places.get((key, text), set())
        kept = None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out.append((key, kept, len(lines), len(gone), sum(1 for n in gone if n - 1 not in gone)))
    return sorted(out, key=repr)


def test_lines_of_edge_rows(spark, edge, edge_rows, no_rows):
    assert rows_of(line_windows.cut_lines(edge), "doc_id", "text", "n_lines", "n_removed", "n_spans") == plain_lines(edge_rows)
    assert line_windows.dedup_lines(edge).columns == edge.columns and line_windows.cut_lines(no_rows).count() == 0
    many = [(i, "\n".join(f"l{(i * j) % 7}" for j in range(60))) for i in range(8)]
    assert rows_of(line_windows.cut_lines(spark.createDataFrame(many, "doc_id long, text string")), "doc_id", "text", "n_lines", "n_removed", "n_spans") == plain_lines(many)


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    shared = "\n".join(f"line {i} of a passage" for i in range(4))
    rows = [(1, "a\n" + shared), (1, "only\nhere\nfound"), (1, shared + "\nz"), (None, "b\n" + shared), (None, "x\ny\nz"), (None, "x\ny\nz"), (2, shared), (2, shared), (0, "first\n" + shared)]
    got = rows_of(line_windows.cut_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text", "n_lines", "n_removed", "n_spans")
    assert got == plain_lines(rows) and (1, "only\nhere\nfound", 3, 0, 0) in got


def test_line_query_equals_its_sql(same):
    same(line_windows.op9_line_windows, line_windows.OP9_SQL)
