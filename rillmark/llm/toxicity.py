"""Toxic spans by a linear-chain conditional random field.

Training (on the driver, from a bounded sample): labels mark documents, so tokens get their
labels first: a token of a toxic document is toxic if its word or one of its prefixes occurs
in toxic documents again and again and hardly ever in others.  The field has two states and
log-linear features (word, prefixes of three to five letters); its weights are fitted by
stochastic gradients of the exact conditional likelihood on the whole texts of the sample, cut
into segments.  The sample holds at most ``MAX_TRAIN_DOCS`` rows and ``MAX_TRAIN_CHARS``
characters of each class, the first by a hash of the id; a text is in it whole or not at all, and
one that does not fit any more is passed over (a class of such texts only keeps its shortest one).

Scoring (a map over whole texts, no shuffle): forward-backward gives each token's marginal;
the greatest, the sum and the length of the text go through a logistic link fitted on the
sample and weighted to the share of toxic rows among all training rows.  Runs of tokens with
a marginal of one half or more are the offending spans, as character offsets.

The forward and backward recursions are ratios of two states, so a step is a fractional
linear map; maps of fixed stretches are composed side by side and then chained, which is exact
for texts of any length.

Defined results: null, empty and wordless texts get the score of a text without evidence;
repeated rows are scored each by itself, and equal texts get equal scores; very long texts are
scored whole, in time and memory in proportion to their words; an id labelled twice with
different labels takes the greater one; with no training rows of either class every score is
the share of toxic rows (0 if there are none); null labels are left out; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import blocks, documents, id_and_text, ship_code

#: Bounds of the training sample, for each class.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 2_500, 20_000_000
SEGMENT, EPOCHS, STEPS, BATCH, RATE = 48, 3, 300, 128, 0.3  # at least so many passes and steps
STRETCH = 64
SHRINK = 0.2
WORDS = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, score double, n_tokens long, n_spans long, spans array<int>"


def features(word: str) -> tuple[str, ...]:
    w = word.lower()
    return ("w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5])


def scan(a, b, c, d):
    """``x[i] = (a[i] x[i-1] + b[i]) / (c[i] x[i-1] + d[i])`` from any start; the first step must forget it (a = c = 0)."""
    import numpy as np

    n = len(a)
    rows = -(-n // STRETCH)
    pad = rows * STRETCH - n
    a, b, c, d = (np.concatenate((x, np.full(pad, fill))).reshape(rows, STRETCH) for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = a[:, 0], b[:, 0], c[:, 0], d[:, 0]
    for i in range(1, STRETCH):
        p, q, r, s = a[:, i] * p + b[:, i] * r, a[:, i] * q + b[:, i] * s, c[:, i] * p + d[:, i] * r, c[:, i] * q + d[:, i] * s
        scale = 1.0 / (np.abs(p) + np.abs(q) + np.abs(r) + np.abs(s))
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    begin, x = np.empty(rows), 1.0
    for i, (pp, qq, rr, ss) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        begin[i] = x
        x = (pp * x + qq) / (rr * x + ss)
    out = np.empty((rows, STRETCH))
    x = begin
    for i in range(STRETCH):
        x = (a[:, i] * x + b[:, i]) / (c[:, i] * x + d[:, i])
        out[:, i] = x
    return out.reshape(-1)[:n]


def marginals(emission, first, last, transition, initial: float):
    """P(state 1) of each token.  ``emission``: log-odds; ``first``/``last``: marks of each text's ends."""
    import numpy as np

    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(np.asarray(transition) - np.max(transition))
    zero = np.zeros(len(e))
    forward = scan(np.where(first, 0, e * t[1, 1]), np.where(first, e * np.exp(initial), e * t[0, 1]), np.where(first, 0, t[1, 0] + zero), np.where(first, 1, t[0, 0] + zero))
    nxt = np.concatenate((e[1:], [1.0]))
    back = [np.where(last, 0, nxt * t[1, 1]), np.where(last, 1, t[1, 0] + zero), np.where(last, 0, nxt * t[0, 1]), np.where(last, 1, t[0, 0] + zero)]
    backward = scan(*(x[::-1] for x in back))[::-1]
    odds = forward * backward
    return odds / (1 + odds)


def token_labels(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Features whose tokens count as toxic within toxic documents."""
    bad, good = Counter(), Counter()
    for words, flag in zip(texts, toxic, strict=True):
        own = {f for w in set(words) for f in features(w)}
        (bad if flag else good).update(own)
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    return {f for f, k in bad.items() if k >= max(3, min(5, n_bad // 20)) and (k / n_bad) > 20 * ((good[f] + 0.1) / n_good)}


def _segments(sequences, labels):
    """All of the texts, in training segments of bounded length."""
    for ids, y in zip(sequences, labels, strict=True):
        for s in range(0, len(y), SEGMENT):
            yield ids[s : s + SEGMENT], y[s : s + SEGMENT]


def fit_field(texts: list[list[str]], toxic: list[int], seed: int = 7) -> dict:
    """Weights of the field: ``emission`` (feature to log-odds), ``bias``, ``transition``, ``initial``."""
    import numpy as np

    rng = np.random.default_rng(seed)
    marks = token_labels(texts, toxic)
    seen: Counter = Counter()
    for words in texts:
        seen.update({f for w in set(words) for f in features(w)})
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, k in seen.items() if k >= 3))}
    memo = {w: [index.get(f, 0) for f in features(w)] for words in texts for w in set(words)}
    hits = {w: any(f in marks for f in features(w)) for w in memo}
    sequences = [np.array([memo[w] for w in words], dtype=np.int32).reshape(-1, 4) for words in texts]
    labels = [np.array([flag and hits[w] for w in words], dtype=np.int8) for words, flag in zip(texts, toxic, strict=True)]
    segments = list(_segments(sequences, labels))
    weights, squares = np.zeros(len(index) + 1), np.full(len(index) + 1, 1e-6)
    other, other_squares = np.array([-2.0, 0.0, 0.0, 0.0, 0.0, -2.0]), np.full(6, 1e-6)  # bias, transitions 00 01 10 11, initial
    for _ in range(max(EPOCHS, STEPS // -(-len(segments) // BATCH)) if segments else 0):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), BATCH):
            part = [segments[i] for i in order[at : at + BATCH]]
            size = np.array([len(y) for _, y in part])
            ids = np.zeros((len(part), SEGMENT, 4), dtype=np.int32)
            y = np.zeros((len(part), SEGMENT), dtype=np.int64)
            for k, (i, v) in enumerate(part):
                ids[k, : len(v)], y[k, : len(v)] = i, v
            real = np.arange(SEGMENT)[None, :] < size[:, None]
            score = weights[ids].sum(axis=2) + other[0]
            t = other[1:5].reshape(2, 2)
            alpha, beta = np.zeros((len(part), SEGMENT, 2)), np.zeros((len(part), SEGMENT, 2))
            emit = np.stack([np.zeros_like(score), score], axis=2)
            alpha[:, 0] = emit[:, 0] + np.array([0.0, other[5]])
            for j in range(1, SEGMENT):
                step = np.logaddexp(alpha[:, j - 1, :1] + t[0], alpha[:, j - 1, 1:] + t[1]) + emit[:, j]
                alpha[:, j] = np.where(real[:, j, None], step, alpha[:, j - 1])
            for j in range(SEGMENT - 2, -1, -1):
                inner = emit[:, j + 1] + beta[:, j + 1]
                step = np.logaddexp(t[:, 0] + inner[:, :1], t[:, 1] + inner[:, 1:])
                beta[:, j] = np.where(real[:, j + 1, None], step, 0.0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.where(real, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
            gap = np.where(real, p - y, 0)
            pair = alpha[:, :-1, :, None] + t[None, None] + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]
            both = real[:, 1:]
            expected = np.where(both[:, :, None, None], np.exp(pair), 0).sum(axis=(0, 1))
            observed = np.zeros((2, 2))
            np.add.at(observed, (y[:, :-1][both], y[:, 1:][both]), 1)
            gradient = np.bincount(ids.reshape(-1), weights=np.repeat(gap.reshape(-1), 4), minlength=len(weights)) / len(part) + 1e-5 * weights
            squares += gradient**2
            weights -= RATE * gradient / np.sqrt(squares)
            weights[0] = 0
            rest = np.concatenate(([gap.sum()], (expected - observed).reshape(-1), [gap[:, 0].sum()])) / len(part)
            other_squares += rest**2
            other -= RATE * rest / np.sqrt(other_squares)
    keep = {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}
    return {"emission": keep, "bias": float(other[0]), "transition": other[1:5].reshape(2, 2).tolist(), "initial": float(other[5])}


class Tagger:
    def __init__(self, model: dict):
        self.model = model
        self.memo: dict[str, float] = {}

    def tag(self, split: list[list[str]]):
        """Marginals of each text's tokens."""
        import numpy as np

        memo, weights, bias = self.memo, self.model["emission"], self.model["bias"]
        if len(memo) > 500_000:
            memo.clear()
        for words in split:
            for w in words:
                if w not in memo:
                    memo[w] = bias + sum(weights.get(f, 0.0) for f in features(w))
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        total = int(sizes.sum())
        if not total:
            return [np.zeros(0) for _ in split]
        emission = np.fromiter((memo[w] for words in split for w in words), dtype=float, count=total)
        ends = np.cumsum(sizes)
        first, last = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        first[(ends - sizes)[sizes > 0]] = True
        last[ends[sizes > 0] - 1] = True
        return np.split(marginals(emission, first, last, self.model["transition"], self.model["initial"]), ends[:-1])


def evidence(p):
    """What the link sees of one text: greatest marginal (log-odds), log of their sum, log of the length."""
    import numpy as np

    if not len(p):
        return (-8.0, 0.0, 0.0)
    top = min(max(float(p.max()), 1e-4), 1 - 1e-4)
    return (float(np.log(top / (1 - top))), float(np.log1p(p.sum())), float(np.log1p(len(p))))


def fit_link(rows, y, weight) -> dict:
    """Weighted ridge-logistic fit on standardised evidence, by Newton steps."""
    import numpy as np

    x, y, weight = np.asarray(rows, dtype=float), np.asarray(y, dtype=float), np.asarray(weight, dtype=float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + SHRINK * np.eye(len(beta))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - SHRINK * beta)
        beta += step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-9))  # damped: classes may be separable
    return {"mean": mean.tolist(), "spread": spread.tolist(), "beta": beta.tolist()}


def link(model: dict, x) -> float:
    import math

    z = model["beta"][0] + sum(b * (v - m) / s for b, v, m, s in zip(model["beta"][1:], x, model["mean"], model["spread"], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def _fitting(rows: list[tuple[int, int, int, int]], max_chars: int) -> list[int]:
    """Ids from (class, hash, id, characters): of each class in the order of the hash those that still fit into ``max_chars``;
    a text that does not fit is passed over and shuts out no other.  A class in which none fits keeps its shortest text."""
    out = []
    for y in (0, 1):
        own, left = sorted(r[1:] for r in rows if r[0] == y), max_chars
        taken = []
        for _, key, n in own:
            if n <= left:
                taken.append(key)
                left -= n
        if own and not taken:
            taken = [min(own, key=lambda r: r[2])[1]]
        out += taken
    return out


def sample(df: DataFrame, labels: DataFrame, label: str, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """``text, y`` of the training sample and the share of ones among all labelled rows."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = id_and_text(df, id_col, text_col)
    sizes = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n")).join(F.broadcast(chosen), docs.doc_id == F.col("_id"))
    fitting = _fitting([tuple(r) for r in sizes.groupBy("y", F.xxhash64("_id"), "_id").agg(F.sum("n")).collect()], max_chars)  # at most 2 * max_docs rows
    within = df.sparkSession.createDataFrame([(key,) for key in fitting], "_id long").join(chosen, "_id")
    return docs.join(F.broadcast(within), docs.doc_id == F.col("_id")).select("text", "y"), counts.get(1, 0) / max(1, sum(counts.values()))


def fit(df: DataFrame, labels: DataFrame, label: str, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model from the labelled rows of ``df``; a bounded sample of them goes to the driver (see :func:`sample`)."""
    rows, share = sample(df, labels, label, max_docs, max_chars, id_col, text_col)
    table = rows.toArrow()  # in one job, however many partitions the documents have
    texts, y = [WORDS.findall(t or "") for t in table.column("text").to_pylist()], table.column("y").to_pylist()
    if len(set(y)) < 2:
        return {"share": share}
    order = sorted(range(len(y)), key=lambda i: (y[i], texts[i]))  # the same model whatever the order of arrival
    texts, y = [texts[i] for i in order], [y[i] for i in order]
    field = fit_field(texts, y)
    tagger = Tagger(field)
    rows = [evidence(p) for i in range(0, len(texts), 200) for p in tagger.tag(texts[i : i + 200])]
    ones = sum(y)
    weight = [share * len(y) / ones if v else (1 - share) * len(y) / (len(y) - ones) for v in y]
    return field | {"link": fit_link(rows, y, weight), "share": share}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_tokens, n_spans, spans``; spans are start and end offsets in characters, flattened."""
    spark = df.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: features of the bounded sample

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = shared.value
        tagger = Tagger(own) if "link" in own else None
        for ids, texts in blocks(batches, 1_000_000):
            split = [WORDS.findall(t) for t in texts]
            tagged = tagger.tag(split) if tagger else [np.zeros(0)] * len(texts)
            scores, spans = [], []
            for text, p in zip(texts, tagged, strict=True):
                scores.append(link(own["link"], evidence(p)) if tagger else float(own["share"]))
                found: list[int] = []
                if len(p) and p.max() >= 0.5:
                    before = False
                    for match, hot in zip(WORDS.finditer(text), (p >= 0.5).tolist(), strict=True):
                        if hot and before:
                            found[-1] = match.end()
                        elif hot:
                            found += match.span()
                        before = hot
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array([len(w) for w in split], pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int32()))],
                names=["doc_id", "score", "n_tokens", "n_spans", "spans"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 3, 1))
    scored = score(docs, fit(docs, train, "toxic"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", "n_spans", "spans")
