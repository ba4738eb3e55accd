"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

One map over the whole texts gives document statistics (written once to the shared checkpoint
folder).  The statistics are standardised with means and spreads of the training rows, and
random Fourier features of them approximate a Gaussian kernel.  Every task sums its part of
the normal equations; the parts are added up row by row before the driver solves them (a
system of ``FEATURES`` + 1 unknowns, whatever the input).  A fifth of the training rows is kept
for calibration: their scores are counted in bins of fixed width, and isotonic regression over
the bins turns a score into a probability.  All labelled training rows are used.  If a part
lacks a class, as with few rows, all training rows stand in for it; scores in bins that hold no
calibration row lie between those of the bins around them.

Defined results: null, empty and wordless texts have statistics of zero and are scored like
any other; repeated rows are scored each by itself; without training rows of both classes
every score is the share of good rows (0 if there are none); null labels are left out; an id labelled
twice with different labels takes the greater one; rows that
share an id are scored by their own texts, and all train where the id is labelled; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import KEY, blocks, documents, id_and_text, row_key, same_row, ship_code, stored
from .toxicity import held_out

FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 0.5, 11
BINS = 400
SYMBOLS = re.compile(r"[#*$%&|<>@=_{}\\^~]")
UPPER, DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")
N_STATS = 17


def statistics(text: str) -> list[float]:
    """Shares and logs that do not depend on language; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    chars = len(text)
    letters = sum(map(len, words))
    kinds = Counter(words)
    lines = text.split("\n")
    grams = n - 2
    upper = len(UPPER.findall(text))
    return [
        math.log1p(n),
        letters / n,
        upper / letters,
        len(DIGIT.findall(text)) / letters,
        len(SYMBOLS.findall(text)) / n,
        text.count("!") / n,
        text.count("|") / n,
        text.count(".") / n,
        text.count(",") / n,
        len(kinds) / n,
        kinds.most_common(1)[0][1] / n,
        sum(k for k in kinds.values() if k == 1) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / grams if grams > 0 else 0.0,
        math.log1p(chars / len(lines)),
        1 - len(set(lines)) / len(lines),
        max(map(len, words)) / 50,
        math.log1p(len(lines)),
    ]


def stats_frame(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, x``: the id, 64 bits of the text, and its statistics, one row per input row."""
    ship_code(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, texts in blocks(batches, 1_000_000):
            own = [pa.array([i[name] for i in ids], pa.int64()) for name in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "key", "x"])

    docs = id_and_text(df, id_col, text_col)
    return docs.select(F.struct("doc_id", row_key(F.col("text")).alias("key")), "text").mapInArrow(run, "doc_id long, key long, x array<double>")


def _matrix(column, width: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


class Kernel:
    """Random Fourier features of standardised statistics, with a constant in front."""

    def __init__(self, mean: list[float], spread: list[float]):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.mean, self.spread = np.array(mean), np.maximum(np.array(spread), 1e-6)
        self.w, self.b = rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, x):
        import numpy as np

        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.ones(len(x)), np.cos(z @ self.w + self.b) * math.sqrt(2 / FEATURES)])


def isotonic(bins: list[tuple[int, int, int]]) -> list[tuple[int, float]]:
    """Pool adjacent violators over (bin, rows, ones), sorted by bin; returns (bin, probability)."""
    pools: list[list[float]] = []  # ones, rows, bins
    for _, rows, ones in bins:
        pools.append([ones, rows, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            ones_, rows_, n_ = pools.pop()
            pools[-1] = [pools[-1][0] + ones_, pools[-1][1] + rows_, pools[-1][2] + n_]
    fitted = [p[0] / p[1] for p in pools for _ in range(int(p[2]))]
    return [(b, p) for (b, _, _), p in zip(bins, fitted, strict=True)]


def bin_of(raw):
    import numpy as np

    return np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)


def fit(stats: DataFrame, labels: DataFrame, label: str) -> dict:
    """The model from rows of ``stats`` (``doc_id, x``) that have a label."""
    import numpy as np

    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y")).where("_id is not null and y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    rows = stats.join(marks, stats.doc_id == F.col("_id")).select("x", "y", (F.pmod(F.xxhash64("_id"), F.lit(5)) == 0).alias("calibrate"))
    x = [F.get("x", F.lit(i)) for i in range(N_STATS)]
    kept = F.when(F.col("calibrate"), F.col("y"))
    first = rows.agg(F.count("*"), F.sum("y"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x], F.count(kept), F.sum(kept)).first()
    n, ones = first[0], first[1] or 0
    share = ones / n if n else 0.0
    if not 0 < ones < n:
        return {"share": share}
    mean, spread = list(first[2 : 2 + N_STATS]), list(first[2 + N_STATS : 2 + 2 * N_STATS])
    n_kept, ones_kept = first[-2], first[-1] or 0
    fitting = rows.where("not calibrate") if 0 < ones - ones_kept < n - n_kept else rows
    calibrating = rows.where("calibrate") if 0 < ones_kept < n_kept else rows
    d = FEATURES + 1

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernel, sums = Kernel(mean, spread), np.zeros((d, d + 1))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(y), 4096):
                phi = kernel(_matrix(batch.column(0).slice(at, 4096), N_STATS))
                sums += phi.T @ np.column_stack([phi, y[at : at + 4096]])
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    parts = fitting.select("x", "y").mapInArrow(part, "i int, v array<double>")
    summed = parts.groupBy("i").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in range(d + 1)])
    system = np.array([list(r)[1:] for r in summed.orderBy("i").collect()])
    weights = np.linalg.solve(system[:, :d] + RIDGE * np.eye(d), system[:, d])

    def binned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kernel = Kernel(mean, spread)
        for batch in batches:
            raw = kernel(_matrix(batch.column(0), N_STATS)) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(bin_of(raw), pa.int64()), batch.column(1)], names=["bin", "y"])

    counts = calibrating.select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    bins = [(r["bin"], r["n"], int(r["ones"])) for r in counts.orderBy("bin").collect()]
    return {"share": share, "mean": mean, "spread": spread, "weights": weights.tolist(), "steps": isotonic(bins)}


def score(stats: DataFrame, model: dict) -> DataFrame:
    """``doc_id, key, score``: calibrated, linear between the bins, within 0 and 1."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = shared.value
        ready = bool(own.get("steps"))
        if ready:
            kernel, weights = Kernel(own["mean"], own["spread"]), np.array(own["weights"])
            at, level = (np.array(c, dtype=float) for c in zip(*own["steps"], strict=True))
        for batch in batches:
            n = batch.num_rows
            if ready and n:
                raw = kernel(_matrix(batch.column(2), N_STATS)) @ weights
                place = np.clip((raw + 0.5) * BINS / 2 - 0.5, 0, BINS - 1)
                value = 0.002 + 0.996 * np.interp(place, at, level) + 0.001 * (2 * place / BINS - 1)
            else:
                value = np.full(n, float(own["share"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(value, 0, 1))], names=["doc_id", "key", "score"])

    return stats.select("doc_id", "key", "x").mapInArrow(run, "doc_id long, key long, score double")


def classify(df: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, score`` for every row of ``df``; ``key`` (see ``row_key``) tells rows apart that share an id."""
    stats = stored(stats_frame(df, id_col, text_col))
    return score(stats, fit(stats, labels, label))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))


def keep_good(spark: SparkSession, df: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` that are good rather than bad, each judged by its own text; all columns stay."""
    scores = classify(df, training_rows(spark, sf_dir)).where(F.col("score") >= least)
    good = scores.select(F.col("doc_id").alias(KEY), F.col("key").alias(KEY + "_text")).distinct()
    return df.join(good, same_row(F.col("doc_id"), F.col(KEY), row_key(F.col("text")), F.col(KEY + "_text")), "left_semi")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(documents(spark, sf_dir), training_rows(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
