"""Quality rules: fixed base rules, then robust multivariate outliers.

Each document gives a vector of five transformed statistics. For each language and source a minimum-covariance-determinant
estimate of centre and scatter is made. There are three starts, all about the coordinate-wise medians: scatter from median
absolute deviations, from products of hyperbolic tangents, and from spatial signs. From each start concentration steps keep
the COVER share of rows of least Mahalanobis distance and estimate anew, until no group's determinant falls by a share of
STILL any more; the start of least determinant is taken. A step is two aggregations over the numbers (never the texts) for
all starts together. Documents whose distance is beyond the chi-squared quantile CUTOFF_P are rejected.

Groups of under LEAST rows that pass the base rules are judged by the estimate for their language without a source of its
own, and where that is as small, by one estimate over all rows. Each coordinate has a least spread (FLOOR), so that a
statistic that is nearly constant in a group does not make harmless differences outliers. Only rows that pass the base rules
enter the estimates.

Null text has no words (and fails); null lang or source is a value of its own. The verdict depends on text, lang and source
alone: repeated rows and rows that share a doc_id are judged as any others, null doc_ids too. Very long texts are counted
whole. Ties at the bound of a step are all kept. Other columns stay as they are, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, trimmed
from .pretokens import code_points, span_hashes

WHITE, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
COVER, STILL, STEPS, LEAST, MANY_GROUPS = 0.75, 1e-3, 30, 50, 4096
#: The transformed statistics with their least spread: log words, log mean length of words, and shares of symbols in
#: characters, of repeated lines in words and of repeated windows in words, as square roots.
FLOOR = {"x_words": 1.0, "x_length": 0.1, "x_symbols": 0.04, "x_lines": 0.08, "x_repeat": 0.2}
CUTOFF_P = 1 - 1e-7
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SLICE = 1 << 19


def text_statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """The base statistics of each text."""
    joined = "\n".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(size + 1)])
    cp = code_points(joined)
    word = ~(((cp >= 9) & (cp <= 13)) | (cp == 32))
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(at, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    word_chars = np.bincount(doc, ends - starts, minlength=len(texts)).astype(np.int64)
    n_repeat = np.zeros(len(texts), np.int64)
    if len(starts) >= WINDOW:
        total = []
        for h in span_hashes(cp, starts, ends):
            w = np.zeros(len(h) - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - WINDOW + 1 + k]
            w ^= w >> np.uint64(29)
            total.append(w * np.uint64(0xBF58476D1CE4E5B9) + doc[: len(w)].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        inside = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        a, b = total[0][inside], total[1][inside]
        order = np.argsort(a, kind="stable")
        a, b, d = a[order], b[order], doc[inside][order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (d[1:] == d[:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        cover = np.zeros(len(starts) + 1, np.int64)
        begin = inside[order][twice]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WINDOW, -1)
        n_repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(texts))
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        dup.append(len(lines) - len(set(lines)))
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    return dict(zip(BASE, (n_words, word_chars, np.array(symbols, np.int64), np.array(dup, np.int64), n_repeat), strict=True))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row of docs."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            found = text_statistics([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(v, pa.int64()) for v in found.values())], ["doc_id", "lang", "source", *BASE])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(work, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{x} long" for x in BASE))


def chi2_cdf(x: float, p: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = p / 2, x / 2
    if x > 200:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def _vectors(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return rows.withColumns(
        {
            "x_words": F.log1p("n_words"),
            "x_length": F.log(chars / words),
            "x_symbols": F.sqrt(F.col("n_symbols") / chars),
            "x_lines": F.sqrt(F.col("n_dup_lines") / words),
            "x_repeat": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


NAMES = list(FLOOR)
P = len(NAMES)
UPPER = [(i, j) for i in range(P) for j in range(i, P)]
STARTS = ("spread", "tangent", "sign")
KEYS = ["g_lang", "g_source"]
MODEL = [*(f"m_{i}" for i in range(P)), *(f"i_{i}_{j}" for i, j in UPPER), "det"]
MODELS = ", ".join(["g_lang string", "g_source string", *(f"{c}_{s} double" for s in STARTS for c in MODEL)])


def _distance(start: str) -> Column:
    d = [F.col(x) - F.col(f"m_{i}_{start}") for i, x in enumerate(NAMES)]
    return sum((d[i] * d[j] * F.col(f"i_{i}_{j}_{start}") * (1 if i == j else 2) for i, j in UPPER), F.lit(0.0))


def floored(scatter: np.ndarray) -> np.ndarray:
    """scatter with the least spreads; on the diagonal alone, which keeps it positive."""
    out, least = scatter.copy(), np.array(list(FLOOR.values())) ** 2
    spread = np.einsum("kii->ki", out)
    spread += np.maximum(0, least - spread)
    spread += least * 1e-3
    return out


def _filled(f: pd.DataFrame, start: str, out: pd.DataFrame, centre: np.ndarray, scatter: np.ndarray) -> None:
    inverse = np.linalg.inv(scatter)
    for i in range(P):
        out[f"m_{i}_{start}"] = centre[:, i]
    for i, j in UPPER:
        out[f"i_{i}_{j}_{start}"] = inverse[:, i, j]
    out[f"det_{start}"] = np.linalg.det(scatter)


def _matrix(f: pd.DataFrame, name: str) -> np.ndarray:
    out = np.zeros((len(f), P, P))
    for i, j in UPPER:
        out[:, i, j] = out[:, j, i] = f[f"{name}_{i}_{j}"].to_numpy(float)
    return out


def _first_models(sums: DataFrame) -> DataFrame:
    """From medians, spreads and the mean products of tangents and signs of each group: its model for each start."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[KEYS].copy()
            centre, spread = (f[[f"{c}_{i}" for i in range(P)]].to_numpy(float) for c in ("m", "d"))
            both = spread[:, :, None] * spread[:, None, :]
            _filled(f, "spread", out, centre, floored(np.einsum("ki,ij->kij", spread**2, np.eye(P))))
            for start in STARTS[1:]:
                _filled(f, start, out, centre, floored(_matrix(f, start) * both))
            yield out

    return sums.mapInPandas(work, MODELS)


def _next_models(sums: DataFrame, consistency: float) -> DataFrame:
    """From counts, sums and sums of products of the rows kept for each start: the new models."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[KEYS].copy()
            for start in STARTS:
                n = f[f"n_{start}"].to_numpy(float)[:, None]
                centre = f[[f"s_{i}_{start}" for i in range(P)]].to_numpy(float) / n
                part = f[[f"p_{i}_{j}_{start}" for i, j in UPPER]].rename(columns=lambda c, end=f"_{start}": c.removesuffix(end))
                scatter = (_matrix(part, "p") / n[:, :, None] - centre[:, :, None] * centre[:, None, :]) * consistency
                _filled(f, start, out, centre, floored(scatter))
            yield out

    return sums.mapInPandas(work, MODELS)


def estimates(fit: DataFrame, with_table: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The model (m_i, i_i_j, det) of each group of fit (KEYS and NAMES). with_table joins a table with one row for each
    group to rows."""
    middle = cut(fit.groupBy(*KEYS).agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"m_{i}") for i, x in enumerate(NAMES))))
    off = with_table(fit, middle).groupBy(*KEYS).agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"d_{i}") for i, x in enumerate(NAMES)))
    spreads = [F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(FLOOR[x])).alias(f"d_{i}") for i, x in enumerate(NAMES)]
    start = cut(middle.join(off, KEYS).select(*KEYS, *(f"m_{i}" for i in range(P)), *spreads))
    z = [(F.col(x) - F.col(f"m_{i}")) / F.col(f"d_{i}") for i, x in enumerate(NAMES)]
    t = [F.tanh(v) for v in z]
    long = F.greatest(sum((v * v for v in z), F.lit(0.0)), F.lit(1e-12))
    products = [F.avg(t[i] * t[j]).alias(f"tangent_{i}_{j}") for i, j in UPPER] + [(F.avg(z[i] * z[j] / long) * P).alias(f"sign_{i}_{j}") for i, j in UPPER]
    models = cut(_first_models(start.join(with_table(fit, start).groupBy(*KEYS).agg(*products), KEYS)))
    consistency = COVER / chi2_cdf(chi2_quantile(COVER, P), P + 2)
    v = [F.col(x) for x in NAMES]
    dets = [f"det_{s}" for s in STARTS]
    for k in range(STEPS):
        near = with_table(fit, models).select(*KEYS, *NAMES, *(_distance(s).alias(f"x_{s}") for s in STARTS))
        bounds = cut(near.groupBy(*KEYS).agg(*(F.percentile_approx(f"x_{s}", COVER, 10_000).alias(f"b_{s}") for s in STARTS)))
        sums = []
        for s in STARTS:
            kept = F.col(f"x_{s}") <= F.col(f"b_{s}")
            sums += [F.count_if(kept).alias(f"n_{s}")] + [F.sum(F.when(kept, v[i])).alias(f"s_{i}_{s}") for i in range(P)] + [F.sum(F.when(kept, v[i] * v[j])).alias(f"p_{i}_{j}_{s}") for i, j in UPPER]
        after = cut(_next_models(with_table(near, bounds).groupBy(*KEYS).agg(*sums), consistency))
        falls = F.greatest(*(F.lit(1.0) - F.col(f"after.{d}") / F.col(f"before.{d}") for d in dets))
        moved = k == 0 or not after.alias("after").join(models.alias("before"), KEYS).filter(falls > STILL).isEmpty()
        models = after
        if not moved:
            break
    best = F.least(*dets)
    pick = lambda c: F.coalesce(*(F.when(F.col(f"det_{s}") == best, F.col(f"{c}_{s}")) for s in STARTS))
    return cut(models.select(*KEYS, *(pick(c).alias(c) for c in MODEL)))


def judged(stats: DataFrame) -> DataFrame:
    """stats (as statistics() gives them) with base_failed, distance and kept. distance is null where no row passes the base
    rules."""
    n_words = F.col("n_words")
    rows = _vectors(stats).withColumn("base_failed", (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n_words))
    # 'v' and 'n' keep nulls apart from strings; small groups have the source 'rest', small languages are 'all'
    mark = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))
    rows = cut(rows.withColumns({"g_lang": mark("lang"), "g_source": mark("source")}))
    sizes = cut(rows.groupBy(*KEYS).agg(F.sum((~F.col("base_failed")).cast("long")).alias("fit")))
    few = sizes.limit(MANY_GROUPS + 1).count() <= MANY_GROUPS

    def with_table(left: DataFrame, table: DataFrame) -> DataFrame:
        return left.join(F.broadcast(table) if few else table.hint("merge"), KEYS)

    source = F.when(F.col("fit") >= LEAST, F.col("g_source")).otherwise(F.lit("rest"))
    rest = sizes.withColumn("to_source", source)
    lang = rest.groupBy("g_lang", "to_source").agg(F.sum("fit").alias("fits")).filter((F.col("to_source") != "rest") | (F.col("fits") >= LEAST)).withColumn("big", F.lit(True))
    names = cut(rest.join(lang, ["g_lang", "to_source"], "left").select(*KEYS, F.when(F.col("big"), F.col("g_lang")).otherwise(F.lit("all")).alias("to_lang"), F.when(F.col("big"), F.col("to_source")).otherwise(F.lit("all")).alias("to_source")))
    rows = cut(with_table(rows, names).drop(*KEYS).withColumnsRenamed({"to_lang": "g_lang", "to_source": "g_source"}))
    fit = rows.filter(~F.col("base_failed")).select(*KEYS, *NAMES)
    everything = fit.withColumns({"g_lang": F.lit("all"), "g_source": F.lit("all")})
    models = estimates(fit.filter("g_lang != 'all'").unionByName(everything), with_table)
    own = models.select(*KEYS, *(F.col(c).alias(f"{c}_own") for c in MODEL))
    seen = rows.join(F.broadcast(own) if few else own.hint("merge"), KEYS, "left")
    out = seen.select(*stats.columns, "base_failed", _distance("own").alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(CUTOFF_P, P)))


def drop_poor(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected."""
    text = F.coalesce(docs["text"], F.lit(""))
    named = docs.select(F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).alias("doc_id"), "lang", "source", "text")
    verdict = cut(judged(statistics(named)).filter("kept").select(F.col("doc_id.h1").alias("h1"), F.col("doc_id.h2").alias("h2"), "lang", "source").distinct())
    same = [F.xxhash64(text) == verdict.h1, F.xxhash64(F.lit(1), text) == verdict.h2, F.equal_null(docs["lang"].cast("string"), verdict.lang), F.equal_null(docs["source"].cast("string"), verdict.source)]
    return docs.join(verdict.hint("merge"), same, "left_semi")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(statistics(docs)).select("doc_id", *BASE, "base_failed", "kept", F.round("distance", 6).alias("distance"))
