"""Mixing to target weights with soft membership.

A classifier trained on the table of labels gives each document a posterior over domains (clean, poor, toxic). Rates r, one
for each document, from 0 to a documented ceiling (MOST), minimise

    sum over domains d of (sum_i r_i n_i p_id / T - w_d)^2 / s_d + RIDGE * sum_i n_i / T * (r_i - 1)^2

(n tokens, p posteriors, w target weights, T the total aimed at, s_d what there is of d, as a share of T) by projected
gradient steps in the metric n_i / T, in which the first term's curvature is at most one, with Nesterov's acceleration, until
the residuals move by less than CLOSE. A step needs only the residuals of the domains, one aggregation over the posteriors; a
document's rate follows from its posterior and the residuals so far, so that no rates are stored between steps. T is such
that the domain ANCHOR, clean documents, is asked for as many tokens as it has: its documents stay at rates of about one.
Where a domain is scarce the ceiling keeps its documents from being repeated without bound, and its target is missed;
shares() reports targets and what was reached.

Tokens are words by white space. The classifier is fitted on at most TRAIN labelled documents of at most TRAIN_CHARS
characters, those of least hash of doc_id, one row for each id; everything else covers all rows and whole texts. Without
labels of two domains, or without documents of the anchor, all rates are one. Null text counts as empty. Rows equal in doc_id
and text have the same rate and number of copies; null doc_ids are ids like others, but are never trained on. Ties don't
arise: rates are rounded by a hash. Other columns stay as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import cut, slices, trimmed

DOMAINS = ["clean", "poor", "toxic"]
TARGETS = {"clean": 0.98, "poor": 0.02, "toxic": 0.0}
ANCHOR = "clean"
TRAIN, TRAIN_CHARS, FEATURES = 2000, 20_000, 1500
RIDGE, MOST, CLOSE, STEPS = 0.02, 2.0, 1e-5, 400
SLICE = 1 << 21


def domain(quality: Column, toxic: Column) -> Column:
    """The label's domain as an index into DOMAINS; null where a label is missing."""
    return F.when(toxic == 1, 2).when((quality == 0) & (toxic == 0), 1).when((quality == 1) & (toxic == 0), 0)


def _words(text: str) -> tuple[int, set[str]]:
    words = text.lower().split()
    return len(words), {w.strip(".,;:!?#*$%&|<>\"'()") for w in words}


def _form(text: str, n: int) -> list[float]:
    """Statistics of a text's form: log words, shares of symbols and of capitals, mean word length."""
    size = max(1, len(text))
    symbols = sum(map(text.count, "#*$%&|<>"))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [np.log1p(n) / 10, min(1.0, 10 * symbols / size), min(1.0, 4 * capitals / size), len(text) / max(1, n) / 20]


class Domains:
    """The classifier: words that tell domains apart, and the form of the text."""

    def __init__(self, texts: list[str], y: np.ndarray):
        seen = [_words(t) for t in texts]
        y = np.asarray(y)
        counts = [Counter(w for i in np.flatnonzero(y == c) for w in seen[i][1]) for c in range(len(DOMAINS))]
        total = sum(counts, Counter())
        share = np.array([max(1, (y == c).sum()) for c in range(len(DOMAINS))], float)
        # how far a word's shares of the domains' documents lie apart, in units of their spread
        gain = {}
        for w, n in total.items():
            if n >= 3 and w:
                p = np.array([counts[c][w] for c in range(len(DOMAINS))]) / share
                q = n / len(y)
                gain[w] = float(np.max(np.abs(p - q) * np.sqrt(share)) / np.sqrt(q * (1 - q) + 1e-9))
        self.words = {w: i for i, w in enumerate(sorted(gain, key=lambda w: (-gain[w], w))[:FEATURES])}
        x = np.array([self.row(t) for t in texts])
        self.w, self.b = logistic.fit(x, y, len(DOMAINS), ridge=2e-4, rounds=400)
        absent = np.bincount(y, minlength=len(DOMAINS)) == 0
        self.b[absent] = -50

    def row(self, text: str) -> np.ndarray:
        n, words = _words(text)
        x = np.zeros(len(self.words) + 4)
        for w in words:
            i = self.words.get(w)
            if i is not None:
                x[i] = 1
        x[-4:] = _form(text, n)
        return x

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and posteriors (texts x domains)."""
        z = np.tile(self.b, (len(texts), 1))
        sizes = np.zeros(len(texts), np.int64)
        known = self.words.keys()
        for i, text in enumerate(texts):
            sizes[i], words = _words(text)
            hits = [self.words[w] for w in words & known]
            if hits:
                z[i] += self.w[hits].sum(axis=0)
            z[i] += np.array(_form(text, int(sizes[i]))) @ self.w[-4:]
        return sizes, logistic.softmax(z)


def trained(docs: DataFrame, labels: DataFrame) -> Domains | None:
    """The classifier, or None if the labels of docs have fewer than two domains."""
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("y")).filter("y is not null and doc_id is not null")
    texts = docs.select("doc_id", "text").filter((F.length("text") <= TRAIN_CHARS) & F.col("doc_id").isNotNull())
    # a label counts if its document is there; by hash, so that more documents bring others in, not more
    ids = texts.select("doc_id").join(known, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)
    ids = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows], np.int64)
    return Domains([r.text for r in rows], y) if len(set(y.tolist())) > 1 else None


def _judge(model: Domains | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and posteriors (texts x domains)."""
    if model is None:
        return np.array([len(t.split()) for t in texts], np.int64), np.tile(np.eye(len(DOMAINS))[0], (len(texts), 1))
    return model.posteriors(texts)


def _chance(docs: DataFrame) -> Column:
    """A number in [0, 1) for each doc_id and text."""
    return F.pmod(F.xxhash64(F.lit(17), docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _posteriors(docs: DataFrame, model: Domains | None) -> DataFrame:
    """doc_id, chance, n_tokens and the posteriors p_<domain>."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            n, p = _judge(model, [x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chance"), pa.array(n), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], ["doc_id", "chance", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _chance(docs).alias("chance"), "text").mapInArrow(work, f"doc_id {kind}, chance double, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


class Rates:
    """The rates that projected-gradient steps from one, with these residuals, lead to."""

    def __init__(self, names: list[str], ridge: float, most: float):
        self.names, self.ridge, self.most, self.residuals = names, ridge, most, []
        self.step = 1 / (1 + ridge)
        self.ahead = (1 - np.sqrt(ridge * self.step)) / (1 + np.sqrt(ridge * self.step))

    def state(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of posteriors (rows x names): the rates, and the points of the next step (rates and a share of their last move)."""
        r = y = np.ones(len(p))
        for e in self.residuals:
            to = np.clip(y - self.step * (p @ e + self.ridge * (y - 1)), 0, self.most)
            r, y = to, to + self.ahead * (to - r)
        return r, y

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(f"p_{d}").to_numpy() for d in self.names], axis=1)


def _totals(posteriors: DataFrame, rates: Rates, ahead: bool) -> np.ndarray:
    """The tokens of each domain at the rates (or at the points ahead of them); one row leaves each task."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rates.names))
        for batch in batches:
            p = rates.of(batch)
            total += (rates.state(p)[ahead] * batch.column("n_tokens").to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"t{k}" for k in range(len(total))])

    kind = ", ".join(f"t{k} double" for k in range(len(rates.names)))
    sums = posteriors.mapInArrow(work, kind).agg(*(F.sum(f"t{k}") for k in range(len(rates.names)))).first()
    return np.array([x or 0.0 for x in sums])


def fitted(posteriors: DataFrame, targets: dict[str, float] | None = None, anchor: str = ANCHOR, ridge: float = RIDGE, most: float = MOST, steps: int = STEPS) -> Rates:
    """The rates for posteriors (n_tokens, p_<domain> for the domains of targets). steps only guards against rounding that
    never comes to rest."""
    targets = targets or TARGETS
    rates = Rates(list(targets), ridge, most)
    weights = np.array(list(targets.values()), float)
    weights = weights / weights.sum()
    supply = _totals(posteriors, rates, False)
    k = rates.names.index(anchor)
    if supply[k] <= 0 or weights[k] <= 0:
        return rates
    total = supply[k] / weights[k]
    share = np.maximum(supply / total, 1e-6)
    for _ in range(steps):
        gap = np.round((_totals(posteriors, rates, True) / total - weights) / share, 9)
        if len(rates.residuals) > 1 and np.abs(gap - rates.residuals[-1]).max() < CLOSE and np.abs(gap - rates.residuals[-2]).max() < CLOSE:
            break
        rates.residuals.append(gap)
    return rates


def shares(posteriors: DataFrame, rates: Rates) -> dict[str, float]:
    """The share of tokens that each domain has at the rates; where it is below its target, the domain is too scarce."""
    got = _totals(posteriors, rates, False)
    return dict(zip(rates.names, (got / max(got.sum(), 1e-300)).tolist(), strict=True))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """One row for each of docs: doc_id, n_tokens, posteriors, rate and n_copies, the rate rounded up with the
    probability of its fraction, drawn by a hash of doc_id and text."""
    posteriors = cut(_posteriors(docs, trained(docs, labels)))
    rates = fitted(posteriors, targets, most=most)

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates.state(rates.of(batch))[0]
            copies = np.floor(r + batch.column("chance").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(copies)], [*batch.schema.names, "rate", "n_copies"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in posteriors.schema.fields)
    return posteriors.mapInArrow(work, f"{kind}, rate double, n_copies int").drop("chance")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = MOST) -> DataFrame:
    """docs, each row as many times as its n_copies says. Posteriors are made once for the rates and once more here, so that
    no text is shuffled."""
    model = trained(docs, labels)
    rates = fitted(cut(_posteriors(docs, model)), targets, most=most)

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            _, p = _judge(model, [x or "" for x in batch.column("text").to_pylist()])
            r = rates.state(p[:, [DOMAINS.index(d) for d in rates.names]])[0]
            copies = np.floor(r + batch.column("chance").to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(np.repeat(np.arange(len(copies)), copies)))], ["row"])

    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rows = docs.select(row, _chance(docs).alias("chance"), docs["text"])
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixed(docs, labels).select("doc_id", "n_tokens", *(F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS), F.round("rate", 6).alias("rate"), F.col("n_copies").cast("long"))
