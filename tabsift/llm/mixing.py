"""Mixing sources to target weights by soft membership.

A softmax classifier over hashed words and a few style bins, trained in numpy on a bounded sample of
the labelled table, gives every document a posterior over domains. Nonnegative document rates,
all 1 at first, are then fitted by projected gradient least squares so that the expected tokens of
each domain (rate x tokens x posterior, summed over all documents) match its target; steps go on until
they do, and targets that cannot be met are reported by a warning. The driver
holds only a vector of domains for each step; a document's rate follows from its posterior and those
vectors, so every step is one scan with a sum and no step writes anything. Where documents of the
largest domain must stay, the steps are projected onto rates of at least 1 for those that most
likely belong to it.

A null or empty text has no tokens, the classifier's prior as posterior, and its rate has no
effect. Without labelled documents all have the domain `clean`. Rows without doc_id or label teach
nothing; of several labels of a doc_id the least counts, of several texts the one of the least hash.
Repeated rows are documents like others, and equal texts have equal posteriors and rates. A very
long text is a slice of its own. Only doc_id and text, and the labels' doc_id, quality and toxic are
read, so further columns may have any name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, flat_bytes, least_hash_rows, materialize, one_thread, pieces, trim
from .shingles import words

DOMAINS = ["clean", "poor", "toxic"]
#: Labelled documents of each domain that the classifier is fitted on, hashed words, and bytes hashed at once.
SAMPLE, BUCKETS, TEXT = 2000, 1 << 18, 1 << 19
#: Sampled documents that must share a feature for it to have a weight, and distinct features of a domain's sample (but for its first document).
SHARED, FEATURES = 10, 4_000_000
BINS = 8
#: Target shares of the mixture's tokens. The domain with the largest share keeps its tokens.
TARGETS = {"clean": 0.93, "poor": 0.04, "toxic": 0.03}
TOLERANCE = 1e-4
#: The fit ends unmet, with a warning, where so many steps lower the weighted residual by less than a thousandth.
PATIENCE = 50


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "clean")


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, the rows' offsets in them, and the rows' numbers of words."""
    h, off = words(text)
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | (h % np.uint64(BUCKETS)))
    raw, at = flat_bytes(text)
    size = np.maximum(np.diff(at), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[at[1:]] - total[at[:-1]]) / size

    owner = (key >> np.uint64(32)).astype(np.int64)
    distinct = np.bincount(owner, minlength=len(n)) / np.maximum(n, 1)
    upper = share((raw >= 65) & (raw <= 90))
    marks = share((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 127))
    digits = share((raw >= 48) & (raw <= 57))
    style = [np.log2(1 + n) / 2, distinct * BINS, upper * 4 * BINS, marks * 4 * BINS, digits * 4 * BINS]
    style = np.stack([BUCKETS + BINS * i + np.clip(s, 0, BINS - 1).astype(np.int64) for i, s in enumerate(style)], 1)
    number = np.concatenate([(key & np.uint64(0xFFFFFFFF)).astype(np.int64), style.ravel()])
    owner = np.concatenate([owner, np.repeat(np.arange(len(n)), style.shape[1])])
    order = np.argsort(owner, kind="stable")
    return number[order], np.append(0, np.cumsum(np.bincount(owner, minlength=len(n)))), n


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posteriors(self, number: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) < 2:
            return np.zeros((0, len(self.names)))
        z = np.add.reduceat(self.weights[number], off[:-1]) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(number: np.ndarray, off: np.ndarray, y: np.ndarray, names: list[str], prior: np.ndarray, epochs: int = 20, rate: float = 0.05, shrink: float = 1e-3) -> Classifier:
    """Softmax regression by AdaGrad over shuffled batches, classes weighted alike, then set to their prior."""
    k = len(names)
    weights, bias = np.zeros((BUCKETS + 5 * BINS, k)), np.zeros(k)
    model = Classifier(names, weights, bias)
    if k < 2:
        return model
    shared = np.bincount(number, minlength=len(weights)) >= min(SHARED, len(y) // 20)
    keep = shared[number]
    off = np.append(0, np.cumsum(keep))[off]
    number = number[keep]
    seen, r = np.full(weights.shape, 1e-2), np.random.default_rng(5)
    balance = len(y) / (k * np.bincount(y, minlength=k))
    for _ in range(epochs):
        order = r.permutation(len(y))
        for b in range(0, len(y), 128):
            rows = order[b : b + 128]
            size = np.diff(off)[rows]
            at = np.concatenate([number[off[i] : off[i + 1]] for i in rows])
            g = model.posteriors(at, np.append(0, np.cumsum(size)))
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= balance[y[rows], None] / len(rows)
            bias -= 0.1 * g.sum(0)
            used, index = np.unique(at, return_inverse=True)
            step = np.zeros((len(used), k))
            np.add.at(step, index, np.repeat(g, size, axis=0))
            step += shrink * weights[used]
            seen[used] += step**2
            weights[used] -= rate * step / np.sqrt(seen[used])
    bias += np.log(prior / prior.sum())
    model.weights = weights.astype(np.float32)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", TEXT):
            number, off, _ = features(part.column("text"))
            lists = pa.array([number[a:b].astype(np.int32).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), pa.array(np.diff(off).astype(np.int64)), lists], ["doc_id", "domain", "size", "features"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    found = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).where("doc_id is not null and domain is not null")
    return found.groupBy("doc_id").agg(F.min("domain").alias("domain")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    found = labelled(docs, labels)
    total = {r.domain: r.n for r in found.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    chosen = least_hash_rows(found, "domain", sample)
    # At most `sample` rows of each of three domains, so these may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    made = materialize(texts.select("doc_id", "domain", "t.text").mapInArrow(_featured, "doc_id long, domain string, size long, features binary"), "features")
    # What reaches the driver is bounded by bytes too: documents in the order of their hash, up to FEATURES.
    upto = F.sum("size").over(Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = made.select("doc_id", "size", upto.alias("upto")).where((F.col("upto") <= FEATURES) | (F.col("upto") == F.col("size"))).select("doc_id")
    rows = made.join(F.broadcast(fits), "doc_id", "left_semi").select("domain", "features").collect()
    rows.sort(key=lambda r: (r.domain, bytes(r.features)))
    names = [d for d in DOMAINS if any(r.domain == d for r in rows)] or DOMAINS[:1]
    x = [np.frombuffer(r.features, np.int32) for r in rows]
    off = np.append(0, np.cumsum([len(v) for v in x])).astype(np.int64)
    return fit(np.concatenate(x) if x else np.zeros(0, np.int64), off, np.array([names.index(r.domain) for r in rows], np.int64), names, np.array([total.get(d, 1) for d in names], np.float64))


def _scored(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", TEXT):
                number, off, n = features(part.column("text"))
                p = model.posteriors(number, off)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(model.names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if part.schema.field(i).name != "text"), pa.array(n), lists], [*(c for c in part.schema.names if c != "text"), "n_tokens", "posterior"])
        trim()

    return run


@dataclass
class Rates:
    """A document's rate from its posterior: projected gradient steps with momentum, replayed."""

    gradients: list[np.ndarray] = field(default_factory=list)
    step: float = 1.0
    #: The domain whose likely documents (a posterior of at least a half) have rates of at least 1.
    keep: int | None = None

    def __call__(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after all steps, and the point at which the next gradient is taken."""
        r = ahead = np.ones(len(p))
        least = np.zeros(len(p)) if self.keep is None else np.where(p[:, self.keep] >= 0.5, 1.0, 0.0)
        t = 1.0
        for g in self.gradients:
            new = np.maximum(least, ahead - self.step * (p @ g))
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            r, ahead = new, np.maximum(least, new + (before - 1) / t * (new - r))
        return r, ahead


def _posterior(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch.column("posterior").flatten()).reshape(-1, k)


def _sums(rates: Rates, k: int, second: bool):
    """Sums over all documents: expected tokens at the rates, and ahead; with `second` the products of posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        total = np.zeros(2 * k + (k * k if second else 0))
        for batch in batches:
            p, n = _posterior(batch, k), np.asarray(batch.column("n_tokens"), np.float64)
            r, ahead = rates(p)
            total[: 2 * k] += np.concatenate([(r * n) @ p, (ahead * n) @ p])
            if second:
                total[2 * k :] += ((p * n[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "x": total})

    return run


def fit_rates(scored: DataFrame, names: list[str], targets: dict[str, float], keep: bool = False) -> Rates:
    """The rates at which (n_tokens, posterior) meet the targets; with `keep` no likely document of the largest domain is rated below 1."""
    k = len(names)
    share = np.array([targets.get(d, 0.0) for d in names])
    rates = Rates(keep=int(np.argmax(share)) if keep else None)

    def sums(second: bool = False) -> np.ndarray:
        rows = scored.select("n_tokens", "posterior").mapInArrow(_sums(rates, k, second), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([r.x for r in sorted(rows)]) if rows else np.zeros(2 * k + k * k)

    first = sums(True)
    have, product = first[:k], first[2 * k :].reshape(k, k)
    if not have.sum() or not share.sum():
        return rates
    anchor = int(np.argmax(share))
    target = share / share[anchor] * have[anchor]
    scale = have.sum()
    # Residuals are weighted by the inverse of the products, so that rare domains converge like large ones.
    value, vector = np.linalg.eigh(product / scale)
    weight = (vector / np.maximum(value, 1e-9 * value.max())) @ vector.T
    near = TOLERANCE * min(scale, target.sum())
    ahead, best, since = have, np.inf, 0
    while np.abs(have - target).max() > near:
        off = (have - target) / scale
        size = off @ weight @ off
        best, since = (size, 0) if size < 0.999 * best else (best, since + 1)
        if since >= PATIENCE:
            warnings.warn(f"no rates were found that meet the targets: tokens {dict(zip(names, have.tolist(), strict=True))}, targets {dict(zip(names, target.tolist(), strict=True))}", stacklevel=2)
            break
        rates.gradients.append(weight @ (ahead - target) / scale)
        now = sums()
        have, ahead = now[:k], now[k:]
    return rates


def _rated(rates: Rates, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("rate", pa.array(rates(_posterior(batch, k))[0]))

    return run


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, keep: bool = False) -> tuple[Classifier, Rates]:
    """The classifier, and the rates as a function of posteriors."""
    return _fitted(docs, labels, targets, sample, keep)[:2]


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int, keep: bool = False) -> tuple[Classifier, Rates, DataFrame]:
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs, labels, sample)
    scored = materialize(docs.mapInArrow(_scored(model), "doc_id long, n_tokens long, posterior array<double>"), "posteriors")
    return model, fit_rates(scored, model.names, targets, keep), scored


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, posterior, rate) of every row of docs, and the domains' names."""
    model, rates, scored = _fitted(docs, labels, targets, sample)
    return scored.mapInArrow(_rated(rates, len(model.names)), "doc_id long, n_tokens long, posterior array<double>, rate double"), model.names


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, p_clean, p_poor, p_toxic, rate) of every row of docs."""
    rated, names = mix(docs, labels, targets)
    p = [(F.col("posterior")[names.index(d)] if d in names else F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS]
    return rated.select("doc_id", "n_tokens", *p, "rate")
