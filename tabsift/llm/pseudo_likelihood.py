"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the SIDE tokens on both of its sides:
offset embeddings are added and squashed (x / (1 + |x|)), then a class and a word within the class are predicted
(a two-level softmax). A document's score is the sum of the log-probabilities of its tokens.

Words are counted over the whole corpus. The most frequent ones are the network's vocabulary, the
others share hashed entries, and the counts are the network's first biases. A word of an entry has
the entry's probability times its own share there: how often it occurs in other documents over the
entry's count and 1. That 1 is left for words of no other document, which share it by their
spelling: a chain of byte pairs counted over the corpus. So a document is scored by what the rest of
the corpus holds, and one that the corpus repeats stands out. The counts follow the corpus and reach
no driver (but the vocabulary and the table of byte pairs, of fixed size): scan tasks pack their
distinct words by hash range, a range's task adds them up and sends the sums back to the packs.

Training is distributed: in each round every task runs numpy SGD from the shared parameters over its
share of the windows of all its documents (the rounds together take every window once), and the
tasks' parameters are averaged in groups, weighted by their windows, before they reach the driver as
one set of fixed size.

Null and empty texts have no tokens and score 0 with a null mean. An empty table trains nothing.
Repeated rows are documents like others, with scores equal but for the rounding of sums; words of
equal counts are ordered by hash. A very long text is a slice of its own. Only doc_id and text are
read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, input_parts, materialize, one_thread, pieces, squeeze, trim, unsqueeze
from .jaccard_join import _each
from .shingles import BORDER, PAIRS, byte_pairs, words

CLASSES, EACH, HASHED, SIDE, WIDTH = 32, 64, 48, 2, 16
SIZE = CLASSES * EACH
VOCABULARY = SIZE - HASHED
#: Rounds of training, which together train every window once; rows of a step; learning rate.
ROUNDS, BATCH, RATE = 2, 8192, 0.16
#: Scores of a softmax are cut here, far above what training reaches, so that none overflows.
TOP = np.float32(60)
TEXT = 1 << 19
#: Words and documents that a scan task packs together at most (but for a single longer slice).
FLUSH, FLUSH_ROWS = 1_000_000, 60_000
#: What each pair of bytes counts at least.
UNSEEN = 0.1
#: kind: 0 words of a hash range and their counts, 1 the pack's own table of documents, the spelling of its words, and which occur
PACK = "part int, pack long, kind int, words binary, counts binary, docs binary"
PACKED = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("words", "counts", "docs"))])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64())])


@dataclass
class Network:
    words: np.ndarray  # sorted hashes of the vocabulary
    number: np.ndarray  # and their numbers, by frequency
    embed: np.ndarray  # offsets x (SIZE + 1) x WIDTH; the last row is the edge of a text
    classes: np.ndarray  # WIDTH + 1 x CLASSES, the last row is the bias
    inner: np.ndarray  # CLASSES x WIDTH + 1 x EACH
    rest: np.ndarray  # the corpus count of all words of each hashed entry
    spelling: np.ndarray  # log-probability of each byte after another, by the number of their pair

    def tokens(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        other = VOCABULARY + (h % np.uint64(HASHED)).astype(np.int64)
        return np.where(self.words[at] == h, self.number[at], other) if len(self.words) else other

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.classes, self.inner)])

    def load(self, flat: np.ndarray) -> None:
        for x in (self.embed, self.classes, self.inner):
            x[...] = flat[: x.size].reshape(x.shape)
            flat = flat[x.size :]


def spelling(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of bytes (or the end of a word) after each byte (or its start), from counts of pairs."""
    table = pairs.reshape(BORDER + 1, BORDER + 1) + UNSEEN
    return np.log(table / table.sum(1, keepdims=True)).ravel()


def start(counts: list[tuple[int, int]], rest: int | np.ndarray, pairs: np.ndarray | None = None) -> Network:
    """A network whose biases are the words' counts: (hash, count) by frequency, and all other words' count, in all or by entry."""
    rest = np.full(HASHED, rest / HASHED) if np.ndim(rest) == 0 else rest
    r = np.random.default_rng(3)
    unigram = np.full(SIZE, 1.0)
    unigram[: len(counts)] += [c for _, c in counts]
    unigram[VOCABULARY:] += rest
    by_class = unigram.reshape(CLASSES, EACH)
    h = np.array([c[0] for c in counts], np.int64).view(np.uint64)
    order = np.argsort(h)
    embed = r.normal(0, 0.1, (2 * SIDE, SIZE + 1, WIDTH)).astype(np.float32)
    classes = np.concatenate([r.normal(0, 0.1, (WIDTH, CLASSES)), np.log(by_class.sum(1) / unigram.sum())[None]]).astype(np.float32)
    inner = np.concatenate([r.normal(0, 0.1, (CLASSES, WIDTH, EACH)), np.log(by_class / by_class.sum(1, keepdims=True))[:, None]], 1).astype(np.float32)
    return Network(h[order], order, embed, classes, inner, rest, spelling(np.zeros(PAIRS) if pairs is None else pairs))


def contexts(token: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each token the 2 x SIDE tokens around it, in its own text."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(token))
    out = np.full((2 * SIDE, len(token)), SIZE, np.int64)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        near = at + d
        inside = (near >= off[row]) & (near < off[row + 1])
        out[k, inside] = token[near[inside]]
    return out


#: Places of a token's row in a flat table of embeddings.
PLACES = np.arange((SIZE + 1) * WIDTH).reshape(SIZE + 1, WIDTH)


def _hidden(net: Network, around: np.ndarray) -> np.ndarray:
    """The hidden layer and a last row of ones, for the biases. Here and below a column is a window, so that sums run along long rows."""
    z = np.take(net.embed[0], around[0], axis=0)
    for k in range(1, len(around)):
        z += np.take(net.embed[k], around[k], axis=0)
    z /= 1 + np.abs(z)
    out = np.ones((WIDTH + 1, len(z)), np.float32)
    out[:-1] = z.T
    return out


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place the exponentials of scores, and the sum of each column."""
    if z.max(initial=0) > TOP:
        np.minimum(z, TOP, out=z)
    np.exp(z, out=z)
    return z, z.sum(0)


def _chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one entry of each column of scores."""
    own = z[at, np.arange(len(at))]
    return own - np.log(_exponentials(z)[1])


def _by_class(token: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order by class, and where each class starts in it."""
    group = (token // EACH).astype(np.uint8)
    return np.argsort(group, kind="stable"), np.append(0, np.cumsum(np.bincount(group, minlength=CLASSES))).tolist()


def log_probabilities(net: Network, token: np.ndarray, around: np.ndarray) -> np.ndarray:
    out = np.zeros(len(token))
    for a in range(0, len(token), 1 << 14):
        order, edges = _by_class(token[a : a + (1 << 14)])
        t, near = np.take(token[a : a + (1 << 14)], order), np.take(around[:, a : a + (1 << 14)], order, axis=1)
        h = _hidden(net, near)
        lp = _chosen(net.classes.T @ h, t // EACH).astype(np.float64)
        for c, (i, j) in enumerate(pairwise(edges)):
            if i < j:
                lp[i:j] += _chosen(net.inner[c].T @ h[:, i:j], t[i:j] % EACH)
        out[a + order] = lp
    return out


def _error(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gradient of the log-loss in the scores, in place of these."""
    z, total = _exponentials(z)
    z /= total
    z[at, np.arange(len(at))] -= 1
    return z


def train_step(net: Network, token: np.ndarray, around: np.ndarray, rate: float) -> None:
    n = len(token)
    order, edges = _by_class(token)
    token, around = np.take(token, order), np.take(around, order, axis=1)
    h = _hidden(net, around)
    place = token % EACH
    g = _error(net.classes.T @ h, token // EACH)
    back = net.classes[:-1] @ g
    net.classes -= np.float32(rate / n) * (h @ g.T)
    for c, (i, j) in enumerate(pairwise(edges)):
        if i < j:
            g = _error(net.inner[c].T @ h[:, i:j], place[i:j])
            back[:, i:j] += net.inner[c, :-1] @ g
            net.inner[c] -= np.float32(rate * CLASSES / n) * (h[:, i:j] @ g.T)
    back *= np.square(1 - np.abs(h[:-1])) * np.float32(rate * 8 / math.sqrt(n))
    step = np.ascontiguousarray(back.T).ravel()
    for k in range(len(around)):
        np.subtract.at(net.embed[k].reshape(-1), np.take(PLACES, around[k], axis=0).ravel(), step)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a task (pair: false) and the pairs of their bytes, each with its count, added up over a few million words at a time."""
    held: list[np.ndarray] = []
    pairs = np.zeros(PAIRS, np.int64)
    size = 0

    def count() -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_pydict({"pair": np.zeros(len(h), bool), "h": h.view(np.int64), "n": n.astype(np.int64)})
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({"pair": np.ones(len(at), bool), "h": at, "n": pairs[at]})
        pairs[:] = 0

    for batch in batches:
        for part in pieces(batch, "text", TEXT):
            held.append(words(part.column("text"))[0])
            size += len(held[-1])
            inner, start, end, last = byte_pairs(part.column("text"))
            run = np.zeros(len(inner) + 1, np.int8)  # 1 inside words
            run[start] += 1
            run[end] -= 1
            pairs += np.bincount(inner[np.cumsum(run[:-1], dtype=np.int8) > 0], minlength=PAIRS) + np.bincount(last, minlength=PAIRS)
            if size >= 2_000_000:
                yield from count()
                held, size = [], 0
    if size:
        yield from count()
    trim()


def in_round(h: np.ndarray, off: np.ndarray, round_: int, rounds: int) -> np.ndarray:
    """The words whose windows train in a round: each word of a text in one of the rounds."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    begin = h[np.minimum(off[:-1], len(h) - 1)] % np.uint64(rounds)  # each text has its own first window
    return np.flatnonzero((np.arange(len(h)) - off[row] + begin[row].astype(np.int64)) % rounds == round_)


def _trained(net: Network, round_: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        task = TaskContext.get().partitionId()
        token, around, seen = [], [], 0

        def steps(all_: bool) -> None:
            nonlocal token, around, seen
            t, c = np.concatenate(token), np.concatenate(around, 1)
            end = len(t) if all_ else len(t) // BATCH * BATCH
            for a in range(0, end, BATCH):
                train_step(net, t[a : a + BATCH], c[:, a : min(a + BATCH, end)], RATE)
            seen += end
            token, around = [t[end:]], [c[:, end:]]

        for batch in batches:
            for part in pieces(batch, "text", TEXT):
                h, off = words(part.column("text"))
                if not len(h):
                    continue
                t = net.tokens(h)
                use = in_round(h, off, round_, rounds)
                token.append(t[use])
                around.append(contexts(t, off)[:, use])
                if sum(map(len, token)) >= 4 * BATCH:
                    steps(False)
        if token and sum(map(len, token)):
            steps(True)
        if seen:
            yield pa.RecordBatch.from_pydict({"task": [task], "weight": [float(seen)], "flat": [net.parameters().tobytes()]}, pa.schema([("task", pa.int32()), ("weight", pa.float64()), ("flat", pa.binary())]))
        trim()

    return run


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("task")
    total = np.zeros(len(rows.flat.iloc[0]) // 4)
    for w, flat in zip(rows.weight, rows.flat, strict=True):
        total += w * np.frombuffer(flat, np.float32)
    weight = rows.weight.sum()
    return pd.DataFrame({"task": [rows.task.iloc[0]], "weight": [weight], "flat": [(total / weight).astype(np.float32).tobytes()]})


def learn(docs: DataFrame, rounds: int = ROUNDS) -> Network:
    counted = materialize(docs.select("text").mapInArrow(_counted, "pair boolean, h long, n long").groupBy("pair", "h").agg(F.sum("n").alias("n")), "counts")
    counts = counted.where("not pair")
    marked = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY).collect()
    rest, pairs = np.zeros(HASHED), np.zeros(PAIRS)
    for r in counts.groupBy(_entry(F.col("h")).alias("entry")).agg(F.sum("n").alias("n")).collect():
        rest[r.entry] = r.n
    for r in marked:
        rest[r.h % 2**64 % HASHED] -= r.n
    for r in counted.where("pair").collect():  # at most PAIRS rows
        pairs[r.h] = r.n
    net = start([(r.h, r.n) for r in marked], rest, pairs)
    row = "task int, weight double, flat binary"
    groups = math.isqrt(input_parts(docs)) + 1
    for k in range(rounds):
        parts = docs.select("text").mapInArrow(_trained(net, k, rounds), row)
        some = parts.groupBy((F.col("task") % groups).alias("g")).applyInPandas(_mean, row)
        done = some.groupBy(F.lit(0).alias("g")).applyInPandas(_mean, row).collect()
        if done:
            net.load(np.frombuffer(done[0].flat, np.float32))
    return net


def _entry(h: Column) -> Column:
    """The hashed entry of a word's hash, which is unsigned."""
    return F.pmod(F.pmod(h, F.lit(HASHED)) + F.when(h < 0, 2**64 % HASHED).otherwise(0), F.lit(HASHED))


def spell(net: Network, text: pa.Array, of: np.ndarray) -> np.ndarray:
    """The log-probability of the spelling of the words that `of` marks."""
    inner, start, end, last = byte_pairs(text)
    total = np.append(0, np.cumsum(net.spelling[inner]))
    return (total[end[of]] - total[start[of]] + net.spelling[last[of]]).astype(np.float32)


def _scored(net: Network, parts: int):
    """Packs of scored documents, without the shares of the words of hashed entries, and of these words by hash range."""
    cuts = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)

    def pack(held: list, number: int) -> pa.RecordBatch:
        doc, n, total, rare, h, spelled = (np.concatenate(x) for x in zip(*held, strict=True))
        value, first, index, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        edges = [0, *np.searchsorted(value, cuts).tolist(), len(value)]
        out = [(p, number, 0, squeeze(value[a:b]), count[a:b].astype(np.int64).tobytes(), b"") for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        table = np.concatenate([np.array([len(n)]), doc[:, 0], doc[:, 1], n, total.view(np.int64), rare])
        out.append((number % parts, number, 1, spelled[first].tobytes(), index.astype(np.uint32).tobytes(), table.astype(np.int64).tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in out], PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = rows = 0
        for batch in batches:
            for part in pieces(batch, "text", TEXT):
                h, off = words(part.column("text"))
                t = net.tokens(h)
                lp = log_probabilities(net, t, contexts(t, off))
                other = t >= VOCABULARY
                lp[other] -= np.log(net.rest[t[other] - VOCABULARY] + 1)
                total, rare = np.append(0, np.cumsum(lp)), np.append(0, np.cumsum(other))
                ids = part.column("doc_id")
                doc = np.stack([ids.fill_null(0).to_numpy(), ids.is_valid().cast(pa.int64()).to_numpy()], 1)
                held.append((doc, np.diff(off), total[off[1:]] - total[off[:-1]], rare[off[1:]] - rare[off[:-1]], h[other], spell(net, part.column("text"), other)))
                size, rows = size + int(rare[-1]), rows + len(doc)
                if size >= FLUSH or rows >= FLUSH_ROWS:
                    yield pack(held, (task << 32) + number)
                    held, size, rows, number = [], 0, 0, number + 1
        if held:
            yield pack(held, (task << 32) + number)
        trim()

    return run


def _sums(rows: pa.Table) -> pa.Table:
    """Of one hash range: back to each pack its words' counts in all packs."""
    rows = rows.combine_chunks()
    kind, part, number, value, count = (rows.column(c).to_pylist() for c in ("kind", "part", "pack", "words", "counts"))
    at = [i for i, k in enumerate(kind) if k == 0]
    out = []
    if at:
        each = [unsqueeze(value[i]) for i in at]
        _, index = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(index, np.concatenate([np.frombuffer(count[i], np.int64) for i in at])).astype(np.int64)[index]
        ends = np.cumsum([len(v) for v in each]).tolist()
        out = [(part[i], number[i], 0, b"", total[e - len(v) : e].tobytes(), b"") for i, v, e in zip(at, each, ends, strict=True)]
    found = pa.Table.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in out], PACKED)
    return pa.concat_tables([found, rows.filter(pa.array([k == 1 for k in kind], pa.bool_())).cast(PACKED)])


def _finished(rows: pa.Table) -> pa.Table:
    """Of one pack: its documents, with the shares of the words of hashed entries in their scores."""
    kind, part, count = (rows.column(c).to_pylist() for c in ("kind", "part", "counts"))
    head = kind.index(1)
    table = np.frombuffer(rows.column("docs")[head].as_buffer(), np.int64)
    doc, valid, n, total, rare = table[1:].reshape(5, table[0])
    ranges = sorted((p, i) for i, (k, p) in enumerate(zip(kind, part, strict=True)) if k == 0)
    corpus = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(count[i], np.int64) for _, i in ranges)])
    spelled = np.frombuffer(rows.column("words")[head].as_buffer(), np.float32)
    index = np.frombuffer(count[head], np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(rare)), rare)
    _, same, own = np.unique(owner * max(len(corpus), 1) + index, return_inverse=True, return_counts=True)
    other = corpus[index] - own[same]  # how often a word occurs in other documents
    share = np.where(other > 0, np.log(np.maximum(other, 1)), spelled[index])
    more = np.append(0, np.cumsum(share))
    off = np.append(0, np.cumsum(rare))
    return pa.Table.from_arrays([pa.array(doc, mask=valid == 0), pa.array(n), pa.array(total.view(np.float64) + more[off[1:]] - more[off[:-1]])], schema=SCORES)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every whole text."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = input_parts(docs, least=64, most=40_000, each=2)
    packed = docs.mapInArrow(_scored(learn(docs, rounds), parts), PACK)
    summed = packed.repartition(parts, "part").mapInArrow(_each("part", _sums), PACK)
    scored = summed.repartition(parts, "pack").mapInArrow(_each("pack", _finished), "doc_id long, n_tokens long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
