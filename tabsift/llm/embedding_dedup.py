"""Near-duplicate embeddings by collision counting on sorted projections.

Equal vectors of a label become one class. Classes are dealt by ranges of their first random
projection into blocks of at most BLOCK, and blocks whose ranges are near enough meet. For a pair
of blocks every one-dimensional projection is sorted, a window around each query's value gives its
collisions, and pairs with at least a given number of collisions over all projections are verified
by their cosine in double precision. The window is one standard deviation of the projected
difference at the threshold; the count is the largest that pairs exactly at the threshold still
reach with probability RECALL (binomial), and closer pairs reach it more often. Blocks farther apart
than APART deviations in the first projection do not meet, which loses a pair at the threshold with
a probability of 0.00006 more.

A block pair returns link counts and a spanning forest of its links, never the links themselves, so
a group of copies costs rows in proportion to its size. Vectors that are null, zero, empty or hold
null or non-finite components, rows without label or vec_id, and vectors of other length link with
nothing. Rows repeated in full count as further vectors of their class. Labels of any type are equal
if their texts are (1.2 and 1.7 are not). An empty table gives an empty one. Only vec_id, embedding
and label are read, so further columns may have any name.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, bounded_batches, gather_runs, input_parts, materialize, one_thread, salted
from .components import components, forest

PROJECTIONS, BLOCK, RECALL, SEED = 48, 1024, 0.999, 20240612
#: Standard deviations of the first projection's difference beyond which blocks do not meet.
APART = 4.0
#: Blocks that one key of the join of blocks has on its smaller side.
SALTED = 64


def spread(cosine: float) -> float:
    """The distance of unit vectors at this cosine: the deviation of their projected difference."""
    return math.sqrt(2 * (1 - cosine))


def least_count(m: int = PROJECTIONS, recall: float = RECALL) -> int:
    """Collisions that a pair at the threshold reaches with this probability, by windows of one deviation."""
    p = math.erf(1 / math.sqrt(2))
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


@functools.cache
def projections(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, m))


def collisions(queries: np.ndarray, sorted_values: np.ndarray, order: np.ndarray, window: float) -> np.ndarray:
    """Over all projections (columns), how often each vector is in the window around each query."""
    n, k = len(queries), len(order)
    count = np.zeros(n * k, np.uint8)
    for j in range(queries.shape[1]):
        low = np.searchsorted(sorted_values[:, j], queries[:, j] - window, "left")
        high = np.searchsorted(sorted_values[:, j], queries[:, j] + window, "right")
        at = order[gather_runs(low, high - low), j] + np.repeat(np.arange(n) * k, high - low)
        count[at] += 1  # a pair collides once in a projection
    return count.reshape(n, k)


def linked(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with at least this cosine; within one block those with i < j."""
    a = projections(x.shape[1])
    px, py = x @ a, y @ a
    order = np.argsort(py, axis=0, kind="stable")
    count = collisions(px, np.take_along_axis(py, order, 0), order, spread(cosine))
    i, j = np.nonzero(count >= least_count())
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= cosine
    return i[keep], j[keep]


BLOCKS = "label string, dim int, block long, low double, high double, ids binary, counts binary, vectors binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack sorted classes into blocks; a block has one label and one length of vectors."""
    held: list[tuple] = []

    def pack() -> pa.RecordBatch:
        label, dim = held[0][:2]
        return pa.RecordBatch.from_pydict(
            {"label": [label], "dim": [dim], "block": [min(r[3] for r in held)], "low": [held[0][2]], "high": [held[-1][2]], "ids": [np.array([r[3] for r in held], np.int64).tobytes()], "counts": [np.array([r[4] for r in held], np.int64).tobytes()], "vectors": [b"".join(r[5] for r in held)]},
            pa.schema([("label", pa.string()), ("dim", pa.int32()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())]),
        )

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "first", "id", "n", "vector")), strict=True):
            if held and (len(held) >= BLOCK or held[0][:2] != r[:2]):
                yield pack()
                held = []
            held.append(r)
    if held:
        yield pack()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, first, vector): unit vectors as doubles; rows that link with nothing have none."""
    for batch in batches:
        out = []
        for v, label, i in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), batch.column("vec_id").to_pylist(), strict=True):
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            scale = np.abs(x).max(initial=0.0)
            if label is None or i is None or not len(x) or not np.isfinite(x).all() or scale == 0:
                out.append((i, label, None, None, None))
                continue
            x = x / scale
            x = x / np.sqrt(x @ x) + 0.0
            out.append((i, label, len(x), float(x @ projections(len(x))[:, 0]), x.tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.binary()), strict=True)] if out else None
        if columns:
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "first", "vector"])


def _links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for r in batch.to_pylist():
                same = r["block"] == r["block2"]
                ids = [np.frombuffer(r[c], np.int64) for c in ("ids", "ids2")]
                n = [np.frombuffer(r[c], np.int64) for c in ("counts", "counts2")]
                x, y = (np.frombuffer(r[c], np.float64).reshape(-1, r["dim"]) for c in ("vectors", "vectors2"))
                i, j = linked(x, y, cosine, same)
                if not len(i):
                    continue
                both = len(x) + len(y)
                shift = 0 if same else len(x)
                total = np.bincount(i, n[1][j], both) + np.bincount(j + shift, n[0][i], both)
                name = np.concatenate(ids)
                has = np.flatnonzero(total)
                edges = forest(i, j + shift, both)
                yield pa.RecordBatch.from_arrays([pa.array(name[has]), pa.array(total[has].astype(np.int64)), pa.nulls(len(has), pa.int64())], ["a", "links", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(name[[e[0] for e in edges]]), pa.nulls(len(edges), pa.int64()), pa.array(name[[e[1] for e in edges]])], ["a", "links", "b"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = materialize(rows.mapInArrow(_vectors, "vec_id long, label string, dim int, first double, vector binary").withColumn("key", F.md5("vector")), "vectors")
    real = rows.where("vector is not null")
    classes = real.groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("first").alias("first"), F.first("vector").alias("vector"))
    classes = materialize(classes, "classes")
    order = ["label", "dim", "first", "id"]
    parts = input_parts(vectors, least=8)
    blocks = materialize(classes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS), "blocks")
    head = blocks.select("label", "dim", "block", "low", "high")
    other = head.select("label", "dim", *(F.col(c).alias(f"{c}2") for c in ("block", "low", "high")))
    reach = APART * spread(cosine)
    head, other = salted(head, other, blocks.count(), SALTED)
    meet = head.join(other, ["label", "dim", "salt"]).where((F.col("block") <= F.col("block2")) & (F.col("low") <= F.col("high2") + reach) & (F.col("low2") <= F.col("high") + reach)).select("block", "block2")
    x = blocks.select("block", "dim", "ids", "counts", "vectors")
    y = blocks.select(F.col("block").alias("block2"), *(F.col(c).alias(f"{c}2") for c in ("ids", "counts", "vectors")))
    pairs = meet.join(x, "block").join(y, "block2").repartition(input_parts(vectors), "block", "block2")
    with batch_rows(spark, 32):  # rows of a few hundred kB
        found = materialize(pairs.mapInArrow(_links(cosine), "a long, links long, b long"), "links")
    links = found.where("links is not null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    label = materialize(components(found.where("b is not null").select("a", "b")), "components")
    named = classes.select("label", "key", "id", "n").join(links, "id", "left").join(label, "id", "left")
    out = rows.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
