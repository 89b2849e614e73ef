"""Language identification by rank-order profiles of character n-grams.

A profile is the PROFILE most frequent 1- to 3-grams of a language's training texts, in order. A
document's own most frequent n-grams are compared to each profile by out-of-place distance: the
sum of rank differences, PROFILE for an n-gram that the profile lacks. The least distance wins
(ties: the name that sorts first); the score is 1 minus the distance over its maximum.

Profiles are learned from at most SAMPLE training rows of each language, those with the least hash
of doc_id, so the sample is bounded, spread over the table and the same in every run. Rows without
doc_id, text or lang teach nothing. A text that is null or has no letter is `und` with score 0, as
is every text if there is nothing to learn from. Repeated rows are rows like others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, least_hash_rows, trim

UND = "und"
PROFILE, SAMPLE = 400, 2000


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself plus 1 if it is a letter, else 1 (the mark between words)."""
    points = np.arange(1, 0x110001, dtype=np.int64)
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(alpha, points, 1)


def grams(text: str) -> np.ndarray:
    """Sorted keys of all 1- to 3-grams of the lower-cased letters, words apart by one mark."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[np.append(True, (c[1:] != 1) | (c[:-1] != 1))]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    keys = np.concatenate([c[c != 1], two, (two[:-1] << 21) | c[2:]])
    keys.sort()
    return keys


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, best first; ties by key."""
    keys = grams(text)
    if not len(keys):
        return keys
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(first, len(keys)))
    return keys[first[np.argsort(-count, kind="stable")[:most]]]


class Profiles:
    """Ranks of all profiles' n-grams: a row for each n-gram, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.names = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for name, key, rank in rows:
            self.ranks[np.searchsorted(self.keys, key), self.names.index(name)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text) if text and self.names else ()
        if not len(own):
            return UND, 0.0
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        rank = self.ranks[at]
        far = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (PROFILE * len(own)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, added up over a batch."""
    for batch in batches:
        for lang in set(batch.column("lang").to_pylist()):
            texts = [t for t, k in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if k == lang]
            keys, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
            yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys, "n": n.astype(np.int64)})
    trim()


def learn(docs: DataFrame, train: Column, sample: int = SAMPLE) -> Profiles:
    """Profiles from the rows (doc_id, text, lang) for which `train` holds."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(train & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    chosen = least_hash_rows(rows.select("doc_id", "lang").distinct(), "lang", sample)
    # At most `sample` rows a language are chosen, so they may be broadcast.
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("text", "lang")
    counts = texts.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PROFILE)
    return Profiles([(r.lang, r.gram, r.place - 1) for r in top.select("lang", "gram", "place").collect()])


def predict(text: Column, profiles: Profiles) -> Column:
    """struct<lang:string,score:double> of a text column."""

    def run(x: pa.Array) -> pa.Array:
        out = [profiles.predict(t.as_py()) for t in x]
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["lang", "score"])

    return F.arrow_udf(run, "struct<lang:string,score:double>")(text)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2; never so for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, learned from the rows not held out."""
    bounded_batches(docs.sparkSession)
    profiles = learn(docs, ~held_out())
    found = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
