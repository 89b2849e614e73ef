"""A corpus pipeline of five operators: each stage works on what its predecessor kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame,
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents, whatever others there are. Rows are told apart by their place in the files and not by
doc_id, so null and repeated ids are rows like others.

- language: rows whose text has no letter or is near no learned language go; a short text has few
  n-grams and so a low score, and less is asked of it.
- near duplicates: of each group of linked texts the row of the least doc_id stays; a row without
  words is linked with nothing and stays.
- personal data: spans become their kind's name, and n_chars follows the text.
- mixture: a row is there as many times as its rate, rounded up or down by a hash of its text and
  doc_id, so that expected tokens follow the rates. Rows that are most likely clean have rates of at
  least 1, so all of them stay.
- tokens: ids with an end id, their number, and a hash of the text that they decode to.

An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsift.llm import jaccard_join, language, mixing, pii, sentencepiece_bpe
from tabsift.llm.common import bounded_batches, materialize, pieces, release, table, trim

#: Scores under which a text is near no language that was learned; texts of the learned ones have 0.45 and more.
LEAST_SCORE = 0.3
#: Code points of a text from which on the whole score is asked for; of a shorter one its share.
SHORT = 120
#: Near duplicates share this percentage of their shingles of so many words.
SIMILARITY, SHINGLE = 80, 5
#: The column that tells rows apart inside a stage.
ROW = "_tabsift_row"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    profiles = language.learn(docs, ~language.held_out())
    found = docs.withColumn(ROW, language.predict(F.col("text"), profiles))
    least = LEAST_SCORE * F.least(F.lit(1.0), F.length("text") / SHORT)
    return found.where((F.col(f"{ROW}.lang") != language.UND) & (F.col(f"{ROW}.score") >= least)).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number in ROW that is the same in every plan and after the loss of an executor: the place of
    their file among all files, and theirs in it. Rows that are no scan of files are written first."""
    try:
        place = docs.metadataColumn("_metadata")
        named = docs.select("*", place["file_path"].alias(f"{ROW}_file"), place["row_index"].alias(f"{ROW}_at"))
    except AnalysisException:
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in named.select(f"{ROW}_file").distinct().collect())  # a row for each file
    order = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{ROW}_place long, {ROW}_file string")
    out = named.join(F.broadcast(order), f"{ROW}_file")
    return out.select(*docs.columns, F.shiftleft(F.col(f"{ROW}_place"), 40).bitwiseOR(F.col(f"{ROW}_at")).alias(ROW))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    joined = materialize(jaccard_join.join(rows, SIMILARITY, SHINGLE, key=ROW), "joined").select(F.col("doc_id").alias(ROW), "component_id")
    release(spark)
    named = rows.select(ROW, "doc_id").join(joined, ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    find = pii.Finder()

    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            spans = find(t) if t else []
            out.append(pii.redact(t, [{"kind": s[0], "start": s[1], "end": s[2]} for s in spans]) if spans else t)
        return pa.array(out, pa.string())

    out = docs.withColumn("text", F.arrow_udf(run, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model, rates = mixing.fitted(docs, table(spark, sf_dir, "labels"), keep=True)

    def copies(text: pa.Array, u: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in pieces(text, None, mixing.TEXT):
            number, off, _ = mixing.features(part)
            out.append(rates(model.posteriors(number, off))[0])
        trim()
        return pa.array(np.floor(np.concatenate(out) + u.to_numpy()).astype(np.int32))

    u = F.shiftrightunsigned(F.xxhash64("text", "doc_id"), 11) / F.lit(2.0**53)  # in [0, 1)
    some = docs.withColumn(ROW, F.arrow_udf(copies, "int")("text", u)).where(F.col(ROW) > 0)
    return some.withColumn(ROW, F.explode(F.sequence(F.lit(1), ROW))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact),
    ("mixture", mix),
    ("tokens", encode),
]

#: SQL cannot express language profiles, boosted trees or merge rounds; tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
