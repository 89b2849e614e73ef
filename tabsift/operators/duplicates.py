"""Exact and near duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.model import MAX_EXAMPLES, MAX_GROUPS, Duplicates, Issue, Table
from ..sources.shared import materialize, spread


def exact_groups(table: Table, options: Duplicates | None = None) -> DataFrame:
    """(keep, rid) for every row of a group of at least two equal rows; keep is the group's first row.

    Rows are equal by their normalised cells but for the ignored columns. The key is a 256-bit hash,
    so wide rows shuffle a short key, and the counts combine before the shuffle.
    """
    options = options or Duplicates()
    use = [S.normalize_cell(F.col(c), options.trim_whitespace, options.case_insensitive) for c, h in zip(table.columns, table.headers, strict=True) if h not in options.ignore_columns]
    keyed = spread(table.df).select("rid", F.sha2(F.concat_ws("\x01", *use) if use else F.lit(""), 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("rid").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(groups, "key").select("keep", "rid")


def near_strings(table: Table, options: Duplicates) -> DataFrame:
    keys = options.near.key_columns
    chosen = [c for c, h in zip(table.columns, table.headers, strict=True) if (h in keys if keys else h not in options.ignore_columns)]
    return table.df.select("rid", F.concat_ws(" ", *(S.normalize_cell(F.col(c), True, True) for c in chosen)).alias("s") if chosen else F.lit("").alias("s"))


def near_classes(strings: DataFrame, threshold: float) -> DataFrame:
    """(id, id2, similarity) of distinct strings, each named by its first row, whose bigram multisets have a Dice
    similarity from the threshold to below 1.

    A multiset becomes a set of numbered bigrams, ordered by frequency; strings that reach the threshold share one
    of the first of these and differ in length by a bounded factor, so only pairs that meet in such a prefix are
    verified.
    """
    texts = strings.groupBy("s").agg(F.min("rid").alias("id"))
    texts = texts.where(F.length("s") >= 2)
    grams = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    rows = texts.select("id", F.posexplode(grams).alias("at", "g"))
    counted = rows.groupBy("id", "g").agg(F.count("*").alias("c"))
    tokens = counted.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda k: F.concat(F.col("g"), F.lit("\x00"), k.cast("string")))).alias("t"))
    frequency = tokens.groupBy("t").agg(F.count("*").alias("f"))
    sets = tokens.join(frequency, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("p"))
    sets = sets.select("id", F.size("p").alias("n"), F.transform("p", lambda s: s["t"]).alias("p"))
    # Dice >= t means an overlap of at least t * n / (2 - t) with any partner.
    least = F.ceil(F.lit(threshold) * F.col("n") / F.lit(2 - threshold) - F.lit(1e-9))
    prefix = sets.select("id", "n", F.explode(F.slice("p", 1, (F.col("n") - least + 1).cast("int"))).alias("t"))
    other = prefix.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "t")
    met = prefix.join(other, "t").where((F.col("id") < F.col("id2")) & (2 * F.least("n", "n2") >= threshold * (F.col("n") + F.col("n2")) - 1e-9)).select("id", "id2").distinct()
    a, b = sets.select("id", F.col("n").alias("na"), F.col("p").alias("pa")), sets.select(F.col("id").alias("id2"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    sim = 2 * F.size(F.array_intersect("pa", "pb")) / (F.col("na") + F.col("nb"))
    found = met.join(a, "id").join(b, "id2").withColumn("similarity", sim).where((F.col("similarity") >= threshold) & (F.col("similarity") < 1)).select("id", "id2", "similarity")
    return found.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"), "similarity")


def near_pairs(strings: DataFrame, threshold: float) -> DataFrame:
    """(i, j, similarity) of all rows i < j of near classes; equal strings multiply, so this is for reports of small tables."""
    members = strings.join(strings.groupBy("s").agg(F.min("rid").alias("id")), "s").select("id", "rid")
    one, two = members.withColumnRenamed("rid", "x"), members.select(F.col("id").alias("id2"), F.col("rid").alias("y"))
    return near_classes(strings, threshold).join(one, "id").join(two, "id2").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")


def near_duplicates(table: Table, options: Duplicates | None = None, classes: bool = False) -> DataFrame:
    """(i, j, similarity) of near-duplicate rows that are not in one exact group; with `classes` only between the
    first rows of equal strings."""
    options = options or Duplicates()
    strings = near_strings(table, options)
    if classes:
        pairs = near_classes(strings, options.near.threshold).select(F.col("id").alias("i"), F.col("id2").alias("j"), "similarity")
    else:
        pairs = near_pairs(strings, options.near.threshold)
    groups = exact_groups(table, options)
    a, b = groups.select(F.col("keep").alias("ki"), F.col("rid").alias("i")), groups.select(F.col("keep").alias("kj"), F.col("rid").alias("j"))
    out = pairs.join(a, "i", "left").join(b, "j", "left").where(~F.coalesce(F.col("ki") == F.col("kj"), F.lit(False)))
    return out.select("i", "j", S.round3(F.col("similarity")).alias("similarity"))


def detect_duplicates(table: Table, options: Duplicates, row_count: int, rows: bool = False) -> list[Issue]:
    """An issue for each exact group and each near pair. Without `rows` a group has its first MAX_EXAMPLES rows and
    its size, near pairs are those between the first rows of equal strings, and the first MAX_GROUPS of either kind
    are reported; exact_groups and near_duplicates have them all."""
    if not options.enabled:
        return []
    found = exact_groups(table, options)
    if rows:
        groups = found.groupBy("keep").agg(F.array_sort(F.collect_list("rid")).alias("rows"), F.count("*").alias("n")).orderBy("keep")
    else:
        found = materialize(found, "groups")
        first = found.groupBy("keep").agg(F.count("*").alias("n")).orderBy("keep").limit(MAX_GROUPS)
        place = F.row_number().over(Window.partitionBy("keep").orderBy("rid"))
        some = found.join(F.broadcast(first.select("keep")), "keep", "left_semi").withColumn("_i", place).where(F.col("_i") <= MAX_EXAMPLES)
        groups = some.groupBy("keep").agg(F.array_sort(F.collect_list("rid")).alias("rows")).join(first, "keep").orderBy("keep")
    out = []
    for r in groups.toLocalIterator():
        out.append(Issue("duplicate", "exact_duplicate_row", "warning", f"Found {r.n} exact duplicate rows", list(r.rows) if rows else None, data={"count": r.n, "keepRow": r.keep, "duplicateRows": list(r.rows[1:])}, n=r.n))
    near = options.near
    if not near.enabled:
        return out
    if near.limit is not None and row_count > near.limit:
        return [*out, Issue("duplicate", "near_duplicate_skipped", "info", f"Skipped near-duplicate detection: {row_count} rows exceeds limit of {near.limit}", data={"rowCount": row_count, "limit": near.limit})]
    pairs = near_duplicates(table, options, classes=not rows).orderBy("i", "j")
    for r in (pairs if rows else pairs.limit(MAX_GROUPS)).toLocalIterator():
        out.append(Issue("duplicate", "near_duplicate_row", "info", f"Rows {r.i} and {r.j} are near-duplicates (similarity {r.similarity:g})", [r.i, r.j], data={"similarity": r.similarity}))
    return out
