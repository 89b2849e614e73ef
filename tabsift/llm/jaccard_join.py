"""N-gram Jaccard join as a grouped prefix join, returned as classes and components.

Two documents link if the Jaccard similarity of their sets of word shingles reaches a threshold
(in hundredths, so that all comparisons are of integers). The steps:

1. Signatures: documents with equal sets become one class.
2. Frequencies: shingles are counted over all documents. A scan task packs its shingles into a few
   binary rows by hash range, one entry for each distinct shingle; a hash range's task adds the
   counts up and sends back, again packed, only shingles that two classes share. A class that has
   too few of those for the threshold links with nothing and leaves here.
3. Prefixes: the rest order their shingles by frequency. Classes of one size whose prefixes are
   identical collapse into a group; the inverted index from prefix shingles has groups.
4. Near hubs first: each group meets, for each prefix shingle, the group of the least id there, and
   verifies the one that shares most of its prefix; groups verify their members against the first.
   The components of these links take up what is in large groups of copies.
5. Then all other pairs: groups that share a prefix shingle but are not in one component pass the
   size and position filters, expand into members and are verified. Pairs inside a component
   need no verification, so the copies in a group never expand into all pairs and no link between
   components is lost. Where very many pairs of groups share a shingle, the families that such
   shingles hold together are packed into blocks in the order of their components, and pairs of
   blocks that are not of one component are verified as matrix products that return a spanning
   forest of their links.

Nulls, empty texts and texts without words have no shingles and link with nothing; a row without
doc_id links with nothing and has no component. Rows repeated in full are members of one class.
Shingles of equal frequency are ordered by hash, groups and hubs by id, so ties are the same in every
run. A very long text is a slice of its own; an empty table gives an empty one. Only the key and the
text of a table are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, bounded_batches, input_parts, materialize, one_thread, pieces, salted, squeeze, trim, unsqueeze
from .components import components, forest
from .shingles import shingles, signatures

#: Shingles and documents that a scan task packs together at most (but for a single longer text).
FLUSH, FLUSH_ROWS = 400_000, 60_000
#: Bytes of text that are hashed at once.
TEXT = 1 << 18
#: Entries of a hash range that are sorted at once.
AT_ONCE = 250_000
#: Pairs across components at one prefix shingle, over which its groups are compared in blocks; classes
#: and shingles of a block, and the columns of its matrix that are compared at once.
CROSSING, BLOCK, BLOCK_SHINGLES, COLUMNS = 1000, 256, 400_000, 4096
#: Blocks of a family that one key of the join of blocks has on its smaller side.
SALTED = 64
#: Rows of packs in an Arrow batch.
PACKS = 64
#: flush: task and number of a pack; part: hash range; kind: 0 shared inside the pack, 1 single, 2 the pack's own table
PACK = "part int, flush long, kind int, hashes binary, counts binary, docs binary, sig binary"
PACKED = pa.schema([("part", pa.int32()), ("flush", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("hashes", "counts", "docs", "sig"))])
SURVIVORS = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64()))])


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", TEXT):
                sets, off = shingles(part.column("text"), width)
                a, b = signatures(sets, off)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": np.diff(off), "s1": a, "s2": b})
        trim()

    return run


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): the size and signature of each document's set."""
    return docs.mapInArrow(_sketch(width), "doc_id long, n_shingles long, s1 long, s2 long")


def _packs(width: int, parts: int):
    """Pack the shingles of a task's documents by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = rows = 0
        for batch in batches:
            for part in pieces(batch, "text", TEXT):
                sets, off = shingles(part.column("text"), width)
                a, b = signatures(sets, off)
                held.append((sets, np.diff(off), a, b))
                size, rows = size + len(sets), rows + len(a)
                if size >= FLUSH or rows >= FLUSH_ROWS:
                    yield _pack(held, (task << 32) + number, parts)
                    held, size, rows, number = [], 0, 0, number + 1
        if size:
            yield _pack(held, (task << 32) + number, parts)
        trim()

    return run


def _pack(held: list, flush: int, parts: int) -> pa.RecordBatch:
    sets, n, s1, s2 = (np.concatenate(x) for x in zip(*held, strict=True))
    once = np.zeros(len(n), bool)  # one document for each class
    once[np.unique(np.stack([s1, s2]), axis=1, return_index=True)[1]] = True
    once &= n > 0
    off = np.cumsum(n) - n
    hashes = sets[np.repeat(once, n)]
    n, s1, s2 = n[once], s1[once], s2[once]
    doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(hashes))).astype(np.uint32)
    one = count == 1
    value = hashes[first]
    cuts = np.searchsorted(value, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
    out = []
    for p, (lo, hi) in enumerate(zip(np.append(0, cuts).tolist(), np.append(cuts, len(value)).tolist(), strict=True)):
        v, c, o, f = value[lo:hi], count[lo:hi], one[lo:hi], first[lo:hi]
        if not o.all():
            out.append((p, flush, 0, squeeze(v[~o]), c[~o].tobytes(), b"", b""))
        if o.any():
            d = doc[f[o]]
            mine, index = np.unique(d, return_inverse=True)
            out.append((p, flush, 1, squeeze(v[o]), index.astype(np.uint16).tobytes(), mine.tobytes(), s1[mine].tobytes()))
    many = np.repeat(~one, count)
    table = np.concatenate([[len(n)], n, s1, s2]).astype(np.int64)
    out.append((flush % parts, flush, 2, squeeze(hashes[many]), b"", doc[many].tobytes(), table.tobytes()))
    return pa.RecordBatch.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in out], PACKED)


def _binary(rows: pa.Table, i: int, column: str) -> pa.Buffer:
    return rows.column(column)[i].as_buffer()


def _each(column: str, handle):
    """Apply handle to the rows of each key of a partition. The partition, which holds whole keys, is gathered
    here in small batches, so that the JVM neither sorts the packs nor holds a key's rows as one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            keys = batch.column(column).to_numpy()
            for k in np.unique(keys).tolist():
                held.setdefault(k, []).append(batch.filter(pa.array(keys == k)))
        while held:
            yield from handle(pa.Table.from_batches(held.popitem()[1])).to_batches(max_chunksize=PACKS)
        trim()

    return run


def _frequencies(rows: pa.Table) -> pa.Table:
    """Of one hash range: back to each pack its shingles that two classes share, with their frequency."""
    trim()
    rows = rows.combine_chunks()
    part, flush, kind = (rows.column(c).to_pylist() for c in ("part", "flush", "kind"))
    packs = []
    for i in (i for i, k in enumerate(kind) if k != 2):
        hashes = unsqueeze(_binary(rows, i, "hashes"))
        if kind[i]:
            packs.append((part[i], flush[i], 1, hashes, np.frombuffer(_binary(rows, i, "counts"), np.uint16), np.frombuffer(_binary(rows, i, "docs"), np.uint16), np.frombuffer(_binary(rows, i, "sig"), np.int64)))
        else:
            packs.append((part[i], flush[i], 0, hashes, np.frombuffer(_binary(rows, i, "counts"), np.uint32), None, None))
    total = sum(len(p[3]) for p in packs)
    out: list[tuple] = []
    if total:
        low, high = min(int(p[3][0]) for p in packs), max(int(p[3][-1]) for p in packs) + 1
        steps = max(1, total // AT_ONCE)
        cuts = np.array([low + (high - low) * k // steps for k in range(1, steps)], np.uint64)
        edges = [np.concatenate([[0], np.searchsorted(p[3], cuts), [len(p[3])]]) for p in packs]
        for k in range(steps):
            out += _shared([(p, int(e[k]), int(e[k + 1])) for p, e in zip(packs, edges, strict=True) if e[k] < e[k + 1]])
    found = pa.Table.from_pylist([dict(zip(PACKED.names, r, strict=True)) for r in out], PACKED)
    passed = rows.filter(pa.array([k == 2 for k in kind], pa.bool_())).cast(PACKED)
    return pa.concat_tables([found, passed])


def _shared(slices: list[tuple[tuple, int, int]]) -> list[tuple]:
    """For slices of packs over one range of values: the rows that go back."""
    if not slices:
        return []
    value = np.concatenate([p[3][a:b] for p, a, b in slices])
    single = np.repeat([p[2] == 1 for p, _, _ in slices], [b - a for _, a, b in slices])
    count = np.concatenate([np.ones(b - a, np.uint32) if p[2] else p[4][a:b] for p, a, b in slices])
    sig = np.concatenate([p[6][p[4][a:b]] if p[2] else np.zeros(b - a, np.int64) for p, a, b in slices])
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.diff(np.append(first, len(value)))
    total = np.add.reduceat(count[order].astype(np.int64), first)
    shared = (np.minimum.reduceat(sig[order], first) != np.maximum.reduceat(sig[order], first)) | ~np.logical_and.reduceat(single[order], first)
    frequency, keep = np.zeros(len(value), np.uint32), np.zeros(len(value), bool)
    frequency[order] = np.repeat(np.minimum(total, 0xFFFFFFFF), size)
    keep[order] = np.repeat(shared, size)
    out, i = [], 0
    for p, a, b in slices:
        k = keep[i : i + b - a]
        if k.any():
            docs = p[5][p[4][a:b][k]].tobytes() if p[2] else b""
            out.append((*p[:3], squeeze(p[3][a:b][k]), frequency[i : i + b - a][k].tobytes(), docs, b""))
        i += b - a
    return out


def _survivors(percent: int):
    """Of one pack: the classes with enough shared shingles, and these by frequency, then hash."""

    def run(rows: pa.Table) -> pa.Table:
        trim()
        kind = rows.column("kind").to_pylist()
        head = kind.index(2)
        table = np.frombuffer(_binary(rows, head, "sig"), np.int64)
        n, s1, s2 = table[1:].reshape(3, table[0])
        parts = []
        multi = [i for i, k in enumerate(kind) if k == 0]
        if multi:
            value = np.concatenate([unsqueeze(_binary(rows, i, "hashes")) for i in multi])
            frequency = np.concatenate([np.frombuffer(_binary(rows, i, "counts"), np.uint32) for i in multi])
            order = np.argsort(value)
            mine = unsqueeze(_binary(rows, head, "hashes"))
            parts.append((mine, frequency[order][np.searchsorted(value[order], mine)], np.frombuffer(_binary(rows, head, "docs"), np.uint16)))
        for i in (i for i, k in enumerate(kind) if k == 1):
            parts.append((unsqueeze(_binary(rows, i, "hashes")), np.frombuffer(_binary(rows, i, "counts"), np.uint32), np.frombuffer(_binary(rows, i, "docs"), np.uint16)))
        if not parts:
            return SURVIVORS.empty_table()
        value, frequency, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        have = np.bincount(doc, minlength=len(n))
        good = have >= -(-percent * n // 100)
        take = good[doc]
        value, frequency, doc = value[take], frequency[take], doc[take]
        order = np.lexsort((value, frequency, doc))
        which = np.flatnonzero(good)
        off = np.append(0, np.cumsum(have[which]))
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(value[order].view(np.int64)))
        return pa.Table.from_arrays([pa.array(s1[which]), pa.array(s2[which]), pa.array(n[which]), lists], schema=SURVIVORS)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    x = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """The least intersection of sets of these sizes at the threshold."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def link_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) for the classes (id, n, shared) that link with another; steps 3 to 5."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    found = sets.select("id", "n", F.size("shared").alias("has"), F.slice("shared", 1, prefix.cast("int")).alias("prefix"))
    group = F.sha2(F.concat_ws(",", "n", "has", F.array_join(F.col("prefix").cast("array<string>"), ",")).cast("binary"), 256)
    found = found.withColumn("key", group)
    first = found.groupBy("key").agg(F.min("id").alias("gid"))
    members = materialize(found.join(first, "key").select("id", "gid", "n", "has", "prefix"), "groups")
    heads = members.where("id = gid")
    index = heads.select("gid", "n", F.posexplode("prefix").alias("at", "token"), "has").select("gid", "n", (F.col("at") + F.col("n") - F.col("has")).alias("at"), "token")
    index = materialize(index, "index")

    # Near hubs: the group of the least id at each token, and of those the one met most often.
    hub = index.groupBy("token").agg(F.min("gid").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    met = index.join(hub, "token").where("gid <> hub").groupBy("gid", "hub").agg(F.count("*").alias("c"))
    best = met.groupBy("gid").agg(F.max(F.struct("c", -F.col("hub"))).alias("best")).select(F.col("gid").alias("b"), (-F.col("best.col2")).alias("a"))
    own = members.where("id <> gid").select(F.col("id").alias("b"), F.col("gid").alias("a"))
    near = materialize(_verified(best.union(own), sets, percent), "links")
    label = materialize(components(near), "labels")

    # All pairs of groups that are not in one component yet (a group may lie in several).
    of_member = members.select("id", "gid").join(label, "id", "left").select("id", "gid", F.coalesce("component", "id").alias("c"))
    of_member = materialize(of_member, "members")
    lists = index.join(of_member.select("gid", "c").distinct(), "gid")
    each = lists.groupBy("token", "c").agg(F.count("*").alias("m"))
    crossing = each.groupBy("token").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("crossing")).where("crossing > 0")
    lists = materialize(lists.join(crossing, "token"), "lists")
    few = lists.where(F.col("crossing") <= CROSSING)
    rest = _verified(_sparse_pairs(few, of_member, percent), sets, percent)
    dense = _dense_links(lists.where(F.col("crossing") > CROSSING), of_member, sets, percent)
    return components(near.union(rest).union(dense))


def _sparse_pairs(lists: DataFrame, of_member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members from groups that share a prefix shingle and pass the filters."""
    several = lists.select("token", "c").distinct()
    meet = several.alias("x").join(several.alias("y"), "token").where("x.c < y.c").select("token", F.col("x.c").alias("c1"), F.col("y.c").alias("c2"))
    x = lists.select("token", *(F.col(k).alias(f"{k}1") for k in ("c", "gid", "n", "at")))
    y = lists.select("token", *(F.col(k).alias(f"{k}2") for k in ("c", "gid", "n", "at")))
    pairs = meet.join(x, ["token", "c1"]).join(y, ["token", "c2"])
    pairs = pairs.where((F.col("n1") * percent <= F.col("n2") * 100) & (F.col("n2") * percent <= F.col("n1") * 100))
    # At the last shared token of the prefixes: what is shared so far and at most all that follows. Pairs that
    # share one of the other tokens too are compared in blocks, whatever this bound says of them.
    pairs = pairs.groupBy("c1", "c2", "gid1", "gid2", "n1", "n2").agg(F.count("*").alias("so_far"), F.max("at1").alias("at1"), F.max("at2").alias("at2"))
    most = F.col("so_far") + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) - 1
    pairs = pairs.where(most >= _least_overlap(F.col("n1"), F.col("n2"), percent))
    a = of_member.select(F.col("id").alias("a"), F.col("gid").alias("gid1"), F.col("c").alias("c1"))
    b = of_member.select(F.col("id").alias("b"), F.col("gid").alias("gid2"), F.col("c").alias("c2"))
    return pairs.select("c1", "c2", "gid1", "gid2").join(a, ["gid1", "c1"]).join(b, ["gid2", "c2"]).select("a", "b").distinct()


BLOCKS = "family long, block long, c_low long, c_high long, n_low long, n_high long, ids binary, cs binary, ns binary, sizes binary, sets binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack sorted classes (family, c, id, n, shared) into blocks of one family."""
    held: list[dict] = []
    total = 0

    def pack() -> pa.RecordBatch:
        c, n, i = (np.array([r[k] for r in held], np.int64) for k in ("c", "n", "id"))
        one = {"family": held[0]["family"], "block": int(i.min()), "c_low": int(c.min()), "c_high": int(c.max()), "n_low": int(n.min()), "n_high": int(n.max()), "ids": i.tobytes(), "cs": c.tobytes(), "ns": n.tobytes(), "sizes": np.array([len(r["shared"]) for r in held], np.int64).tobytes(), "sets": np.concatenate([np.array(r["shared"], np.int64) for r in held]).tobytes()}
        return pa.RecordBatch.from_pylist([one], pa.schema([*((k, pa.int64()) for k in ("family", "block", "c_low", "c_high", "n_low", "n_high")), *((k, pa.binary()) for k in ("ids", "cs", "ns", "sizes", "sets"))]))

    for batch in batches:
        for r in batch.to_pylist():
            if held and (held[0]["family"] != r["family"] or len(held) >= BLOCK or total + len(r["shared"]) > BLOCK_SHINGLES):
                yield pack()
                held, total = [], 0
            held.append(r)
            total += len(r["shared"])
    if held:
        yield pack()
    trim()


def overlaps(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the sets that lie one after another in x with those in y."""
    out = np.zeros((len(x_size), len(y_size)), np.float32)
    tokens = np.intersect1d(x, y)
    rx, ry = np.repeat(np.arange(len(x_size)), x_size), np.repeat(np.arange(len(y_size)), y_size)
    px, py = np.searchsorted(tokens, x), np.searchsorted(tokens, y)
    okx, oky = (tokens[np.minimum(p, max(len(tokens) - 1, 0))] == v if len(tokens) else np.zeros(len(v), bool) for p, v in ((px, x), (py, y)))
    for a in range(0, len(tokens), COLUMNS):
        left, right = (np.zeros((len(s), min(COLUMNS, len(tokens) - a)), np.float32) for s in (x_size, y_size))
        for m, p, r, ok in ((left, px, rx, okx), (right, py, ry, oky)):
            here = ok & (p >= a) & (p < a + COLUMNS)
            m[r[here], p[here] - a] = 1
        out += left @ right.T
    return out.astype(np.int64)


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for r in batch.to_pylist():
                sides = [{k: np.frombuffer(r[k + end], np.int64) for k in ("ids", "cs", "ns", "sizes", "sets")} for end in ("", "2")]
                x, y = sides
                both = overlaps(x["sets"], x["sizes"], y["sets"], y["sizes"])
                link = (100 * both >= percent * (x["ns"][:, None] + y["ns"] - both)) & (x["cs"][:, None] != y["cs"])
                i, j = np.nonzero(link)
                name = np.concatenate([x["ids"], y["ids"]])
                edges = forest(i, j + len(x["ids"]), len(name))
                yield pa.RecordBatch.from_arrays([pa.array(name[[e[0] for e in edges]], pa.int64()), pa.array(name[[e[1] for e in edges]], pa.int64())], ["a", "b"])
        trim()

    return run


def _dense_links(lists: DataFrame, of_member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold together all that link across components and share one of these prefix shingles."""
    spark = lists.sparkSession
    hub = lists.groupBy("token").agg(F.min("gid").alias("a"))
    edges = materialize(lists.select("token", F.col("gid").alias("b")).join(hub, "token").select("a", "b").distinct(), "links")
    family = components(edges).select(F.col("id").alias("gid"), F.col("component").alias("family"))
    # A group that is alone at its shingles has no link to another one: it is a family of its own.
    family = lists.select("gid").distinct().join(family, "gid", "left").select("gid", F.coalesce("family", "gid").alias("family"))
    family = materialize(family, "families")
    rows = of_member.join(family, "gid").select("id", "c", "family").join(sets, "id").select("family", "c", "id", "n", "shared")
    order = ["family", "c", "id"]
    parts = input_parts(lists, least=8)
    with batch_rows(spark, 50):
        blocks = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS), "blocks")
    head = blocks.select("family", "block", "c_low", "c_high", "n_low", "n_high")
    other = head.select("family", *(F.col(k).alias(f"{k}2") for k in ("block", "c_low", "c_high", "n_low", "n_high")))
    apart = ~((F.col("c_low") == F.col("c_high")) & (F.col("c_low2") == F.col("c_high2")) & (F.col("c_low") == F.col("c_low2")))
    sizes = (F.col("n_low") * percent <= F.col("n_high2") * 100) & (F.col("n_low2") * percent <= F.col("n_high") * 100)
    head, other = salted(head, other, blocks.count(), SALTED)
    meet = head.join(other, ["family", "salt"]).where((F.col("block") <= F.col("block2")) & apart & sizes).select("block", "block2")
    data = ("ids", "cs", "ns", "sizes", "sets")
    x = blocks.select("block", *data)
    y = blocks.select(F.col("block").alias("block2"), *(F.col(k).alias(f"{k}2") for k in data))
    pairs = meet.join(x, "block").join(y, "block2").repartition(parts, "block", "block2")
    with batch_rows(spark, 2):
        return materialize(pairs.mapInArrow(_compared(percent), "a long, b long"), "links")


def join(docs: DataFrame, percent: int = 85, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = materialize(sketch(docs, width), "sketch")
    real = sketched.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    parts = input_parts(docs, least=64, most=40_000, each=2)
    packed = docs.where("doc_id is not null").mapInArrow(_packs(width, parts), PACK)
    counted = packed.repartition(parts, "part").mapInArrow(_each("part", _frequencies), PACK)
    left = counted.repartition(parts, "flush").mapInArrow(_each("flush", _survivors(percent)), "s1 long, s2 long, n long, shared array<long>")
    with batch_rows(spark, PACKS):
        left = materialize(left, "survivors").dropDuplicates(["s1", "s2"])
    sets = materialize(left.join(classes, ["s1", "s2"]).select("id", "n", "shared"), "sets")
    linked = materialize(link_classes(sets, percent), "components")
    named = classes.join(linked, "id", "left").select("s1", "s2", F.col("id").alias("class_id"), "component")
    out = sketched.join(named, ["s1", "s2"], "left")
    alone = F.col("n_shingles") == 0
    own = F.when(F.col("doc_id").isNull() | alone, F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        own.otherwise(F.col("class_id")).alias("class_id"),
        own.otherwise(F.coalesce("component", "class_id")).alias("component_id"),
    )
