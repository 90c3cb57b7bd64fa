"""Exact n-gram Jaccard self-join by grouped prefix filtering.

Plan: (1) a fixed-size sketch of shingle frequencies, built over all documents,
orders shingles from rare to frequent; (2) documents with one shingle set
collapse into a class, classes with one size and prefix into a group, and only
groups enter the prefix index; (3) index matches pass the size, position and
parity filters and become pairs of groups; (4) pairs are gathered in families, whose
members are laid out in blocks, and every pair of blocks is one small unit that
verifies its pairs by one matrix product. Units return link counts and a
spanning forest, never lists of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import wordhash
from .common import drop_path, free_name, materialize, materialize_at, scratch_path
from .components import components

_BUCKETS = 1 << 20
_CHUNKS = 64
_NODE = 16  # classes of one group in a node
_BITS = 1 << 25
_COLUMNS = 1 << 13
_TILE = 512  # sets on each side of a matrix product
_FEW = 256  # pairs of a tile below which they are intersected one by one
_PAIRS = 1 << 20  # pairs verified at once
_BLOCK = 1 << 22  # shingles in a block of a family


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    h, at = wordhash.words(texts, wordhash.SPACE_TABLE)
    for a, b in zip(at[:-1], at[1:]):
        yield np.unique(wordhash.shingles(h[a:b], n))


def _narrow(s: np.ndarray) -> bytes:
    """The upper 6 bytes of each hash: within one pair of sets as good as 8, and a quarter less to move."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _parity(s: np.ndarray) -> bytes:
    """One bit for each residue of the hashes, set where it occurs an odd number of times; half a bit to a bit a shingle."""
    bits = max(64, 1 << (max(1, len(s)).bit_length() - 1))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(percent: int):
    """Drop pairs of sets whose parity bits differ in too many places.

    Every differing bit needs a shingle that only one of the sets has, so
    n1 + n2 - (differing bits) bounds twice the intersection: no link is lost.
    A longer bitmap folds onto a shorter one by exclusive or. Pairs with a
    group of several sets, which has no bits of its own, stay.
    """

    def run(batches):
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy() for c in (2, 3))
            b1, b2 = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = np.ones(len(n1), dtype=bool)
            kinds: dict[tuple, list[int]] = {}
            for i, (x, y) in enumerate(zip(b1, b2)):
                if x is not None and y is not None:
                    kinds.setdefault((len(x), len(y)), []).append(i)
            for (p, q), some in kinds.items():
                x = np.frombuffer(b"".join([b1[i] for i in some]), np.uint64).reshape(len(some), -1)
                y = np.frombuffer(b"".join([b2[i] for i in some]), np.uint64).reshape(len(some), -1)
                w = min(p, q) // 8
                differ = np.bitwise_xor.reduce(x.reshape(len(some), -1, w), axis=1) ^ np.bitwise_xor.reduce(y.reshape(len(some), -1, w), axis=1)
                total = n1[some] + n2[some]
                most = (total - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)) // 2
                keep[some] = most * (100 + percent) >= percent * total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["g", "h"]).filter(pa.array(keep))

    return run


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Frequency levels by bucket of the shingle hash: fixed 1 MB whatever the input."""

    def count(batches):
        total = np.zeros(_BUCKETS, dtype=np.int64)
        for batch in wordhash.slices(batches, 0):
            found = list(_sets(batch.column(0), n))
            if found:
                total += np.bincount((np.concatenate(found) & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(_CHUNKS), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, _CHUNKS)], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(counts, dtype=np.int64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition(8, "chunk").mapInArrow(merge, schema).collect()
    total = np.zeros(_BUCKETS, dtype=np.int64)
    for row in parts:
        total.reshape(_CHUNKS, -1)[row.chunk] = np.frombuffer(row.counts, dtype=np.int64)
    usual = total.sum() // _BUCKETS + 1
    return np.minimum(np.log2(total // usual + 1), 15).astype(np.uint8)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n, cid, gid, prefix, bits) for each document; cid names its set, gid its size and prefix."""
    levels = docs.sparkSession.sparkContext.broadcast(_sketch(docs, n))

    def sign(batches):
        for batch in wordhash.slices(batches, 1):
            size, cid, gid, prefix, bits = [], [], [], [], []
            for s in _sets(batch.column(1), n):
                size.append(len(s))
                if not len(s):
                    cid.append(None), gid.append(None), prefix.append(None), bits.append(None)
                    continue
                cid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                level = levels.value[(s & np.uint64(_BUCKETS - 1)).astype(np.int64)]
                first = s[np.argsort(level, kind="stable")[:keep]].view(np.int64)
                gid.append(int.from_bytes(hashlib.blake2b(first.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                prefix.append(first)
                bits.append(_parity(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(cid, pa.binary()), pa.array(gid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n", "cid", "gid", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n long, cid binary, gid long, prefix array<long>, bits binary")


def _group_pairs(signed: DataFrame, percent: int) -> DataFrame:
    """(g, h), g < h: groups whose prefixes meet and whose sizes and positions allow the similarity."""
    groups = signed.where("gid is not null").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posting = groups.select("gid", "n", "prefix", F.posexplode("prefix").alias("pos", "token")).select("token", "gid", F.col("n").cast("int").alias("n"), "pos", F.expr("try_element_at(prefix, if(pos = 0, null, pos))").alias("prev"))
    left, right = posting.alias("a"), posting.alias("b")
    shared = f"(least(a.pos, b.pos) + 1 + least(a.n - a.pos, b.n - b.pos) - 1) * {100 + percent}L >= {percent}L * (a.n + b.n)"
    return (
        left.join(right, F.expr(f"a.token = b.token and a.gid < b.gid and a.n * 100L >= {percent} * b.n and b.n * 100L >= {percent} * a.n and {shared} and not (a.prev <=> b.prev and a.prev is not null)"))
        .select(F.col("a.gid").alias("g"), F.col("b.gid").alias("h"))
        .distinct()
    )


def _commons(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, pair by pair; dense tiles of pairs as matrix products."""
    common = np.zeros(len(i), dtype=np.int64)
    tile = (i // _TILE) * (len(sets) // _TILE + 1) + j // _TILE
    order = np.argsort(tile, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(tile[order])) + 1).tolist(), len(order)]
    dense = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b - a >= _FEW]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < _FEW:
            for k in order[a:b].tolist():
                common[k] = len(np.intersect1d(sets[i[k]], sets[j[k]], assume_unique=True))
    if not dense:
        return common
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(lens)])
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(df > 1, np.cumsum(df > 1) - 1, -1)[ids]  # what is in one set only is in no intersection
    wide = int((df > 1).sum())

    def block(t: int, lo: int) -> np.ndarray:
        first, last = t * _TILE, min((t + 1) * _TILE, len(sets))
        c = column[begin[first] : begin[last]] - lo
        row = np.repeat(np.arange(last - first), lens[first:last])
        inside = (c >= 0) & (c < _COLUMNS) & (column[begin[first] : begin[last]] >= 0)
        out = np.zeros((last - first, min(wide - lo, _COLUMNS)), dtype=np.float32)
        out[row[inside], c[inside]] = 1
        return out

    for lo in range(0, wide, _COLUMNS):  # columns in slices: memory does not grow with the texts
        at, left = -1, None
        for a, b in dense:
            k = order[a:b]
            ti, tj = int(i[k[0]]) // _TILE, int(j[k[0]]) // _TILE
            if ti != at:
                at, left = ti, block(ti, lo)
            gram = left @ (left if ti == tj else block(tj, lo)).T
            common[k] += gram[i[k] - ti * _TILE, j[k] - tj * _TILE].astype(np.int64)
    return common


def _verify(percent: int):
    """For a task's units, one after the other: link counts by class and a spanning forest."""

    def unit(rows: list[tuple]) -> tuple[list, list]:
        nodes: dict[tuple, list[int]] = {}
        cids, sizes, sets, pairs, seen = [], [], [], [], set()
        for gid, k, gid2, k2, cid, size, s in rows:
            if cid is None:
                pairs.append(((gid, k), (gid2, k2)))
            elif cid not in seen:  # rows that repeat an id bring a set twice
                seen.add(cid)
                nodes.setdefault((gid, k), []).append(len(cids))
                cids.append(cid), sizes.append(size), sets.append(_wide(s))
        lens, size = np.array([len(s) for s in sets], dtype=np.int64), np.array(sizes, dtype=np.int64)
        adds, parent, forest = np.zeros(len(sets), dtype=np.int64), list(range(len(sets))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def settle(left: list[int], right: list[int]) -> None:
            i, j = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
            i, j = np.minimum(i, j), np.maximum(i, j)
            close = np.minimum(lens[i], lens[j]) * 100 >= percent * np.maximum(lens[i], lens[j])
            i, j = i[close], j[close]
            common = _commons(sets, i, j)
            linked = common * 100 >= percent * (lens[i] + lens[j] - common)
            i, j = i[linked], j[linked]
            np.add.at(adds, i, size[j])
            np.add.at(adds, j, size[i])
            for x, y in zip(i.tolist(), j.tolist()):
                if (rx := root(x)) != (ry := root(y)):
                    parent[rx] = ry
                    forest.append((cids[x], cids[y]))

        left, right = [], []
        for p, q in pairs:
            mine, other = nodes.get(p, ()), nodes.get(q, ())
            for n, x in enumerate(mine):
                some = other[n + 1 :] if p == q else other
                left += [x] * len(some)
                right += some
            if len(left) > _PAIRS:
                settle(left, right)
                left, right = [], []
        settle(left, right)
        return [(cids[i], int(adds[i])) for i in np.flatnonzero(adds)], forest

    def run(batches):
        now, rows = None, []

        def done():
            counts, forest = unit(rows)
            if counts:
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": pa.array([x for x, _ in counts] + [x for x, _ in forest], pa.binary()),
                        "b": pa.array([None] * len(counts) + [y for _, y in forest], pa.binary()),
                        "add": pa.array([y for _, y in counts] + [0] * len(forest), pa.int64()),
                    }
                )

        for batch in batches:
            for f, b1, b2, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, b1, b2) != now:
                    if rows:
                        yield from done()
                    now, rows = (f, b1, b2), []
                rows.append(tuple(row))
        if rows:
            yield from done()

    return run


def _slot(id_sql: str) -> str:
    return f"pmod(xxhash64({id_sql}), {_BITS})"


def _bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bitmap of the hashed ids: 4 MB whatever the input; a false hit costs time, never a result."""
    bits = rows.select(F.expr(f"cast({_slot(column)} div 64 as int)").alias("word"), F.expr(f"shiftleft(1L, cast({_slot(column)} % 64 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(_BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(signed, classes) of a self-join at ``percent`` Jaccard over n-word shingles.

    signed has a row per document: doc_id, n (set size), cid (null without
    words). classes has a row for each set with more than one document or a
    link: cid, size (documents), links (documents with other sets linked
    directly), root (one cid for each component) and component (smallest doc_id
    reachable). Links are complete and
    verified; shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "prefixes")
    full = materialize_at(signatures(docs, n, percent), path)
    signed = materialize(full.select("doc_id", "n", "cid"), "signed")
    classes = materialize(full.where("cid is not null").groupBy("cid").agg(F.count("*").alias("size"), F.min("doc_id").alias("rep"), F.first("gid").alias("gid"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    groups = classes.groupBy("gid").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.first("n").alias("n"), F.first("bits").alias("bits")).withColumn("nk", F.expr(f"cast(ceil(m / {_NODE}) as int)"))
    groups = materialize(groups.withColumn("bits", F.when(F.col("m") == 1, F.col("bits"))), "groups")
    mine, other = groups.select(F.col("gid").alias("g"), F.col("n").alias("n1"), F.col("bits").alias("b1")), groups.select(F.col("gid").alias("h"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    met = _group_pairs(full, percent).join(mine, "g").join(other, "h").select("g", "h", "n1", "n2", "b1", "b2")
    between = materialize(met.mapInArrow(_may_link(percent), "g long, h long"), "pairs")
    drop_path(spark, path)

    # families: a pair belongs to the smaller leader of its two groups
    around = between.union(between.select("h", "g"))
    leader = around.groupBy("g").agg(F.min("h").alias("l"))
    group = materialize(groups.join(leader, groups.gid == leader.g, "left").select(F.col("gid").alias("g"), "m", "s", "nk", F.least("gid", "l").alias("l")), "groups")
    first, second = group.select("g", F.col("nk").alias("n1"), F.col("l").alias("l1")), group.select(F.col("g").alias("h"), F.col("nk").alias("n2"), F.col("l").alias("l2"))
    led = between.join(first, "g").join(second, "h").select(F.least("l1", "l2").alias("f"), "g", "n1", "h", "n2")
    within = group.where("m > 1").select(F.col("l").alias("f"), "g", F.col("nk").alias("n1"), F.col("g").alias("h"), F.col("nk").alias("n2"))
    led = materialize(led.union(within), "families")
    sizes = led.select("f", "g").union(led.select("f", "h")).distinct().join(group.select("g", "s"), "g").groupBy("f").agg(F.sum("s").alias("total"))
    pairs = (
        led.join(sizes, "f")
        .withColumn("k1", F.explode(F.expr("sequence(0, n1 - 1)")))
        .withColumn("k2", F.explode(F.expr("sequence(0, n2 - 1)")))
        .where("g <> h or k1 <= k2")
        .withColumn("nb", F.expr(f"ceil(total / {_BLOCK})"))
        .withColumn("c1", F.expr("pmod(xxhash64(g, k1), nb)"))
        .withColumn("c2", F.expr("pmod(xxhash64(h, k2), nb)"))
        .select("f", F.least("c1", "c2").alias("b1"), F.greatest("c1", "c2").alias("b2"), "g", "k1", "h", "k2")
    )
    pairs = materialize(pairs, "units")

    members = classes.drop("n", "bits").join(groups.select("gid", "nk"), "gid").withColumn("k", F.expr("cast(pmod(xxhash64(cid), nk) as int)")).select("gid", "k", "cid", "size", "rep")
    placed = pairs.select("f", "b1", "b2", F.col("g").alias("gid"), F.col("k1").alias("k")).union(pairs.select("f", "b1", "b2", "h", "k2")).distinct()
    # a fixed-size bitmap of the wanted representatives spares most texts; a false hit falls out in the join
    shared = spark.sparkContext.broadcast(_bitmap(members.join(placed.select("gid").distinct(), "gid", "left_semi").where("rep is not null"), "rep"))

    def reread(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = (shared.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            for part in wordhash.slices([batch.filter(pa.array(hit | batch.column(2).to_numpy(zero_copy_only=False)))], 1):
                found = [s for s in _sets(part.column(1), n) if len(s)]
                yield pa.RecordBatch.from_pydict({"cid": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), "shingles": pa.array([_narrow(s) for s in found], pa.binary())})

    source = docs.select(F.expr(_slot("cast(doc_id as bigint)")).alias("slot"), "text", F.col("doc_id").isNull().alias("nameless"))
    sets = source.mapInArrow(reread, "cid binary, shingles binary")
    full_members = placed.join(members, ["gid", "k"]).join(sets, "cid")
    none = F.lit(None)
    rows = full_members.select("f", "b1", "b2", "gid", "k", none.cast("long").alias("h"), none.cast("int").alias("k2"), "cid", "size", "shingles").union(
        pairs.select("f", "b1", "b2", "g", "k1", "h", "k2", none.cast("binary"), none.cast("long"), none.cast("binary"))
    )
    found = rows.repartition("f", "b1", "b2").sortWithinPartitions("f", "b1", "b2").mapInArrow(_verify(percent), "a binary, b binary, add long")
    found = materialize(found, "links")

    direct = found.where("b is null").groupBy("a").agg(F.sum("add").alias("links")).withColumnRenamed("a", "cid")
    roots = components(found.where("b is not null")).withColumnRenamed("node", "cid")
    known = classes.join(direct, "cid", "left").join(roots, "cid", "left").where("size > 1 or links > 0").select("cid", "size", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    return signed, materialize(known.join(least, "root").select("cid", "size", "links", "root", "component"), "components")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, n_similar, component_id.

    Null and empty texts and texts without words have no shingles, no links and
    themselves as component. Repeated rows count as documents. A null doc_id
    takes part in links; it is never a component's smallest id unless all are
    null. Other columns are not read. No rows give no rows.
    """
    signed, classes = links(docs, n, percent)
    return signed.join(classes, "cid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of links: the one with its smallest id.

    All columns and rows without words stay. Rows that repeat the smallest id
    within a component, or a component whose ids are all null, leave one row.
    No rows give no rows. Only the rows that share a component with another
    (and those that a fixed-size bitmap of their ids takes for such) are
    shuffled, by id and set, so copies of one text meet in no task.
    """
    spark = docs.sparkSession
    signed, classes = links(docs, n, percent)
    touched = materialize(signed.join(classes.select("cid", "root", "component"), "cid"), "touched")
    stays = F.col("doc_id").eqNullSafe(F.col("component"))
    gone = touched.where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("cid").alias("gone_cid")).distinct()
    first = touched.where(stays)
    twice = first.groupBy("root").agg(F.count("*").alias("rows")).where("rows > 1").select("root")
    repeated = materialize(first.join(twice, "root").select("cid", "root").distinct().withColumnsRenamed({"cid": "again_cid", "root": "again_root"}), "repeated")
    shared = spark.sparkContext.broadcast(_bitmap(touched.where("doc_id is not null"), "doc_id"))

    names = docs.columns
    key, slot = free_name(names, "set_id"), free_name(names, "slot")
    lower = [c.lower() for c in names]
    at = lower.index("text")
    slotted = docs.withColumn(slot, F.expr(_slot(f"cast(`{names[lower.index('doc_id')]}` as bigint)")))

    def hit(batch, nameless: bool):
        x = batch.column(len(names))
        known = x.fill_null(0).to_numpy(zero_copy_only=False)
        found = (shared.value[known // 64] >> (known % 64).astype(np.uint64)) & np.uint64(1) == 1
        return np.where(x.is_null().to_numpy(zero_copy_only=False), nameless, found)

    def clear(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=batch.schema.names[: len(names)]).filter(pa.array(~hit(batch, True)))

    def tag(batches):
        for batch in batches:
            some = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=batch.schema.names[: len(names)]).filter(pa.array(hit(batch, True)))
            for part in wordhash.slices([some], at):
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in _sets(part.column(at), n)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, key])

    slotted = slotted.withColumn(slot, F.when(F.col(names[lower.index("doc_id")]).isNotNull(), F.col(slot)))
    plain = slotted.mapInArrow(clear, docs.schema)
    tagged = slotted.mapInArrow(tag, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    left = tagged.alias("d").join(gone.alias("g"), F.col(f"d.`{names[lower.index('doc_id')]}`").eqNullSafe(F.col("g.gone_id")) & (F.col(f"d.{key}") == F.col("g.gone_cid")), "left_anti")
    if repeated.isEmpty():
        return plain.unionByName(left.drop(key))
    both = left.alias("d").join(repeated.alias("r"), F.col(f"d.{key}") == F.col("r.again_cid"), "left")
    once = both.where("r.again_cid is null").select("d.*").drop(key)
    again = free_name([*names, key], "again")
    several = both.where("r.again_cid is not null").select("d.*", F.col("r.again_root").alias(again)).dropDuplicates([again]).drop(key, again)
    return plain.unionByName(once).unionByName(several)
