"""Embedding near-duplicates by NN-descent.

Vectors of one label form a neighbour graph. Random hyperplane buckets give
each vector a first list of K neighbours; then every round joins the
neighbours (and reverse neighbours) of each vector with one another and keeps
the best K of each, until few list entries change. Equal vectors of a label are one
vector with a weight. The connected members of threshold edges are compared in
tiles, which yields all their links without listing all pairs. Saturated lists,
whose last neighbour is still above the threshold, are enlarged as far as
needed: their vectors look for the nearest outside their own connected group,
and groups are joined, until no list is filled by neighbours above the
threshold. Every gathered group has a bounded size; a larger one is split by
hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .components import components

_LEAF = 64  # expected vectors in a bucket
_PART = 192  # most vectors compared in one go
_TILE = 256
_TREES = 6
_DESCENT = 12  # list length during descent
_STILL = 0.02  # share of changed list entries below which descent ends


def normalised(vectors: DataFrame, vec: str = "embedding", label: str = "label", id_col: str = "vec_id") -> DataFrame:
    """(v, vec_id, label, x): unit double vectors in binary, null where unusable; v numbers the rows."""

    def unit(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = batch.column(1)
            n, size = len(x), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = x.flatten()
            value = pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            label = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            out, first = [None] * n, np.cumsum(size) - size
            for width in np.unique(size[size > 0]).tolist():
                some = np.flatnonzero((size == width) & ~label)
                a = value[first[some][:, None] + np.arange(width)]
                big = np.abs(a).max(axis=1)  # scaled first, so neither huge nor tiny components overflow
                good = np.isfinite(a).all(axis=1) & (big > 0)
                a = a[good] / big[good, None] + 0.0  # no negative zeros: equal vectors have equal bytes
                a /= np.sqrt((a * a).sum(axis=1))[:, None]
                for i, v in zip(some[good].tolist(), a):
                    out[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["v", "vec_id", "label", "x"])
            row += n

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec, F.col(label).cast("long").alias("label")).mapInArrow(unit, "v long, vec_id long, label long, x binary")


def _groups(batches, key: list[str]):
    """Consecutive rows with one key, as tables."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in key:
            c = table.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-2]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _nearest(ids: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[np.ndarray]:
    """The k nearest of each that are not of its own set and more similar than its floor, as (v, w, sim)."""
    sims = x @ x.T
    sims[own[:, None] == own[None, :]] = -2
    k = min(k, len(ids) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(ids)), k)
    near = near.ravel()
    sim = sims[row, near]
    other = sim > (-1.5 if floor is None else floor[row])
    return [ids[row[other]], ids[near[other]], sim[other]]


def _lists(table_key: list[str], k: int):
    def run(batches):
        out, n = [], 0
        for g in _groups(batches, table_key):
            ids = g.column("v").to_numpy()
            ids, first = np.unique(ids, return_index=True)
            if len(ids) > 1:
                floor = g.column("floor").to_numpy()[first] if "floor" in g.column_names else None
                out.append(_nearest(ids, g.column("own").to_numpy()[first], _matrix(g.column("x"))[first], k, floor))
                n += len(out[-1][0])
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["v", "w", "sim"])
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["v", "w", "sim"])

    return run


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each vector; ties by number."""
    w = Window.partitionBy("v").orderBy(F.desc("sim"), "w")
    once = lists.groupBy("v", "w").agg(F.max("sim").alias("sim"))
    return once.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).drop("at")


def _initial(unit: DataFrame, k: int, trees: int) -> DataFrame:
    """Lists from random hyperplane buckets, sized by each label's count; a heavy bucket is split by hash."""
    counts = unit.groupBy("label").agg(F.count("*").alias("c"))
    sized = unit.join(counts, "label").withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / _LEAF))).cast("int"))

    def bucket(batches):
        planes: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x")).to_pylist()
            bits = batch.column(batch.schema.get_field_index("bits")).to_numpy()
            width = np.array([len(y) // 8 for y in x])
            for d in np.unique(width):
                some = np.flatnonzero(width == d)
                m = np.frombuffer(b"".join(x[i] for i in some), np.float64).reshape(-1, d)
                for tree in range(trees):
                    if (tree, d) not in planes:
                        planes[tree, d] = np.random.default_rng([tree, int(d)]).standard_normal((int(d), 40))
                    side = m @ planes[tree, d] > 0
                    code = np.zeros(len(some), dtype=np.int64)
                    for j in range(40):
                        code = np.where(j < bits[some], code * 2 + side[:, j], code)
                    part = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(part.schema.get_field_index(c)) for c in ("v", "own", "label")] + [pa.array(np.full(len(some), tree * 100_000 + d, dtype=np.int64)), pa.array(code), part.column(part.schema.get_field_index("x"))],
                        names=["v", "own", "label", "tree", "code", "x"],
                    )

    coded = sized.select("v", "own", "label", "x", "bits").mapInArrow(bucket, "v long, own long, label long, tree long, code long, x binary")
    key = ["label", "tree", "code"]
    heavy = coded.groupBy(*key).agg(F.count("*").alias("c"))
    split = coded.join(heavy, key).withColumn("part", F.expr(f"pmod(xxhash64(v, tree), cast(ceil(c / {_PART}) as bigint))")).select(*key, "part", "v", "own", "x")
    key.append("part")
    return split.repartition(*key).sortWithinPartitions(*key).mapInArrow(_lists(key, k), "v long, w long, sim double")


def _descend(unit: DataFrame, lists: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: the neighbours and reverse neighbours of each vector meet.

    A hub's are split by a hash that changes with the round. A worker returns
    only what improves a list: more similar than its last entry.
    """
    around = lists.select(F.col("v").alias("hub"), F.col("w").alias("v")).union(lists.select(F.col("w").alias("hub"), "v")).distinct()
    sizes = around.groupBy("hub").agg(F.count("*").alias("c"))
    placed = around.join(sizes, "hub").withColumn("part", F.expr(f"pmod(xxhash64(v, hub, {turn}), cast(ceil(c / {_PART}) as bigint))")).select("hub", "part", "v")
    last = lists.groupBy("v").agg(F.min("sim").alias("sim"), F.count("*").alias("c")).select("v", F.when(F.col("c") >= k, F.col("sim")).otherwise(-1.5).alias("floor"))
    known = unit.select("v", "own", "x").join(last, "v", "left").select("v", "own", "x", F.coalesce("floor", F.lit(-1.5)).alias("floor"))
    met = placed.join(known, "v").select("hub", "part", "v", "own", "x", "floor")
    found = met.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_lists(["hub", "part"], k), "v long, w long, sim double")
    return _best(found.union(lists), k)


def neighbour_lists(unit: DataFrame, k: int = _DESCENT, trees: int | None = None) -> DataFrame:
    """(v, w, sim): an approximate list of the k nearest of each vector within its label, without those of one ``own``.

    The number of trees grows with the logarithm of the largest label, for the
    chance that two near vectors share no bucket grows with it. Rounds go on
    until few list entries change.
    """
    largest = unit.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    trees = trees or max(_TREES, int(np.ceil(np.log2(max(2, largest)) / 2)))
    lists = materialize(_best(_initial(unit, k, trees), k), "lists")
    total, turn = max(1, lists.count()), 0
    while True:
        turn += 1
        after = materialize(_descend(unit, lists, k, turn), "lists")
        same = after.join(lists.select("v", "w"), ["v", "w"], "left_semi").count()
        changed, lists = after.count() - same, after
        if changed < _STILL * total:
            return lists


def _groups_of(unit: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node, root): the groups connected by threshold edges.

    A pair above the threshold is cut from both lists only if both are
    saturated. Such vectors look again, outside their groups; each pass joins
    every group that still has one to another, so few passes are needed.
    """
    some, edges, roots = unit.withColumn("own", F.col("v")), None, None
    while True:
        lists = neighbour_lists(some, k)
        near = lists.where(F.col("sim") >= threshold - 1e-9)
        links = near.select(F.col("v").alias("a"), F.col("w").alias("b"))
        if edges is not None and links.isEmpty():
            return roots
        edges = links if edges is None else edges.union(links)
        roots = components(edges)
        full = near.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("v")
        full = materialize(full.join(roots.select(F.col("node").alias("v"), F.col("root").alias("own")), "v"), "saturated")
        if full.select("own").distinct().limit(2).count() < 2:
            return roots
        some = materialize(unit.join(full, "v"), "unit")


def _tiles(threshold: float):
    """For each pair of blocks of a connected group: links by vector and a spanning forest."""

    def run(batches):
        for g in _groups(batches, ["root", "b1", "b2"]):
            ids, side, weight, x = g.column("v").to_numpy(), g.column("block").to_numpy(), g.column("weight").to_numpy(), _matrix(g.column("x"))
            b1, b2 = g.column("b1")[0].as_py(), g.column("b2")[0].as_py()
            p, q = np.flatnonzero(side == b1), np.flatnonzero(side == b2)
            linked = x[p] @ x[q].T >= threshold
            if b1 == b2:
                linked &= ids[p][:, None] != ids[q][None, :]
            n = np.bincount(p, weights=linked @ weight[q], minlength=len(ids))
            if b1 != b2:
                n += np.bincount(q, weights=weight[p] @ linked, minlength=len(ids))
            parent, forest = list(range(len(ids))), []
            for i, j in np.argwhere(linked).tolist():
                i, j = int(p[i]), int(q[j])
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                while parent[j] != j:
                    parent[j] = j = parent[parent[j]]
                if i != j:
                    parent[i] = j
                    forest.append((ids[i], ids[j]))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([*ids[some].tolist(), *(int(i) for i, _ in forest)], pa.int64()),
                    "b": pa.array([None] * len(some) + [int(j) for _, j in forest], pa.int64()),
                    "add": pa.array([*n[some].astype(int).tolist(), *([0] * len(forest))], pa.int64()),
                }
            )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = _DESCENT) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors are compared within one label by cosine in double precision. A null
    label and a vector that is null, empty or zero, or holds a null or
    non-finite component, links with nothing and is kept. Vectors of different
    length never meet; they may be of any length. Equal vectors link. Repeated
    rows count as rows; rows with a null id link but give no component its id,
    and are kept only where no linked row has one. No rows give no rows. Only vec_id, embedding and label
    are read, so other columns may have any names.
    """
    rows = materialize(normalised(vectors).withColumn("digest", F.unhex(F.sha2("x", 256))), "rows")
    equal = materialize(rows.where("x is not null").groupBy("label", "digest").agg(F.min("v").alias("one"), F.count("*").alias("weight")), "equal")
    unit = materialize(rows.join(equal.select(F.col("one").alias("v"), "weight"), "v").select("v", "label", "x", "weight"), "unit")
    roots = _groups_of(unit, threshold, k)
    sizes = roots.groupBy("root").agg(F.count("*").alias("m")).withColumn("nb", F.expr(f"cast(ceil(m / {_TILE}) as int)"))
    blocks = roots.withColumnRenamed("node", "v").join(sizes, "root").withColumn("block", F.expr("cast(pmod(xxhash64(v), nb) as int)"))
    pairs = blocks.select("root", "v", "block", F.explode(F.expr("sequence(0, nb - 1)")).alias("other"))
    tiled = pairs.select("root", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "v").join(unit.select("v", "weight", "x"), "v")
    key = ["root", "b1", "b2"]
    found = materialize(tiled.repartition(*key).sortWithinPartitions(*key).mapInArrow(_tiles(threshold), "a long, b long, add long"), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("add").alias("n_links")).withColumnRenamed("a", "v")
    groups = components(found.where("b is not null")).withColumnRenamed("node", "v")
    weighed = equal.withColumnRenamed("one", "v").join(links, "v", "left").join(groups, "v", "left")
    known = weighed.select("label", "digest", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "v").alias("root"))
    named = materialize(rows.select("v", "vec_id", "label", "digest").join(known, ["label", "digest"], "left"), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    return named.join(least, "root", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("least", "vec_id")).alias("kept"),
    )


def recall(vectors: DataFrame, sample: int = 256, threshold: float = 0.98) -> tuple[float | None, int]:
    """Audit: (share of the true links of ``sample`` vectors, those with the smallest hashes, that the descent finds; their number).

    The share is null where there is nothing to find. Null ids are not audited.
    """
    found = near_duplicates(vectors, threshold).select("vec_id", "n_links")
    unit = materialize(normalised(vectors).where("x is not null"), "audit")
    chosen = unit.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "v").limit(sample).select("v", "vec_id", "label", "x").collect()  # `sample` rows
    asked: dict[tuple, list] = {}
    for r in chosen:
        asked.setdefault((r.label, len(r.x)), []).append(r)
    matrices = {k: (np.array([r.v for r in rs]), np.array([r.vec_id for r in rs]), np.frombuffer(b"".join(r.x for r in rs), np.float64).reshape(len(rs), -1)) for k, rs in asked.items()}

    def count(batches):
        for batch in batches:
            groups: dict[tuple, list] = {}
            for v, label, x in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if (label, len(x)) in matrices:
                    groups.setdefault((label, len(x)), []).append((v, x))
            for key, rows in groups.items():
                own, ids, y = matrices[key]
                x = np.frombuffer(b"".join(x for _, x in rows), np.float64).reshape(len(rows), -1)
                near = (x @ y.T >= threshold) & (np.array([v for v, _ in rows])[:, None] != own[None, :])
                n = near.sum(axis=0)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids[n > 0]), "true": pa.array(n[n > 0])})

    truth = unit.mapInArrow(count, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    row = truth.join(found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")), "vec_id").agg(F.sum(F.least("true", "n_links")).alias("got"), F.sum("true").alias("all")).first()
    return (row.got / row["all"] if row["all"] else None), row["all"] or 0
