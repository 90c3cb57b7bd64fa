"""K-d tree sharding: weighted medians along the widest metadata dimension.

One pass over the texts leaves a compact table; equal texts are one group with
its bytes. A group's place along a dimension (language, source, length) is a
number: its cell of 2**20 in the upper bits and the text's hash in the lower, so
many groups in one cell still have an order and a hot value splits as well as
any other. The tree is split level by level, all nodes at once: a node that
stands for s shards is cut where floor(s/2)/s of its weight lies below, along
the dimension in which its groups extend furthest, or where a heavy group lies
across that cut, along the next dimension, or in another order of the groups of
one cell, that has a better one. The cut is found by
histograms of places, each narrower than the last. A group is never cut; one
heavier than an even share has a shard to itself. Rows get their shard from the
tree as one expression. Only histograms, bounded by the number of shards, and
the groups that are a thousandth of all rows or more reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

_BINS = 1024
_CELLS = 1 << 20
_EXACT = 0.0005  # a cut may miss its weight by this share of a shard
_HOT = 1000  # at most so many groups can have this part of the rows each
_SLOTS = 500_000  # rows numbered in one go
_NEAR = 1.01  # load of a shard, of an even one, with which a cut is good
DIMENSIONS = 3
_PLACES = 2 * DIMENSIONS


def _code(column: Column) -> Column:
    """The first six bytes of a text as a number, in text order; -1 for null."""
    six = F.rpad(F.substring(column.cast("binary"), 1, 6), 6, F.lit(b"\x00"))
    return F.coalesce(F.conv(F.hex(six), 16, 10).cast("long"), F.lit(-1))


def points(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, text_crc32, hash of the text, and the codes c0 (lang), c1 (source), c2 (length)."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    have = {c.lower() for c in docs.columns}
    pick = lambda c: _code(F.col(c).cast("string")) if c in have else F.lit(-1).cast("long")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        pick("lang").alias("c0"),
        pick("source").alias("c1"),
        F.floor(F.log2(F.octet_length(text) + 1.0) * 1e6).cast("long").alias("c2"),
    )


def _places(groups: DataFrame) -> DataFrame:
    """Groups with their places (k0, ...): along each dimension, in each order of the groups of one cell."""
    ends = groups.agg(*(f(f"c{d}").alias(f"{n}{d}") for d in range(DIMENSIONS) for n, f in (("a", F.min), ("b", F.max)))).first()
    low = [F.col("hash").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("hash", 32)]
    cell = lambda d: F.floor((F.col(f"c{d}") - ends[f"a{d}"]) / max(ends[f"b{d}"] - ends[f"a{d}"], 1) * (_CELLS - 1)).cast("long")
    return groups.select("hash", "text_crc32", "w", "n", *((cell(d % DIMENSIONS) * (1 << 32) + low[d // DIMENSIONS]).alias(f"k{d}") for d in range(_PLACES)))


class _Node:
    def __init__(self, shards: int):
        self.shards, self.cut, self.left, self.right = shards, None, None, None

    def leaves(self) -> list[_Node]:
        return [self] if self.cut is None else self.left.leaves() + self.right.leaves()

    def locate(self, number: dict[int, int]) -> Column:
        """The number of the leaf that a group falls into."""
        if self.cut is None:
            return F.lit(number[id(self)])
        dim, at = self.cut
        return F.when(F.col(f"k{dim}") <= at, self.left.locate(number)).otherwise(self.right.locate(number))

    def plain(self, number: dict[int, int]):
        """The tree as nested tuples (dimension, place, left, right), with the numbers of the wanted leaves."""
        if self.cut is None:
            return number.get(id(self))
        return (*self.cut, self.left.plain(number), self.right.plain(number))


def _histograms(groups: DataFrame, tree, state: dict[tuple[int, int], dict]) -> dict[tuple[int, int], list]:
    """For each (node, dimension) the filled bins (w, a, b) between lo and hi: weight, least and greatest place."""
    wanted = [(i, d, s["lo"], s["hi"]) for (i, d), s in state.items()]

    def count(batches):
        shape = (len(wanted), _BINS)
        weight, low, high = np.zeros(shape, np.int64), np.full(shape, 1 << 62, np.int64), np.full(shape, -1, np.int64)
        for batch in batches:
            w, k = batch.column(0).to_numpy(), [batch.column(d + 1).to_numpy() for d in range(_PLACES)]
            inside: dict[int, np.ndarray] = {}
            stack = [(tree, np.arange(len(w)))]
            while stack:
                t, some = stack.pop()
                if isinstance(t, tuple):
                    left = k[t[0]][some] <= t[1]
                    stack += [(t[2], some[left]), (t[3], some[~left])]
                elif t is not None:
                    inside[t] = some
            for row, (i, d, lo, hi) in enumerate(wanted):
                at = inside[i]
                x = k[d][at]
                here = (x >= lo) & (x <= hi)
                x, at = x[here], at[here]
                order = np.argsort(x, kind="stable")
                x, y = x[order], w[at[order]]
                if not len(x):
                    continue
                bins = (x - lo) * _BINS // (hi - lo + 1)
                first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
                b = bins[first]
                weight[row, b] += np.add.reduceat(y, first)
                low[row, b] = np.minimum(low[row, b], x[first])
                high[row, b] = np.maximum(high[row, b], x[np.append(first[1:], len(x)) - 1])
        row, b = np.nonzero(high >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (row, b, weight[row, b], low[row, b], high[row, b])], names=["row", "bin", "w", "a", "b"])

    parts = groups.select("w", *(f"k{d}" for d in range(_PLACES))).mapInArrow(count, "row long, bin long, w long, a long, b long")
    found: dict[tuple[int, int], list] = {k: [] for k in state}
    for r in parts.groupBy("row", "bin").agg(F.sum("w").alias("w"), F.min("a").alias("a"), F.max("b").alias("b")).collect():  # nodes x places x _BINS at most
        found[wanted[r.row][:2]].append(r)
    return found


def _share(below: int, above: int, shards: int) -> tuple[float, int]:
    """The least greatest load of a shard, and how many shards the lower part then has."""
    return min((max(below / s, above / (shards - s)), abs(2 * s - shards), s) for s in range(1, shards))[::2]


def _cuts(groups: DataFrame, root: _Node, open_: list[_Node], slack: float) -> dict[int, tuple[int, int, int]]:
    """For each open node (dimension, place, shards below): groups up to this place go left. Nodes of one group have none."""
    tree = root.plain({id(n): i for i, n in enumerate(open_)})
    state: dict[tuple[int, int], dict] = {(i, d): {"lo": 0, "hi": _CELLS * (1 << 32) - 1} for i in range(len(open_)) for d in range(_PLACES)}
    seen = _histograms(groups, tree, state)
    widest: dict[int, list[int]] = {}
    options: dict[int, dict[int, tuple]] = {}
    for i, node in enumerate(open_):
        if not seen[i, 0]:  # no groups at all
            widest[i] = []
            for d in range(_PLACES):
                del state[i, d]
            continue
        extent = {d: (max(r.b for r in seen[i, d]) >> 32) - (min(r.a for r in seen[i, d]) >> 32) for d in range(DIMENSIONS)}
        widest[i], options[i] = sorted(range(_PLACES), key=lambda d: (-extent[d % DIMENSIONS], d)), {}
        for d in range(_PLACES):
            total = sum(r.w for r in seen[i, d])
            state[i, d] |= {"bins": seen[i, d], "below": 0, "last": None, "total": total, "need": total * (node.shards // 2) / node.shards}
    while state:
        for (i, dim), s in list(state.items()):
            below, last = s["below"], s["last"]
            for r in sorted(s["bins"], key=lambda r: r.a):
                if below + r.w > s["need"]:
                    break
                below, last = below + r.w, r.b
            if r.a != r.b and r.w > slack:
                s |= {"lo": r.a, "hi": r.b, "below": below, "last": last}
                continue
            for x, at in ((below, last), (below + r.w, r.b)):
                if 0 < x < s["total"]:
                    load, shards = _share(x, s["total"] - x, open_[i].shards)
                    options[i][dim] = min(options[i].get(dim, (float("inf"),)), (load * open_[i].shards / s["total"], at, shards))
            del state[i, dim]
        if state:
            for k, bins in _histograms(groups, tree, state).items():
                state[k]["bins"] = bins
    out = {}
    for i, dims in widest.items():
        if not dims:
            continue
        good = [d for d in dims if d in options[i] and options[i][d][0] <= _NEAR] or sorted(options[i], key=lambda d: options[i][d][0])
        if good:
            _, at, shards = options[i][good[0]]
            out[i] = (good[0], at, shards)
    return out


def kd_shards(docs: DataFrame, shards: int = 40, exact: float = _EXACT) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards are of near equal size, as near as whole groups
    allow, and all rows of a text (of its 64-bit hash and checksum) are in one
    shard. A text heavier than an even share of the rest has a shard to itself,
    and the rest is spread evenly over the others. size counts UTF-8 bytes and
    16 more; a null text has no bytes and counts as equal to an empty one. A
    group's language and source are the least of its rows; a missing column or
    a null is a value of its own, before all others. slot counts gaplessly from
    0 within each shard; repeated rows have slots of their own. Texts may be as
    long as they like. Only doc_id, text, lang and source are read, so other
    columns may have any names. No rows give no rows.
    """
    base = materialize(points(docs), "points")
    key = ["hash", "text_crc32"]
    groups = base.groupBy(*key).agg(F.sum("size").alias("w"), F.count("*").alias("n"), *(F.min(f"c{d}").alias(f"c{d}") for d in range(DIMENSIONS)))
    groups = materialize(groups, "groups")
    sums = groups.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    slot, grown = F.lit(0).cast("long"), F.lit(None).cast("int")
    if sums.w is None:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), slot.alias("slot"), grown.alias("grown_shard"))
    groups = materialize(_places(groups), "places")
    # at most shards - 1 texts are heavier than an even share
    heavy = groups.where(F.col("w") * shards > sums.w).orderBy(F.desc("w"), *key).collect()
    alone, weight = [], sums.w
    for g in heavy:
        if len(alone) < shards - 1 and g.w * (shards - len(alone)) > weight:
            alone.append(g)
            weight -= g.w
    of = F.lit(None).cast("int")
    for i, g in enumerate(alone):
        of = F.when((F.col("hash") == g.hash) & (F.col("text_crc32") == g.text_crc32), shards - 1 - i).otherwise(of)
    rest = groups.where(of.isNull())
    root = _Node(shards - len(alone))
    open_ = [root] if root.shards > 1 else []
    while open_:
        cuts = _cuts(rest, root, open_, exact * weight / root.shards)
        made = []
        for i, n in enumerate(open_):
            if i in cuts:
                dim, at, below = cuts[i]
                n.cut, n.left, n.right = (dim, at), _Node(below), _Node(n.shards - below)
                made += [c for c in (n.left, n.right) if c.shards > 1]
        open_ = made
    number, at = {}, 0
    for leaf in root.leaves():
        number[id(leaf)] = at
        at += leaf.shards
    named = groups.select(*key, "n", F.coalesce(of, root.locate(number)).alias("shard"))
    # texts with a thousandth of the rows each are _HOT at most: they are broadcast, and no key of the join is hot
    hot = named.where(F.col("n") * _HOT >= sums.n).select(*key, "shard")
    cool = named.where(F.col("n") * _HOT < sums.n).select(*key, "shard")
    compact = base.select("row", "doc_id", "size", *key)
    placed = compact.join(F.broadcast(hot), key).unionByName(compact.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cool, key))
    cells = max(4, -(-sums.n // (shards * _SLOTS)))
    placed = materialize(placed.select("row", "doc_id", "size", "text_crc32", "shard", F.expr(f"cast(pmod(xxhash64(row), {cells}) as int)").alias("cell")), "placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    return placed.withColumn("rank", rank).join(counts.select("shard", "cell", before.alias("before")), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), grown.alias("grown_shard")
    )
