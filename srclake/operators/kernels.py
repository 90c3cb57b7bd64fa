"""Relational kernels: generic over tables, with column names as parameters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# filters and joins


def contains_ci(column: str, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.instr(F.lower(F.col(column)), needle.lower()) > 0


def dotted_suffixes(column: str) -> Column:
    """Every suffix of a dotted name that begins after a dot, and the name itself."""
    parts = F.split(F.col(column), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def suffix_join(calls: DataFrame, names: DataFrame, callee: str, name: str) -> DataFrame:
    """Pairs where callee equals name or ends with '.' + name, as an equi join on exploded suffixes."""
    exploded = calls.withColumn("_suffix", F.explode(dotted_suffixes(callee)))
    return exploded.join(names, F.col("_suffix") == F.col(name)).drop("_suffix")


def last_segment(column: str) -> Column:
    return F.substring_index(F.col(column), ".", -1)


def missing(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Used keys that are not declared."""
    return used.select(key).distinct().join(declared.select(key), key, "left_anti")


def missing_by_prefix(used: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Used keys that are not declared, where a key that goes on after an underscore stands for the shorter one too.

    Both prefix tests are equi joins on exploded prefixes.
    """
    parts = F.split(F.col(key), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    u, d = used.select(key).where(F.col(key) != "").distinct(), declared.select(key).where(F.col(key) != "").distinct()
    longer = d.select(F.explode(prefixes).alias(key)).distinct()
    left = u.join(longer, key, "left_anti")
    shorter = left.select(F.col(key).alias("_whole"), F.explode(prefixes).alias(key)).join(d, key, "left_semi").select(F.col("_whole").alias(key)).distinct()
    return left.join(shorter, key, "left_anti")


def sampled(df: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """(key, n, sample): the number of distinct members of each key, and up to ``most`` of them in order; no list grows with the data."""
    ranked = df.select(key, member).distinct().withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(member)))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_at") <= most, F.col(member)))).alias("sample"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, deleted, updated or unchanged, by a full outer join."""
    a, b = old.select(F.col(key), F.col(value).alias("_old"), F.lit(1).alias("_a")), new.select(F.col(key), F.col(value).alias("_new"), F.lit(1).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def retain(derived: DataFrame, fresh: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """Derived rows of unchanged keys, and fresh rows of the added and updated ones."""
    same, changed = diff.where("status = 'unchanged'").select(key), diff.where("status in ('added', 'updated')").select(key)
    return derived.join(same, key, "left_semi").unionByName(fresh.join(changed, key, "left_semi"), allowMissingColumns=True)


# aggregates


def duplicate_groups(df: DataFrame, fingerprint: str, member: str) -> DataFrame:
    """(fingerprint, n, members): values that occur more than once, most frequent first to be sorted by the caller."""
    return df.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(member)).alias("members")).where("n > 1")


def inventory(df: DataFrame, dims: list[str], lines: str) -> DataFrame:
    """Counts and line sums in total and by each of the dimensions, in one pass."""
    view = df.select(*dims, F.col(lines).alias("_lines"))
    keys = ", ".join(dims)
    sets = ", ".join(["()"] + [f"({d})" for d in dims])
    return df.sparkSession.sql(f"select {keys}, count(*) as files, cast(sum(_lines) as bigint) as lines from {{t}} group by grouping sets ({sets})", t=view)


def severity(column: Column, warn: float, critical: float) -> Column:
    return F.when(column > critical, "critical").when(column > warn, "warning").otherwise("ok")


def coverage(covered: Column, groups: list[str], df: DataFrame) -> DataFrame:
    """Totals, covered rows and their percentage, by group."""
    n, c = F.count("*"), F.count_if(covered)
    return df.groupBy(*groups).agg(n.alias("total"), c.alias("covered"), F.round(F.lit(100.0).cast("double") * c / n, 1).alias("pct"))


def pick_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order key, for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# graph


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree) over distinct edges."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    both = e.select(F.col("d").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("s", F.lit(0), F.lit(1)))
    if nodes is not None:
        both = both.union(nodes.select(F.col(nodes.columns[0]), F.lit(0), F.lit(0)))
    return both.groupBy("node").agg(F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"))


def rank_threshold(df: DataFrame, column: str, floor: int) -> DataFrame:
    """One row: the value at place max(1, n // 20), from 0, of the descending order, and at least ``floor``.

    Only the histogram of values is ordered, not the rows.
    """
    hist = df.groupBy(column).agg(F.count("*").alias("_c"))
    above = F.coalesce(F.sum("_c").over(Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = hist.agg(F.sum("_c").alias("_n"))
    place = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") / 20)), F.col("_n") - 1)
    at = hist.withColumn("_a", above).crossJoin(F.broadcast(total)).where((F.col("_a") <= place) & (place < F.col("_a") + F.col("_c")))
    return at.agg(F.greatest(F.max(column), F.lit(floor)).cast("bigint").alias("threshold"))


def roles(degree: DataFrame, in_floor: int = 3, out_floor: int = 5) -> DataFrame:
    """core, hub, utility, isolated or standard, first rule wins; one-row thresholds are broadcast."""
    i, o = rank_threshold(degree, "in_degree", in_floor).withColumnRenamed("threshold", "_i"), rank_threshold(degree, "out_degree", out_floor).withColumnRenamed("threshold", "_o")
    high_in, high_out = F.col("in_degree") >= F.col("_i"), F.col("out_degree") >= F.col("_o")
    role = F.when(high_in & high_out, "core").when(high_out, "hub").when(high_in, "utility").when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "isolated").otherwise("standard")
    return degree.crossJoin(F.broadcast(i)).crossJoin(F.broadcast(o)).withColumn("role", role).drop("_i", "_o")


def importance(degree: DataFrame) -> DataFrame:
    """0.7 of the relative in-degree and 0.3 of the relative out-degree, to 6 places."""
    top = degree.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("_i"), F.greatest(F.max("out_degree"), F.lit(1)).alias("_o"))
    score = F.lit(0.7).cast("double") * F.col("in_degree") / F.col("_i") + F.lit(0.3).cast("double") * F.col("out_degree") / F.col("_o")
    return degree.crossJoin(F.broadcast(top)).select("node", F.round(score, 6).alias("importance"))


def reverse_adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(dst).alias("node"), F.col(src).alias("_s")).distinct().groupBy("node").agg(F.sort_array(F.collect_list("_s")).alias("callers"))


def transitive(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth): callers reached within ``depth`` steps back from ``start``, at their least depth."""
    back = edges.select(F.col(dst).alias("_to"), F.col(src).alias("node")).distinct()
    seen = start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        front = front.select(F.col("node").alias("_to")).join(back, "_to").select("node").distinct().join(seen, "node", "left_anti").select("node", F.lit(k).alias("depth"))
        seen = seen.union(front)
    return seen.where("depth > 0")


def trace_paths(edges: DataFrame, roots: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(path, depth, truncated): simple paths from the roots; a repeated node ends a path as truncated."""
    step = edges.select(F.col(src).alias("_from"), F.col(dst).alias("_next")).distinct()
    level = roots.select(F.array(F.col(roots.columns[0])).alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("truncated"))
    levels = [level]
    for k in range(1, depth + 1):
        open_ = levels[-1].where(~F.col("truncated"))
        nxt = open_.withColumn("_from", F.element_at("path", -1)).join(step, "_from")
        levels.append(nxt.select(F.concat("path", F.array("_next")).alias("path"), F.lit(k).alias("depth"), F.array_contains("path", F.col("_next")).alias("truncated")))
    return reduce(DataFrame.union, levels)


# similarity


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0).cast("double"), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(vectors: DataFrame, query: list[float], id_col: str, vec: str, k: int = 10, least: float = 0.3) -> DataFrame:
    """The k nearest of one query by cosine, without those below ``least``; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.select(id_col, cosine(F.col(vec), q).alias("_s")).orderBy(F.desc("_s"), id_col).limit(k)
    return top.where(F.col("_s") >= least).select(id_col, F.round("_s", 3).alias("score"))


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of the usual width that are neither null nor zero and hold no null."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(np.bincount(size).argmax()) if len(size) and size.max() else 0
    some = np.flatnonzero(size == width) if width else np.zeros(0, np.int64)
    if not width:
        return some, np.zeros((0, 0))
    flat = pc.fill_null(pc.cast(column.take(pa.array(some)).flatten(), pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(some), width)
    norm = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return some[good], flat[good] / norm[good, None]


_SIDE = 512  # queries compared at once, with twice as many vectors


def _merge_nearest(best: np.ndarray, who: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """Take vectors into the rows of each query's nearest, in place: scores ``best``, falling, and ids ``who``.

    The product only finds candidates: its last digits depend on a vector's
    place in it, and equal vectors must tie.
    """
    row, at = np.nonzero(q @ x.T >= best[:, -1:] - 1e-9)
    step = max(1, (1 << 20) // q.shape[1])
    s = np.concatenate([np.zeros(0), *((q[row[i : i + step]] * x[at[i : i + step]]).sum(axis=1) for i in range(0, len(row), step))])
    edge = best[row, -1]
    keep = (s > edge) | (s == edge) & (ids[at] < who[row, -1])
    row, s, w = row[keep], s[keep], ids[at[keep]]
    some, k = np.unique(row), best.shape[1]
    row, s, w = np.concatenate([np.repeat(some, k), row]), np.concatenate([best[some].ravel(), s]), np.concatenate([who[some].ravel(), w])
    order = np.lexsort((w, -s, row))
    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
    best[some], who[some] = s[order].reshape(-1, k), w[order].reshape(-1, k)


def cosine_topk_each(queries: DataFrame, vectors: DataFrame, id_col: str, vec: str, k: int = 10, least: float = 0.3, block: int = 4096) -> DataFrame:
    """(query_id, id, score): for each query the k nearest of all vectors by cosine, without those below ``least``; ties by id.

    Queries go in blocks of bounded size, each broadcast once; a task compares
    them in squares of bounded size and keeps the k nearest of each query, however
    many tie, so little is held or shuffled. No queries or no vectors give
    no rows; a null or zero vector, or one of another width, is near nothing.
    """
    spark, schema = vectors.sparkSession, f"query_id long, {id_col} long, _s double"
    blocks = -(-queries.count() // block)
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = queries.where(F.expr(f"pmod(xxhash64(`{id_col}`), {blocks})") == b).select(F.col(id_col).cast("long"), vec).toArrow()  # about `block` rows
        at, unit = _unit_rows(rows.column(1).combine_chunks())
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy()[at], unit))

        def nearest(batches, shared=shared):
            names, q = shared.value
            best, who = np.full((len(names), k), np.nextafter(least, -np.inf)), np.full((len(names), k), np.iinfo(np.int64).max)
            for batch in batches:
                at, x = _unit_rows(batch.column(1))
                if not len(at) or x.shape[1] != q.shape[1]:
                    continue
                ids = batch.column(0).to_numpy()[at]
                for i in range(0, len(names), _SIDE):
                    for j in range(0, len(at), 2 * _SIDE):
                        _merge_nearest(best[i : i + _SIDE], who[i : i + _SIDE], q[i : i + _SIDE], x[j : j + 2 * _SIDE], ids[j : j + 2 * _SIDE])
            row, place = np.nonzero(best >= least)
            s, w = best[row, place], who[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(w), pa.array(s)], names=["query_id", id_col, "_s"])

        found = found.union(vectors.select(F.col(id_col).cast("long"), vec).mapInArrow(nearest, schema))
    top = found.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), id_col)))
    return top.where((F.col("_at") <= k) & (F.col("_s") >= least)).select("query_id", id_col, F.round("_s", 3).alias("score"))


# text lines and rules


def lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., line_no, line): universal newlines; a trailing newline adds no line."""
    plain = F.regexp_replace(F.col(text), r"\r\n|\r", "\n")
    cut = F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1)
    return df.where(F.length(text) > 0).select(*keep, F.posexplode(cut).alias("_p", "line")).select(*keep, (F.col("_p") + 1).alias("line_no"), "line")


def line_count(text: Column) -> Column:
    """Lines of a text; empty and null have none."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r", "\n")
    n = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    return (n + F.when((plain != "") & ~plain.endswith("\n"), 1).otherwise(0)).cast("bigint")


def first_rule(column: Column, rules: list[tuple[str, str]], default: str | None = "other") -> Column:
    """The label of the first regex that matches."""
    out = None
    for pattern, label in rules:
        out = F.when(column.rlike(pattern), label) if out is None else out.when(column.rlike(pattern), label)
    return (out if default is None else out.otherwise(default)) if out is not None else F.lit(default)


def tags(column: Column, rules: list[tuple[str, str]], most: int = 10) -> Column:
    """Distinct labels of all matching rules, in rule order, at most ``most``."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(column.rlike(p), t) for p, t in rules]))), 1, most)


def lookahead(df: DataFrame, first: Column, then: Column, within: int, partition: list[str], order: str) -> DataFrame:
    """Rows where ``first`` holds with the rows where ``then`` holds at most ``within`` places later, by a windowed array."""
    w = Window.partitionBy(*partition).orderBy(order)
    ahead = F.array_compact(F.array(*[F.when(F.lead(then).over(w), F.lead(order).over(w)) if k == 1 else F.when(F.lead(then, k).over(w), F.lead(order, k).over(w)) for k in range(1, within + 1)]))
    return df.withColumn("_ahead", ahead).where(first).select(*partition, F.col(order).alias("at"), F.explode("_ahead").alias("next_at"))


def domain(url: Column) -> Column:
    """Host of a url without scheme, path and port; null unless it has a dot (relative and template urls)."""
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://|^//", "")
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    relative = url.startswith("/") & ~url.startswith("//") | host.rlike(r"[{}$<>\s]")
    return F.when(~relative & (F.instr(host, ".") > 0), host)


def first_line(text: Column, most: int = 200) -> Column:
    """The first line, cut to ``most`` characters with an ellipsis; null if empty."""
    line = F.trim(F.substring_index(F.trim(text), "\n", 1))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("..."))).when(line != "", line)


# navigation in JSON columns


def json_keys(df: DataFrame, keep: list[str], column: str, path: str = "$") -> DataFrame:
    """(keep..., key, type, count, value): what an object or array at a JSON path holds.

    Objects and arrays have their size, other values themselves cut to 50
    characters. A row whose path leads nowhere, or to a plain value, gives one
    row with a null key and ``missing`` or the value's type.
    """
    spot = df.select(*keep, F.expr(f"try_variant_get(try_parse_json(`{column}`), '{path}', 'variant')").alias("_v"))
    kind = lambda v: F.when(F.col(v).isNull(), "missing").when(F.expr(f"is_variant_null({v})"), "null").otherwise(F.lower(F.regexp_extract(F.expr(f"schema_of_variant({v})"), "^[A-Za-z]+", 0)))
    text = lambda v: F.expr(f"to_json({v})")
    size = lambda v, k: F.when(k == "object", F.size(F.json_object_keys(text(v)))).when(k == "array", F.json_array_length(text(v))).cast("bigint")
    whole = spot.withColumn("_k", kind("_v"))
    nested = whole.where("_k in ('object', 'array')")
    view = nested.sparkSession.sql("select t.*, e.pos as _pos, e.key as _key, e.value as _e from {t} t, lateral variant_explode(_v) e", t=nested)
    inner = view.withColumn("_ek", kind("_e")).select(*keep, F.coalesce("_key", F.col("_pos").cast("string")).alias("key"), F.col("_ek").alias("type"), size("_e", F.col("_ek")).alias("count"), F.when(~F.col("_ek").isin("object", "array"), shorten(F.expr("try_variant_get(_e, '$', 'string')"))).alias("value"))
    plain = whole.where("_k not in ('object', 'array')").select(*keep, F.lit(None).cast("string").alias("key"), F.col("_k").alias("type"), F.lit(None).cast("bigint").alias("count"), shorten(F.expr("try_variant_get(_v, '$', 'string')")).alias("value"))
    return inner.unionByName(plain)


def shorten(text: Column, most: int = 50) -> Column:
    """For display: at most so many characters, and dots for the rest."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
