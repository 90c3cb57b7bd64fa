"""Kernel queries over the driver's tables, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import staleness
from ..operators import kernels as K

_EDGES_SQL = """e as (select user_id as src, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) as dst from events),
g as (select distinct src, dst from e where dst is not null and src <> dst)"""
_DEG_SQL = _EDGES_SQL + """, deg as (select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree
from (select dst as node, 1 as i, 0 as o from g union all select src, 0, 1 from g) group by node)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the users of consecutive events of a day."""
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


@query(f"""with {_DEG_SQL}, n as (select count(*) as n from deg),
ri as (select in_degree as v, row_number() over (order by in_degree desc) - 1 as r from deg), ro as (select out_degree as v, row_number() over (order by out_degree desc) - 1 as r from deg),
t as (select greatest((select v from ri where r = least(greatest(1, n // 20), n - 1)), 3) as ti, greatest((select v from ro where r = least(greatest(1, n // 20), n - 1)), 5) as tou from n)
select node, in_degree, out_degree, case when in_degree >= ti and out_degree >= tou then 'core' when out_degree >= tou then 'hub' when in_degree >= ti then 'utility'
when in_degree = 0 and out_degree = 0 then 'isolated' else 'standard' end as role from deg, t""")
def graph_roles(spark, sf_dir):
    return K.roles(K.degrees(transitions(spark, sf_dir)))


@query(f"with {_DEG_SQL} select node, round(0.7::double * in_degree / greatest((select max(in_degree) from deg), 1) + 0.3::double * out_degree / greatest((select max(out_degree) from deg), 1), 6) as importance from deg")
def graph_importance(spark, sf_dir):
    return K.importance(K.degrees(transitions(spark, sf_dir)))


@query(f"with {_EDGES_SQL} select dst as node, array_to_string(list_sort(list(src)), ',') as callers, count(*) as n from g group by dst")
def graph_reverse_adjacency(spark, sf_dir):
    r = K.reverse_adjacency(transitions(spark, sf_dir))
    return r.select("node", F.array_join(F.transform("callers", lambda x: x.cast("string")), ",").alias("callers"), F.size("callers").cast("bigint").alias("n"))


@query(f"""with {_EDGES_SQL}, d1 as (select distinct src as node from g where dst = 13 and src <> 13), d2 as (select distinct src as node from g where dst in (select node from d1) and src <> 13 and src not in (select node from d1))
select node, cast(1 as bigint) as depth from d1 union all select node, 2 from d2""")
def graph_transitive_callers(spark, sf_dir):
    start = spark.range(13, 14).toDF("node")
    return K.transitive(transitions(spark, sf_dir), start, 2).select("node", F.col("depth").cast("bigint").alias("depth"))


_NEXT_SQL = """e as (select user_id as src, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) as dst from events),
c as (select src, dst, count(*) as n from e where dst is not null group by src, dst), r as (select src, dst, row_number() over (partition by src order by n desc, dst) as place from c), f as (select src, dst from r where place = 1)"""


def _usual_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge from each user, to the user who follows most often: as in a flow, the first resolution only."""
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst is not null")
    return e.groupBy("src", "dst").agg(F.count("*").alias("n")).groupBy("src").agg(F.max_by("dst", F.struct("n", -F.col("dst"))).alias("dst"))


_TRACE_SQL = f"""with recursive {_NEXT_SQL}, p(path, depth, truncated) as (select [src], 0, false from f union all select list_append(path, dst), depth + 1, list_contains(path, dst) from p join f on f.src = path[len(path)] where depth < 6 and not truncated)"""


@query(f"{_TRACE_SQL} select array_to_string(path, '>') as path, cast(depth as bigint) as depth, truncated from p")
def graph_trace_paths(spark, sf_dir):
    edges = _usual_next(spark, sf_dir)
    p = K.trace_paths(edges, edges.select("src"), 6)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.col("depth").cast("bigint").alias("depth"), "truncated")


@query(f"{_TRACE_SQL} select path[1] as root, cast(max(depth) as bigint) as max_depth, count_if(depth > 0) as calls, count(distinct path[len(path)]) as functions from p group by 1")
def graph_flow_metrics(spark, sf_dir):
    edges = _usual_next(spark, sf_dir)
    p = K.trace_paths(edges, edges.select("src"), 6)
    return p.groupBy(F.element_at("path", 1).alias("root")).agg(F.max("depth").cast("bigint").alias("max_depth"), F.count_if(F.col("depth") > 0).alias("calls"), F.countDistinct(F.element_at("path", -1)).alias("functions"))


@query(f"""with {_DEG_SQL}, r as (select *, row_number() over (order by in_degree + out_degree desc, node) as place from deg) select node, in_degree, out_degree from r where place <= 15""")
def graph_top_degrees(spark, sf_dir):
    return K.degrees(transitions(spark, sf_dir)).orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node").limit(15)


@query(f"""with {_EDGES_SQL}, r as (select dst, src, row_number() over (partition by dst order by src) as place from g)
select dst as node, count(*) as n, array_to_string(list(src order by src) filter (place <= 10), ',') as callers from r group by dst""")
def graph_caller_samples(spark, sf_dir):
    r = K.sampled(transitions(spark, sf_dir), "dst", "src", 10)
    return r.select(F.col("dst").alias("node"), "n", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("callers"))


@query("select 'sha256:' || substr(sha256(text), 1, 16) as hash, count(*) as n, array_to_string(list_sort(list(doc_id)), ',') as members from documents where text is not null group by 1 having count(*) > 1")
def doc_duplicates(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("sha256:"), F.substring(F.sha2("text", 256), 1, 16)).alias("hash"))
    return K.duplicate_groups(d, "hash", "doc_id").select("hash", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("""with d as (select lang, source, case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end as l from documents)
select lang, source, count(*) as files, cast(sum(l) as bigint) as lines from d group by grouping sets ((), (lang), (source))""")
def doc_inventory(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("lang", "source", K.line_count(F.col("text")).alias("n_lines"))
    return K.inventory(d, ["lang", "source"], "n_lines")


@query("select severity, count(*) as n from (select case when n_chars > 4000 then 'critical' when n_chars > 2000 then 'warning' else 'ok' end as severity from documents) group by 1")
def doc_severity(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(K.severity(F.col("n_chars"), 2000, 4000).alias("severity")).agg(F.count("*").alias("n"))


@query("select lang, count(*) as total, count_if(l.doc_id is not null) as covered, round(100.0::double * count_if(l.doc_id is not null) / count(*), 1) as pct from documents d left join (select distinct doc_id from labels) l using (doc_id) group by lang")
def label_coverage(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("hit")).distinct()
    return K.coverage(F.col("hit").isNotNull(), ["lang"], _t(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled_docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""with d as (select c_custkey as k from customer where c_mktsegment <> 'BUILDING'), u as (select distinct user_id as k from events)
select 'missing' as problem, k from u where k not in (select k from d) union all select 'unused', k from d where k not in (select k from u)""")
def missing_unused(spark, sf_dir):
    d, u = _t(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k")), _t(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return K.missing(u, d, "k").select(F.lit("missing").alias("problem"), "k").union(K.missing(d, u, "k").select(F.lit("unused"), "k"))


_NEW_SQL = "old as (select doc_id, md5(text) as h from documents), new as (select doc_id, md5(case when doc_id % 13 = 0 then text || 'x' else text end) as h from documents where doc_id % 17 <> 0 union all select doc_id + 1000000, md5(text) from documents where doc_id % 29 = 0)"


def _snapshots(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    new = d.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    new = new.union(d.where("doc_id % 29 = 0").select(F.col("doc_id") + 1000000, "text"))
    return d.select("doc_id", F.md5("text").alias("h")), new.select("doc_id", F.md5("text").alias("h"))


@query(f"with {_NEW_SQL} select coalesce(old.doc_id, new.doc_id) as doc_id, case when old.doc_id is null then 'added' when new.doc_id is null then 'deleted' when old.h = new.h then 'unchanged' else 'updated' end as status from old full join new on old.doc_id = new.doc_id")
def snapshot_diff(spark, sf_dir):
    return K.snapshot_diff(*_snapshots(spark, sf_dir), "doc_id", "h")


@query(f"with {_NEW_SQL} select new.doc_id, new.h, case when old.h = new.h then 'kept' else 'fresh' end as origin from new left join old on old.doc_id = new.doc_id")
def retain_unchanged(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return K.retain(old.withColumn("origin", F.lit("kept")), new.withColumn("origin", F.lit("fresh")), K.snapshot_diff(old, new, "doc_id", "h"), "doc_id")


@query(f"with {_NEW_SQL}, d as (select case when old.doc_id is null then 'added' when new.doc_id is null then 'deleted' when old.h = new.h then 'unchanged' else 'updated' end as status from old full join new on old.doc_id = new.doc_id) select status, count(*) as files from d group by status")
def change_counts(spark, sf_dir):
    return staleness.change_counts(K.snapshot_diff(*_snapshots(spark, sf_dir), "doc_id", "h"))


@query("""with n as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as l from embeddings), s as (select q.vec_id as query_id, v.vec_id, list_dot_product(v.e, q.e) / (v.l * q.l) as s from n q, n v where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by s desc, vec_id) as place from s) select query_id, vec_id, round(s, 3) as score from r where place <= 10 and s >= 0.3""")
def cosine_topk_each(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return K.cosine_topk_each(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding")


@query("select domain, count(*) as n from (select regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) as domain from pages) where contains(domain, '.') group by 1")
def page_domains(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select(K.domain(F.col("url")).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))


@query("select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages) group by all")
def page_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


_LINE_RULES = [("<!DOCTYPE", "doctype"), ("<article", "article"), ("</html>", "end"), ("<p>", "paragraph")]


@query("""with l as (select page_id, unnest(string_split(rtrim(html, chr(10)), chr(10))) as line from pages)
select page_id, case when contains(line, '<!DOCTYPE') then 'doctype' when contains(line, '<article') then 'article' when contains(line, '</html>') then 'end' when contains(line, '<p>') then 'paragraph' else 'other' end as kind, count(*) as n from l group by 1, 2""")
def page_line_scan(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"\n+\z", "").alias("html"))
    return K.lines(p, "html", ["page_id"]).groupBy("page_id", K.first_rule(F.col("line"), _LINE_RULES).alias("kind")).agg(F.count("*").alias("n"))


_TAG_RULES = [("(password|token|secret)", "credential"), ("(licen[cs]e|copyright)", "licence"), ("@", "address"), ("[0-9]{6,}", "number")]


@query("""select doc_id, concat_ws(',', case when regexp_matches(text, '(password|token|secret)') then 'credential' end, case when regexp_matches(text, '(licen[cs]e|copyright)') then 'licence' end,
case when regexp_matches(text, '@') then 'address' end, case when regexp_matches(text, '[0-9]{6,}') then 'number' end) as tags from documents""")
def doc_tags(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(K.tags(F.col("text"), _TAG_RULES), ",").alias("tags"))


@query("select category, count(*) as n from (select case when regexp_matches(url, '^https?://blog[.]') then 'blog' when regexp_matches(url, '^https?://www[.]') then 'web' when regexp_matches(url, '^https?://m[.]') then 'mobile' else 'other' end as category from pages) group by 1")
def url_category(spark, sf_dir):
    rules = [("^https?://blog[.]", "blog"), ("^https?://www[.]", "web"), ("^https?://m[.]", "mobile")]
    return _t(spark, sf_dir, "pages").groupBy(K.first_rule(F.col("url"), rules).alias("category")).agg(F.count("*").alias("n"))


@query("select p_partkey, p_name, p_type from part where contains(lower(p_name), 'red w')")
def symbol_substring_lookup(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(K.contains_ci("p_name", "Red W")).select("p_partkey", "p_name", "p_type")


@query("""with h as (select distinct regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) as host from pages), d as (select distinct regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) as dom from h)
select host, dom from h join d on dom <> '' and (host = dom or host like '%.' || dom)""")
def dotted_suffix_join(spark, sf_dir):
    h = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]*)", 1).alias("host")).distinct()
    d = h.select(F.regexp_extract("host", "([^.]+[.][^.]+[.][^.]+)$", 1).alias("dom")).where("dom <> ''").distinct()
    return K.suffix_join(h, d, "host", "dom")


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def json_keys_path(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""with k as (select event_id, props, unnest(json_keys(props)) as key from events)
select event_id, key, case json_type(props, '$.' || key) when 'UBIGINT' then 'bigint' when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' else lower(json_type(props, '$.' || key)) end as type, json_extract_string(props, '$.' || key) as value from k""")
def json_keys_listing(spark, sf_dir):
    return K.json_keys(_t(spark, sf_dir, "events"), ["event_id"], "props").select("event_id", "key", "type", "value")


@query("select o_custkey, count(*) as n, array_to_string(list(o_orderkey order by o_orderkey) filter (place <= 5), ',') as first_users from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as place from orders) group by o_custkey")
def usage_statistics(spark, sf_dir):
    r = K.sampled(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 5)
    return r.select("o_custkey", "n", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("first_users"))


@query("""with d as (select distinct split_part(split_part(url, '://', 2), '/', 1) as host from pages), u as (select distinct replace(host, '.', '_') as name from d), p as (select distinct replace(regexp_extract(host, '^([^.]+)[.]', 1), '.', '_') as name from d where length(host) % 2 = 0)
select name from u where not exists (select 1 from p where p.name <> '' and (u.name = p.name or starts_with(u.name, p.name || '_') or starts_with(p.name, u.name || '_')))""")
def missing_by_prefix(spark, sf_dir):
    host = _t(spark, sf_dir, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")).distinct()
    declared = host.where(F.length("host") % 2 == 0).select(F.regexp_extract("host", "^([^.]+)[.]", 1).alias("name"))
    return K.missing_by_prefix(host.select(F.replace("host", F.lit("."), F.lit("_")).alias("name")), declared, "name")


@query("""with r as (select *, row_number() over (partition by conv_id order by turn) as p from conversations)
select a.conv_id, a.turn as at, b.turn as next_at from r a join r b on a.conv_id = b.conv_id and b.p between a.p + 1 and a.p + 5 where a.role = 'user' and b.role = 'assistant'""")
def handler_lookahead(spark, sf_dir):
    return K.lookahead(_t(spark, sf_dir, "conversations"), F.col("role") == "user", F.col("role") == "assistant", 5, ["conv_id"], "turn")


@query("""with l as (select doc_id, trim(string_split(trim(text), chr(10))[1]) as line from documents) select doc_id, case when length(line) > 200 then left(line, 200) || '...' when line <> '' then line end as preview from l""")
def truncate_preview(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", K.first_line(F.col("text")).alias("preview"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events group by user_id")
def latest_per_key(spark, sf_dir):
    return K.pick_latest(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")
