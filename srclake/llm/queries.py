"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

import warnings
from secrets import token_bytes

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, ngram_join, nn_descent, packing, pii, secrets, sharding, toxicity, warc
from .common import for_texts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return for_texts(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_read(spark, sf_dir, "documents"), 40)


def op2_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.deduplicated_archives(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def benchmark_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_items, and n_near with items whose words occur in order with gaps. No SQL; a test searches every place."""
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), slop=decontam.SLOP).select("doc_id", "n_items", "n_near")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def op10_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"), run_key(spark))


def pii_key(spark: SparkSession) -> bytes:
    """The key of pseudonyms, from the session. A local master (tests) may do without; a cluster may not."""
    key = spark.conf.get("srclake.pii.key", None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set srclake.pii.key to a secret")
    return (key or "for tests on a local master").encode()


_OWN: dict[str, bytes] = {}


def run_key(spark: SparkSession) -> bytes:
    """As ``pii_key``, but a cluster whose session names no key gets a random one, kept in the driver as long as the application runs.

    Nobody knows it, so pseudonyms stay secret; they are the same in all queries
    of the application, and not those of another.
    """
    try:
        return pii_key(spark)
    except ValueError:
        warnings.warn("srclake.pii.key is not set: pseudonyms of this application will not match those of another", stacklevel=2)
        return _OWN.setdefault(spark.sparkContext.applicationId, token_bytes(32))


QUERIES = {f.__name__: f for f in (op1_kd_shards, op2_wrapper_extract, op3_secrets, op4_ngram_jaccard, op5_warc_revisits, op6_decontaminate, op7_nn_descent, op8_toxicity, op9_pack, op10_pii_feistel, benchmark_near_matches)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_ngram_jaccard": f"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
              else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as shingle from w where w is not null),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r(node, far) as (select a, b from e union select r.node, e.b from r join e on r.far = e.a)
        select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, (select count(*) from e where e.a = d.doc_id) as n_similar,
               least(d.doc_id, coalesce((select min(far) from r where r.node = d.doc_id), d.doc_id)) as component_id
        from documents d left join n using (doc_id) group by d.doc_id
    """,
    "op6_decontaminate": f"""
        with b as (select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(10, len(w)) as k, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) as words from b where len(w) > 0),
        d as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        o as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from d, (select distinct k from win) where len(w) >= k),
        hit as (select o.doc_id, o.i, o.k, win.item_id from o join win on win.k = o.k and win.words = array_to_string(list_slice(w, i, i + o.k - 1), ' ')),
        n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
        m as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hit) group by doc_id)
        select d.doc_id, coalesce(len(d.w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join n using (doc_id) left join m using (doc_id)
    """,
    "op7_nn_descent": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null),
        u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as l from v where len(e) > 0 and list_dot_product(e, e) > 0),
        p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.98),
        r(node, far) as (select a, b from p union select r.node, p.b from r join p on r.far = p.a)
        select vec_id, (select count(*) from p where a = vec_id) as n_links, least(vec_id, coalesce((select min(far) from r where node = vec_id), vec_id)) as component_id,
               vec_id = least(vec_id, coalesce((select min(far) from r where node = vec_id), vec_id)) as kept
        from embeddings
    """,
    "op5_warc_revisits": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        h as (select page_id, cast(octet_length(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
        f as (select *, min(page_id) over (partition by payload_digest) as first_id from h)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from f
    """,
}
