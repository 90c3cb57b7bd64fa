"""The corpus pipeline against the plain loops that its stages stand for, on a table with every odd row."""

import collections
import zlib

import pytest

import corpus_pipeline
from srclake.llm import pii, queries
from tests.llm.test_operators import brute_windows, shingle_sets

BASE = " ".join(f"word{i}" for i in range(80))
PASSAGE = " ".join(f"quiz{i}" for i in range(14))
LONG = " ".join(f"l{i % 811}x{i % 13}" for i in range(20000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, set_id string, slot long, gone_id long, again_root string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [None, "", "  ", "one", BASE, BASE, BASE + " more", "intro " + PASSAGE + " outro", LONG, LONG + " end", "mail a.b@c.org or 4111 1111 1111 1111", "you zorgle zorgle fool", "zorgle"]
    texts += [f"clean filler{i} sentence about thing{i} and matter{i % 7}" for i in range(120)] + [f"zorgle{'' if i % 2 else ' again'} filler{i} sentence about thing{i}" for i in range(120, 180)]
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "x", 3, 4, "y") for i, t in enumerate(texts)]
    rows += [(None, BASE, *[None] * 8), (None, "nameless only here", *[None] * 8), (None, "nameless only here", *[None] * 8), (4, BASE, "en", "s", 1, 1.0, "x", 3, 4, "y"), (9, LONG + " end", *[None] * 8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/full/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    labels = [(i, int("zorgle" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1), (3, None)]
    for name in ("full", "none"):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/{name}/labels.parquet")
        spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string").write.parquet(f"{path}/{name}/benchmark.parquet")
    return path


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    rows = [r for r in spark.read.parquet(f"{folder}/full/documents.parquet").collect() if "zorgle" not in (r.text or "")]
    sets = list(shingle_sets(rows))
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    kept = [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in groups.values()]
    windows = {tuple(brute_windows(PASSAGE)[i : i + 10]) for i in range(5)}
    kept = [r for r in kept if not any(tuple(w[i : i + 10]) in windows for w in [brute_windows(r.text)] for i in range(len(w)))]
    p, t = pii.Pseudonyms(queries.pii_key(spark)), Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for r in kept:
        ids = [*t.encode(p.replace(r.text)[0] if r.text else "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            want[r.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + 2048])), len(ids)] += 1
    got = corpus_pipeline.run(spark, f"{folder}/full").collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_stages_keep_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/none/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, f"{folder}/none")
        assert made.count() == 0 and (name == "packing" or made.columns == docs.columns)
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
