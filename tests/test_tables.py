"""Queries over the tables against brute force on small ones."""

import tracemalloc

import numpy as np
import pyarrow as pa

from srclake.operators import kernels as K
from srclake.plans import tables


def test_cosine_topk(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((350, 3))
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/full/embeddings.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in (0, 100, 200, 300):
        s = unit @ unit[q]
        want |= {(q, int(i)): s[i] for i in sorted(range(350), key=lambda i: (-s[i], i))[:10] if s[i] >= 0.3}
    got = {(r.query_id, r.vec_id): r.score for r in tables.cosine_topk_each(spark, f"{tmp_path}/full").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-4 for k in want)
    assert tables.cosine_topk_each(spark, f"{tmp_path}/none").count() == 0
    blocks = K.cosine_topk_each(df.where("vec_id % 7 = 0"), df, "vec_id", "embedding", block=9).collect()
    whole = K.cosine_topk_each(df.where("vec_id % 7 = 0"), df, "vec_id", "embedding").collect()
    assert sorted(blocks) == sorted(whole) and len(whole) == 500


def test_cosine_topk_memory_and_ties(spark, monkeypatch):
    """A task holds no block of queries times a batch of vectors, even where all vectors tie; of equal ones the smallest ids stay."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 64))
    x = np.vstack([np.repeat(x, 3, axis=0), np.repeat(x[:1], 4000, axis=0)])
    ids = rng.permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    runs = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: runs.append(f) or plain(self, f, schema))
    got = K.cosine_topk_each(df.where("vec_id % 2 = 0"), df, "vec_id", "embedding").collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in np.flatnonzero(ids % 2 == 0):
        s = np.round(unit @ unit[q], 10)
        want |= {(int(ids[q]), int(ids[i])) for i in np.lexsort((ids, -s))[:10] if s[i] >= 0.3}
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == len(want)
    table = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x))], names=["vec_id", "embedding"])
    tracemalloc.start()
    made = pa.Table.from_batches(runs[0](iter([table, table])))
    assert made.num_rows and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
