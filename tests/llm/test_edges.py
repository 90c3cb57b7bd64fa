"""Odd rows of every operator: clashing columns, repeated rows, very long and very deep inputs, empty tables."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from srclake.llm import common, decontam, html_extract, nn_descent, packing, pii, queries, toxicity, warc, wordhash

LONG = " ".join(f"w{i % 9973}" for i in range(200_000))


def clash(df, *names):
    """Extra columns with names that the operators use inside."""
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


@pytest.mark.parametrize("depth", [160, 5000, 60000])
def test_deep_pages(depth):
    assert html_extract.main_text("<div>" * depth + "<article><p>hello") == "hello"
    assert html_extract.main_text("<div>" * depth + "<nav>menu</nav><p>hello") == "hello"
    assert html_extract.main_text("<b>" * depth + "<hr>" * 2000 + "<ul>" + "<li>x" * 2000).count("x") == 2000
    assert html_extract.main_text("<span>" * depth + "</i>" * depth + "end") == "end"


def test_deep_pages_have_a_wrapper(spark):
    page = "<body>" + "<div>" * 3000 + "<div class=t>Same</div><p>body {0}</p>"
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {i: f"body {i}" for i in range(6)}


def test_quotes_and_open_tags():
    assert html_extract.main_text("<p class=a\">one</p><p title=\"a>b\">two</p>") == "one\n\ntwo"
    assert html_extract.main_text("<p>kept</p><a href=\"never closed " + "<a '" * 50_000) == "kept"
    assert html_extract.main_text("<p>" + LONG + "</p>") == LONG
    tree = html_extract.skeleton(html_extract.number(html_extract.parse("<div><p>a</p><p>b</p><section>c</section></div>")))
    again = html_extract.unpack(html_extract.pack(tree))
    assert html_extract.pack(again) == html_extract.pack(tree)


def test_pages_without_a_host(spark):
    page = "<body><div class=t>Same on all</div><p>body {0}</p></body>"
    rows = [(i, url, page.format(i)) for url in (None, "no host") for i in range(8)]
    got = html_extract.extract(clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "host", "shape", "cut", "text")).collect()
    assert len(got) == 16 and all(r.text == f"Same on all\n\nbody {r.page_id}" for r in got)


def test_template_needs_a_share_of_the_host(spark):
    """A notice on 5 of 800 pages is no template, on 40 it is."""
    page = "<body>{1}<p>body {0}</p></body>"
    few, many = "<div class=x>On a few</div>", "<section>On many</section>"
    rows = [(i, f"http://a.b/{i}", page.format(i, few if i < 5 else many if i < 45 else "")) for i in range(800)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "On a few\n\nbody 3" and got[30] == "body 30" and got[500] == "body 500"


def test_warc_edges(spark):
    rows = [(1, "u", "x" * 500)] * 40 + [(2, None, "x" * 500), (3, "u", "y" * 2_000_000), (None, "u", "z" * 200), (None, "u", "z" * 200)]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "file", "at", "payload_digest", "o_file")
    got = warc.deduplicated_archives(pages.repartition(4)).collect()
    hot = [r for r in got if r.payload_bytes == 500]
    assert sorted(r.record_type for r in hot) == ["response"] + ["revisit"] * 40 and {r.refers_to for r in hot if r.record_type == "revisit"} == {1}
    nameless = [r for r in got if r.payload_bytes == 200]
    assert sorted(r.record_type for r in nameless) == ["response", "revisit"] and all(r.refers_to is None for r in nameless)
    assert len(got) == 44


def test_embeddings_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (3, v, 1), (None, v, 0), (4, [], 0), (5, [1e300, 1e300, 1.0], 0), (6, [-0.0, 0.0, 0.0], 0), (7, [1.0, 2.0], 0)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "v", "x", "own", "floor", "root")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(df).collect())
    assert got == sorted([("1", 3, 1, True), ("1", 3, 1, True), ("2", 3, 1, False), ("3", 0, 3, True), ("None", 3, 1, False), ("4", 0, 4, True), ("5", 0, 5, True), ("6", 0, 6, True), ("7", 0, 7, True)])


def test_toxicity_edges(spark):
    rows = [(i, ("zorgle " if i % 3 == 0 else "nice ") + f"filler{i % 20}") for i in range(90)]
    rows += [(5, rows[5][1])] * 30 + [(200, LONG + " zorgle"), (201, LONG), (202, None)]
    d = clash(spark.createDataFrame(rows, "doc_id long, text string"), "id", "score", "label", "toxic", "h")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] * 2, "doc_id long, toxic int")
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 5}) == 1
    kept = toxicity.reject_toxic(d, labels)
    assert kept.columns == d.columns and kept.where("doc_id = 5").count() == 31 and kept.where("doc_id % 3 = 0 and doc_id < 90").count() == 0


def test_pii_edges(spark):
    text = "a.b@c.org"
    d = clash(spark.createDataFrame([(1, text), (1, text), (2, None), (3, LONG + " " + text), (None, text)], "doc_id long, text string"), "n_pii", "n_email", "TEXT2")
    made = pii.pseudonymise(d, b"k").collect()
    new = {r.text for r in made if r.text and len(r.text) < 30}
    assert len(new) == 1 and text not in new and [r.text for r in made if r.doc_id == 2] == [None] and made[3].text.startswith(LONG)
    assert [r.n_pii for r in pii.report(d, b"k").collect()] == [1, 1, 0, 1, 1] and pii.pseudonymise(d.limit(0), b"k").count() == 0
    assert pii.Pseudonyms(b"k").replace(text)[0] != pii.Pseudonyms(b"other").replace(text)[0]


def test_pii_long_addresses(spark):
    """An address of any length gets a pseudonym of its shape; short ones keep theirs."""
    name = "Ab9." * 5000
    values = [f"{name}x@c.org", f"{name}y@c.org", "q" * 400_000 + "@c.org", "1" * 5000 + "@c.org", f"jo@{'b' * 5000}.org"]
    d = spark.createDataFrame([(i, f"to {v}, 10.1.2.3") for i, v in enumerate([*values, values[0]])], "doc_id long, text string")
    got = [r.text.split(",")[0][3:] for r in pii.pseudonymise(d, b"k").orderBy("doc_id").collect()]
    shape = lambda t: "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in t)
    assert [shape(t) for t in got] == [shape(v) for v in [*values, values[0]]]
    assert len(set(got) | set(values)) == 10 and got[5] == got[0] and sum(a == b for a, b in zip(got[0], got[1])) < 10_000
    assert [r.n_email for r in pii.report(d, b"k").collect()] == [1] * 6
    p, sizes = pii.Pseudonyms(b"k"), [26, 10, 10, 26]
    made = {tuple(p.permute_places([a, b, c, e], sizes, "t")) for a in range(26) for b in range(10) for c in range(10) for e in range(26)}
    assert len(made) == 26 * 10 * 10 * 26 and all(x < s for m in made for x, s in zip(m, sizes))
    assert p.replace("jo.smith7@mail.example.org")[0] == "ct.bvikf4@sgif.kjkzkgf.org"


def test_decontaminate_edges(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    d = clash(spark.createDataFrame([(1, LONG + " " + passage), (1, passage), (2, None), (None, passage)], "doc_id long, text string"), "n_hit", "doc_ids", "terms")
    items = clash(spark.createDataFrame([(7, passage), (7, passage), (8, None)], "item_id long, text string"), "n", "hashes")
    got = decontam.decontaminate(d, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got) == [("1", 12, 12, 1), ("1", 200_012, 12, 1), ("2", 0, 0, 0), ("None", 12, 12, 1)]
    kept = decontam.drop_contaminated(d, items)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_shared_folder_and_keys(spark):
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(Cluster)
    with pytest.raises(ValueError, match="srclake.pii.key"):
        queries.pii_key(Cluster)
    assert common.qualified(spark, "/tmp/x").startswith("file:///tmp/x") and common.filesystem("file:///tmp/x")[1] == "/tmp/x"


def test_stages_on_a_cluster_without_a_key(spark):
    """The session names no key: one of the application serves all its queries."""

    class Cluster:
        conf = spark.conf

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-1"

    d = spark.createDataFrame([(i, "mail a.b@c.org or b.c@d.org") for i in range(6)], "doc_id long, text string").repartition(3)
    with pytest.warns(UserWarning, match="srclake.pii.key"):
        one, two = ({r.text for r in corpus_pipeline.private(Cluster, d, "").collect()} for _ in range(2))
    assert one == two and len(one) == 1 and "a.b@c.org" not in one.pop()
    key = queries.run_key(Cluster)
    Cluster.sparkContext.applicationId = "app-2"
    assert len(key) == 32 and queries.run_key(Cluster) != key and queries.run_key(spark) == queries.pii_key(spark)


def test_bytes_that_are_no_utf8(spark):
    """They pass pseudonymisation as they are, and packing as U+FFFD."""
    from tokenizers import Tokenizer

    raw = [b"x \xff\xfe mail a.b@c.org \xe6\xbc", b"\xed\xa0\x80", b"caf\xe9s plain", b"mail a.b@c.org", None, b""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "doc_id long, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text"))
    got = {r.doc_id: r.raw for r in pii.pseudonymise(d, b"k").select("doc_id", F.expr("cast(text as binary)").alias("raw")).collect()}
    mail = pii.Pseudonyms(b"k").replace("mail a.b@c.org")[0].encode()
    assert [got[i] for i in range(6)] == [raw[0].replace(raw[3], mail), raw[1], raw[2], mail, None, b""]
    assert {r.doc_id: r.n_pii for r in pii.report(d, b"k").select("doc_id", "n_pii").collect()} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    t = Tokenizer.from_file(queries.TOKENIZER)
    ids = [[*t.encode((x or b"").decode(errors="replace"), add_special_tokens=False).ids, 1] for x in raw]
    made = packing.pack(d, queries.TOKENIZER).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in made} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)} and len(made) == 6
    plain = packing.WordTokenizer(queries.TOKENIZER, 1)._plainly(pa.array(raw, pa.binary()).view(pa.string()))[0]
    assert plain.tolist() == [i for x in ids for i in x]


def test_toxicity_of_frequent_words_only(spark):
    """Every word is in many examples, so that no text has a short list."""
    texts = [" ".join(f"w{i}" for i in some) for some in itertools.combinations(range(12), 6)]
    labels = spark.createDataFrame([(i, int("w0 " in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels).collect()
    assert len(got) == 924 and all((r.score > 0.5) == ("w0 " in texts[r.doc_id]) for r in got)


def test_slices_cover_all_rows():
    texts = pa.array(["a" * n for n in (0, 5, 3_000_000, 1, 2)] + [None])
    parts = list(wordhash.slices([pa.RecordBatch.from_arrays([texts], names=["t"])], 0))
    assert sum(p.num_rows for p in parts) == 6 and np.concatenate([np.array([len(x or "") for x in p.column(0).to_pylist()]) for p in parts]).tolist() == [0, 5, 3_000_000, 1, 2, 0]
