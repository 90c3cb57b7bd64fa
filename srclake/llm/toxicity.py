"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents gives the examples; every word of theirs
is a term. A term weighs (1 + log of its count) times its inverse document
frequency over all documents, times its relevance: how surely the sample shows
that it goes with the label or against it (1 for certain, FLOOR for a term that
shows nothing, so no term is left out). Examples with one vector are one entry
with its votes.

The inverted index has for each term its postings by entry; the long lists are
laid out in blocks of entries with their maxima. A batch of queries first adds
up the postings of its short lists. With the block maxima of the long ones they
bound every similarity in a block. The most promising blocks are completed
first, and then all blocks whose bound reaches the k-th similarity found: the
neighbours are exact. Their votes, weighted by squared
similarity, are calibrated by a logistic curve fitted on the examples
themselves, each scored without its own votes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import wordhash
from .common import free_name

EXAMPLES = 8192  # bound of the labelled sample
NEIGHBOURS = 20  # distinct vectors that vote
THRESHOLD = 0.7
FLOOR = 0.02  # least relevance of a term
_SURE = 50.0  # chi-square at which half of the relevance is reached
_PRIOR = 0.05  # weight of the base rate among the votes
_BLOCK = 64
_QUERIES = 48  # texts searched at once
_CHUNKS = 64
_TABLE = wordhash.ALNUM_TABLE


def held_out(doc_id):
    """Column: the label of this document must not be learnt."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [first, last), and the range of each."""
    n = last - first
    total = int(n.sum())
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(total) + np.repeat(first - np.cumsum(n) + n, n), of


class Vocabulary:
    """Numbers of the known terms, by an open-addressing table."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms  # ascending
        self._slots = None

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def __len__(self) -> int:
        return len(self.terms)

    def _build(self) -> None:
        size = 1 << max(10, (4 * len(self.terms)).bit_length())
        slots, left = np.full(size, -1, dtype=np.int32), np.arange(len(self.terms), dtype=np.int32)
        at = (self.terms & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of several for one place the last stays
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)
        self._slots, self._mask = slots, size - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is no term."""
        if not len(self.terms):
            return np.full(len(h), -1, dtype=np.int64)
        if self._slots is None:
            self._build()
        at = (h & np.uint64(self._mask)).astype(np.int64)
        out = self._slots[at].astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.terms[out] != h))
        while len(left):
            at[left] = (at[left] + 1) & self._mask
            out[left] = self._slots[at[left]]
            left = left[(out[left] >= 0) & (self.terms[out[left]] != h[left])]
        return out

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), by text and term."""
        keys = [np.zeros(0, np.int64)]
        width = max(1, len(self.terms))
        for doc, h in wordhash.grams(texts, _TABLE, ()):
            i = self.find(h)
            known = i >= 0
            keys.append(doc[known] * width + i[known])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // width, key % width, n


@dataclass
class Index:
    """Terms and their values, and the postings (entry, weight) of each term by entry."""

    vocabulary: Vocabulary
    value: np.ndarray  # idf times relevance
    first: np.ndarray  # where each term's postings begin
    entry: np.ndarray
    weight: np.ndarray
    positive: np.ndarray  # votes by entry
    total: np.ndarray
    evidence: np.ndarray  # an example's id by entry
    blank: float  # score of a text without a term
    prior: float
    curve: tuple[float, float] = (1.0, 0.0)
    own: dict[int, int] = field(default_factory=dict)  # entry of each example, for calibration

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _blocks(self) -> None:
        """Lay the long lists out by block, with their block maxima."""
        self._entries = -(-len(self.total) // _BLOCK) * _BLOCK
        long = np.flatnonzero(np.diff(self.first) >= max(_BLOCK, len(self.total) // 32))
        self._row = np.full(len(self.value), -1, dtype=np.int64)
        self._row[long] = np.arange(len(long))
        self._lists = np.zeros((self._entries // _BLOCK, len(long), _BLOCK), dtype=np.float32)  # by block, then term
        for i, t in enumerate(long.tolist()):
            e = self.entry[self.first[t] : self.first[t + 1]]
            self._lists[e // _BLOCK, i, e % _BLOCK] = self.weight[self.first[t] : self.first[t + 1]]
        self._maxima = np.ascontiguousarray(self._lists.max(axis=2).T) if len(long) else np.zeros((0, self._entries // _BLOCK), np.float32)

    def weights(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each text's terms, with length 1."""
        if not len(doc):
            return np.zeros(0)
        w = (1 + np.log(n)) * self.value[term]
        return w / np.sqrt(np.bincount(doc, w * w))[doc]

    def nearest(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, entry, similarity) of the k nearest entries that share a term; by text, most similar first, ties by number."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(doc) and len(self.total):
            if not hasattr(self, "_lists"):
                self._blocks()
            names, starts = np.unique(doc, return_index=True)
            for step in range(0, len(names), _QUERIES):
                n = min(_QUERIES, len(names) - step)
                a, b = starts[step], starts[step + n] if step + n < len(names) else len(doc)
                row, who, sims = self._some(np.searchsorted(names[step : step + n], doc[a:b]), term[a:b], w[a:b], n, k)
                out.append((names[step + row], who, sims))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _some(self, doc, term, w, rows: int, k: int):
        at = self._row[term]
        long, short = at >= 0, at < 0
        query = np.zeros((rows, len(self._maxima)), dtype=np.float32)
        query[doc[long], at[long]] = w[long]
        place, of = _spread(self.first[term[short]], self.first[term[short] + 1])
        sims = np.bincount(doc[short][of] * self._entries + self.entry[place], w[short][of] * self.weight[place], minlength=rows * self._entries)
        sims = sims.astype(np.float64, copy=False).reshape(rows, -1, _BLOCK)  # of no short list at all, bincount makes integers
        bound = sims.max(axis=2) + query @ self._maxima
        seen = np.zeros(bound.shape, dtype=bool)

        def visit(wanted: np.ndarray) -> None:
            """Complete the similarities in the wanted blocks."""
            if 2 * np.count_nonzero(wanted) > wanted.size:  # most of all: one product each block, without picking queries
                np.add(sims, np.matmul(query, self._lists).transpose(1, 0, 2), out=sims, where=wanted[:, :, None])
            else:
                for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                    some = np.flatnonzero(wanted[:, block])
                    sims[some, block] += query[some] @ self._lists[block]
            seen[wanted] = True

        def kth(known: np.ndarray) -> np.ndarray:
            at = max(0, known.shape[1] - k)
            return np.partition(known, at, axis=1)[:, at] if known.shape[1] >= k else np.zeros(rows)

        top = min(bound.shape[1], 2 + k // _BLOCK)
        best = np.argpartition(-bound, top - 1, axis=1)[:, :top]
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, best, True, axis=1)
        visit(first)
        least = kth(np.take_along_axis(sims, best[:, :, None], axis=1).reshape(rows, -1))
        rest = (bound > 0) & ~seen & (bound >= least[:, None] - 1e-5)
        if rest.any():
            visit(rest)
            least = kth(np.where(seen[:, :, None], sims, 0).reshape(rows, -1))
        table = np.where(seen[:, :, None], sims, 0).reshape(rows, -1)
        r, who = np.nonzero((table >= least[:, None]) & (table > 0))
        s = table[r, who]
        order = np.lexsort((who, -s, r))
        r, who, s = r[order], who[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        return r[place < k], who[place < k], s[place < k]

    def votes(self, texts: pa.Array, without: list[tuple[int, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(share of votes for the label, whether any term is known, neighbours) of each text.

        ``without`` names for each text an entry and the votes that do not count there.
        """
        doc, term, n = self.vocabulary.counts(texts)
        row, who, sims = self.nearest(doc, term, self.weights(doc, term, n))
        pos, total = self.positive[who], self.total[who]
        if without is not None:
            e, p, t = np.array(without, dtype=np.int64).reshape(-1, 3).T
            mine = e[row] == who
            pos, total = pos - np.where(mine, p[row], 0), total - np.where(mine, t[row], 0)
        v = sims * sims
        yes, all_ = (np.bincount(row, v * x, minlength=len(texts)) for x in (pos, total))
        known = np.bincount(row, minlength=len(texts)) > 0
        return (yes + _PRIOR * self.prior) / (all_ + _PRIOR), known, (row, who, sims)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * _logit(share) + b)))

    def scores(self, texts: pa.Array, most: int = 0) -> tuple[np.ndarray, list[list]]:
        """Scores in 0..1, and up to ``most`` neighbours of each text as its evidence."""
        share, known, (row, who, sims) = self.votes(texts)
        why: list[list] = [[] for _ in range(len(texts))]
        if most:
            at = np.arange(len(row)) - np.searchsorted(row, row)
            for r, e, s in zip(row[at < most].tolist(), who[at < most].tolist(), sims[at < most].tolist()):
                why[r].append((int(self.evidence[e]), s))
        return np.clip(np.where(known, self.calibrated(share), self.blank), 0, 1), why


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log((p + 0.005) / (1.005 - p))


def fit_curve(share: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve of a * logit(share) + b that is likeliest; a is kept positive, so ranks stay."""
    x, (a, b) = _logit(share), (1.0, 0.0)
    if not 0 < positive.sum() < total.sum():
        return a, b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = positive - total * p, total * p * (1 - p)
        ga, gb = (g * x).sum() - 0.1 * (a - 1), g.sum() - 0.1 * b
        haa, hab, hbb = (h * x * x).sum() + 0.1, (h * x).sum(), h.sum() + 0.1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = max(0.05, a + da / size), b + db / size
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def relevance(n: np.ndarray, pos: np.ndarray, total: int, positive: int) -> np.ndarray:
    """FLOOR to 1: the chi-square of each term and the label, squashed."""
    rate = positive / total
    if not 0 < rate < 1:
        return np.ones(len(n))
    chi = (pos - n * rate) ** 2 / (n * rate * (1 - rate)) * total / np.maximum(total - n, 1)
    return FLOOR + (1 - FLOOR) * chi * chi / (chi * chi + _SURE * _SURE)


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """(document frequency of each term, rows) over all documents; each task adds up before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = -(-max(1, len(vocabulary)) // _CHUNKS)

    def count(batches):
        df, rows = np.zeros(width * _CHUNKS, dtype=np.int32), 0
        for part in wordhash.slices(batches, 0):
            df += np.bincount(shared.value.counts(part.column(0))[1], minlength=len(df)).astype(np.int32)
            rows += part.num_rows
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(_CHUNKS), pa.int32()), "df": pa.array([x.tobytes() for x in np.split(df, _CHUNKS)], pa.binary()), "rows": pa.array([rows] + [0] * (_CHUNKS - 1), pa.int64())})

    def merge(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, df, rows in zip(*(c.to_pylist() for c in batch.columns)):
                s = sums.setdefault(chunk, [np.zeros(width, dtype=np.int64), 0])
                s[0] += np.frombuffer(df, np.int32)
                s[1] += rows
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "df": pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), "rows": pa.array([r for _, r in sums.values()], pa.int64())})

    schema = "chunk int, df binary, rows long"
    out, rows = np.zeros(width * _CHUNKS, dtype=np.int64), 0
    for r in docs.select("text").mapInArrow(count, schema).repartition(8, "chunk").mapInArrow(merge, schema).collect():  # 8 bytes a term
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.df, np.int64)
        rows += r.rows
    shared.destroy()
    return out[: len(vocabulary)], rows


def build(vocabulary: Vocabulary, value: np.ndarray, examples: list[tuple], prior: float) -> Index:
    """The index of (id, term numbers, counts, votes for, votes) rows."""
    entries: dict[tuple, list] = {}
    none = [0, 0]
    for i, terms, n, pos, total in examples:
        if not len(terms):
            none[0] += pos
            none[1] += total
            continue
        e = entries.setdefault((terms.tobytes(), n.tobytes()), [terms, n, 0, 0, []])
        e[2], e[3] = e[2] + pos, e[3] + total
        e[4].append(i)
    # entries near each other share their heaviest term, which makes tight block maxima
    heavy = lambda e: int(e[0][np.argmax((1 + np.log(e[1])) * value[e[0]])])
    kept = sorted(entries.values(), key=lambda e: (heavy(e), min(e[4])))
    sizes = [len(e[0]) for e in kept]
    doc = np.repeat(np.arange(len(kept)), sizes)
    term = np.concatenate([e[0] for e in kept]) if kept else np.zeros(0, np.int64)
    n = np.concatenate([e[1] for e in kept]) if kept else np.zeros(0, np.int64)
    w = (1 + np.log(n)) * value[term]
    if len(doc):
        w = w / np.sqrt(np.bincount(doc, w * w))[doc]
    order = np.lexsort((doc, term))
    doc, term, w = doc[order], term[order], w[order].astype(np.float32)
    return Index(
        vocabulary,
        value,
        np.searchsorted(term, np.arange(len(vocabulary) + 1)).astype(np.int64),
        doc.astype(np.int32),
        w,
        np.array([e[2] for e in kept], dtype=float),
        np.array([e[3] for e in kept], dtype=float),
        np.array([min(e[4]) for e in kept], dtype=np.int64),
        (none[0] + prior) / (none[1] + 1),
        prior,
        own={i: k for k, e in enumerate(kept) for i in e[4]},
    )


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """Learn from at most ``examples`` labelled rows, those with the smallest hash of the id.

    Rows of labels that are held out, or whose doc_id or label is null, are
    never read further. Repeated labels of a document all vote; of repeated
    documents the least text counts. The vocabulary is every word of these
    examples; its document frequencies are counted over all of ``docs``.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
        .where("id is not null and label is not null")
        .where(~held_out("id"))
        .select("id", "label", F.xxhash64("id").alias("h"))
        .orderBy("h", "id", "label")
        .limit(examples)
        .collect()
    )
    votes: dict[int, list[int]] = {}
    for row in chosen:
        v = votes.setdefault(row.id, [0, 0])
        v[0] += row.label == 1
        v[1] += 1
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in votes], "id long"))  # at most `examples` ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id").groupBy("id").agg(F.min("text").alias("text"))

    def describe(batches):
        for part in wordhash.slices(batches, 1):
            docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for doc, h in wordhash.grams(part.column(1), _TABLE, ()):
                docs.append(doc), hashes.append(h)
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(h)])
            n = np.diff(np.append(new, len(h)))
            cuts = np.searchsorted(doc[new], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in (h[new], n.astype(np.int32)))], names=["id", "terms", "counts"]
            )

    rows = texts.mapInArrow(describe, "id long, terms binary, counts binary").toArrow()  # at most `examples` rows
    found = [(i, np.frombuffer(t, np.uint64), np.frombuffer(n, np.int32), *votes[i]) for i, t, n in zip(*(c.to_pylist() for c in rows.columns))]
    found.sort(key=lambda r: r[0])
    del rows
    total, positive = sum(r[4] for r in found), sum(r[3] for r in found)
    prior = positive / total if total else 0.0
    terms, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[1] for r in found)]), return_inverse=True)
    at = at.astype(np.int32)
    found = [(i, None, *rest) for i, _, *rest in found] if len(terms) else found
    vocabulary = Vocabulary(terms)
    if not len(terms):
        return build(vocabulary, np.zeros(0), [(r[0], r[1], *r[2:]) for r in found], prior)
    sizes = [len(r[2]) for r in found]
    n, pos = (np.bincount(at, np.repeat([float(r[k]) for r in found], sizes), minlength=len(terms)) for k in (4, 3))
    df, n_docs = _frequencies(docs, vocabulary)
    value = (np.log((1 + n_docs) / (1 + df)) + 1) * relevance(n, pos, total, positive)
    cuts = np.cumsum([0, *sizes])
    index = build(vocabulary, value, [(r[0], at[a:b], r[2], r[3], r[4]) for r, a, b in zip(found, cuts[:-1], cuts[1:])], prior)
    if 0 < prior < 1:
        shared = spark.sparkContext.broadcast((index, votes))

        def others(batches):
            ix, own_votes = shared.value
            for part in wordhash.slices(batches, 1):
                ids = part.column(0).to_pylist()
                share, known, _ = ix.votes(part.column(1), [(ix.own.get(i, -1), *own_votes[i]) for i in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(known, share, np.nan))], names=["id", "share"])

        scored = [(s, *votes[i]) for i, s in texts.mapInArrow(others, "id long, share double").collect() if s == s]  # at most `examples` rows
        shared.destroy()
        if scored:
            index.curve = fit_curve(*np.array(scored, dtype=float).T)
    index.own = {}
    return index


def score_column(docs: DataFrame, index: Index, name: str) -> DataFrame:
    """``docs`` with the score as one more column."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for part in wordhash.slices(batches, at):
            s, _ = shared.value.scores(part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence.

    evidence lists up to three nearest labelled documents with their
    similarity. Whole texts count, however long. A null or empty text, or one
    without a known term, has the smoothed rate of the examples that have no
    term either. Without usable labels every score is 0 (no positive example)
    or near 1 (no other). Ties go to the entry with the smaller number;
    repeated rows get equal scores. Other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for part in wordhash.slices(batches, 1):
            s, why = shared.value.scores(part.column(1), 3)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(s, pa.float64()), pa.array([[{"doc_id": i, "similarity": x} for i, x in w] for w in why], pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())])))],
                names=["doc_id", "score", "evidence"],
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double>>")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns and repeated rows stay."""
    name = free_name(docs.columns, "score")
    return score_column(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)
