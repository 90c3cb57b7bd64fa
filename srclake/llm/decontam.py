"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` stores, for each block of documents, the postings of every term
of the training texts: term hashes, list ends and ascending positions in the
block's token stream. ``exact_matches`` looks up phrases by intersecting
offset-adjusted lists, from the phrase's rarest term in the block onwards;
``proximity_matches`` finds ordered terms within a distance. Postings never
leave their block, so a query moves phrases to postings, in slices of bounded
size, and no shuffle of the corpus is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import filesystem, scratch_path

WINDOW = 10
SLOP = 2  # other words between two of a window, for near matches
_BLOCK_BYTES = 2 << 20  # text bytes of a block, but for a longer text
_SLICE = 200_000  # phrases held by a task at once
_GAP = 1 << 10  # positions left free between documents, so no match crosses
INDEX_SCHEMA = "doc_ids array<long>, starts binary, lengths binary, terms binary, ends binary, gaps binary"


class Block:
    """The postings of one block of documents."""

    def __init__(self, starts, lengths, terms, ends, positions):
        self.starts, self.lengths, self.terms, self.ends, self.positions = starts, lengths, terms, ends, positions
        self.size = int(starts[-1] + lengths[-1]) + _GAP if len(starts) else _GAP
        order = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(ends, prepend=0))
        self.keys = order * self.size + positions  # ascending: by term, then position

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        h, at = wordhash.words(texts, wordhash.ALNUM_TABLE)
        lengths = np.diff(at)
        starts = np.concatenate([[0], np.cumsum(lengths + _GAP)[:-1]]) if len(lengths) else lengths
        where = np.arange(len(h), dtype=np.int64) + np.repeat(starts - at[:-1], lengths)
        order = np.argsort(h, kind="stable")
        h = h[order]
        last = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.zeros(0, np.int64)
        return cls(starts, lengths, h[last], last + 1, where[order])

    def pack(self) -> tuple[bytes, ...]:
        """Positions as differences within each list, which compress well."""
        gaps = np.diff(self.positions, prepend=0)
        first = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(self.ends)]
        gaps[first] = self.positions[first]
        return tuple(x.astype(t).tobytes() for x, t in ((self.starts, np.int64), (self.lengths, np.int32), (self.terms, np.uint64), (self.ends, np.int32), (gaps, np.int32)))

    @classmethod
    def unpack(cls, starts: bytes, lengths: bytes, terms: bytes, ends: bytes, gaps: bytes) -> Block:
        ends, gaps = np.frombuffer(ends, np.int32).astype(np.int64), np.frombuffer(gaps, np.int32).astype(np.int64)
        sums = np.cumsum(gaps)
        first = np.concatenate([[0], ends[:-1]])[: len(ends)]
        positions = sums - np.repeat(sums[first] - gaps[first], np.diff(ends, prepend=0))
        return cls(np.frombuffer(starts, np.int64), np.frombuffer(lengths, np.int32).astype(np.int64), np.frombuffer(terms, np.uint64), ends, positions)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each term, -1 where the block has it not."""
        if not len(self.terms):
            return np.full(hashes.shape, -1, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def _list(self, t: int) -> np.ndarray:
        return self.positions[self.ends[t - 1] if t else 0 : self.ends[t]]

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence; phrases: hashes, one row each, all of one length."""
        term = self.find(phrases)
        alive = np.flatnonzero((term >= 0).all(axis=1))
        term = term[alive]
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.diff(self.ends, prepend=0)
        rare = np.argsort(sizes[term], axis=1, kind="stable")
        out_p, out_at = [], []
        step = 0
        while step < len(alive):  # as many phrases at once as have about a million postings
            heads = sizes[term[np.arange(step, len(alive)), rare[step:, 0]]]
            n = max(1, int(np.searchsorted(np.cumsum(heads), 1 << 20)))
            t, r, heads = term[step : step + n], rare[step : step + n], heads[:n]
            row = np.repeat(np.arange(len(t)), heads)
            head = t[np.arange(len(t)), r[:, 0]]
            base = self.ends[head] - heads
            inside = np.arange(heads.sum()) - np.repeat(np.cumsum(heads) - heads, heads)
            at = self.positions[np.repeat(base, heads) + inside] - r[row, 0]
            for j in range(1, phrases.shape[1]):
                if not len(at):
                    break
                offset = r[row, j]
                want = t[row, offset] * self.size + at + offset
                i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                keep = self.keys[i] == want
                row, at = row[keep], at[keep]
            out_p.append(alive[step + row])
            out_at.append(at)
            step += n
        return np.concatenate(out_p), np.concatenate(out_at)

    def near(self, phrase: np.ndarray, slop: int) -> np.ndarray:
        """First positions of the terms in order, each at most slop + 1 after the one before."""
        term = self.find(phrase)
        if (term < 0).any():
            return np.zeros(0, np.int64)
        if len(term) > 1:  # the rarest term first: without a neighbour in reach there is nothing to find
            sizes = np.diff(self.ends, prepend=0)[term]
            r = int(np.argmin(sizes))
            x, other = self._list(term[r]), self._list(term[r + 1] if r + 1 < len(term) else term[r - 1])
            lo, hi = (1, slop + 1) if r + 1 < len(term) else (-slop - 1, -1)
            if not (np.searchsorted(other, x + hi, side="right") > np.searchsorted(other, x + lo)).any():
                return np.zeros(0, np.int64)
        lists = [self._list(t) for t in term]
        good = lists[-1]
        for x in reversed(lists[:-1]):  # positions from which the rest can be reached
            i = np.minimum(np.searchsorted(good, x, side="right"), len(good) - 1) if len(good) else np.zeros(0, int)
            x = x[(good[i] > x) & (good[i] <= x + slop + 1)] if len(good) else x[:0]
            good = x
        return good


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents, with the postings of all its terms.

    A null or empty text has no terms; repeated rows and null ids keep their
    places. No rows give no blocks. Only the two columns are read.
    """

    def build(batches):
        for part in wordhash.slices(batches, 1, _BLOCK_BYTES):
            block = Block.of(part.column(1)).pack()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in block)], names=["doc_ids", "starts", "lengths", "terms", "ends", "gaps"]
            )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(build, INDEX_SCHEMA)


def write_phrases(benchmark: DataFrame, window: int = WINDOW) -> str:
    """Write each item's distinct windows as (item_id, n, hashes) and return the path.

    A null text or one without words has none; a null id stays null; repeated
    items repeat their windows.
    """

    def cut(batches):
        for batch in batches:
            h, at = wordhash.words(batch.column(1), wordhash.ALNUM_TABLE)
            ids, sizes, hashes = [], [], []
            for item, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
                k = min(window, int(b - a))
                if k:
                    for row in np.unique(np.lib.stride_tricks.sliding_window_view(h[a:b], k), axis=0):
                        ids.append(item), sizes.append(k), hashes.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())], names=["item_id", "n", "hashes"])

    path = scratch_path(benchmark.sparkSession, "phrases")
    benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, n int, hashes binary").write.parquet(path)
    return path


class Group:
    """Phrases of one length by the rarest of their terms: a block is asked only for those whose term it has."""

    def __init__(self, items: np.ndarray, rows: np.ndarray):
        _, at, n = np.unique(rows, return_inverse=True, return_counts=True)
        rare = rows[np.arange(len(rows)), np.argmin(n[at.reshape(rows.shape)], axis=1)]
        order = np.argsort(rare, kind="stable")
        self.items, self.rows, rare = items[order], rows[order], rare[order]
        self.keys, self.first = np.unique(rare, return_index=True)
        self.last = np.append(self.first[1:], len(rare))

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Items and phrases that may be in the block."""
        some = np.flatnonzero(np.isin(self.keys, block.terms, assume_unique=True) if len(self.keys) * 8 > len(block.terms) else block.find(self.keys) >= 0)
        at = np.concatenate([np.arange(a, b) for a, b in zip(self.first[some].tolist(), self.last[some].tolist())]) if len(some) else np.zeros(0, np.int64)
        return self.items[at], self.rows[at]


class Phrases:
    """The written phrases, slice by slice; one slice in memory, kept while it is the only one."""

    _kept: dict[str, list] = {}

    def __init__(self, path: str):
        self.path = path

    def __iter__(self):
        if self.path in self._kept:
            yield from self._kept[self.path]
            return
        import pyarrow.dataset as ds

        files, folder = filesystem(self.path)
        slices, n = [], 0
        for batch in ds.dataset(folder, filesystem=files, format="parquet").to_batches(columns=["item_id", "n", "hashes"], batch_size=_SLICE):
            items, sizes, hashes = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            made = [Group(items[sizes == k], np.frombuffer(b"".join(x for x, s in zip(hashes, sizes) if s == k), np.uint64).reshape(-1, k)) for k in np.unique(sizes)]
            n += len(items)
            slices = slices + [made] if n <= _SLICE else []
            yield made
        if n <= _SLICE:
            self._kept.clear()
            self._kept[self.path] = slices


def _hits(block: Block, phrases: Phrases, slop: int | None = None):
    """(hit words, item ids, item ids within ``slop``) for each document of a block."""
    n = len(block.starts)
    edge = np.zeros(block.size + 1, dtype=np.int32)
    found: list[set] = [set() for _ in range(n)]
    close: list[set] = [set() for _ in range(n)]
    for made in phrases:
        for group in made:
            items, rows = group.of(block)
            if not len(rows):
                continue
            p, at = block.exact(rows)
            if len(p):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + rows.shape[1], -1)
                doc = np.searchsorted(block.starts, at, side="right") - 1
                for d, item in set(zip(doc.tolist(), items[p].tolist())):
                    if item is not None:
                        found[d].add(item)
            if slop is not None:
                for i in np.flatnonzero((block.find(rows) >= 0).all(axis=1)).tolist():
                    if items[i] is not None and len(at := block.near(rows[i], slop)):
                        for d in set((np.searchsorted(block.starts, at, side="right") - 1).tolist()):
                            close[d].add(items[i])
    if not edge.any():
        return np.zeros(n, np.int64), found, close
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return hit[block.starts + block.lengths] - hit[block.starts], found, close


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _score(ids, block: Block, phrases: Phrases, slop: int | None) -> pa.RecordBatch:
    hit, found, close = _hits(block, phrases, slop)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(block.lengths, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([_digest(x) for x in found]), pa.array(hit > 0), pa.array([len(x) for x in close], pa.int64())],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_path: str | None = None, slop: int | None = None) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and with ``slop`` n_near.

    n_near counts the items of which a window's words occur in order with at
    most ``slop`` other words between two, exact occurrences among them.

    The index is written to ``index_path`` (the shared folder if none is given)
    and the benchmark's windows are searched in it. A null or empty text has no
    words; a text of any length is read whole. Repeated rows give repeated
    results; items with a null id count in n_hit and contaminated only; an
    empty table on either side is fine. Only doc_id, item_id and the texts are
    read, so other columns may have any names.
    """
    spark = docs.sparkSession
    path = index_path or scratch_path(spark, "index")
    build_index(docs).write.option("compression", "zstd").parquet(path)
    phrases = write_phrases(benchmark, window)

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *packed = (c[i].as_py() for c in batch.columns)
                yield _score(ids, Block.unpack(*packed), Phrases(phrases), slop)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"
    scored = spark.read.schema(INDEX_SCHEMA).parquet(path).mapInArrow(search, schema)
    return scored if slop is not None else scored.drop("n_near")


def proximity_matches(index: DataFrame, phrases: dict[str, str], slop: int) -> DataFrame:
    """(name, doc_id, word): ordered terms of each phrase, at most ``slop`` other words between two.

    ``phrases`` is a bounded driver-side dict of queries. Null phrases and those
    without words match nothing; documents without text match nothing, null and
    repeated ids come back as they are, and an empty index gives no rows.
    """
    names = list(phrases)
    h, at = wordhash.words(pa.array([phrases[k] for k in names], pa.string()), wordhash.ALNUM_TABLE)
    queries = [(k, h[a:b]) for k, a, b in zip(names, at[:-1], at[1:]) if b > a]
    if slop >= _GAP - 1:
        raise ValueError(f"slop must be below {_GAP - 1}")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, *packed = (c[i].as_py() for c in batch.columns)
                block, out = Block.unpack(*packed), []
                for name, q in queries:
                    for pos in block.near(q, slop).tolist():
                        d = int(np.searchsorted(block.starts, pos, side="right")) - 1
                        out.append((name, ids[d], pos - int(block.starts[d])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["name", "doc_id", "word"])

    return index.mapInArrow(search, "name string, doc_id long, word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay, whatever their names.

    Null and empty texts stay. An empty table on either side is fine.

    Works in place on each block: its postings are built, searched and dropped,
    so nothing is joined back and rows with a null or repeated doc_id are safe.
    """
    phrases = write_phrases(benchmark, window)
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches):
        for part in wordhash.slices(batches, at, _BLOCK_BYTES):
            hit, *_ = _hits(Block.of(part.column(at)), Phrases(phrases))
            yield part.filter(pa.array(hit == 0))

    return docs.mapInArrow(keep, docs.schema)
