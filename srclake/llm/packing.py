"""First-fit-decreasing sequence packing with a tournament tree of capacities.

Documents are tokenised once, next to the scan, and cut into full sequences and
a tail. Only piece descriptions travel from there on: they fall into randomised
groups of bounded expected size, and each group is packed by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import materialize

_SLOTS = 1 << 21  # places for known words, at most half of them used; a full table starts afresh


class WordTokenizer:
    """Ids of a tokenizer whose pieces cross neither ASCII white space nor the border of letters and punctuation.

    A batch is cut into such words by vectorised 64-bit hashing. An
    open-addressing table has the words seen before; each new one is encoded
    once, by the tokenizer itself, and a text's ids are those of its words in
    order.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        self.keys, self.value = np.zeros(_SLOTS, dtype=np.uint64), np.zeros(_SLOTS, dtype=np.int32)
        self.words, self.ids = 1, 1  # the first word is the closing id
        self.start, self.size, self.pool = np.zeros(1 << 16, np.int32), np.ones(1 << 16, np.int32), np.full(1 << 18, self.end_id, "<u4")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if unknown."""
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.value[slot], np.int32(-1))
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)
            key = self.keys[slot[left]]
            same = key == h[left]
            out[left[same]] = self.value[slot[left[same]]]
            left = left[~same & (key != 0)]
        return out

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        n = len(h)
        if self.words + n > _SLOTS // 2:
            raise OverflowError
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        encoded = [e.ids for e in encode(words, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), dtype=np.int64, count=n)
        flat = np.fromiter((i for x in encoded for i in x), dtype="<u4", count=int(size.sum()))
        while len(self.start) < self.words + n:
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.pool) < self.ids + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.ids : self.ids + len(flat)] = flat
        self.start[self.words : self.words + n] = self.ids + np.cumsum(size) - size
        self.size[self.words : self.words + n] = size
        value = np.arange(self.words, self.words + n, dtype=np.int32)
        self.words, self.ids = self.words + n, self.ids + len(flat)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one place the last stays
            won = self.keys[slot] == h
            self.value[slot[won]] = value[won]
            h, value, slot = h[~won], value[~won], (slot[~won] + 1) & (_SLOTS - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by the end id, and where each text begins (length n + 1)."""
        h, at, start, stop, raw = wordhash.parts(texts, wordhash.SPACE_TABLE)
        index = self._find(h)
        new = np.flatnonzero(index < 0)
        if len(new):
            unknown, first = np.unique(h[new], return_index=True)
            first = new[first]
            data = raw.tobytes()
            words = [data[a:b].decode(errors="replace") for a, b in zip(start[first].tolist(), stop[first].tolist())]
            try:
                self._learn(unknown, words)
            except OverflowError:  # start afresh; a single text with more words than the table has none to share
                if self.words == 1:
                    return self._plainly(texts)
                self.reset()
                return self.encode(texts) if len(h) <= _SLOTS // 2 else self._plainly(texts)
            index[new] = self._find(h[new])
        ends = np.arange(1, len(at)) + at[1:]  # after each text's words comes the closing id
        full = np.insert(index, at[1:], 0)
        size = self.size[full].astype(np.int64)
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[full] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.concatenate([[0], total[ends - 1]])

    def _plainly(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = texts.cast(pa.large_binary()).to_pylist()
        ids = [[*self.tokenizer.encode((t or b"").decode(errors="replace"), add_special_tokens=False).ids, self.end_id] for t in raw]
        return np.array([i for x in ids for i in x], dtype="<u4"), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, end_id: int) -> WordTokenizer:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: largest items first, each into the first bin with room.

    A tournament tree over the bins' free space finds that bin in log2(bins) steps.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = [0] * n
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        need, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        out[i] = at - leaves
        tree[at] -= need
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return out


def pieces(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """Every document's pieces: full sequences and a tail; ``salt`` is random but the same on a retry."""

    def cut(batches):
        from pyspark import TaskContext

        t, row = tokenizer(path, end_id), TaskContext.get().partitionId() << 40
        for part in wordhash.slices(batches, 1):
            ids, begins = t.encode(part.column(1))
            out = []
            for doc, a, b in zip(part.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist()):
                for s in range(a, b, length):
                    e = min(s + length, b)
                    row += 1
                    out.append((doc, s - a, e - s, zlib.crc32(ids[s:e]), b - a, row))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_pieces: int = 4096) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in one piece; a null or empty text has the
    end id only, and bytes that are no UTF-8 are read as U+FFFD. Groups are formed by a hash of a row number, so repeated rows
    or one hot id never gather. sequence_id is the group's number times 2**32
    plus the sequence within it. No rows give no rows. Only doc_id and text are
    read.
    """
    cut = materialize(pieces(docs, tokenizer_path, length, end_id), "pieces")
    groups = max(1, round(cut.count() / group_pieces))
    spark = docs.sparkSession

    def fill(batches):
        """Groups come one after the other."""
        now, rows = None, []

        def done():
            table = pa.Table.from_batches(rows)
            sizes = table.column("length").to_pylist()
            bins = first_fit_decreasing(sizes, length)
            free: dict[int, int] = {}
            offsets = []
            for b, s in zip(bins, sizes):
                offsets.append(free.get(b, 0))
                free[b] = offsets[-1] + s
            table = table.drop_columns(["grp"]).append_column("sequence_id", pa.array([(now << 32) + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            return table.combine_chunks().to_batches()

        for batch in batches:
            grp = batch.column(batch.schema.get_field_index("grp")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    if rows and grp[a] != now:
                        yield from done()
                        rows = []
                    now = int(grp[a])
                    rows.append(batch.slice(a, b - a))
        if rows:
            yield from done()

    keyed = cut.withColumn("grp", F.expr(f"pmod(xxhash64(salt), {groups})")).repartition(min(groups, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "grp").sortWithinPartitions("grp", "salt").drop("salt")
    return keyed.mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
