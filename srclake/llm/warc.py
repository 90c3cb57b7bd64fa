"""WARC archives with revisit records.

Archives are first written as captured, one response per row. Their headers are
shuffled by payload digest (with a partial aggregate, and the hottest digests
broadcast, so a hot digest is no hot task), revisit records are joined to their original responses, and each
archive is rewritten with fresh headers: the first of equal payloads stays a
response, the others become revisits without payload. Files are written under a
temporary name and renamed, so a repeated task leaves the same archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, qualified, scratch_path

LEAST = 100  # smaller payloads are never revisited
_HOT = 1000  # at most so many digests can have this part of the records each
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _clean(value) -> str:
    """A header value: without line breaks."""
    return "" if value is None else " ".join(str(value).split())


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One gzip member with a WARC 1.1 record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 1, mtime=0)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, payload) of every record of an archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        f = io.BufferedReader(f, 1 << 20)
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = {}
            while (line := f.readline().decode().rstrip("\r\n")) != "":
                k, _, v = line.partition(":")
                headers[k.strip().lower()] = v.strip()
            yield headers, f.read(int(headers["content-length"]))
            f.readline(), f.readline()


class _Archive:
    """A file that appears only when it is complete; a repeated task replaces it by the same bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.final, self.temporary = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)


def capture(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row as a response; (file, at, page_id, payload_bytes, payload_digest) by record."""

    def write(batches):
        from pyspark import TaskContext

        name, archive, n = f"capture-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        for batch in batches:
            archive = archive or _Archive(folder, name)
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", _record_id(name, n)), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
                archive.out.write(record(headers + ([("X-Page-ID", str(page))] if page is not None else []), payload))
                out.append((name, n, page, len(payload), digest))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "at", "page_id", "payload_bytes", "payload_digest"])
        if archive:
            archive.close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(write, "file string, at long, page_id long, payload_bytes long, payload_digest string")


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """The revisit records (file, at) with the place of their original (o_file, o_at, o_page), and a row of nulls for each file.

    The original of equal payloads is the record with the smallest page_id
    (null last), then the first by file and place.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "at")
    first = (
        headers.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min(order).alias("o"), F.count("*").alias("c"))
        .where("c > 1")
        .select("payload_digest", "c", F.col("o.file").alias("o_file"), F.col("o.at").alias("o_at"), F.col("o.page_id").alias("o_page"))
    )
    # only what may be a revisit is joined; digests with a thousandth of the records each are _HOT at most and broadcast, so no key of the other join is hot
    total = headers.count()
    large = headers.where(F.col("payload_bytes") >= least).select("file", "at", "payload_digest")
    hot = F.broadcast(first.where(F.col("c") * _HOT >= total).drop("c"))
    cool = first.where(F.col("c") * _HOT < total).drop("c")
    joined = large.join(hot, "payload_digest").unionByName(large.join(hot.select("payload_digest"), "payload_digest", "left_anti").join(cool, "payload_digest"))
    revisits = joined.where(~((F.col("file") == F.col("o_file")) & (F.col("at") == F.col("o_at")))).select("file", "at", "o_file", "o_at", "o_page")
    none = F.lit(None)
    return headers.select("file").distinct().select("file", none.cast("long").alias("at"), none.cast("string").alias("o_file"), none.cast("long").alias("o_at"), none.cast("long").alias("o_page")).unionByName(revisits)


def rewrite(decisions: DataFrame, source: str, target: str) -> DataFrame:
    """Write each captured archive anew, with revisits for repeated payloads; (file, records) by archive."""

    def write(batches):
        plan: dict[str, dict[int, tuple]] = {}
        archive_rows = None

        def done(name, rows):
            fs, base = filesystem(source)
            archive = _Archive(target, name.replace("capture", "dedup"))
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for n, (h, payload) in enumerate(read_records(stream)):
                    o_file, o_at, o_page = rows.get(n, (None, None, None))
                    fresh = [("WARC-Type", "revisit" if o_file else "response"), ("WARC-Record-ID", _record_id("dedup", name, n)), ("WARC-Date", h["warc-date"]), ("WARC-Target-URI", h["warc-target-uri"]), ("WARC-Payload-Digest", h["warc-payload-digest"]), ("X-Payload-Length", str(len(payload)))]
                    if o_file:
                        fresh += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id("dedup", o_file, o_at))] + ([("X-Refers-To-Page", str(o_page))] if o_page is not None else [])
                    else:
                        fresh.append(("Content-Type", h["content-type"]))
                    if "x-page-id" in h:
                        fresh.append(("X-Page-ID", h["x-page-id"]))
                    archive.out.write(record(fresh, b"" if o_file else payload))
            archive.close()
            return name, n + 1

        # rows come sorted by file; only the revisits of one file are held
        now, rows, made = None, {}, []
        for batch in batches:
            for file, at, *original in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    if now is not None:
                        made.append(done(now, rows))
                    now, rows = file, {}
                if original[0] is not None:
                    rows[at] = tuple(original)
        if now is not None:
            made.append(done(now, rows))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made]), pa.array([y for _, y in made], pa.int64())], names=["file", "records"])

    # the work is in the archives, not in these rows: a task for each, as far as hashing spreads them
    files = max(1, decisions.select("file").distinct().count())
    return decisions.repartition(files, "file").sortWithinPartitions("file", "at").mapInArrow(write, "file string, records long")


def read_archives(spark, folder: str, names: DataFrame) -> DataFrame:
    """Records of the archives that ``names`` (column file) lists: headers and, for responses, verified payloads."""

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = filesystem(folder)
                out = []
                with fs.open_input_stream(f"{base}/{name.replace('capture', 'dedup')}", compression=None) as stream:
                    for h, payload in read_records(stream):
                        digest, kind = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: payload and digest of {h['warc-record-id']} differ")
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page")
                        out.append((None if page is None else int(page), h["warc-target-uri"], int(h["x-payload-length"]), digest, kind, None if refers is None else int(refers), h["warc-record-id"], h.get("warc-refers-to")))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 8, types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record"])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"
    return names.select("file").mapInArrow(read, schema)


def deduplicated_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to deduplicated archives below ``folder`` and read them back, one row per record.

    Null html is an empty payload and, like any below ``least`` bytes, always a
    response. Of repeated rows with one page_id the first written is the
    response; the others refer to that id. A null page_id sorts last and gives
    a null refers_to, with the record id still in refers_to_record. No rows
    give no archive. Payloads may have any length. Only page_id, url and html
    are read, so other columns may have any names.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else scratch_path(spark, "warc")
    headers = materialize(capture(pages, f"{folder}/capture"), "headers")
    decisions = materialize(resolve(headers, least), "decisions")
    archives = materialize(rewrite(decisions, f"{folder}/capture", f"{folder}/dedup"), "archives")
    n = archives.count()
    return read_archives(spark, f"{folder}/dedup", archives.repartition(max(1, n)))
