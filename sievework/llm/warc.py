"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each of whole WARC records, and a seek table in a skippable frame
at its end (the public seekable format). The index maps record ids to (bundle, frame, place in the frame, length),
so one record costs one frame. Tasks write bundles through pyarrow's file systems into the shared folder, under
names of their own; the index, written by Spark, names only bundles of tasks that succeeded, so lost executors and
repeated tasks leave at most files that nobody reads.

Of records with equal payloads of at least MIN_DEDUP bytes, the one with the smallest id is a response, the others
are revisit records without payload that name it.

Edge cases: null html is an empty payload; smaller payloads are all responses; rows of the same id and payload are
responses alike; null ids are less than none: they revisit a known id, and are responses where a payload has null
ids only; a null url is written as an empty target; an empty table makes no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import shared_dir, stored
from sievework.operators.skew import lookup_join

MIN_DEDUP = 100
#: Records are gathered into a frame up to so many bytes, frames into a bundle up to so many.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
LEVEL = 3
#: Frames that a task reads back, about.
FRAMES_A_TASK = 16
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, page_id long, bundle string, frame long, frame_start long, frame_bytes long, place long, length long"
PAYLOADS = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    """Ids follow from page and payload, so that a repeated task writes the same, and revisits can name their response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{kind}')}>"


def record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> tuple[str, bytes]:
    """A record's id and bytes."""
    rid = record_id(page_id, digest, kind)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {rid}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        named = record_id(refers_to, digest, "response")
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Bundle:
    """Writes one bundle: frames as they fill, the seek table at the end."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        system, path = _open(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.table, self.buffer, self.held, self.index = system.open_output_stream(path, compression=None), 0, [], [], 0, []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, page_id: int | None, rid: str, raw: bytes) -> None:
        self.index.append([rid, page_id, self.uri, len(self.table), self.at, 0, self.held, len(raw)])
        self.buffer.append(raw)
        self.held += len(raw)

    def end_frame(self) -> list[list]:
        if not self.held:
            return []
        frame = self.zstd.compress(b"".join(self.buffer))
        self.out.write(frame)
        self.table.append((len(frame), self.held))
        self.at += len(frame)
        rows, self.buffer, self.held, self.index = self.index, [], 0, []
        for row in rows:
            row[5] = len(frame)
        return rows

    def close(self) -> list[list]:
        rows = self.end_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()
        return rows


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, bytes, bytes unpacked) of each frame, from the end of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * n)
    sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
    out, at = [], 0
    for packed, unpacked in sizes:
        out.append((at, packed, unpacked))
        at += packed
    return out


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, size, digest, kind, refers_to. Only (id, digest) take part in the look for equal payloads; html is
    moved by it only where repeated payloads are too many to be broadcast, and then no hot one is."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.col("size") >= MIN_DEDUP).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = stored(first, "repeated-payloads")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # repeated payloads are few or hot: they are broadcast, so that no html moves to look for them
    known = lookup_join(rows, first, ["digest"], "n", first.agg(F.sum("n")).first()[0] or 0, how="left")
    return known.select(
        "page_id", "url", "payload", "size", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to")
    )


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes bundles into folder; returns the stored index."""

    def bundles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
        bundle = None
        for pdf in parts:
            for page_id, url, payload, size, digest, kind, refers_to in pdf.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                bundle = bundle or _Bundle(folder)
                bundle.add(page_id, *record(page_id, url, kind, digest, size, refers_to, bytes(payload)))
                if bundle.held >= FRAME_BYTES:
                    yield frame(bundle.end_frame())
                if bundle.at >= BUNDLE_BYTES:
                    yield frame(bundle.close())
                    bundle = None
        if bundle:
            yield frame(bundle.close())

    return stored(records.mapInPandas(bundles, INDEX), "warc-index")


def read_back(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of an index. Each frame is one row of work: found by its bundle's seek table, unpacked once, and
    its records are cut out by their places. A payload that doesn't have its digest is an error."""
    # the index is small beside the frames it names, so its bytes must not decide in how many tasks they are read
    tasks = max(1, index.where("place = 0").count() // FRAMES_A_TASK)
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list(F.struct("place", "length")).alias("records"))
    names = [x.split()[0] for x in PAYLOADS.split(", ")]

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, list] = {}
        unzip = zstandard.ZstdDecompressor()
        for pdf in parts:
            for bundle, frame, records in pdf.itertuples(index=False):
                system, path = _open(bundle)
                with system.open_input_file(path) as source:
                    if bundle not in tables:
                        tables.clear()
                        tables[bundle] = seek_table(source)
                    start, packed, unpacked = tables[bundle][frame]
                    source.seek(start)
                    raw = unzip.decompress(source.read(packed), max_output_size=unpacked)
                rows = []
                for r in records:
                    fields, payload = parse(raw[r["place"] : r["place"] + r["length"]])
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']} of {bundle} has another payload than was written")
                    page, refers_to = (int(x) if x else None for x in (fields["X-Page"], fields.get("X-Refers-To-Page")))
                    size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                    rows.append((page, fields["WARC-Record-ID"], size, digest, kind, refers_to, payload if with_payload else None))
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return frames.mapInPandas(unpack, PAYLOADS)


def fetch(spark: SparkSession, index: DataFrame, record_ids: list[str]) -> DataFrame:
    """Some records by id: only their frames are read."""
    wanted = index.where(F.col("record_id").isin(record_ids))
    return read_back(wanted, with_payload=True)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for each page, reads the archives back, and returns what they say."""
    spark = pages.sparkSession
    index = write(decided(pages), shared_dir(spark, "warc"))
    return read_back(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
