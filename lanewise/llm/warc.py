"""WARC archives with an index of byte ranges.

Writing: the tasks write records to files of their own in the shared folder and report an index row for each
(file, offset, length, url, digest, ids). The committed index table alone says which files and records exist.
Reading: selected index rows are sorted by file and offset; neighbouring ranges become one read.
Of records with equal payloads one holds the payload, the others are revisit records that refer to it.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import attempt_name, columns, filesystem, partitions, row_key, saved, shared_dir

FILE_BYTES, READ_BYTES, GAP_BYTES, SEGMENT_BYTES = 256 << 20, 8 << 20, 64 << 10, 64 << 20
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_id string, record_type string, refers_to string, refers_page long"
RECORD = "page_id long, url string, record_id string, record_type string, refers_record string, refers_to long, digest string, payload binary, intact boolean"


def _sha1(column: Column) -> Column:
    return F.sha1(F.coalesce(column, F.lit("")))


def base32_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """One gzip member holding one WARC record, as the format's compressed form asks."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def _one_line(url: str | None) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record_id(*parts) -> str:
    """The same row always gets the same id, so a record can be referred to before it is written."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def roles(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with sha (hex), copy, top_page, top_url: of equal payloads the row with the largest
    (page_id, url) and copy 1 is the response. copy numbers rows that are equal in page_id, url and payload."""
    key = ["page_id", "url", "sha"]
    p = pages.withColumn("sha", _sha1(F.col("html"))).select("*", *row_key(*key))
    light = p.select("__k1", "__k2", *key).distinct()
    top = light.groupBy(F.col("sha").alias("s")).agg(F.max(F.struct("page_id", "url")).alias("top"))
    decided = light.join(top, F.col("sha") == F.col("s")).select("__k1", "__k2", "top")
    numbered = p.withColumn("copy", F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy(F.lit(1))))
    return numbered.join(decided, ["__k1", "__k2"]).select(*key, "html", "copy", F.col("top.page_id").alias("top_page"), F.col("top.url").alias("top_url"))


def write_archives(pages: DataFrame, when: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files and returns their index.

    A null html is an empty payload; a null or odd url is written as an empty or escaped target. Rows that
    repeat give a record each. Extra columns are ignored. An empty table gives an empty index and no file.
    """
    root = shared_dir(pages.sparkSession, "warc")

    def write(batches):
        fs = path = None
        out, at, name = None, 0, ""
        for batch in batches:
            rows = []
            for page, url, sha, html, copy, top_page, top_url in zip(*[batch.column(c).to_pylist() for c in
                                                                     ("page_id", "url", "sha", "html", "copy", "top_page", "top_url")]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{root}/{attempt_name('part', '.warc.gz')}"
                    fs, path = filesystem(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, at = fs.open_output_stream(path, compression=None), 0
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                response = copy == 1 and (page, url) == (top_page, top_url)
                rid, top = _record_id(page, url, sha, copy), _record_id(top_page, top_url, sha, 1)
                fields = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", when),
                          ("WARC-Target-URI", _one_line(url)), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if page is not None:
                    fields.append(("X-Page-ID", str(page)))
                if not response:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", top),
                               ("WARC-Refers-To-Target-URI", _one_line(top_url))]
                    if top_page is not None:
                        fields.append(("X-Refers-To-Page-ID", str(top_page)))
                raw = _record(fields, payload if response else b"")
                out.write(raw)
                rows.append((name, at, len(raw), url, digest, page, rid, "response" if response else "revisit",
                             None if response else top, None if response else top_page))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(INDEX))], _names(INDEX)) if rows else _empty(INDEX)
        if out is not None:
            out.close()

    return saved(roles(columns(pages, "page_id", "url", "html")).mapInArrow(write, INDEX), "warc-index")


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    return [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]


def _empty(schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in _types(schema)], _names(schema))


def parse_record(raw: bytes) -> tuple:
    """The fields of RECORD from one gzip member."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    f = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(f["Content-Length"])]
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = f["WARC-Type"] == "response"
    number = lambda k: int(f[k]) if k in f else None
    return (number("X-Page-ID"), f["WARC-Target-URI"], f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Refers-To"), number("X-Refers-To-Page-ID"), digest,
            body if whole else None, rest[len(body):] == b"\r\n\r\n" and (not whole or base32_digest(body) == digest))


def read_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows, by coalesced range reads. A revisit has no payload of its own.

    Ranges of one file segment that lie at most GAP_BYTES apart are read together, READ_BYTES at most
    unless a record is longer.
    """
    n = partitions(index.sparkSession)
    segment = F.floor(F.col("offset") / SEGMENT_BYTES)
    ordered = index.select("file", "offset", "length").repartition(n, "file", segment).sortWithinPartitions("file", "offset")

    def read(batches):
        for batch in batches:
            runs = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                last = runs[-1] if runs else None
                if last and last[0] == file and offset - last[2] <= GAP_BYTES and offset + length - last[1] <= READ_BYTES:
                    last[2] = max(last[2], offset + length)
                    last[3].append((offset, length))
                else:
                    runs.append([file, offset, offset + length, [(offset, length)]])
            held = name = None
            for file, lo, hi, wanted in runs:
                if file != name:
                    if held is not None:
                        held.close()
                    fs, path = filesystem(file)
                    held, name = fs.open_input_file(path), file
                held.seek(lo)
                data = held.read(hi - lo)
                rows = [parse_record(data[o - lo:o - lo + k]) for o, k in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(RECORD))], _names(RECORD))
            if held is not None:
                held.close()

    return ordered.mapInArrow(read, RECORD)


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url from the archives just written.

    A revisit's payload is that of the record it refers to. A record whose payload does not
    match its digest stops the job.
    """
    index = write_archives(pages)
    got = read_records(index).select("page_id", "url", "record_id", "record_type", "refers_record", "refers_to", "digest", "intact",
                                     F.octet_length("payload").cast("long").alias("size"))
    got = saved(got, "warc-records")
    size_of = got.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("size").alias("ref_size"), F.col("digest").alias("ref_digest"))
    met = got.join(size_of, "refers_record", "left")
    sound = F.col("intact") & ((F.col("record_type") == "response") | (F.col("digest") == F.col("ref_digest")))
    digest = F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
    return met.select("page_id", F.coalesce("size", "ref_size").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "url")
