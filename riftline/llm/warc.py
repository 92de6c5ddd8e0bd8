"""Deterministic sharded web archives.

Pages are range-sorted by key and written as WARC/1.1 records, one gzip member a record, in files that roll by
compressed size. Headers and digests are made anew. A task attempt writes under temporary names of its own and
returns manifest rows; Spark keeps the rows of the attempts that it accepted, a second job renames just those
files, and the manifest, written last, says which files count. An attempt that is lost or runs twice leaves
nothing but temporary files, which go in the end.

The page text is shuffled once: which records repeat a payload is found from digests, and these narrow rows
travel with the pages through the same range shuffle, next to the page that they are about.

Defined cases: a null payload is an empty one; of equal payloads of at least ``least_revisit`` bytes the
smallest key is the response and the others refer to it (a key that comes twice with one payload: the later
one refers to its own key); a row with a null key is a revisit if some other key has the payload, else a
response; a null address becomes ``urn:unknown``; no pages give no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import materialise, shared_dir

ROLL_BYTES, CHUNK = 16 << 20, 1 << 20
#: Fixed values of the WARC/1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"

MANIFEST = "file string, temporary string, records long, bytes long, sha1 string"
RECORDS = "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, intact boolean, file string"


def _filesystem(uri: str):
    """The file system of a URI and the path in it, on any node."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, key: str | None, serial: int, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    name = quote(key, safe="") if key is not None else "none"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:record:{name}:{digest.hex()}:{serial}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else "urn:unknown"),
        ("WARC-Payload-Digest", "sha1:" + _base32(digest)),
        ("WARC-Block-Digest", "sha1:" + _base32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if key is not None:
        head.append(("X-Key", quote(key, safe="")))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:record:{quote(refers_to, safe='')}:{digest.hex()}:0>"), ("X-Refers-To-Key", quote(refers_to, safe=""))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one task attempt; a new one begins when the last has ``roll_bytes``."""

    def __init__(self, root: str, part: int, roll_bytes: int):
        self.fs, self.root = _filesystem(root)
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.part, self.roll, self.attempt, self.number = part, roll_bytes, uuid.uuid4().hex, 0
        self.out = None

    def write(self, record: bytes) -> Iterator[dict]:
        if self.out is None:
            self.temporary, self.records, self.size, self.hash = f"_temporary/{self.attempt}-{self.number:05d}", 0, 0, hashlib.sha1()
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.hash.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> dict:
        self.out.close()
        self.out = None
        self.number += 1
        return {"file": f"part-{self.part:06d}-{self.number - 1:05d}.warc.gz", "temporary": self.temporary, "records": self.records, "bytes": self.size, "sha1": self.hash.hexdigest()}


def write_archives(pages: DataFrame, key: str, url: str, html: str, root: str, *, roll_bytes: int = ROLL_BYTES, least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record a page below ``root`` and return the manifest of the committed files."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    kind = pages.schema[key].dataType
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), body.alias("html"), F.unhex(F.sha1(F.encode(body, "UTF-8"))).alias("digest"))
    narrow = materialise(rows.where(F.octet_length("html") >= least_revisit).select("k", "digest"))
    firsts = narrow.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    repeats = narrow.join(firsts, "digest").where(~F.col("k").eqNullSafe(F.col("first"))).distinct()
    notes = repeats.select("k", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.col("first").cast("string").alias("first"), F.lit(0).alias("is_page"))
    both = notes.unionByName(rows.withColumns({"first": F.lit(None).cast("string"), "is_page": F.lit(1)}))
    dealt = both.repartitionByRange("k", "digest").sortWithinPartitions("k", "digest", "is_page").withColumn("k", F.col("k").cast("string"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = _Roller(root, TaskContext.get().partitionId(), roll_bytes)
        now, first, serial = None, None, 0
        for batch in batches:
            done: list[dict] = []
            for k, address, text, digest, to, is_page in batch[["k", "url", "html", "digest", "first", "is_page"]].itertuples(index=False, name=None):
                if (k, digest) != now:
                    now, first, serial = (k, digest), None, 0
                if not is_page:
                    first = to
                    continue
                payload = text.encode()
                refers = first if first is not None else k if serial and k is not None and len(payload) >= least_revisit else None
                record = _record("response" if refers is None else "revisit", k, serial, address, payload, digest, refers, date)
                done.extend(roller.write(record))
                serial += 1
            yield pd.DataFrame(done, columns=["file", "temporary", "records", "bytes", "sha1"])
        if roller.out is not None:
            yield pd.DataFrame([roller.close()])

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(root)
        for batch in batches:
            for file, temporary in zip(batch["file"], batch["temporary"], strict=True):
                try:
                    fs.move(f"{base}/{temporary}", f"{base}/{file}")
                except FileNotFoundError:  # an earlier attempt of this task has moved it
                    if not fs.get_file_info(f"{base}/{file}").is_file:
                        raise
            yield batch

    assert kind is not None
    written = materialise(dealt.mapInPandas(write, MANIFEST))
    written.mapInPandas(commit, MANIFEST).write.parquet(f"{root}/manifest")
    fs, base = _filesystem(root)
    if fs.get_file_info(f"{base}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _head(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        k, _, v = line.decode().partition(":")
        found[k.strip().lower()] = v.strip()
    return found


def _parse(stream, file: str) -> Iterator[tuple]:
    """The records of one archive, a chunk of payload in memory at a time."""
    while version := stream.readline():
        if version != VERSION:
            raise ValueError(f"{file}: not a record: {version[:40]!r}")
        head = _head(stream)
        status = stream.readline()
        left = int(head["content-length"]) - len(status)
        http = {}
        while (line := stream.readline()) != b"\r\n":
            left -= len(line)
            k, _, v = line.decode().partition(":")
            http[k.strip().lower()] = v.strip()
        left -= 2
        sha, size = hashlib.sha1(), 0
        while left:
            data = stream.read(min(left, CHUNK))
            if not data:
                raise ValueError(f"{file}: cut off")
            sha.update(data)
            size, left = size + len(data), left - len(data)
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{file}: no end of record")
        stated, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        intact = kind == "revisit" or (_base32(sha.digest()) == stated and size == int(http["content-length"]))
        key, to = head.get("x-key"), head.get("x-refers-to-key")
        yield unquote(key) if key is not None else None, head["warc-target-uri"], kind, int(http["content-length"]), _base32(sha.digest()) if kind == "response" else stated, unquote(to) if to is not None else None, intact, file


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """One row a record of the files that the manifest of ``root`` names; ``intact``: the payload has the stated digest."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("file")
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(root)
        for batch in batches:
            for file in batch["file"]:
                rows = []
                with fs.open_input_stream(f"{base}/{file}", compression=None) as raw, gzip.open(raw) as stream:
                    for row in _parse(stream, file):
                        rows.append(row)
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.repartition(max(1, files.count())).mapInPandas(read, RECORDS)  # a task a file


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/archives"
    write_archives(pages, "page_id", "url", "html", root)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, root).select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
