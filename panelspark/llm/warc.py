"""WARC archives of pages, and a two-level index of their captures.

Each page is a record, a gzip member of its own, in the archives that the tasks write: a response with
the page's HTML, or a revisit without it where another page has an equal payload. Captures are sorted by the
reversed-host form of their URL (SURT) and written as lines in compressed blocks; beside each file of blocks
stands its directory, a line a block. A search finds the file by the files' bounds, the blocks by
bisection in the directory, the lines by bisection in the block, and the record by one read of its range.

Archives and blocks are files of the shared folder whose names no two attempts of a task share; only those
that finished tasks report are known, so that a lost executor leaves nothing but files that no one reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch
from .store import located, ranges
from .streams import key_runs
from .textkit import column_chunks

#: Time of capture of pages that have none.
DATE = "1970-01-01T00:00:00Z"
#: Payloads below this size are always stored; bytes of an archive, about; lines of a block; files of blocks at most.
LEAST, ARCHIVE, LINES, FILES = 0, 1 << 30, 1000, 4096
#: Captures of a file of blocks, about.
FILE_ROWS = 1_000_000
#: Bytes of an archive that one task reads in a row, about.
READ = 1 << 24
_LEVEL = 6
_NAMES = uuid.UUID("6b9f4c1e-53f0-5d0e-8f5c-0f3d6c3a9b11")
_CAPTURE = "key string, page_id long, file string, offset long, length long, type string"
_RECORD = "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, intact boolean"


def surt(url: Column) -> Column:
    """The reversed-host key of a URL: com,example,www)/path?query. Schemes, user names, usual ports and fragments go, hosts
    are lower case; white space and control characters are %20. Other strings are their own key, null is the empty one."""
    form = r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)"
    found = lambda i: F.regexp_extract(url, form, i)
    host = F.rtrim(F.lower(found(1)), F.lit("."))
    back = F.when(host.startswith("["), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    port = F.when(found(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), found(2)))
    path = F.when(found(3).startswith("/"), found(3)).otherwise(F.concat(F.lit("/"), found(3)))
    key = F.when(url.rlike(form) & (host != ""), F.concat(back, port, F.lit(")"), path)).otherwise(url)
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20"), F.lit(""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: object) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page {page_id}' if page_id is not None else f'{digest} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record: the page as a response, or a revisit of the page refers_to whose payload is equal."""
    digest, address = digest_of(payload), _header(url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest, address)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest, '')}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    parts = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in parts}


def parse(raw: bytes) -> dict:
    """The fields of a record. intact: its lengths hold, and so does its digest if it has the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    whole = fields["warc-type"] == "response"
    refers, page = fields.get("refers-to-page-id"), fields.get("page-id")
    return {
        "page_id": int(page) if page is not None else None, "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "record_type": fields["warc-type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": int(refers) if refers is not None else None, "payload": payload if whole else None,
        "intact": rest[size:] == b"\r\n\r\n" and (not whole or (len(payload) == length and digest_of(payload) == digest)),
    }


def _typed(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """pages (page_id, url, html, date) with refers_to: the smallest page_id of the pages with an equal payload, if that is not the page's
    own. Payloads are compared by SHA-256 and length; what is exchanged of them is that alone."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    known = scratch.save(pages.select("page_id", F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size")).filter(F.col("size") >= least), "payloads")
    firsts = known.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    firsts = scratch.save(firsts, "firsts")
    again = known.join(firsts, ["sha", "size"]).filter("page_id IS NULL OR page_id <> first")
    again = scratch.save(again.select(F.col("page_id").alias("_page"), "sha", "size", "first").distinct(), "revisits")
    keyed = pages.withColumns({"_sha": F.sha2(payload, 256), "_size": F.octet_length(payload), "_payload": payload})
    same = keyed["page_id"].eqNullSafe(again["_page"]) & (keyed["_sha"] == again["sha"]) & (keyed["_size"] == again["size"])
    return keyed.join(again, same, "left").select("page_id", "url", "date", "key", F.col("first").alias("refers_to"), F.col("_payload").alias("payload"))


def _archived(folder: str):
    """Write the records of a partition, and give each one's capture: where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = located(folder)
        name = out = None
        offset = 0
        for batch in batches:
            for lo, hi in column_chunks(batch.column("payload")):
                captures = []
                for row in batch.slice(lo, hi - lo).to_pylist():
                    if out is None or offset > ARCHIVE:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{at}/{name}", compression=None)
                    data = gzip.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["date"]), _LEVEL, mtime=0)
                    out.write(data)
                    captures.append({"key": row["key"], "page_id": row["page_id"], "file": name, "offset": offset, "length": len(data), "type": "response" if row["refers_to"] is None else "revisit"})
                    offset += len(data)
                yield pa.RecordBatch.from_pylist(captures, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
        if out is not None:
            out.close()

    return run


_LINE = ("page_id", "file", "offset", "length", "type")


def _indexed(folder: str):
    """Write the captures of a sorted partition in blocks and their directory; a row for the file: name and bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = located(folder)
        name, out, directory, held = f"{uuid.uuid4().hex}.cdxj.gz", None, [], []
        offset, last = 0, ""

        def close_block() -> None:
            nonlocal offset
            data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"), _LEVEL)
            out.write(data)
            directory.append((held[0].split(" ", 1)[0], offset, len(data), len(held)))
            offset += len(data)
            held.clear()

        for pdf in batches:
            for key, *rest in pdf[["key", *_LINE]].astype({"page_id": object}).itertuples(index=False):
                if out is None:
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                held.append(f"{key} {json.dumps([None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in rest])}")
                last = key
                if len(held) == LINES:
                    close_block()
        if out is not None:
            if held:
                close_block()
            out.close()
            with files.open_output_stream(f"{at}/{name}.directory", compression=None) as beside:
                beside.write(json.dumps(directory).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"file": [name], "first": [directory[0][0]], "last": [last], "blocks": [len(directory)]})

    return run


@dataclass(frozen=True)
class CaptureIndex:
    """Archives and their index in a folder: the files of blocks, in order, with their first and last keys, FILES of them at most;
    and in how many tasks the archives are read."""

    folder: str
    tasks: int
    files: tuple[str, ...]
    firsts: tuple[str, ...]
    lasts: tuple[str, ...]

    def blocks(self, keys: DataFrame) -> DataFrame:
        """(key, file, offset, length): the blocks that may hold each of keys (key), found in the directories."""
        index = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, at = located(index.folder)
            name, directory, starts = None, [], []
            for pdf in batches:
                found = []
                for key in pdf["key"]:
                    for i in range(bisect_left(index.lasts, key), bisect_right(index.firsts, key)):
                        if index.files[i] != name:
                            name = index.files[i]
                            with files.open_input_file(f"{at}/{name}.directory") as f:
                                directory = json.loads(f.read())
                            starts = [d[0] for d in directory]
                        # the block before the first one that starts with the key may end with it
                        for _, offset, length, _ in directory[max(0, bisect_left(starts, key) - 1) : bisect_right(starts, key)]:
                            found.append((key, name, offset, length))
                yield pd.DataFrame(found, columns=["key", "file", "offset", "length"])

        return keys.mapInPandas(run, "key string, file string, offset long, length long")

    def captures(self, keys: DataFrame) -> DataFrame:
        """(key, page_id, file, offset, length, type) of all captures of each of keys (key), different ones."""
        index = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, at = located(index.folder)
            for (name, offset), g in key_runs(batches, ["file", "offset"]):
                with files.open_input_file(f"{at}/{name}") as f:
                    f.seek(int(offset))
                    lines = zlib.decompress(f.read(int(g["length"][0]))).decode("utf-8", "surrogatepass").split("\n")
                own, found = [x.split(" ", 1)[0] for x in lines], []
                for key in g["key"]:
                    found += [(key, *json.loads(x.split(" ", 1)[1])) for x in lines[bisect_left(own, key) : bisect_right(own, key)]]
                yield pd.DataFrame(found, columns=["key", *_LINE]).astype({"page_id": "Int64"})

        met = self.blocks(keys.repartition("key").sortWithinPartitions("key"))
        return met.repartition(self.tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(run, _CAPTURE)

    def read(self, captures: DataFrame) -> DataFrame:
        """The records of captures (file, offset, length), each by its own range: page_id, url, date, record_type, payload_bytes,
        payload_digest, refers_to, payload (null for revisits), intact."""
        index = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, at = located(index.folder)
            for (name,), g in key_runs(batches, ["file"]):
                with files.open_input_file(f"{at}/{name}") as f:
                    rows, held = [], 0
                    for data in ranges(f, zip(g["offset"].tolist(), g["length"].tolist(), strict=True)):
                        rows.append(parse(gzip.decompress(data)))
                        held += len(rows[-1]["payload"] or b"")
                        if held > 16 << 20 or len(rows) >= 4096:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

        near = captures.select("file", "offset", "length").repartition(self.tasks, "file", F.floor(F.col("offset") / READ))
        return near.sortWithinPartitions("file", "offset").mapInPandas(run, _RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})


def write_archives(pages: DataFrame, date: str | None = None, least: int = LEAST) -> CaptureIndex:
    """Archives and index of pages (page_id, url, html; date: the column of their time of capture, WARC's or any text without breaks).

    A payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least `least` bytes the one with the smallest
    page_id is a response and the others revisit it; rows that repeat its page_id are responses too. A null page_id comes after all others and
    is never revisited. Null and odd urls have the empty or their own text as key; a long html is a record like any other. Other
    columns are ignored. An empty table gives an index without files.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    when = F.lit(DATE) if date is None else F.coalesce(F.col(date).cast("string"), F.lit(DATE))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.regexp_replace(when, r"[\x00-\x1f]", " ").alias("date"), surt(F.col("url")).alias("key"))
    scratch.folder("archives")
    captures = scratch.save(_typed(rows, scratch, least).mapInArrow(_archived(f"{scratch.root}/archives"), _CAPTURE), "captures")
    return build_index(spark, captures, f"{scratch.root}/archives", scratch)


def build_index(spark: SparkSession, captures: DataFrame, folder: str, scratch: Scratch) -> CaptureIndex:
    """Sort captures into files of blocks beside the archives."""
    size = captures.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    n = size["n"]
    if not n:
        return CaptureIndex(folder, 1, (), (), ())
    parts = min(max(-(-n // FILE_ROWS), min(-(-n // LINES), 32)), FILES)
    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # a row a file, and all of them cross the driver: FILES, or as many as Spark makes of parts
    made = scratch.save(ranged.mapInPandas(_indexed(folder), "file string, first string, last string, blocks int"), "files").collect()
    made.sort(key=lambda r: (r["first"], r["last"]))
    return CaptureIndex(folder, max(min(-(-n // LINES), 32), -(-size["bytes"] // (4 * READ))), *(tuple(r[c] for r in made) for c in ("file", "first", "last")))


def archive_and_read(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages, then look up the captures of all their urls in the index and read each one's record back."""
    index = write_archives(pages, least=least)
    keys = pages.select(surt(F.col("url")).alias("key")).distinct()
    return index.read(index.captures(keys))
