"""Operator 8: WARC records in ZIP packages, read by range without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import shared_folder, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_ARCHIVE, _INDEXES = re.compile(r"archive/.+\.warc(\.gz)?"), re.compile(r"indexes/.+\.cdxj?(\.gz)?")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; any store that Arrow knows will do."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


# ---- ZIP directories


@dataclass
class Member:
    """A stored member: where its bytes begin in the package, and how many there are."""

    name: str
    start: int
    size: int


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Replace the fields of the directory that are all ones by those of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            body, k = extra[at + 4 : at + 4 + size], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[i], k = struct.unpack_from("<Q", body, k)[0], k + 8
        at += 4 + size
    return values


def members(file) -> dict[str, Member]:
    """Stored members of a package by name, from its central directory (ZIP64 where it has one); ``file`` can seek.

    Compressed members are left out; where they are archives or their indexes, that is an error.
    """
    length = file.size()
    tail_at = max(0, length - 65557)  # the end record and the longest comment
    tail = file.read_at(length - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", tail, locator + 8)[0]
        count, size, start = struct.unpack_from("<QQQ", file.read_at(56, at), 32)
    directory, at, out = file.read_at(size, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, offset = _wide(extra, [plain, packed, offset])
        if method == 0:  # others cannot be read by range
            n_name_here, n_extra_here = struct.unpack_from("<HH", file.read_at(30, offset), 26)
            out[name] = Member(name, offset + 30 + n_name_here + n_extra_here, plain)
        elif _ARCHIVE.fullmatch(name) or _INDEXES.fullmatch(name):
            raise ValueError(f"{name} is compressed in its package and cannot be read by range")
        at += 46 + n_name + n_extra + n_comment
    return out


# ---- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: the page's response, or a revisit that holds the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:  # line ends and other controls would end the header
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~' + chr(39))}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return head + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers of a record by lower-case name, and under ``block`` its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in lines))
    out["block"] = rest[: int(out["content-length"])]
    return out


def page_of(record_id: str) -> int | None:
    """The page that a record's id names; other writers' ids name none."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id)
    return int(found[1]) if found else None


# ---- writing and reading on Spark


class Package:
    """A package under construction: gzipped records in one stored member, then an index (offset, length) in another."""

    def __init__(self, uri: str):
        self.uri = uri
        store, path = opened(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        body = pack.compress(raw) + pack.flush()
        self.data.write(body)
        self.index.append(f"{self.size} {len(body)}\n")
        self.size += len(body)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.file.close()
        return self.uri, len(self.index), self.size


def write_packages(pages: DataFrame, folder: str, target_bytes: int = 64 << 20, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of (page_id, url, html) into ZIP packages; returns their list (path, records, bytes).

    Of the rows with equal payloads of at least ``min_bytes``, those with the largest page_id are responses and the
    others revisit them; all other rows are responses.  The payload is the html in UTF-8; null is empty.  A null
    page_id never is the largest unless all are null, and then all are responses.  A null url is left out.
    Every task writes packages of its own under new names, and the stored list holds those of the tasks that
    succeeded, so that a task that runs again does no harm.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    several = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha")
    several = several.agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stored(several.select(F.col("sha").alias("of"), "last"), "payloads")
    rows = rows.join(several, F.col("sha") == F.col("of"), "left")
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("last").cast("string"))
    schema = "path string, records long, bytes long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package, done = None, []
        for frame in frames:
            for page, url, html, last in zip(*(frame[c].tolist() for c in frame), strict=True):
                page, last = page and int(page), last and int(last)
                if package is None:
                    package = Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(record(page, url, html.encode(), last, last is not None and page != last))
                if package.size >= target_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return stored(rows.mapInPandas(run, schema), "packages")


def indexed(file) -> list[tuple[Member, list[tuple[int, int]]]]:
    """Each archive of a package with the places (offset, length) of its records, in order, from all indexes.

    Index lines are this writer's, of ``DATA``, or CDXJ lines, which name their file.  An index line that names no
    place, or a file that is not there, and an archive that no line names are errors.
    """
    found = members(file)
    places: dict[str, set[tuple[int, int]]] = {name: set() for name in found if _ARCHIVE.fullmatch(name)}
    for name in filter(_INDEXES.fullmatch, found):
        raw = file.read_at(found[name].size, found[name].start)
        for line in (zlib.decompress(raw, 31) if name.endswith(".gz") else raw).decode().splitlines():
            if own := re.fullmatch(r"(\d+) (\d+)", line):
                of, at = DATA, (int(own[1]), int(own[2]))
            elif line.startswith("!") or not line.strip():  # CDXJ headers
                continue
            elif "{" in line:
                told = json.loads(line[line.index("{") :])
                of, at = "archive/" + told["filename"].removeprefix("archive/"), (int(told["offset"]), int(told["length"]))
            else:
                raise ValueError(f"unknown line in {name}")
            if of not in places:
                raise ValueError(f"{name} names {of}, which is not in the package")
            places[of].add(at)
    for name, at in places.items():
        if found[name].size and not at:
            raise ValueError(f"no index of {name}")
    return [(found[name], sorted(at)) for name, at in places.items()]


def read_ranges(packages: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """Ranges (path, start, lengths of the records in it) of about ``range_bytes`` that cover all indexed records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uri in frame["path"]:
                store, path = opened(uri)
                with store.open_input_file(path) as file:
                    archives = indexed(file)
                for data, places in archives:
                    start, lengths, size = data.start, [], 0
                    for offset, length in places:
                        # A range has no gaps: other writers do not index every record.
                        if lengths and (size + length > range_bytes or start + size != data.start + offset):
                            out.append((uri, start, lengths))
                            lengths, size = [], 0
                        if not lengths:
                            start = data.start + offset
                        lengths.append(length)
                        size += length
                    if lengths:
                        out.append((uri, start, lengths))
            yield pd.DataFrame(out, columns=["path", "start", "lengths"])

    return packages.select("path").mapInPandas(run, "path string, start long, lengths array<long>")


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the packages: (page_id, payload_bytes, payload_digest, record_type, refers_to), payload if asked for.

    Directories and indexes are read first; then every range of records is one read of the package, on any executor.
    A revisit's payload is empty here; its length and digest are those of the full payload.  A response whose payload
    does not have the digest it claims is an error.
    """
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, start, lengths in zip(frame["path"], frame["start"], frame["lengths"], strict=True):
                store, path = opened(uri)
                with store.open_input_file(path) as file:
                    raw = file.read_at(int(sum(lengths)), int(start))
                at, out = 0, []
                for length in map(int, lengths):
                    one = raw[at : at + length]
                    r = parse_record(zlib.decompress(one, 31) if one[:2] == b"\x1f\x8b" else one)
                    at += length
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
                    claimed = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] == "response" and digest(payload) != claimed:
                        raise ValueError(f"damaged payload in {uri}")
                    refers = r.get("warc-refers-to")
                    row = (page_of(r["warc-record-id"]), size, claimed, r["warc-type"], refers and page_of(refers))
                    out.append((*row, payload) if with_payload else row)
                result = pd.DataFrame(out, columns=names + ["payload"] * with_payload)
                for c in ("page_id", "refers_to"):
                    result[c] = pd.array(result[c], dtype="Int64")
                yield result

    n = packages.sparkSession.sparkContext.defaultParallelism
    ranges = read_ranges(packages).repartition(4 * n)
    return ranges.mapInPandas(run, fields + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' records to packages in the shared folder and read them back; a row for each row."""
    folder = f"{shared_folder(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    return read_packages(write_packages(pages, folder))
