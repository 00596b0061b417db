"""WARC archives: writing, normalising whole-file gzip, and reading by offset.

``write_archives`` turns pages into WARC records with Spark's text writer: the record separator
is the line separator, and gzip over a whole file is what Spark's codec makes. Of pages with
equal payloads the one with the smallest id is a response, the others are revisits of it.

``normalise`` takes such archives, one gzip stream over a whole file, which nobody can read but
from the start. Each is inflated once, in pieces; every record is written again as a gzip member
of its own, with a sidecar index of offsets. Members are written as they are met, so memory is
bounded by the longest record. ``read_archives`` opens normalised archives by that index and
inflates single members.

Digests are bare upper-case base32 SHA-1 of the payload. Rows of one payload are told apart from
others by digest and length; the smallest id is found by an aggregation that combines within
tasks, and the join back to the pages is one that adaptive execution splits where a payload is
hot.

Defined cases: a null page is an empty payload; payloads shorter than ``least_revisit`` bytes are
responses all; of rows that repeat id and payload all are responses; a row with a null id never
is the smallest while another has one; a null address is written as ``urn:page:<id>``, line ends
in it are escaped; an empty table makes no archive and an empty result; further columns play no
part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilscan.llm import files
from veilscan.llm.inputs import shuffle_partitions, utf8
from veilscan.session import materialise

CUT = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_NAME = "urn:page:"
RECORDS_PER_ARCHIVE = 20_000
PIECE = 1 << 20

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """160 bits as eight groups of four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), _CONV_32, _BASE32)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> DataFrame:
    """page_id, url, payload (string), n_bytes, digest, first_id (of the response)."""
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        html.alias("payload"), F.octet_length(html).cast("long").alias("n_bytes"),
        sha1_base32(utf8(html)).alias("digest"),
    )
    first = rows.groupBy("digest", "n_bytes").agg(F.min("page_id").alias("first_id"))
    joined = rows.join(first, ["digest", "n_bytes"])
    own = (F.col("n_bytes") < least_revisit) | F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("first_id", F.when(own, F.col("page_id")).otherwise(F.col("first_id"))).withColumn("response", own)


def _name(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{PAGE_NAME}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, folder: str, date: str = DATE, per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Writes ``folder``/part-*.txt.gz, each one gzip stream over a WARC file."""
    address = F.regexp_replace(
        F.regexp_replace(F.coalesce("url", F.concat(F.lit(PAGE_NAME), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), "\r", "%0D"),
        "\n", "%0A",
    )
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"), F.lit(CUT),
    )
    block = F.when(F.col("response"), F.concat(answer, "payload")).otherwise(answer)
    kind = F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))
    refers = F.when(F.col("response"), F.lit("")).otherwise(
        F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first_id")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    )
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), address, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"), F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(CUT), block,
    )
    (
        records.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", CUT)
        .option("maxRecordsPerFile", per_archive).text(folder)
    )


class RecordStream:
    """Cuts an inflated stream into records, piece by piece."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, whole record with its closing blank lines)."""
        while True:
            searched = 0
            while (end := self.held.find(CUT.encode(), searched)) < 0:
                searched = max(0, len(self.held) - 3)
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends within a record")
                    return
            headers = parse_headers(bytes(self.held[:end]))
            size = end + 4 + int(headers["content-length"]) + 4
            while len(self.held) < size:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            yield headers, bytes(self.held[:size])
            del self.held[:size]


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].strip().startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of bounded size."""
    inflate = zlib.decompressobj(31)
    while raw := stream.read(PIECE):
        raw = bytes(raw)
        while raw:
            yield inflate.decompress(raw, 4 * PIECE)
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


_INDEX = "archive string, sidecar string, records long, bytes long"


def normalise(spark, archives: str, folder: str) -> DataFrame:
    """Rewrites every gzip file below ``archives`` into ``folder`` with one member per record and
    a sidecar ``.idx`` of lines "offset length type id". Returns one row per archive."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                archive = files.own_name(folder, "archive", ".warc.gz")
                sidecar, offset, count = archive.replace(".warc.gz", ".idx"), 0, 0
                with files.reader(path) as source, files.writer(archive) as out, files.writer(sidecar) as index:
                    for headers, record in RecordStream(inflated(source)).records():
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        line = f"{offset} {len(member)} {headers['warc-type']} {headers['warc-record-id']}\n"
                        index.write(line.encode())
                        offset += len(member)
                        count += 1
                yield pd.DataFrame({"archive": [archive], "sidecar": [sidecar], "records": [count], "bytes": [offset]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(archives).select("path")
    return materialise(
        found.repartition(shuffle_partitions(found), "path").mapInPandas(rewrite, _INDEX), "warc-archives"
    )


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _id_in(name: str | None) -> int | None:
    digits = (name or "").removeprefix(f"<{PAGE_NAME}").removesuffix(">")
    return int(digits) if digits else None


def read_record(record: bytes) -> tuple:
    """A response's digest and length come from its payload, a revisit's from its headers."""
    head, _, rest = record.partition(CUT.encode())
    headers = parse_headers(head)
    block = rest[: int(headers["content-length"])]
    answer, _, payload = block.partition(CUT.encode())
    kind, refers = headers["warc-type"], None
    if kind == "revisit":
        lengths = [x.split(b":")[1] for x in answer.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, digest = int(lengths[0]), headers["warc-payload-digest"].removeprefix("sha1:")
        refers = _id_in(headers["warc-refers-to"])
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _id_in(headers["warc-record-id"]), size, digest, kind, refers, headers["warc-target-uri"]


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives, each member opened at its offset."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, sidecar in zip(batch["archive"], batch["sidecar"]):
                with files.reader(sidecar) as index:
                    lines = bytes(index.read()).decode().splitlines()
                with files.mapped(archive) as source:
                    for at in range(0, len(lines), 1000):
                        rows = []
                        for line in lines[at : at + 1000]:
                            offset, length = (int(x) for x in line.split(" ", 2)[:2])
                            source.seek(offset)
                            rows.append(read_record(zlib.decompress(source.read(length), 31)))
                        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _PAGES.split(", ")])
                        yield out.assign(
                            page_id=pd.array(out["page_id"], dtype="Int64"),
                            refers_to=pd.array([r[4] for r in rows], dtype="Int64"),
                        )

    return archives.repartition(shuffle_partitions(archives), "archive").mapInPandas(read, _PAGES)
