"""WARC archives whose repeated payloads are revisit records.

Only headers (digest, id, size) are grouped by payload digest; one record of each group
is the response and the others become revisits that refer to it. Archives are written
by Spark's own file writer, so lost executors and repeated tasks leave no half files,
and read back record by record in a stream.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import attach
from burnish.session import checkpointed

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: The record's date; a crawl would give each its own.
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """The base32 form of a 40-digit hexadecimal digest, 20 bits at a time."""
    out = []
    for chunk in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * chunk + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def record_id(page_id: Column, digest: Column) -> Column:
    """A URN that depends on the page's id and payload alone."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_text(value: Column) -> Column:
    """A header value on one line: control characters and spaces percent-encoded."""
    safe = value
    for code in (*range(33), 127):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return safe


def headers(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    raw = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sized = raw.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("_hex", F.sha1(F.encode("payload", "UTF-8")))
    return sized.withColumn("digest", base32(F.col("_hex"))).drop("_hex")


def write_archives(
    pages: DataFrame,
    folder: str,
    min_payload: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    records_per_file: int = 20_000,
    compression: str = "gzip",
) -> None:
    """Write a record per row: a response, or a revisit of the response with an equal payload.

    Of the rows with equal payloads of ``min_payload`` bytes or more, that with the
    largest id is the response; smaller payloads are all responses. Null payloads are
    empty. Null ids come before all others and are written without the id field; null
    urls without a target URI. Rows that share their payload's largest id are all
    responses. Extra columns are ignored; an empty table writes no record. A file holds
    at most ``records_per_file`` records.
    """
    rows = headers(pages, id_col, url_col, payload_col)
    # payloads stay behind: digest, id, size and url alone are grouped and shuffled
    heads = rows.filter(F.col("payload_bytes") >= min_payload).select("digest", "page_id", "url")
    groups = heads.groupBy("digest").agg(
        F.count("*").alias("n"), F.max("page_id").alias("keeper"), F.max_by("url", F.struct("page_id", "url")).alias("keeper_url")
    )
    groups = checkpointed(groups.filter("n > 1"), "digests")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    chosen = attach(rows, groups, "digest", "n", total, "left")
    revisit = F.coalesce((F.col("payload_bytes") >= min_payload) & ~F.col("keeper").eqNullSafe(F.col("page_id")) & F.col("n").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "payload_bytes", F.lit(END))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    only = lambda value: F.when(revisit, value)
    record = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        field("WARC-Target-URI", header_text(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Profile", only(F.lit(PROFILE))),
        field("WARC-Refers-To", only(record_id(F.col("keeper"), F.col("digest")))),
        field("WARC-Refers-To-Target-URI", only(header_text(F.col("keeper_url")))),
        field("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes")),
        F.lit(END),
        http,
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    writer = chosen.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(folder)


def _chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a plain or gzip file, piece by piece; gzip members may follow each other."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view = memoryview(data)
    while len(view):
        member = zlib.decompressobj(31)
        while not member.eof and len(view):
            yield member.decompress(view[:size])
            view = view[size:]
        rest = member.unused_data
        if rest:
            view = memoryview(rest + bytes(view))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a file."""
    pieces, held = _chunks(data), b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        if piece is None:
            return False
        held += piece
        return True

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        if not cut:  # the blank lines after a record
            held = held[4:]
            continue
        lines = held[:cut].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        size = int(fields["content-length"])
        parts, have = [held[cut + 4 :]], len(held) - cut - 4
        while have < size:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("an archive ends inside a record")
            parts.append(piece)
            have += len(piece)
        rest = b"".join(parts)
        yield fields, rest[:size]
        held = rest[size:]


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record: record_id, record_type, url, page_id, digest, payload_bytes, refers_to_record.

    payload_bytes and digest of a response are taken from its payload anew, and a digest
    that differs from the header's raises; a revisit has its header's digest and no size
    yet. ``with_payload`` adds the response's payload. Folders without a record give an
    empty table.
    """
    schema = "record_id string, record_type string, url string, page_id bigint, digest string, payload_bytes bigint, refers_to_record string"
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for fields, block in records(content):
                    page = fields.get("x-page-id")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    row = [fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), int(page) if page else None]
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest and found != digest:
                            raise ValueError(f"the payload of {row[0]} does not have its digest")
                        row += [found, len(payload), None]
                    else:
                        payload = None
                        row += [digest, None, fields.get("warc-refers-to")]
                    out.append((*row, payload) if with_payload else tuple(row))
                    held += len(payload or b"") if with_payload else 1
                    if held >= (4 << 20 if with_payload else 4096):
                        yield frame(out)
                        out, held = [], 0
                if out:
                    yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=[*names, "payload"] if with_payload else names)
        return f.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInPandas(parse, schema + (", payload binary" if with_payload else ""))


def resolve_revisits(found: DataFrame) -> DataFrame:
    """The records, revisits joined to their originals: refers_to and the payload's size.

    Archives are parsed once and their records written, as they are looked at several
    times. Headers are shuffled by payload digest. ``refers_to`` is the original's page
    id, null for responses. A revisit without an original in the archives keeps null in both.
    """
    found = checkpointed(found, "records")
    originals = found.filter("record_type = 'response'").select("digest", "record_id", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    asked = found.filter("record_type = 'revisit'")
    per_digest = asked.groupBy("digest").agg(F.count("*").alias("_n"), F.first("refers_to_record").alias("_record"))
    per_digest = checkpointed(
        per_digest.join(originals, (per_digest["digest"] == originals["digest"]) & (per_digest["_record"] == originals["record_id"]), "left")
        .groupBy(per_digest["digest"], "_n")
        .agg(F.max("refers_to").alias("refers_to"), F.max("_bytes").alias("_bytes")),
        "originals",
    )
    total = per_digest.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    joined = attach(asked, per_digest, "digest", "_n", total, "left")
    joined = joined.withColumn("payload_bytes", F.col("_bytes")).select(*found.columns, "refers_to")
    same = found.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return same.unionByName(joined)


def rewrite_archives(spark: SparkSession, source: str, folder: str, min_payload: int = 0) -> None:
    """Read archives, find revisits anew over all of them and write them with fresh headers.

    Payloads of earlier revisits come from their originals; payloads must be UTF-8.
    """
    found = checkpointed(read_archives(spark, source, with_payload=True), "records")
    original = found.filter("record_type = 'response'").groupBy("digest").agg(F.first("payload").alias("_payload"))
    revisits = found.filter("record_type = 'revisit'")
    n = revisits.groupBy("digest").agg(F.count("*").alias("_n"))
    whole = attach(revisits.drop("payload"), original.join(n, "digest"), "digest", "_n", revisits.count())
    both = found.filter("record_type = 'response'").select("page_id", "url", "payload").unionByName(
        whole.select("page_id", "url", F.col("_payload").alias("payload"))
    )
    write_archives(both.withColumn("payload", F.decode("payload", "UTF-8")), folder, min_payload, "page_id", "url", "payload")
