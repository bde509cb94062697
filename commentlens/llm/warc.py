"""WARC archives of captures: written by Spark's text writer, read back in splits, and put together again by record ids.

A capture is a request, a response (or, for a payload that another capture has, a revisit) and a metadata record, tied by WARC-Concurrent-To.
A record ends with two line ends, which is the line separator that the writer is given. The reader is given the beginning of a version line,
``WARC/1.``, as separator, so that large archives are read by many tasks; a payload that holds this text is found by its
Content-Length, and only then is its file read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.llm.common import settle

LINE = "\r\n"
END = LINE * 2
SEPARATOR = "WARC/1."
#: Captures in one file, at most; files that must be read whole stay readable.
CAPTURES_PER_FILE = 20_000
#: Records of one Arrow batch.
ROWS = 256
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of numbers in base 32, and those of RFC 4648.
_DIGITS, _RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = (
    "id string, type string, url string, concurrent_to array<string>, refers_to string, digest string, "
    "payload_bytes bigint, headers string, fields map<string,string>, payload binary, intact boolean"
)


def payload_digest(payload: Column) -> Column:
    """SHA-1 as WARC spells it, in upper-case base 32: every five hexadecimal digits are four of these."""
    sha = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), _DIGITS, _RFC_DIGITS)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def _name(*key: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in key]))


def _record_id(kind: str, *key: Column) -> Column:
    x = _name(F.lit(kind), *key)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, record_id: Column, content_type: Column | str, block: Column, **headers: Column | str) -> Column:
    """A record without its end; headers whose value is null are left out."""
    named = {"WARC-Type": kind, "WARC-Record-ID": record_id} | {k.replace("_", "-"): v for k, v in headers.items()} | {"Content-Type": content_type}
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in named.items()]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(LINE, F.lit("WARC/1.1"), *lines, length), F.lit(END), block)


def plan_captures(pages: DataFrame, key: str, url: str, payload: str, min_revisit_bytes: int = 0) -> DataFrame:
    """key, url, copy, payload (null for revisits), payload_bytes, digest, is_revisit, keeper, keeper_url: a row for every page.

    Of pages with equal payloads of ``min_revisit_bytes`` or more, the one with the largest key (then url; null is least) is the response.
    Rows equal in all three are numbered copies; the first is the response. Only responses carry their payload through a
    shuffle, where equal rows have become one before.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    named = rows.withColumn("digest", payload_digest(F.col("payload").cast("binary"))).withColumn("name", _name(*map(F.col, ("key", "url", "digest"))))
    counted = settle(
        named.groupBy("name", "key", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")).agg(F.count("*").alias("copies"))
    )
    keepers = counted.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max(F.struct("key", "url")).alias("keeper"))
    judged = counted.join(keepers, "digest", "left").select(
        *counted.columns, F.col("keeper.key").alias("keeper"), F.col("keeper.url").alias("keeper_url"), F.col("keeper").isNull().alias("alone")
    )
    kept = F.col("alone") | (F.col("key").eqNullSafe(F.col("keeper")) & F.col("url").eqNullSafe(F.col("keeper_url")))
    each = judged.withColumn("kept", kept).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = each.withColumn("is_revisit", ~F.col("alone") & ~(F.col("kept") & (F.col("copy") == 1))).drop("copies", "alone", "kept")
    # A payload travels once, to meet its response.
    bodies = named.groupBy("name").agg(F.first("payload").alias("payload"))
    full = each.where("NOT is_revisit").join(bodies, "name")
    return full.unionByName(each.where("is_revisit").withColumn("payload", F.lit(None).cast("string"))).drop("name")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write a request, a response or revisit, and a metadata record for every page, as gzip files of ``CAPTURES_PER_FILE`` captures at most.

    Payloads are UTF-8; null is empty. White space and control characters of URLs become %20; a null URL leaves its header out.
    No pages leave an empty folder. Extra columns are not looked at.
    """
    c = plan_captures(pages, key, url, payload, min_revisit_bytes).withColumn("link", _one_line(F.col("url")))
    me, keeper = (F.col("key"), F.col("url"), F.col("digest"), F.col("copy")), (F.col("keeper"), F.col("keeper_url"), F.col("digest"), F.lit(1))
    main, link, digest = _record_id("capture", *me), F.col("link"), F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    http = "application/http; msgtype="
    host = F.regexp_extract(link, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_replace(link, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    ask = F.concat(F.lit("GET "), F.coalesce(F.when(target != "", target), F.lit("/")), F.lit(" HTTP/1.1" + LINE + "Host: "), F.coalesce(host, F.lit("")), F.lit(END))
    request = _record("request", _record_id("request", *me), http + "request", ask, WARC_Target_URI=link, WARC_Concurrent_To=main)
    response = _record("response", main, http + "response", F.concat(head, F.col("payload")), WARC_Target_URI=link, WARC_Payload_Digest=digest)
    revisit = _record(
        "revisit", main, http + "response", head, WARC_Target_URI=link, WARC_Payload_Digest=digest,
        WARC_Refers_To=_record_id("capture", *keeper), WARC_Profile=REVISIT_PROFILE,
    )
    facts = F.concat(F.lit("capture-key: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(LINE))
    metadata = _record("metadata", _record_id("metadata", *me), "application/warc-fields", facts, WARC_Target_URI=link, WARC_Concurrent_To=main)
    records = F.concat_ws(END, request, F.when(F.col("is_revisit"), revisit).otherwise(response), metadata)
    writer = c.select(records.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", CAPTURES_PER_FILE).mode("errorifexists").text(path)


def _header_fields(lines: bytes) -> list[tuple[str, str]]:
    unfolded = re.sub(rb"\r?\n[ \t]+", b" ", lines)
    pairs = (line.partition(b":") for line in re.split(rb"\r?\n", unfolded) if b":" in line)
    return [(k.strip().decode("utf-8", "replace").lower(), v.strip().decode("utf-8", "replace")) for k, _, v in pairs]


def _parts(data: bytes, start: int) -> tuple[list[tuple[str, str]], int, int] | None:
    """Headers, and where the block begins and ends, of the record whose headers begin at ``start``; None if it isn't all there."""
    gap = re.compile(rb"\r?\n\r?\n").search(data, start)
    if not gap:
        return None
    headers = _header_fields(data[start : gap.start()])
    size = dict(headers).get("content-length", "")
    if not re.fullmatch("[0-9]+", size) or gap.end() + int(size) > len(data):
        return None
    return headers, gap.end(), gap.end() + int(size)


def _parsed(headers: list[tuple[str, str]], block: bytes, with_payload: bool) -> dict:
    named = dict(headers)
    payload, head, fields = block, b"", {}
    kind = named.get("content-type", "").lower()
    if kind.startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        fields = dict(_header_fields(head.partition(b"\r\n")[2]))
    elif kind.startswith("application/warc-fields"):
        fields = dict(_header_fields(block))
    said = named.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = named.get("warc-type") == "revisit"
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    size = fields.get("content-length", "") if revisit else str(len(payload))
    return {
        "id": named.get("warc-record-id"), "type": named.get("warc-type"), "url": named.get("warc-target-uri"),
        "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"], "refers_to": named.get("warc-refers-to"),
        "digest": said if revisit else own, "payload_bytes": int(size) if re.fullmatch("[0-9]{1,18}", size) else None,
        "headers": head.decode("utf-8", "replace"), "fields": list(fields.items()), "payload": payload if with_payload else None,
        "intact": revisit or not said or said == own,
    }


_ARROW = pa.schema([
    ("id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()), ("intact", pa.bool_()),
])


_SPLIT = pa.schema([("file", pa.string()), ("torn", pa.bool_()), *_ARROW])


def _batches(records):
    part = []
    for x in records:
        part.append(x)
        if len(part) == ROWS:
            yield pa.RecordBatch.from_pylist(part, _ARROW)
            part = []
    yield pa.RecordBatch.from_pylist(part, _ARROW)


def _from_piece(piece: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """The record of what lies between two version lines; None if the separator was part of a payload."""
    found = _parts(piece, piece.find(b"\n") + 1) if re.match(rb"[0-9]+\r?\n", piece) else None
    if not found or piece[found[2] :].strip(b"\r\n"):
        return None
    return found[0], piece[found[1] : found[2]]


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    # What stands before the first version line is empty.
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).where("length(piece) > 0")


def _from_splits(spark: SparkSession, path: str | list[str], payload: bool) -> DataFrame:
    """Records of the pieces, with their file; a piece that isn't a whole record leaves its file alone."""

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                found = (_from_piece(x.as_py()) for x in some.column("piece"))
                rows = [{"file": f, "torn": x is None} | (_parsed(*x, payload) if x else {}) for f, x in zip(some.column("file").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, _SPLIT)

    return _pieces(spark, path).mapInArrow(split, f"file string, torn boolean, {RECORD}")


def _torn(found: DataFrame) -> list[str]:
    return sorted(r.file for r in found.where("torn").select("file").distinct().collect())


def torn_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files in which a payload holds the separator, so that splitting at it tears a record. A list of file names, as Spark's driver has."""
    return _torn(_from_splits(spark, path, False))


def read_records(spark: SparkSession, path: str | list[str], payload: bool = True) -> DataFrame:
    """Every record of WARC files, plain or compressed: ids, links, digest and size of the payload, headers and named fields of the block.

    ``payload`` False leaves the payloads themselves out and keeps the rest in the shared folder, so that files are read once; digests and
    sizes are computed from the payloads all the same. ``intact`` is false where a payload is not what its digest says; a revisit has what its
    headers say of it. A file with a record that isn't all there is an error.
    """
    found = _from_splits(spark, path, payload)
    if not payload:
        found = settle(found)
    torn = _torn(found) if not payload else torn_files(spark, path)

    def whole(batches):
        def records(data: bytes):
            at = 0
            while at < len(data):
                version = re.compile(rb"[\r\n]*WARC/1\.[0-9]+\r?\n").match(data, at)
                found = _parts(data, version.end()) if version else None
                if not found:
                    if data[at:].strip(b"\r\n"):
                        raise ValueError("a WARC record is cut off or has no length")
                    return
                yield _parsed(found[0], data[found[1] : found[2]], payload)
                at = found[2]

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                if name.as_py().endswith(".gz"):
                    data = b"".join(_members(data))
                yield from _batches(records(data))

    if not torn:
        return found.drop("file", "torn")
    listed = spark.createDataFrame([(f,) for f in torn], "file string")
    rest = found.join(F.broadcast(listed), "file", "left_anti").drop("file", "torn")
    return rest.unionByName(spark.read.format("binaryFile").load(torn).select("path", "content").mapInArrow(whole, RECORD))


def _members(data: bytes):
    """What the members of a gzip file hold, one after the other."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data)
        if not one.eof:
            raise ValueError("a gzip member is cut off")
        data = one.unused_data


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: id, capture (the response, revisit or other main record), request, metadata (structs; null if there is none).

    Requests and metadata name their capture by concurrent-to, the capture may name them, and they may name each other; links are followed
    until none leads on. Of several records of one kind the one of smallest id stands; ``n_sides`` counts them all. Records that lead to no capture
    make a row of their own, by the id that they name (or their own), with a null capture. Repeated ids are one record. Warcinfo
    records belong to no capture and are left out.
    """
    cells = [c for c in records.columns if c != "id"]
    records = records.where("type IS NULL OR type != 'warcinfo'")
    sides = F.coalesce(F.col("type").isin("request", "metadata"), F.lit(False))
    mains = records.where(~sides).select("id", F.struct("id", *cells).alias("capture"))
    named = records.where(sides).select("id", "type", F.struct("id", *cells).alias("record"), F.explode_outer("concurrent_to").alias("to"))
    backward = records.where(~sides).select(F.explode("concurrent_to").alias("id"), F.col("id").alias("to"))
    is_main = records.where(~sides).select(F.col("id").alias("to"), F.lit(True).alias("main")).distinct()
    # Where each side record leads: straight, by the capture's own links, or through other side records.
    links = named.select("id", "to").where("to IS NOT NULL").unionByName(backward).distinct().join(is_main, "to", "left")
    homes = settle(links.groupBy("id").agg(F.min(F.when(F.col("main"), F.col("to"))).alias("home"), F.min("to").alias("to")))
    while True:
        lost = homes.where("home IS NULL AND to IS NOT NULL")
        if lost.isEmpty():
            break
        through = homes.where("home IS NOT NULL").select(F.col("id").alias("to"), F.col("home").alias("next"))
        moved = settle(lost.join(through, "to").select("id", F.col("next").alias("home"), "to"))
        if moved.isEmpty():
            break
        homes = settle(homes.join(moved.select("id", F.col("home").alias("late")), "id", "left").select("id", F.coalesce("home", "late").alias("home"), "to"))
    placed = records.where(sides).select("id", "type", F.struct("id", *cells).alias("record")).join(homes, "id", "left")
    home = F.coalesce("home", "to", "id").alias("home")

    def first(kind: str) -> Column:
        return F.min_by(F.when(F.col("type") == kind, F.col("record")), F.when(F.col("type") == kind, F.col("id"))).alias(kind)

    together = placed.groupBy(home).agg(first("request"), first("metadata"), F.count("*").alias("n_sides"))
    once = mains.groupBy("id").agg(F.first("capture").alias("capture"))
    return once.join(together, F.col("id") == F.col("home"), "full_outer").select(F.coalesce("id", "home").alias("id"), "capture", "request", "metadata", F.coalesce("n_sides", F.lit(0)).alias("n_sides"))
