"""WARC archives: a writer, and a reader that salvages damaged ones.

Writing. Each page becomes one record, compressed as a gzip member of its own
before anything is shuffled. Of pages with equal payloads the one with the
largest id is a ``response``; the others are ``revisit`` records that refer to
it. Tasks gather members into archives of about ``archive_bytes`` and Spark's
text sink commits each as a file (one row a file, which also works where the
folder is in a remote store); the sink ends a file with one zero byte, padding
that gzip readers ignore.

Reading. Archives are read whole, as they are bounded. A member is taken only
if it decompresses with a good checksum and its record has a version line,
headers, the stated length and matching digests. Where a check fails, the
reader searches byte by byte for the next member or version line that passes
all of them, goes on there, and logs the bytes between as a quarantined gap.
In a member that is damaged, or holds a bad record among several, the search
goes on within what could be inflated: records there whose own digests match
are recovered, and gaps are logged by their place in the content. The log of
gaps is written as JSON beside the archives on demand.
Records that aren't compressed are read alike; their headers have no checksum
in this format, so damage there shows only where it breaks syntax, the length
or a digest.

Defined cases: a null html is an empty payload; equal rows with the largest
id are all responses; a null page id counts as smallest and stays null; line
breaks in an url become spaces and a null url is left out; a very long html is
one record, in an archive of its own size; other columns aren't read, whatever
their names; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, shared_folder, stored

ARCHIVE_BYTES = 16 << 20
_STEP = 1 << 14
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, uri string, path string, offset long, length long, inner long, reason string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(kind: str, page: int | None, uri: str | None, payload: bytes | None, payload_digest: str, payload_bytes: int, refers_to: int | None, date: str) -> bytes:
    """The bytes of one uncompressed record. A revisit has HTTP headers only."""
    block = _HTTP % payload_bytes + (payload or b"")
    headers = {"WARC-Type": kind, "WARC-Record-ID": _name(page), "WARC-Date": date}
    if uri is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", uri)
    if kind == "revisit":
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _name(refers_to)}
    headers |= {
        "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Payload-Length": str(payload_bytes),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


# Reading


def parse_record(data, at: int = 0, *, proven: bool = False) -> tuple[dict, int]:
    """The headers and checked payload facts of the record at ``at``, and its end. ValueError where a check fails.

    ``proven`` records must bring a digest of their block or payload.
    """
    if not (line := _LINE.match(data, at)):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", line.end())
    if stop < 0:
        raise ValueError("headers don't end")
    headers = {}
    for text in bytes(data[line.end() : stop]).split(b"\r\n"):
        key, colon, value = text.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("no length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length doesn't fit")
    block = bytes(data[begin:end])
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    kind = headers.get("warc-type", "")
    if proven and not ("warc-block-digest" in headers or kind == "response" and "warc-payload-digest" in headers):
        raise ValueError("no digest")
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = int(headers["payload-length"]) if headers.get("payload-length", "").isdecimal() else None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if said not in (None, digest(payload)):
            raise ValueError("payload digest differs")
        said, size = digest(payload), len(payload)
    out = {"page_id": _page(headers.get("warc-record-id")), "record_type": kind, "payload_bytes": size, "payload_digest": said, "refers_to": _page(headers.get("warc-refers-to")), "uri": headers.get("warc-target-uri")}
    return out, end + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int | None, str]:
    """One member's content as far as it goes, and its end or what is wrong."""
    press, out, pos = zlib.decompressobj(31), [], at
    while not press.eof:
        part = data[pos : pos + _STEP]
        if not part:
            return b"".join(out), None, "member is cut off"
        try:
            out.append(press.decompress(part))
        except zlib.error as e:
            return b"".join(out) + _last(data, pos, press_from=at), None, f"bad member: {e}"
        pos += len(part)
    return b"".join(out), pos - len(press.unused_data), ""


def _last(data: memoryview, pos: int, *, press_from: int) -> bytes:
    """What of a bad step can still be inflated, byte by byte."""
    press, at, out = zlib.decompressobj(31), press_from, []
    while at < pos:
        press.decompress(data[at : min(at + _STEP, pos)])
        at += _STEP
    try:
        for i in range(pos, min(pos + _STEP, len(data))):
            out.append(press.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _within(content: bytes, *, proven: bool) -> tuple[list[dict], list[dict], str]:
    """The records and gaps of a member's content, by ``inner`` place, and what was wrong first."""
    found, gaps, at, reason = [], [], 0, ""
    while at < len(content):
        try:
            facts, end = parse_record(content, at, proven=proven)
        except ValueError as e:
            reason = reason or str(e)
            following = _LINE.search(content, at + 1)
            end = following.start() if following else len(content)
            if gaps and gaps[-1]["inner"] + gaps[-1]["length"] == at:
                gaps[-1]["length"] += end - at
            else:
                gaps.append({"record_type": "gap", "inner": at, "length": end - at, "reason": str(e)})
        else:
            found.append(facts | {"inner": at})
        at = end
    return found, gaps, reason


def salvage(data: bytes) -> Iterator[dict]:
    """Records (with offset and length) and gaps (record_type ``gap`` with a reason) of an archive."""
    view, at, lost, why = memoryview(data), 0, None, ""
    while at < len(data):
        if lost is None and data[at] == 0:  # padding
            at += 1
            continue
        found, gaps, end, reason = [], [], None, ""
        if data.startswith(b"\x1f\x8b\x08", at):
            content, end, reason = _inflate(view, at)
            found, gaps, wrong = _within(content, proven=end is None)
            reason = reason or wrong or "empty member"
        else:
            try:
                facts, end = parse_record(data, at)
                found = [facts]
            except ValueError as e:
                reason = str(e)
        if found and end is not None:
            if lost is not None:
                yield {"record_type": "gap", "offset": lost, "length": at - lost, "reason": why}
                lost = None
            for facts in [*found, *gaps]:
                yield {"length": end - at} | facts | {"offset": at}
            at = end
            continue
        if lost is None:
            lost, why = at, reason
        # Of a damaged member's content, what its own digests prove.
        yield from ({"length": len(content) - x["inner"]} | x | {"offset": at} for x in found)
        following = _START.search(data, at + 1)
        at = following.start() if following else len(data)
    if lost is not None:
        yield {"record_type": "gap", "offset": lost, "length": len(data) - lost, "reason": why}


def read_archives(spark: SparkSession, path: str, *, log: str | None = None) -> DataFrame:
    """All records and gaps of the archives in a folder. The gaps are also written to the folder ``log``, if given."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def make():
        def handle(batch: pa.RecordBatch) -> dict:
            rows = [r | {"path": p.as_py()} for p, c in zip(batch.column("path"), batch.column("content"), strict=True) for r in salvage(c.as_py())]
            return {n: [r.get(n) for r in rows] for n in names}

        return handle

    found = map_batches(files, make, _RECORDS)
    if log is None:
        return found
    found = stored(found, "records")
    found.where("record_type = 'gap'").select("path", "offset", "inner", "length", "reason").write.json(log)
    return found


# Writing


def _members(date: str):
    """Digest, size and compressed response of each page."""

    def make():
        def handle(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"page_id": batch.column("page_id").to_pylist(), "url": batch.column("url").to_pylist(), "digest": [], "size": [], "member": []}
            for page, url, html in zip(out["page_id"], out["url"], batch.column("html").cast(pa.binary()).to_pylist(), strict=True):
                payload = html or b""
                said = digest(payload)
                out["digest"].append(said)
                out["size"].append(len(payload))
                out["member"].append(member(record("response", page, url, payload, said, len(payload), None, date)))
            return out

        return handle

    return make


def _archives(date: str, archive_bytes: int):
    def make():
        held: list[bytes] = []

        def handle(batch: pa.RecordBatch):
            done = []
            for r in batch.to_pylist():
                if r["first"]:
                    held.append(r["member"])
                else:
                    held.append(member(record("revisit", r["page_id"], r["url"], None, r["digest"], r["size"], r["largest"], date)))
                if sum(map(len, held[-1:])) + handle.size >= archive_bytes:
                    done.append(b"".join(held))
                    held.clear()
                    handle.size = 0
                else:
                    handle.size += len(held[-1])
            return {"archive": done} if done else None

        def finish():
            if held:
                yield {"archive": [b"".join(held)]}

        handle.size, handle.finish = 0, finish
        return handle

    return make


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per page; payloads below ``min_revisit_bytes`` are all responses."""
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    made = map_batches(chosen, _members(date), "page_id long, url string, digest string, size long, member binary")
    # The same key is made on the JVM for the aggregate, so that pages are compressed once.
    hashed = chosen.select(F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("sha"), "page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    shared = hashed.groupBy("sha").agg(F.max("page_id").alias("largest"), F.max("n").alias("n"), F.count("*").alias("rows")).where(F.col("rows") > 1)
    shared = shared.where(F.col("n") >= min_revisit_bytes).select(_base32(F.col("sha")).alias("digest"), "largest", F.lit(True).alias("shared"))
    dealt = made.join(shared, "digest", "left")
    first = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("largest"))
    kept = dealt.select("page_id", "url", "digest", "size", "largest", first.alias("first"), F.when(first, F.col("member")).alias("member"))
    files = map_batches(kept, _archives(date, archive_bytes), "archive binary")
    files.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _base32(sha: F.Column) -> F.Column:
    """Upper-case base32 of 20 bytes."""
    digits = F.hex(sha)
    fives = [F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 10).cast("long") for i in range(8)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, (F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for v in fives for s in (15, 10, 5, 0)])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    found = read_archives(spark, path, log=f"{path}-quarantine")
    return found.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS largest FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM p JOIN g USING (h)
"""
