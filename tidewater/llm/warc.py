"""WARC archives: written as text, read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, forget, save, scratch_path

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of an archive that are searched for records as one range.
RANGE = 1 << 20
#: Records that one archive file holds at most; a file is read as one row.
RECORDS_PER_FILE = 20_000
#: The pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that one archive file holds at most, unless a single record is longer.
BYTES_PER_FILE = 256 << 20
#: Ends a record's own fields, those of its block, and a record.
BLANK = re.compile(rb"\r\n\r\n")


def base32(hex40: Column) -> Column:
    """Bare upper-case base32 of 20 bytes that are given as 40 hex digits."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr(F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, payload_bytes, payload_digest, record_type, refers_to).

    Of the pages with equal payloads of at least ``least_bytes`` bytes that with the
    largest page_id is the response and the others revisit it; smaller ones are
    all responses.  Null payloads are empty; a null page_id is never referred to
    unless all pages of the payload have none, which are responses then.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32(F.sha1("payload"))})
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = rows.join(save(groups.select("payload_digest", "first"), "responses"), "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def record_text() -> Column:
    """A whole record but for its last byte, which is the line end that the text sink adds."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    block = F.octet_length(head) + F.octet_length(body)
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), named("page_id"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("\r\nWARC-Refers-To: "), named("refers_to"), F.lit(f"\r\nWARC-Profile: {REVISIT}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"), head, body, F.lit("\r\n\r"),
    )


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, per_file_bytes: int = BYTES_PER_FILE) -> None:
    """Write planned records as uncompressed WARC files; each task writes its own, by Spark's text sink.

    Records too long for ``per_file`` of them to fit in a file's bytes are written apart, fewer to
    a file, by classes of sizes that are each four times the one before.
    """
    # a revisit's size is taken with its payload, the other fields as 1,000 bytes
    size = F.col("payload_bytes") + F.octet_length(F.coalesce("url", F.lit(""))) + 1000
    kind = F.greatest(F.ceil(F.log2(size * per_file / F.lit(float(per_file_bytes))) / 2), F.lit(0)).cast("int")
    kinds = sorted(r[0] for r in records.select(kind.alias("kind")).distinct().collect()) or [0]
    for k in kinds:
        some = records if len(kinds) == 1 else records.where(kind == k)
        some.select(record_text().alias("value")).write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", max(1, per_file >> 2 * k)).text(path)


def fields_of(raw: memoryview, at: int) -> tuple[dict[str, str], int] | None:
    """The named fields of a record and where its block begins; None if it has no proper fields."""
    found = BLANK.search(raw, at)
    if found is None:
        return None
    lines = bytes(raw[at : found.start()]).decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return (fields, found.end()) if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() else None


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


CANDIDATE = "file string, part long, at long, next long, exit long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, whole boolean"


def candidates(spark: SparkSession, path: str, range_bytes: int = RANGE, with_payload: bool = False) -> DataFrame:
    """Every place in the archives where a record may begin, with what it says of itself.

    Files are searched range by range.  next is where the record's successor
    would begin, exit the first place on its chain that lies beyond its range.
    payload_digest is recomputed from the bytes (for revisits the one they state);
    whole tells whether the bytes agree with the fields.
    """
    arrow_rows(spark, 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CANDIDATE.split(", ")] + ["payload"] * with_payload
        kinds = {"file": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "whole": pa.bool_(), "payload": pa.binary()}
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(raw.as_buffer())
                for lo in range(0, max(1, len(raw)), range_bytes):
                    rows = []
                    for m in MAGIC.finditer(raw[: min(len(raw), lo + range_bytes + 16)], lo):
                        at = m.start()
                        # a record follows another's blank line, so no two candidates search the same bytes for their fields' end
                        if at >= lo + range_bytes or (at and raw[max(0, at - 4) : at] != b"\r\n\r\n") or (got := fields_of(raw, at)) is None:
                            continue
                        fields, block = got
                        end = block + int(fields["content-length"])
                        if end + 4 > len(raw) or raw[end : end + 4] != b"\r\n\r\n":
                            continue
                        http = BLANK.search(raw, block, end)
                        start = http.end() if http else end
                        said = re.search(rb"(?i)content-length: *(\d{1,18})", bytes(raw[block:start]))
                        revisit = fields.get("warc-type") == "revisit"
                        digest = base64.b32encode(hashlib.sha1(raw[start:end]).digest()).decode()
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append([
                            file, lo // range_bytes, at, end + 4, end + 4, page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"),
                            page_of(fields.get("warc-refers-to")), int(said[1]) if said and revisit else end - start, stated if revisit else digest, revisit or stated == digest,
                            *([bytes(raw[start:end])] if with_payload else []),
                        ])
                    exits: dict[int, int] = {}
                    for r in reversed(rows):
                        r[4] = exits[r[2]] = exits.get(r[3], r[3]) if r[3] < lo + range_bytes else r[3]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(each, CANDIDATE + ", payload binary" * with_payload)


def reachable(found: DataFrame, most_rounds: int = 40) -> DataFrame:
    """The places (file, at) that chains from the files' starts enter ranges at, by pointer jumping.

    Jumps start as the exits of all candidates; each round follows the jumps from all
    places reached and then doubles them, so rounds grow as the logarithm of the ranges of a file.
    """
    jumps = found.select("file", "at", F.col("exit").alias("to"))
    reached = save(found.where("at = 0").select("file", "at"), "reached")
    size = reached.count()
    for _ in range(most_rounds):
        grown = save(reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached")
        then = grown.count()
        forget(reached)
        reached = grown
        if then == size:
            return reached
        size = then
        ends = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = save(jumps.join(ends, ["file", "to"]).select("file", "at", F.col("further").alias("to")), "jumps")
    raise RuntimeError("chains are longer than allowed")


def follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one range that the chain from its entry passes."""
    step = dict(zip(pdf["at"], pdf["next"], strict=True))
    seen = set()
    for entry in pdf.loc[pdf["entry"], "at"]:
        at = entry
        while at in step and at not in seen:
            seen.add(at)
            at = step[at]
    return pdf.loc[pdf["at"].isin(seen), ["file", "at"]]


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE, with_payload: bool = False) -> DataFrame:
    """The true records of uncompressed WARC files below ``path``.

    Only candidates on the chain of records that starts at a file's first byte are
    returned; magic inside payloads is rejected.  Columns: file, at, page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, whole[, payload].  An
    archive without files or records gives no rows.  A chain that breaks off before its
    file's end raises an error.
    """
    found = save(candidates(spark, path, range_bytes, with_payload), "candidates")
    entries = save(reachable(found), "entries").withColumn("entry", F.lit(True))
    lengths = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    ends = entries.groupBy("file").agg(F.max("at").alias("end"))
    broken = lengths.join(ends, "file", "left").where(~F.col("length").eqNullSafe(F.col("end"))).first()
    if broken is not None:
        raise ValueError(f"{broken.file}: records end at byte {broken.end or 0} of {broken.length}")
    steps = found.join(entries, ["file", "at"], "left").select("file", "part", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    arrow_rows(spark)
    passed = save(steps.groupBy("file", "part").applyInPandas(follow, "file string, at long"), "passed")
    return found.join(passed, ["file", "at"]).drop("part", "next", "exit")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per page and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(plan_records(pages, id_col, url_col, payload_col, least_bytes), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
