"""WARC archives: written by Spark's text sink, read back, assembled to one row per capture."""

import base64
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.session import scratch_path

CRLF = "\r\n"
# Fixed value: the profile that the standard names for revisits by payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "headers array<struct<name:string,value:string>>, payload_bytes long, payload_digest string, block binary")
COPIES_A_TASK = 1000      # records that one row unfolds to at a time


@F.pandas_udf(T.StringType())
def _base32(digest: pd.Series) -> pd.Series:
    return digest.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for the empty lines after it; a header without a value is left out."""
    clean = [(name, F.regexp_replace(value, "[\r\n]", " ")) for name, value in headers]
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in clean]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.0"), *lines, length), F.lit(CRLF * 2), block)


def _numbered(rows: DataFrame, least: int) -> DataFrame:
    """``(page_id, url, html, sha1, copy, first)``: a number among equal rows, and the row that is the response, if others are equal.

    Equal rows become one while they are read, so payloads are shuffled once.
    """
    rows = rows.withColumn("k", F.md5(F.concat_ws(
        ":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha1", F.coalesce(F.concat(F.lit("+"), F.col("url")), F.lit("-")))))

    def one(*more):
        return rows.groupBy("k").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "sha1")], F.count("*").alias("copies"), *more)
    small = one(F.max(F.octet_length("html")).alias("bytes"))
    first = small.where(F.col("bytes") >= least).groupBy("sha1").agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.sum("copies").alias("n")).where("n > 1").select("sha1", "first")
    marks = small.join(first, "sha1").select("k", "first")
    whole = one(F.first("html").alias("html")).join(marks, "k", "left").drop("k")
    names = ["page_id", "url", "html", "sha1", "first"]

    def unfold(df, start, stop):
        return df.select(*names, F.explode(F.sequence(start, stop)).alias("copy"))
    few = unfold(whole.where(F.col("copies") <= COPIES_A_TASK), F.lit(0).cast("long"), F.col("copies") - 1)
    many = whole.where(F.col("copies") > COPIES_A_TASK).select(*names, "copies", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_A_TASK).cast("long"))).alias("start"))
    return few.unionByName(unfold(many.repartition("sha1", "start"), F.col("start"),
                                  F.least(F.col("start") + COPIES_A_TASK, F.col("copies")) - 1))


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Write a request, a response or revisit, and a metadata record per row of ``(page_id, url, html)``.

    Of rows with one payload of at least ``least`` bytes the one with the largest
    page_id (an absent one being the smallest; among equals the largest url) is
    the response, and the others revisit it.  A null html is an empty payload, a
    null url leaves its header out.  Identifiers follow from page_id, url,
    payload and a number among rows equal in all three, so every row is a capture
    of its own; of equal rows the first is the response.  Equal rows are counted,
    reduced to one, and unfolded again, many of them in parts that tasks share.  Spark's text sink writes the
    archives, compressed, with the two line ends after a record as its line
    separator; the commit of its tasks covers lost executors.  An empty table
    writes archives without records; other columns are left aside.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("sha1"))
    rows = _numbered(rows, least).withColumn("again", F.col("first").isNotNull() & (
        (F.col("first") != F.struct("page_id", "url")) | (F.col("copy") > 0)))

    def record_id(kind, page_id="page_id", url="url", copy="copy"):
        h = F.md5(F.concat_ws(":", F.lit(kind), F.coalesce(F.col(page_id).cast("string"), F.lit("-")),
                              F.coalesce(F.concat(F.lit("+"), F.col(url)), F.lit("-")), F.col("sha1"), F.lit(date),
                              F.col(copy).cast("string") if isinstance(copy, str) else copy))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in (
            (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    own, digest = record_id("response"), F.concat(F.lit("sha1:"), _base32("sha1"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#\s]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("html"), F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request")),
                       ("WARC-Concurrent-To", own), *common,
                       ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    response = _record([("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", own),
                        *common, ("WARC-Payload-Digest", digest),
                        ("WARC-Refers-To", F.when(F.col("again"), record_id("response", "first.page_id", "first.url", F.lit("0")))),
                        ("WARC-Profile", F.when(F.col("again"), SAME_PAYLOAD)),
                        ("Content-Type", F.lit("application/http; msgtype=response"))],
                       F.when(F.col("again"), head).otherwise(F.concat(head, F.col("html"))))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata")),
                        ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")) \
        .write.text(path, compression="gzip", lineSep=CRLF * 2)


class _Parser:
    """Records of one archive from its lines, which came apart at CR LF.

    Content-Length decides where a block ends, so a block may hold anything.  A
    length that is no number counts as none; such a record has an empty block, and
    reading goes on at the next line that begins one.  Headers keep their order,
    repeated ones too.
    """

    def __init__(self):
        self.headers: list[tuple[str, str]] | None = None
        self.block: list[bytes] | None = None
        self.room = 0

    def feed(self, line: bytes):
        """The record that ends with this line, or None."""
        if self.block is not None:
            self.block.append(line)
            self.room -= len(line) + 2 * (len(self.block) > 1)
            return self.done() if self.room <= 0 else None
        if self.headers is None:
            if line.startswith(b"WARC/1."):
                self.headers = []
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.headers.append((name.strip().lower(), value.strip()))
        else:
            self.block, self.room = [], self.length()
            return self.done() if self.room == 0 else None
        return None

    def length(self) -> int:
        value = next((v for k, v in self.headers if k == "content-length"), "")
        return int(value) if value.isascii() and value.isdigit() else 0

    def done(self):
        block = b"\r\n".join(self.block)
        record = (self.headers, block[:self.length()])
        self.headers = self.block = None
        return record


def _records(keep_block: bool):
    def row(pairs, block):
        headers = dict(reversed(pairs))       # the first of a name; all of them in the column headers
        kind = headers.get("warc-type")
        payload = block
        if headers.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind != "revisit":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                headers.get("warc-target-uri"), headers.get("warc-date"), [{"name": k, "value": v} for k, v in pairs],
                None if kind == "revisit" else len(payload), digest,
                block if keep_block or kind not in ("response", "revisit") else None)

    kinds = [pa.string()] * 6 + [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches):
        file, parser, rows, held = None, _Parser(), [], 0
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    file, parser = name, _Parser()
                record = parser.feed(line)
                if record:
                    rows.append(row(*record))
                    held += len(record[1])
                    if held > 8_000_000 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
        yield batch_of(rows)
    return run


def read_warc(spark: SparkSession, path: str, keep_block: bool = True) -> DataFrame:
    """One row per record of the compressed archives under ``path``.

    A compressed archive is read by one task, in order, as a stream; an archive
    holds as much as a crawl writes into one, so tasks stay even.  Without
    ``keep_block`` the blocks of responses stay behind once they are measured.
    """
    lines = spark.read.text(path, lineSep=CRLF).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_records(keep_block), RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and lists of its request, metadata and other records.

    A record joins every capture that one of its concurrent-to headers names; a
    response or revisit, and a record that names none, is a capture of its own.
    Records may lie in any archive and order; an absent response is null, an
    absent list empty.  Of several responses with one identifier the least record
    is ``response``.  Lists are ordered, and hold repeated records as often as
    they occur.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])
    own = F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull()
    named = F.array_distinct(F.transform(F.filter("headers", lambda h: h["name"] == "warc-concurrent-to"), lambda h: h["value"]))
    keyed = records.select(F.explode(F.when(own | (F.size(named) == 0), F.array("record_id")).otherwise(named))
                           .alias("capture_id"), whole.alias("r"))

    def listed(test):
        return F.sort_array(F.collect_list(F.when(test, F.col("r"))))
    kind = F.coalesce(F.col("r.type"), F.lit(""))
    answer = kind.isin("response", "revisit")
    return keyed.groupBy("capture_id").agg(
        F.min(F.when(answer, F.col("r"))).alias("response"), listed(kind == "request").alias("requests"),
        listed(kind == "metadata").alias("metadata"),
        listed(~answer & ~kind.isin("request", "metadata")).alias("others"))


def archive_table(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and return one row per capture, that is per row of ``pages``.

    Payload size and digest come from the archived payload; a revisit takes them
    from the response that it refers to.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path)
    seen = captures(read_warc(spark, path, keep_block=False)).select(
        "response.record_id", "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest",
        F.regexp_extract(F.col("metadata")[0]["block"].cast("string"), r"page-id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"))
    first = seen.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"),
        F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    answers = seen.where("type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"))
    again = seen.where("type = 'revisit'").join(first, "refers_to").select(
        "page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("first_page").alias("refers_to"))
    return answers.unionAll(again)
