"""WARC archives: one record per page, payload copies as revisits, long records as segments.

Writing. Equal payloads are found by digest; the smallest page id of each keeps the payload, all others become
revisit records. A response's block is an HTTP header and the chunk-framed payload; a block longer than one
segment is cut, and the rest follows in continuation records. Spark's text writer puts the records down with
the record separator as its line separator, so each part file is a valid archive.

Reading. Archive files are parsed by the lengths that they state. Segments are grouped by the identifier of
their origin, ordered by segment number, and joined; the total length is verified; the chunk framing is
decoded; the payload is verified against its digest. Revisits are resolved through the record they name.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lookup, shared_dir, table, written

#: Payloads shorter than this are always stored.
MIN_REVISIT = 100
#: Characters of a block in one segment, and of payload in one transfer chunk.
SEGMENT_CHARS = 8 * 1024
CHUNK_CHARS = 2 * 1024
#: Records in one archive file; with segments of bounded size this bounds what a reader holds.
FILE_RECORDS = 500
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
_URI = "urn:page:"


def _crlf(*parts) -> F.Column:
    return F.concat(*[F.concat(p if not isinstance(p, str) else F.lit(p), F.lit("\r\n")) for p in parts])


def _stretches(text: F.Column, size: int) -> F.Column:
    """A text cut into pieces of ``size`` characters in one pass; an empty text is one empty piece."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def marked(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``pages`` as page_id, url, body, digest, size, own (record name), refers (name of the record that it revisits, or null).

    Only ids, digests and sizes are aggregated; bodies meet what was found by lookup() on (id, digest), mostly nothing.
    A page with no id is never revisited and revisits nothing. Rows equal in id and payload are numbered, in one task for
    each such row.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.url_encode(F.col("page_id").cast("string"))), F.lit("-"))
    full = pages.select("page_id", "url", body.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long")).withColumn("_k", key)
    index = written(full.groupBy("_k", "digest").agg(F.first("page_id").alias("page_id"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies")), "warc-pages")
    many = index.where((F.col("size") >= min_revisit) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "_k")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = written(many.drop("n"), "warc-firsts")
    name = lambda k: F.concat(k, F.lit(":"), F.substring("digest", 1, 16), F.lit(":"))
    later = lookup(index, many, ["digest"], "_k", "left").withColumn("refers", F.when(F.col("first.page_id") < F.col("page_id"), F.concat(name(F.col("first._k")), F.lit("1"))))
    found = written(later.where("refers is not null or copies > 1").select("_k", "digest", "refers", "copies"), "warc-marks")
    repeated = found.where("copies > 1").limit(1).count() > 0
    rows = lookup(full, found, ["_k", "digest"], "_k", "left")
    if repeated:
        again = rows.where("copies > 1").withColumn("_n", F.row_number().over(W.partitionBy("_k", "digest").orderBy("url")))
        rows = rows.where("coalesce(copies, 1) = 1").withColumn("_n", F.lit(1)).unionByName(again)
    else:
        rows = rows.withColumn("_n", F.lit(1))
    return rows.select("page_id", "url", "body", "digest", "size", F.concat(name(F.col("_k")), F.col("_n").cast("string")).alias("own"), "refers")


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT, segment: int = SEGMENT_CHARS, chunk: int = CHUNK_CHARS) -> DataFrame:
    """Column ``value``: WARC records without the closing empty lines, segments included; one origin record per row of ``pages``.

    Null html: an empty payload. Null url: no target URI; white space in a URL is percent-encoded. Null page_id: a record
    without a page id, always a response. Repeated page ids are records of their own. Other columns are ignored.
    """
    http = _crlf("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "")
    framed = F.array_join(F.transform(_stretches(F.col("body"), chunk), lambda c: F.when(c != "", _crlf(F.lower(F.hex(F.octet_length(c))), c)).otherwise("")), "")
    block = F.when(F.col("refers").isNotNull(), _crlf("HTTP/1.1 200 OK", "")).otherwise(F.concat(http, framed, F.lit("0\r\n\r\n")))
    built = marked(pages, min_revisit).select("page_id", "url", "digest", "own", "refers", block.alias("block"))
    cuts = _stretches(F.col("block"), segment)
    parts = built.select("page_id", "url", "digest", "own", "refers", F.octet_length("block").alias("total"), F.size(cuts).alias("segments"), F.posexplode(cuts).alias("seg", "part"))
    number = F.col("seg") + 1
    many = F.col("segments") > 1
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))
    opt = lambda cond, *x: F.when(cond, F.concat(*x)).otherwise("")
    named = lambda c: F.concat(F.lit(f"<{_URI}"), c, F.lit(">"))
    own = F.when(F.col("seg") == 0, named(F.col("own"))).otherwise(named(F.concat("own", F.lit("/"), number.cast("string"))))
    kind = F.when(F.col("seg") > 0, F.lit("continuation")).when(F.col("refers").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    uri = F.col("url")
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", own), line("WARC-Date", F.lit(DATE)),
        opt(F.col("page_id").isNotNull() & (F.col("seg") == 0), line("X-Page-ID", F.url_encode(F.coalesce(F.col("page_id").cast("string"), F.lit(""))))),
        opt(F.col("url").isNotNull() & (F.col("seg") == 0), line("WARC-Target-URI", F.coalesce(uri, F.lit("")))),
        opt(F.col("seg") == 0, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        opt(F.col("refers").isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            line("WARC-Refers-To", named(F.coalesce("refers", F.lit(""))))),
        opt(many, line("WARC-Segment-Number", number)),
        opt(F.col("seg") > 0, line("WARC-Segment-Origin-ID", named(F.col("own")))),
        opt(many & (number == F.col("segments")), line("WARC-Segment-Total-Length", F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("part")), F.lit("\r\n"),
    )
    return parts.select(F.concat(header, F.col("part")).alias("value"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Gzipped archive files of at most FILE_RECORDS records below ``path``, a URI that Spark writes."""
    out = records(pages, **options).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


_PARSED = "own string, page_id string, origin string, kind string, seg int, segments_total long, url string, digest string, refers string, block binary"


def parse(content: bytes):
    """(headers, block) of each record of an archive's bytes; ValueError where a stated length does not hold."""
    at = 0
    while at < len(content):
        head = content.index(END.encode(), at)
        lines = content[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin = head + 4
        end = begin + int(headers["Content-Length"])
        if content[end : end + 4] != END.encode():
            raise ValueError(f"record at byte {at} does not end where it says")
        yield headers, content[begin:end]
        at = end + 4


def dechunked(body: bytes) -> bytes:
    """The bytes inside chunked transfer framing; ValueError where a chunk is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[at : at + n])
        at += n + 2


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record, page_id (string or null), record_type, url, payload (binary, of responses), payload_bytes, payload_digest, refers_to
    (the record that a revisit names).

    Fails on a record whose lengths, segments or digest do not hold. An archive without records gives no rows.
    """

    def parsed(frames):
        import gzip
        from urllib.parse import unquote_plus

        for frame in frames:
            for content in frame["content"]:
                rows = []
                for h, block in parse(gzip.decompress(content)):
                    own = h["WARC-Record-ID"].strip("<>").removeprefix(_URI)
                    origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]).strip("<>").removeprefix(_URI)
                    total = h.get("WARC-Segment-Total-Length")
                    page = h.get("X-Page-ID")
                    rows.append((own, page and unquote_plus(page), origin, h["WARC-Type"], int(h.get("WARC-Segment-Number", 0)), total and int(total), h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest", "").removeprefix("sha256:"), (h.get("WARC-Refers-To") or "").strip("<>").removeprefix(_URI) or None, block))
                yield pd.DataFrame(rows, columns=["own", "page_id", "origin", "kind", "seg", "segments_total", "url", "digest", "refers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    raw = files.select("content").mapInPandas(parsed, _PARSED)
    # whole records pass straight on; only segments are shuffled and joined
    whole = raw.where("seg = 0").select(F.col("own").alias("record"), "page_id", "kind", "url", "digest", "refers", "block")
    pieces = raw.where("seg > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("seg", "block"))).alias("p"), F.max("segments_total").alias("total"),
        *[F.max(F.when(F.col("seg") == 1, F.col(c))).alias(c) for c in ("page_id", "kind", "url", "digest", "refers")],
    )
    blocks = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["block"]))
    joined = pieces.withColumn("block", blocks)
    unbroken = (F.octet_length("block") == F.col("total")) & (F.get("p", F.size("p") - 1)["seg"] == F.size("p"))
    joined = joined.where(F.when(F.coalesce(unbroken, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("segments do not add up: "), F.col("origin"))).cast("boolean")))
    every = whole.unionByName(joined.select(F.col("origin").alias("record"), "page_id", "kind", "url", "digest", "refers", "block"))

    def decoded(frames):
        for frame in frames:
            payloads = []
            for kind, digest, block in zip(frame["kind"], frame["digest"], frame["block"], strict=True):
                if kind != "response":
                    payloads.append(None)
                    continue
                head, _, body = bytes(block).partition(b"\r\n\r\n")
                data = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError("payload does not match its digest")
                payloads.append(data)
            yield frame[["record", "page_id", "kind", "url", "digest", "refers"]].assign(payload=payloads)

    return every.mapInPandas(decoded, "record string, page_id string, kind string, url string, digest string, refers string, payload binary").select(
        "record", "page_id", F.col("kind").alias("record_type"), "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("refers").alias("refers_to"))


def resolved(found: DataFrame) -> DataFrame:
    """Archive rows without payloads, each revisit with the length and digest of the response that it names; refers_to is that
    response's page id.

    A revisit whose response is missing or has another digest fails the job. Responses that are named come to their
    revisits by lookup(), so one that most records revisit does not gather them.
    """
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to").alias("record")).distinct().join(responses, "record")
    named = written(named.select(F.col("record").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d")), "warc-named")
    revisits = lookup(revisits, named, ["refers_to"], "record", "left")
    checked = F.when(F.col("_d") == F.col("payload_digest"), F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("no such response: "), F.col("refers_to"))).cast("long"))
    revisits = revisits.withColumn("payload_bytes", checked).withColumn("refers_to", F.col("_page"))
    return responses.select(*columns).unionByName(revisits.select(*columns))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = written(read_archives(spark, path).drop("payload", "url"), "warc-index")
    out = resolved(found)
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
