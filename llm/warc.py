"""WARC archives in which repeated payloads are revisit records."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ref, saved

_END = "\r\n"
#: Stands for a null id in joins.
_NO_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive file, about; a reader holds a file at a time.
FILE_BYTES = 32 << 20


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit(""))


def revisits(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The header facts of each record: id, digest (SHA-256 of the UTF-8 payload), bytes, and ``first``, the id of the response that it
    revisits (null for a response).

    Only these headers are shuffled by digest; the smallest id of each comes from partial aggregation. Of the
    records with one payload of at least ``least_bytes`` the smallest id is the response, null ids last. Rows repeated with the same
    id and payload cannot be told apart, so all of the smallest id are responses.
    """
    payload = _payload(ref(html_col))
    heads = saved(pages.select(ref(id_col).cast("long").alias("id"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")))
    firsts = heads.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    joined = heads.join(firsts, "digest", "left")
    return joined.withColumn("first", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))


def record_id(page: Column, digest: Column) -> Column:
    """A URN made of the page's id and payload digest, so that a rerun writes the same archives."""
    h = F.md5(F.concat_ws("/", F.lit("page"), F.coalesce(page.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Writes a record per row of ``pages`` as WARC 1.1 files below ``folder``, with fresh headers: ids, dates, lengths and digests.

    A response holds an HTTP header and the payload; a revisit the HTTP header alone, and names the response. A null html is an empty
    payload; a null URL is written as one made from the id; control characters and blanks in URLs are left out. The row's id
    goes along as an extension field. Files are gzip-compressed as a whole. Spark's text writer puts them in place, with its commit of finished tasks, and ends each
    record with the two line breaks that the format asks for.
    """
    facts = saved(revisits(pages, least_bytes, id_col, html_col).distinct())
    total = facts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    payload = _payload(ref(html_col))
    rows = pages.select(
        F.coalesce(ref(id_col).cast("long"), F.lit(_NO_ID)).alias("p_id"),
        ref(url_col).cast("string").alias("p_url"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("p_digest"),
    ).repartition(parts, "p_digest", "p_id")
    # Plain equality, so that the join takes the rows as they have been dealt.
    facts = facts.withColumn("f_id", F.coalesce("id", F.lit(_NO_ID)))
    rows = rows.join(facts, (F.col("p_digest") == F.col("digest")) & (F.col("p_id") == F.col("f_id")))
    revisit = F.col("first").isNotNull()
    url = F.coalesce(F.regexp_replace("p_url", r"[\x00-\x20\x7f]", ""), F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", record_id(F.col("id"), F.col("digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("first"), F.col("digest")))),
        ("X-Row-Id", F.col("id").cast("string")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = F.concat(F.lit(f"WARC/1.1{_END}"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_END)), F.lit("")) for k, v in fields])
    rows.select(F.concat(lines, F.lit(_END), block).alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").text(folder)


def parse_records(data: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields and block of each record of an archive; blocks end where Content-Length says, whatever they hold."""
    at, raw = 0, data.obj if isinstance(data.obj, bytes) else bytes(data)
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *rest = raw[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"No WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in rest)
        size = int(fields["Content-Length"])
        start = end + 4
        if raw[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"The record at byte {at} does not end where its length says")
        yield fields, data[start : start + size]
        at = start + size + 4


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record: record_id, row_id, type, uri, refers_to (a record id), payload_bytes and payload_digest of the bytes found (null for
    revisits, which have none), and the payload itself if asked for. Digests and lengths in the headers are checked."""
    schema = "record_id string, row_id bigint, type string, uri string, refers_to string, payload_bytes bigint, payload_digest string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        for batch in batches:
            for file in batch["content"]:
                out: list[list] = [[] for _ in names]
                held = 0
                for fields, block in parse_records(memoryview(gzip.decompress(file.as_py()))):
                    content = bytes(block)
                    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(content).hexdigest()}":
                        raise ValueError(f"Wrong block digest in {fields['WARC-Record-ID']}")
                    payload = content[content.index(b"\r\n\r\n") + 4 :]
                    response = fields["WARC-Type"] == "response"
                    row_id = fields.get("X-Row-Id")
                    values = [
                        fields["WARC-Record-ID"], None if row_id is None else int(row_id), fields["WARC-Type"], fields["WARC-Target-URI"],
                        fields.get("WARC-Refers-To"), len(payload) if response else None, hashlib.sha256(payload).hexdigest() if response else None,
                    ] + [payload if response else None] * with_payload
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    held += len(payload) if with_payload else 0
                    if len(out[0]) >= 10_000 or held > FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                        out, held = [[] for _ in names], 0
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(rows, schema + ", payload binary" * with_payload)


def archive_round_trip(
    pages: DataFrame, folder: str, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` and reads them back: a row per page with its id, payload_bytes and payload_digest of the full
    payload, record_type (response or revisit) and refers_to (the id of the response, for revisits).

    A revisit's payload facts come from its response: revisits are joined to responses by record id, headers only. Null html
    is an empty payload, a null id is read back as null, repeated rows stay repeated, an empty table gives an empty result.
    """
    write_archives(pages, folder, least_bytes, "2024-01-01T00:00:00Z", id_col, url_col, html_col)
    records = saved(read_archives(pages.sparkSession, folder))
    originals = records.where("type = 'response'").groupBy("record_id").agg(
        F.first("row_id").alias("o_row"), F.max(F.struct("payload_bytes", "payload_digest")).alias("o")
    )
    back = records.where("type = 'revisit'").join(originals.withColumnRenamed("record_id", "o_id"), F.col("refers_to") == F.col("o_id"))
    responses = records.where("type = 'response'").select(
        F.col("row_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")
    )
    resolved = back.select(
        F.col("row_id").alias(id_col), F.col("o.payload_bytes").alias("payload_bytes"), F.col("o.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("o_row").alias("refers_to"),
    )
    return responses.unionAll(resolved)
