"""WARC derivatives: metadata and plain-text conversion records of responses.

``derive`` takes response records (record_id, target_uri, date, http_headers,
payload) and gives two records for each, both referring to it
(WARC-Refers-To) and carrying its target URI and date:

* ``metadata`` (application/warc-fields): the source's status line and headers,
  its block and payload digests and its outlinks;
* ``conversion`` (text/plain): the payload's text, with the source's payload
  digest.

Digests that the source record carries (block_digest, payload_digest) are kept
as they are; where it has none they are computed.

``read_warc`` reads WARC files (also gzip members), ``responses`` makes response
records of what it reads, ``write_warc`` writes records as WARC files through
Spark's text sink.

Edge cases: a null payload or header counts as empty, a null target URI leaves
the header out, null ids are written as empty ids; repeated responses give
repeated records; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import html as references
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumentrace.llm.common import table

CRLF = "\r\n"
#: Character references that OP1_SQL decodes; ampersands last.  ``decoded`` reads all that HTML has.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
UNSEEN = r"(?is)<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|head\b.*?</head|noscript\b.*?</noscript)\s*>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
#: Outlinks as OP1_SQL finds them: values in double quotes only.
LINKS = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'
#: Outlinks with their quotes, if any: an attribute named href, never the inside of another quoted value.
OUTLINKS = r"""(?i)<a(?=[\s/"'])[^>"']*?(?:(?:"[^"]*"|'[^']*')[^>"']*?)*?(?<=[\s/"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
#: Bytes of records that a task hands on together.
READ_AT_ONCE = 32 << 20
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{1,31};?)")
RECORDS = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block", "content_length", "block_digest", "source_payload_digest"]


def decode(text: str | None) -> str | None:
    """``text`` with its named and numeric character references decoded once; no-break spaces of references are spaces."""
    if not text or "&" not in text:
        return text
    return REFERENCE.sub(lambda m: references.unescape(m[0]).replace("\xa0", " "), text)


@F.arrow_udf(StringType())
def decoded(text: pa.Array) -> pa.Array:
    return pa.array(map(decode, text.to_pylist()), pa.string())


def plain_text(html) -> F.Column:
    text = F.regexp_replace(html, UNSEEN, " ")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    text = decoded(text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r"^\n|\n$", ""))


def _digest(text) -> F.Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def urn(*parts) -> F.Column:
    """A record id that names its parts, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response, with RECORDS' columns."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = lambda c: F.col(c) if c in responses.columns else F.lit(None).cast("string")
    rows = responses.select(empty("record_id").alias("refers_to"), "target_uri", "date", empty("http_headers").alias("head"), empty("payload").alias("payload"), given("payload_digest").alias("digest"), given("block_digest").alias("whole"))
    rows = rows.withColumn("digest", F.coalesce("digest", _digest(F.col("payload"))))
    rows = rows.withColumn("whole", F.coalesce("whole", _digest(F.concat("head", F.lit(CRLF + CRLF), "payload"))))
    links = F.transform(F.regexp_extract_all("payload", F.lit(OUTLINKS), F.lit(1)), lambda u: F.regexp_replace(u, r"""^["']|["']$""", ""))
    fields = F.concat(
        F.lit("source-status: "), F.substring_index("head", CRLF, 1), F.lit(CRLF),
        F.array_join(F.transform(F.slice(F.split("head", CRLF), F.lit(2), F.greatest(F.lit(0), F.size(F.split("head", CRLF)) - 1)), lambda h: F.concat(F.lit("source-header: "), h, F.lit(CRLF))), ""),
        F.lit("source-block-digest: "), F.col("whole"), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("digest"), F.lit(CRLF),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF))), ""),
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    rows = rows.select("refers_to", "target_uri", "date", F.col("digest").alias("source_payload_digest"), F.inline(two))
    rows = rows.withColumns({"record_id": urn("warc_type", "refers_to"), "content_length": F.octet_length("block").cast("long"), "block_digest": _digest(F.col("block"))})
    return rows.select(*RECORDS)


def serialised(records: DataFrame) -> DataFrame:
    """One string column: a record's header and block."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise("")
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    return records.select(F.concat(F.lit("WARC/1.1" + CRLF), *[line(*x) for x in named], F.lit(CRLF), "block").alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records end with two line ends, which Spark's text sink writes as its separator."""
    serialised(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def records_of(f):
    """(headers, block) of the records of an open WARC file; a length that is no number counts as 0."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while line := f.readline().decode("utf-8", "replace").strip("\r\n"):
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        length = head.get("content-length", "")
        yield head, f.read(int(length) if length.isdecimal() and len(length) < 16 else 0)


def _parse(batches):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([[*h.items()] for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in rows], pa.binary())], ["headers", "block"])

    for batch in batches:
        for content in batch.column("content"):
            raw = io.BytesIO(content.as_buffer())
            rows, size = [], 0
            for record in records_of(gzip.open(raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw):
                rows.append(record)
                size += len(record[1])
                if size > READ_AT_ONCE:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (map, lower-case names), block (binary) of the records of WARC files.

    A file, of 2 GB at most, is one task's, which holds the file as it is and
    ``READ_AT_ONCE`` bytes of its records.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, "headers map<string,string>, block binary")


def _unchunked(body: bytes) -> bytes:
    """The parts of a chunked body; what follows a length that is no number is left as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return b"".join(out) + body[at:]
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def body_text(head: str, body: bytes) -> str:
    """The text of an HTTP body: its transfer and content encoding undone, in its charset; wrong bytes become U+FFFD, unknown encodings stay."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split(CRLF)[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding.strip(), ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", fields.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


NAMED = {"record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "block_digest": "warc-block-digest"}


def _read_responses(batches):
    names = [*NAMED, "http_headers", "payload"]
    sha = lambda b: f"sha256:{hashlib.sha256(b).hexdigest()}"
    for batch in batches:
        out = []
        for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist()):
            held, block = dict(headers), block or b""
            head, found, body = block.partition(b"\r\n\r\n")
            row = {c: held.get(name) for c, name in NAMED.items()}
            row |= {"payload_digest": row["payload_digest"] or sha(body), "block_digest": row["block_digest"] or sha(block)}
            head = head.decode("utf-8", "replace")
            out.append([*row.values(), head, body_text(head, body) if found else None])
        columns = list(zip(*out)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)


def responses(records: DataFrame) -> DataFrame:
    """The response records among those of ``read_warc``, for ``derive``: the HTTP head goes up to the first empty line.

    Digests that a record lacks are of its bytes as they are; the payload is
    their text, decoded.
    """
    rows = records.where(F.lower(F.element_at("headers", "warc-type")) == "response").select("headers", "block")
    return rows.mapInArrow(_read_responses, ", ".join(f"{c} string" for c in [*NAMED, "http_headers", "payload"]))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Page rows as response records."""
    head = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    return pages.select(urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit(head), length).alias("http_headers"), F.col("html").alias("payload"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_of(table(spark, sf_dir, "pages")))


def _uuid_sql(text: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _text_sql(html: str) -> str:
    out = f"regexp_replace({html}, '{UNSEEN}', ' ', 'g')"
    out = rf"regexp_replace({out}, '\s+', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    for reference, character in REFERENCES:
        out = f"replace({out}, '{reference}', '{character.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace(regexp_replace({out}, ' *\n[ \n]*', chr(10), 'g'), '^\n|\n$', '', 'g'))"


OP1_SQL = f"""
with r as (
  select {_uuid_sql("concat_ws('|', 'response', page_id::varchar, url)")} as refers_to, url as target_uri, coalesce(html, '') as payload,
    'HTTP/1.1 200 OK' as status, 'Content-Type: text/html; charset=utf-8' as h1, 'Content-Length: ' || strlen(coalesce(html, '')) as h2, chr(13) || chr(10) as nl
  from pages
), d as (select *, 'sha256:' || sha256(payload) as digest from r),
two as (
  select 'metadata' as warc_type, 'application/warc-fields' as content_type, refers_to, target_uri, digest,
    'source-status: ' || status || nl || 'source-header: ' || h1 || nl || 'source-header: ' || h2 || nl
    || 'source-block-digest: sha256:' || sha256(status || nl || h1 || nl || h2 || nl || nl || payload) || nl
    || 'source-payload-digest: ' || digest || nl
    || coalesce(list_aggregate(list_transform(regexp_extract_all(payload, '{LINKS}', 1), lambda u: 'outlink: ' || u || nl), 'string_agg', ''), '') as block from d
  union all
  select 'conversion', 'text/plain', refers_to, target_uri, digest, {_text_sql("payload")} from d
)
select warc_type, {_uuid_sql("concat_ws('|', warc_type, refers_to)")} as record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' as date, content_type, block,
  strlen(block)::bigint as content_length, 'sha256:' || sha256(block) as block_digest, digest as source_payload_digest from two
"""
