"""Operator 2: WARC derivatives, response records to linked metadata and plain-text conversion records.

``read_records`` cuts WARC files (plain or gzip by record) into records; ``derive`` makes, for every response, a
``metadata`` record (application/warc-fields) and a ``conversion`` record (text/plain); ``serialise`` gives the
bytes of a record. ``derive`` uses DataFrame functions, and Arrow passes for charsets and references. The records stay
linked: WARC-Refers-To names the response's record id, WARC-Refers-To-Target-URI, WARC-Date and the payload digest come
from its headers, and both records carry all its HTTP headers. New record ids are name-based, from the source's id and the
new type, so that a task that runs again writes the same records. Digests are sha256 in hexadecimal: of the whole
block, and of the payload's bytes as they were sent.

The plain text is the payload (its content and transfer codings undone, decoded by the charset that its headers or its
first 1,024 bytes name, else as UTF-8, else as windows-1252) without comments, scripts and styles, tags cut at their
brackets, all character references decoded, white space (no-break spaces too) folded. Null payloads are empty, null
headers are left out; repeated rows give repeated records; an empty table gives none; other columns are not read.

Broken files lose nothing that can be read: a record without a valid length ends where the next one begins, a cut one
has what is left of it, a damaged gzip member what came before the damage; ``problem`` says so.
"""

from __future__ import annotations

import codecs
import html
import html.entities
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The marks of the format.
VERSION, END = "WARC/1.1", "\r\n"


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of fetched pages: record_id, target_uri, date, headers, payload."""
    payload = F.coalesce(F.col(body), F.lit(""))
    uri = F.coalesce(F.col(url), F.lit(""))
    ident = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), uri)
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(F.col(key).alias("source_key"), urn(ident).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload"))


def urn(name: Column) -> Column:
    """A name-based record id."""
    h = F.sha2(name.cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def plain_text(payload: Column) -> Column:
    """Text of a payload: markup is cut by functions alone, then all character references are decoded, each once."""
    text = F.regexp_replace(payload, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = _decoded(F.regexp_replace(text, r"<[^<>]*>", " "))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\u00a0]+", " "))


@F.arrow_udf(StringType())
def _decoded(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


_CHARSET = re.compile(r"""(?im)^content-type:[^\r\n]*charset=["']?([\w.:-]+)""")
_META = re.compile(rb"""(?i)<meta[^>]{0,200}charset=["']?([\w.:-]+)""")
_CODING = re.compile(r"(?im)^(?:content|transfer)-encoding:[ \t]*([^\r\n]*)")


#: Bytes that a payload may have once its codings are undone; what lies beyond is not read.
MOST_BYTES = 64 << 20
_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?")


def _unchunked(body: bytes) -> bytes:
    """The chunks of a body; one that does not begin with a chunk is no chunked body, a size that is no number ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        said = _SIZE.fullmatch(body, at, end)
        if not said and not at:
            raise ValueError("not chunked")
        size = int(said.group(1), 16) if said else 0
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _inflated(body: bytes) -> bytes:
    """What a compressed body holds, up to MOST_BYTES; a damaged one gives what came before the damage."""
    undo, out = zlib.decompressobj(47), []
    step, left = body, MOST_BYTES
    try:
        while step and left > 0 and not undo.eof:
            out.append(undo.decompress(step, min(left, 1 << 20)))
            left -= len(out[-1])
            step = undo.unconsumed_tail
    except zlib.error:
        if not out:
            raise
    return b"".join(out)


def decoded(payload: bytes, headers: str) -> tuple[str, str | None]:
    """The text of a payload by its headers, of any bytes; and ``too_large`` where MOST_BYTES cut it."""
    codings, problem = ",".join(_CODING.findall(headers)).lower(), None
    for name, undo in (("chunked", _unchunked), ("gzip", _inflated), ("deflate", _inflated)):
        if name in codings:
            try:
                payload = undo(payload)
            except (ValueError, zlib.error):  # sent otherwise than said
                continue
            problem = "too_large" if undo is _inflated and len(payload) >= MOST_BYTES else problem
    named = _CHARSET.search(headers)
    found = named.group(1) if named else (m.group(1).decode("ascii", "replace") if (m := _META.search(payload[:1024])) else "")
    try:
        codec = codecs.lookup(found) if found else None
    except LookupError:
        codec = None
    if codec is not None and codec._is_text_encoding:
        return payload.decode(codec.name, "replace"), problem
    try:
        return payload.decode(), problem
    except UnicodeDecodeError:
        return payload.decode("cp1252", "replace"), problem


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("problem", StringType())]))
def _text(payload: pa.Array, headers: pa.Array) -> pa.Array:
    found = [decoded(p, h or "") for p, h in zip(payload.to_pylist(), headers.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["text", "problem"])


def derive(records: DataFrame) -> DataFrame:
    """Two rows a response: source_key, record_id, warc_type, refers_to, target_uri, date, content_type, content_length, block_digest, payload_digest, source_headers, block, problem.

    ``payload`` may be text, which is taken as it is, or bytes; ``problem`` is ``too_large`` where these inflate to over MOST_BYTES.
    """
    plain = records.schema["payload"].dataType.simpleString() == "string"
    raw = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    own = records.withColumn("raw", raw)
    if plain:
        own = own.withColumns({"payload": F.coalesce("payload", F.lit("")), "problem": F.lit(None).cast("string")})
    else:
        own = own.withColumn("read", _text("raw", F.col("headers"))).withColumns({"payload": F.col("read.text"), "problem": F.col("read.problem")})
    fields = F.concat(F.lit("payload-length: "), F.octet_length("raw").cast("string"), F.lit("\r\npayload-digest: "), digest(F.col("raw")), F.lit("\r\ntitle: "), F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)", 1), r"[ \t\n\r\f]+", " ")), F.lit("\r\nlinks: "), (F.size(F.split("payload", r"<a[ \t\n\r]+href=", -1)) - 1).cast("string"), F.lit("\r\n"), F.coalesce(F.col("headers"), F.lit("")))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    out = own.withColumn("payload_digest", digest(F.col("raw"))).withColumn("made", F.explode(made))
    block = F.col("made.block")
    return out.select(
        "source_key",
        urn(F.concat_ws("|", F.col("record_id"), F.col("made.warc_type"))).alias("record_id"),
        F.col("made.warc_type").alias("warc_type"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("made.content_type").alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        digest(block).alias("block_digest"),
        "payload_digest",
        F.col("headers").alias("source_headers"),
        block.alias("block"),
        "problem",
    )


def serialise(derived: DataFrame) -> DataFrame:
    """source_key, record_id, record: the text of each record, ready for a file; a field WARC-Source-Header for each line of the source's HTTP head."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    source = F.array_join(F.transform(F.filter(F.split(F.coalesce("source_headers", F.lit("")), r"\r?\n"), lambda x: x != ""), lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit(END))), "")
    head = F.concat(F.lit(VERSION + END), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("payload_digest")), source, line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(END))
    return derived.select("source_key", "record_id", F.concat(head, F.col("block"), F.lit(END * 2)).alias("record"))


def read_records(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, position, headers map, block, problem (null: none) of every record of WARC files; a record of any length is whole."""

    def batch(name, first: int, found: list) -> pa.RecordBatch:
        columns = [pa.array([name] * len(found), pa.string()), pa.array(range(first, first + len(found)), pa.int64()), pa.array([list(h.items()) for h, _, _ in found], pa.map_(pa.string(), pa.string())), pa.array([b for _, b, _ in found], pa.binary()), pa.array([p for _, _, p in found], pa.string())]
        return pa.record_batch(columns, names=["path", "position", "headers", "block", "problem"])

    def run(batches):
        for part in batches:
            for name, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, size, first = [], 0, 0
                for record in scan(body or b""):
                    found.append(record)
                    size += len(record[1])
                    if size > BATCH_BYTES:
                        yield batch(name, first, found)
                        found, size, first = [], 0, first + len(found)
                yield batch(name, first, found)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, position long, headers map<string,string>, block binary, problem string")


#: Bytes of records that leave a task together; a longer record is a batch of its own.
BATCH_BYTES = 16 << 20


class _Members(io.RawIOBase):
    """The members of a gzip file, one after the other; what follows a damaged one is searched for the next."""

    def __init__(self, body: bytes):
        self.body, self.at, self.member, self.fed, self.damaged = body, 0, zlib.decompressobj(31), False, False

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while self.at < len(self.body):
            taken = self.body[self.at : self.at + (1 << 16)]
            try:
                out, self.fed = self.member.decompress(taken, len(target)), True
                self.at += len(taken) - len(self.member.unused_data if self.member.eof else self.member.unconsumed_tail)
            except zlib.error:
                self.damaged, self.fed, out = True, False, b""
                following = self.body.find(b"\x1f\x8b\x08", self.at + 1)
                self.at = len(self.body) if following < 0 else following
                self.member = zlib.decompressobj(31)
            if self.member.eof:
                self.member, self.fed = zlib.decompressobj(31), False
            if out:
                target[: len(out)] = out
                return len(out)
        self.damaged |= self.fed  # the last member has no end
        self.fed = False
        return 0


def _take(stream, size: int) -> bytes:
    """``size`` bytes, or what there is; asked for in parts, so a false size costs nothing."""
    parts = []
    while size > 0 and (part := stream.read(min(size, 1 << 20))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def scan(body: bytes):
    """(headers with names in lower case, block, problem or None) of each record."""
    zipped = _Members(body) if body[:2] == b"\x1f\x8b" else None
    stream = io.BufferedReader(zipped, 1 << 16) if zipped else io.BytesIO(body)
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        headers, name, problem = {}, None, None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and name:  # a folded value
                headers[name] += " " + line.decode("utf-8", "replace").strip()
                continue
            field, mark, value = line.decode("utf-8", "replace").partition(":")
            if mark:
                name = field.strip().lower()
                headers[name] = value.strip()
        if not line:
            problem = "cut"
        size = headers.get("content-length", "")
        if size.isascii() and size.isdigit():
            block = _take(stream, int(size))
            if len(block) < int(size):
                problem = "cut"
            line = stream.readline()
        else:
            parts, problem = [], problem or "content-length"
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                parts.append(line)
            block = b"".join(parts).removesuffix(b"\r\n\r\n")
        if zipped and zipped.damaged:
            problem = problem or "gzip"
            zipped.damaged = False
        yield headers, block, problem


def cut(body: bytes):
    """(headers, block) of each record."""
    for headers, block, _ in scan(body):
        yield headers, block


def from_records(records: DataFrame) -> DataFrame:
    """Response rows, as ``derive`` takes them, of records read from files: the HTTP head is cut from the payload, which stays bytes."""
    own = records.filter(F.lower(F.col("headers").getItem("warc-type")) == "response").select(F.col("headers").alias("fields"), F.coalesce("block", F.lit("").cast("binary")).alias("block"))
    first = F.decode(F.substring("block", 1, 1 << 16), "iso-8859-1")  # a sign a byte; the whole block only where the head is longer
    own = own.withColumn("signs", F.when(F.locate("\r\n\r\n", first) > 0, first).otherwise(F.decode("block", "iso-8859-1"))).withColumn("at", F.locate("\r\n\r\n", F.col("signs")))
    head = F.when(F.col("at") > 0, F.concat(F.expr("substring(signs, 1, at - 1)"), F.lit("\r\n"))).otherwise(F.lit(""))
    payload = F.when(F.col("at") > 0, F.expr("substring(block, at + 4)")).otherwise(F.col("block"))
    field = lambda name: F.col("fields").getItem(name)
    return own.select(field("warc-record-id").alias("source_key"), field("warc-record-id").alias("record_id"), field("warc-target-uri").alias("target_uri"), field("warc-date").alias("date"), head.alias("headers"), payload.alias("payload"))


def _names() -> str:
    """The named references of HTML 5, with and without the semicolon, as rows of SQL (from the standard library's table)."""
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(html.entities.html5.items()))


def _numbers() -> str:
    """Numeric references that do not mean their own code point, as rows of SQL (from the standard library's decoder)."""
    odd = {n: html.unescape(f"&#{n};") for n in [*range(1, 160), 0]}
    return ", ".join("({}, {})".format(n, " || ".join(f"chr({ord(c)})" for c in v) or "''") for n, v in sorted(odd.items()) if v != chr(n))


#: The same derivatives of ``pages`` in DuckDB. References are cut out, decoded by the tables above (the longest name that
#: is known, what follows it stays) and put back in their places.
ORACLE = r"""
WITH RECURSIVE name_(k, v) AS (VALUES @NAMES@), number_(k, v) AS (VALUES @NUMBERS@), source AS (
  SELECT page_id AS source_key, coalesce(url, '') AS target_uri, '2024-01-01T00:00:00Z' AS date, coalesce(html, '') AS payload,
         sha256(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''))) AS h
  FROM pages
), response AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(payload)) || chr(13) || chr(10) AS headers,
         'sha256:' || sha256(payload) AS payload_digest
  FROM source
), bare AS (
  SELECT *, regexp_replace(regexp_replace(payload, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^<>]*>', ' ', 'g') AS text FROM response
), pieces AS (
  SELECT source_key, target_uri, payload, unnest(regexp_extract_all(text, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&')) AS piece,
         generate_subscripts(regexp_extract_all(text, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&'), 1) AS n FROM (SELECT DISTINCT source_key, target_uri, payload, text FROM bare)
), kinds AS (SELECT DISTINCT piece FROM pieces WHERE starts_with(piece, '&') AND length(piece) > 1
), valued AS (
  SELECT piece, CASE WHEN regexp_matches(piece, '^&#[xX]') THEN TRY_CAST('0x' || regexp_replace(piece[4:], ';$', '') AS BIGINT)
                     WHEN piece[2] = '#' THEN TRY_CAST(regexp_replace(piece[3:], ';$', '') AS BIGINT) END AS code FROM kinds
), numeric_ AS (
  SELECT piece, CASE WHEN v IS NOT NULL THEN v WHEN code BETWEEN 55296 AND 57343 OR code > 1114111 OR code IS NULL THEN chr(65533)
                     WHEN code BETWEEN 64976 AND 65007 OR code % 65536 >= 65534 THEN '' ELSE chr(CAST(code AS INTEGER)) END AS out
  FROM valued LEFT JOIN number_ ON code = k WHERE piece[2] = '#'
), named_ AS (
  SELECT piece, arg_max(v || piece[length(k) + 2:], length(k)) AS out
  FROM kinds JOIN name_ ON starts_with(piece[2:], k) WHERE piece[2] <> '#' GROUP BY piece
), decoded AS (SELECT * FROM numeric_ UNION ALL SELECT * FROM named_
), joined AS (
  SELECT source_key, target_uri, payload, string_agg(coalesce(out, p.piece), '' ORDER BY n) AS text FROM pieces p LEFT JOIN decoded USING (piece) GROUP BY 1, 2, 3
), made AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
         'payload-length: ' || octet_length(encode(payload)) || chr(13) || chr(10) || 'payload-digest: ' || payload_digest || chr(13) || chr(10)
         || 'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)', 1), '[ \t\n\r\f]+', ' ', 'g')) || chr(13) || chr(10)
         || 'links: ' || (len(regexp_split_to_array(payload, '<a[ \t\n\r]+href=')) - 1) || chr(13) || chr(10) || headers AS block
  FROM response
  UNION ALL
  SELECT r.*, 'conversion', 'text/plain; charset=utf-8', trim(regexp_replace(coalesce(j.text, ''), '[ \t\n\r\f\x{00a0}]+', ' ', 'g'))
  FROM response r LEFT JOIN joined j ON r.source_key IS NOT DISTINCT FROM j.source_key AND r.target_uri = j.target_uri AND r.payload = j.payload
), named AS (SELECT *, sha256(refers_to || '|' || warc_type) AS k FROM made)
SELECT source_key, '<urn:uuid:' || k[1:8] || '-' || k[9:12] || '-' || k[13:16] || '-' || k[17:20] || '-' || k[21:32] || '>' AS record_id,
       warc_type, refers_to, target_uri, date, content_type, CAST(octet_length(encode(block)) AS BIGINT) AS content_length,
       'sha256:' || sha256(block) AS block_digest, payload_digest, headers AS source_headers, block, CAST(NULL AS VARCHAR) AS problem
FROM named
""".replace("@NAMES@", _names()).replace("@NUMBERS@", _numbers())
