"""Readers that turn documents into blocks: one row a block, with code-point spans into the extracted text."""

from __future__ import annotations

import hashlib
import html
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "doc string, ordinal int, type string, level int, text string, start long, end long"


def read_files(spark: SparkSession, path: str, most: int = 64 << 20) -> DataFrame:
    """Bytes with their digest: path, media_type, content, digest, status. A file above ``most`` bytes is too_large and has no content."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = spark.read.format("binaryFile").load(path)
    whole = F.when(F.col("length") <= most, F.col("content"))
    return rows.select("path", kind.alias("media_type"), whole.alias("content"), F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("digest"), F.when(F.col("length") <= most, "read").otherwise("too_large").alias("status"))


def by_policy(files: DataFrame, kinds: list[str], most: int, root: str) -> DataFrame:
    """Adds why a file must not be read: another kind than the policy's, too large, or outside ``root``."""
    inside = F.startswith(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(root.rstrip("/") + "/")) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    why = F.array(F.when(~F.col("media_type").isin(kinds), "kind"), F.when((F.col("status") == "too_large") | (F.octet_length("content") > most), "too_large"), F.when(~inside, "outside"))
    return files.withColumn("refused", F.array_join(F.array_compact(why), ","))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest is the expected one (columns path, expected_digest)."""
    return files.join(expected, "path").filter(F.col("digest") == F.col("expected_digest")).drop("expected_digest")


#: What ends a line: all that Unicode calls a line end, a carriage return and line feed as one.
ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
LINE = rf"[^{ENDS}]*(?:\r\n|[{ENDS}])|[^{ENDS}]+"
#: The last sign of an end, and the signs of ``ENDS`` themselves.
LAST_OF_END = rf"[{ENDS}](?<!\r(?=\n))"
END_SIGNS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain text: a paragraph for each line that is not blank, with its offsets, without its end.

    Texts are cut at the last sign of each end, so a sign that ends nothing is looked at once and nothing is looked up behind it;
    what is left of an end of two signs is a carriage return.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LAST_OF_END, -1)).alias("line_no", "piece"))
    long = F.length("piece") + 1
    before = F.sum(long).over(Window.partitionBy(key).orderBy("line_no")) - long
    own = lines.withColumn("start", before.cast("long")).withColumn("text", F.rtrim("piece", F.lit("\r")))
    return own.withColumn("end", F.col("start") + F.length("text")).filter(F.trim("text") != "").select(key, "line_no", "start", "end", "text")


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown by lines: fenced code as one block, headings with level, paragraphs, and a link block for each link."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "text"))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("start", (F.sum(F.length("text") + 1).over(w) - F.length("text") - 1).cast("long"))
    fence = F.col("text").rlike(r"^\s*```")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(w))
    code = (F.col("fences") % 2 == 1) & ~F.col("fence")
    heading = F.regexp_extract("text", r"^(#{1,6})\s+", 1)
    kind = F.when(code, "code").when(heading != "", "heading").otherwise("paragraph")
    own = lines.filter(~F.col("fence") & (F.trim("text") != "")).withColumn("type", kind).withColumn("level", F.when(F.col("type") == "heading", F.length(heading)))
    body = own.filter("type <> 'code'").select(key, "line_no", "type", "level", F.regexp_replace("text", r"^#{1,6}\s+", "").alias("text"), "start", (F.col("start") + F.length("text")).alias("end"))
    fenced = own.filter("type = 'code'").groupBy(key, "fences").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("start").alias("start"), F.max(F.col("start") + F.length("text")).alias("end"))
    links = body.filter("type <> 'heading'").select(key, "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]\([^)]+\)"), F.lit(1))).alias("text"), "start", "end")
    return body.unionByName(fenced.select(key, "line_no", F.lit("code").alias("type"), F.lit(None).cast("int").alias("level"), "text", "start", "end")).unionByName(links.select(key, "line_no", F.lit("link").alias("type"), F.lit(None).cast("int").alias("level"), "text", "start", "end"))


class _Simple(HTMLParser):
    """One open structural tag at a time: a nested one discards what came before it in its parent."""

    KINDS = {**{f"h{k}": "heading" for k in range(1, 7)}, "p": "paragraph", "a": "link", "pre": "code", "code": "code", "figcaption": "caption", "li": "list"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: str | None = None
        self.text: list[str] = []
        self.out: list[tuple[str, int | None, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.KINDS:
            self.open, self.text = tag, []

    def handle_data(self, data):
        if self.open:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == self.open:
            text = " ".join("".join(self.text).split())
            if text:
                self.out.append((self.KINDS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None, text))
            self.open = None


def _rows(key, blocks) -> list[tuple]:
    out, at = [], 0
    for k, (kind, level, text) in enumerate(blocks):
        out.append((key, k, kind, level, text, at, at + len(text)))
        at += len(text) + 1
    return out


def _frames(reader):
    def run(frames):
        for frame in frames:
            rows = [r for key, body in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) for r in _rows(key, reader(body))]
            out = pd.DataFrame(rows, columns=["doc", "ordinal", "type", "level", "text", "start", "end"])
            yield out.astype({"level": "Int32"})

    return run


def _html(body: str | None) -> list[tuple]:
    parser = _Simple()
    parser.feed(body or "")
    parser.close()
    return parser.out


def html_blocks(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """HTML: headings, paragraphs, links, code, captions and list items in page order."""
    return pages.select(F.col(key).cast("string").alias("doc"), F.col(source)).mapInPandas(_frames(_html), BLOCKS)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(body: bytes | None) -> list[tuple]:
    """Paragraphs, headings by style, list items and tables of a word-processing package; an unreadable one has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(body or b"")) as z:
            tree = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for node in tree.find(f"{_W}body") if tree.find(f"{_W}body") is not None else []:
        if node.tag == f"{_W}p":
            text = "".join(t.text or "" for t in node.iter(f"{_W}t"))
            style = next((s.get(f"{_W}val", "") for s in node.iter(f"{_W}pStyle")), "")
            level = re.fullmatch(r"[Hh]eading ?([1-6])", style)
            kind = "heading" if level else "list" if next(node.iter(f"{_W}numPr"), None) is not None else "paragraph"
            if text.strip():
                out.append((kind, int(level[1]) if level else None, text))
        elif node.tag == f"{_W}tbl":
            rows = ["\t".join("".join(t.text or "" for t in cell.iter(f"{_W}t")) for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
            out.append(("table", None, "\n".join(rows)))
    return out


def docx_blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(key).cast("string").alias("doc"), F.col(content)).mapInPandas(_frames(_docx), BLOCKS)


def _pdf_literals(body: bytes | None) -> list[tuple]:
    """The literal strings that a plain, uncompressed PDF shows."""
    found = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*Tj", body or b"")
    return [("paragraph", None, re.sub(rb"\\(.)", rb"\1", x).decode("latin-1")) for x in found if x.strip()]


def pdf_literal_blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(key).cast("string").alias("doc"), F.col(content)).mapInPandas(_frames(_pdf_literals), BLOCKS)


def html_headings(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """The first first-level heading of each page, whatever its attributes, without the tags inside, by patterns alone."""
    inner = F.regexp_extract(F.regexp_replace(source, _UNSEEN, ""), rf"(?is)<h1{_REST}(.*?)</h1(?=[\s/>])", 1)
    return pages.select(key, F.trim(F.regexp_replace(F.regexp_replace(inner, rf"</?[a-zA-Z][^\s/>]*+{_REST}", ""), r"\s+", " ")).alias("heading"))


#: Start or end tags that end a heading or a paragraph.
BLOCK_TAGS = "address|article|aside|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hgroup|hr|html|legend|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
#: The rest of a tag after its name; a > in a quoted value does not end it. Possessive, so that long texts need no stack.
_REST = r"""(?=[\s/>])(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
_PIECE = rf"(?i)<(?:h1|p){_REST}[^<]*+(?:<(?!/?(?:{BLOCK_TAGS})(?=[\s/>]))[^<]*+)*+"


def html_paragraphs(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """First-level headings and paragraphs up to their end, the next block tag: key, ordinal, heading, text as in the source without tags inside; line breaks are spaces."""
    seen = F.regexp_replace(source, _UNSEEN, "")
    pieces = pages.select(key, F.posexplode(F.regexp_extract_all(seen, F.lit(_PIECE), F.lit(0))).alias("ordinal", "piece"))
    inner = F.regexp_replace(F.regexp_replace("piece", rf"(?i)^<(?:h1|p){_REST}", ""), rf"(?i)<br{_REST}", " ")
    return pieces.select(key, "ordinal", F.col("piece").rlike("(?i)^<h1").alias("heading"), F.regexp_replace(inner, rf"</?[a-zA-Z][^\s/>]*+{_REST}|<[!?][^>]*+>", "").alias("text"))


def parse_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of a text that its blocks cover, and what to do with the parse."""
    size = F.sum(F.length("text"))
    blocks = line_blocks(docs, key, text).groupBy(key).agg(size.alias("covered"), F.count("*").alias("blocks"))
    all_ = docs.select(key, F.length(F.trim(F.coalesce(F.col(text), F.lit("")))).alias("whole"))
    share = F.round(F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.greatest(F.lit(1), F.col("whole"))), 6)
    decision = F.when(share >= 0.98, "accept").when(share >= 0.5, "fallback").otherwise("quarantine")
    return all_.join(blocks, key, "left").select(key, F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), share.alias("coverage"), decision.alias("decision"))


def forward_fill(blocks: DataFrame, key: str, order: str, heading: Column, value: Column) -> DataFrame:
    """Each block under the latest heading at or before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("concept", F.last(F.when(heading, value), ignorenulls=True).over(w))


def content_digest(body: bytes) -> str:
    return "sha256:" + hashlib.sha256(body).hexdigest()


def unescape(text: str) -> str:
    return html.unescape(text)
