"""Extension surface: parsers, distillers and synthesisers are registered under an id and run over whole tables; parsing falls back once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources import blocks as B

# Least qualities to accept and to fall back, attempts, block types of a parse.
ACCEPT, FALLBACK, ATTEMPTS = 0.8, 0.7, 2
TYPES = {"heading", "paragraph", "list", "table", "code", "image", "caption", "footnote", "link"}
#: How a converter's labels read as block types.
LABELS = {"title": "heading", "section_header": "heading", "list_item": "list", "picture": "image", "text": "paragraph", "formula": "paragraph", "page_footer": "footnote"}


@dataclass
class Parser:
    """``parse``: bytes to (type, level, text) blocks. ``score`` ranks parsers of one media type; ``evidence``: whether a benchmark let it in."""

    parser_id: str
    media_types: tuple[str, ...]
    parse: Callable[[bytes], list[tuple]]
    score: float = 0.5
    evidence: bool = True
    most_bytes: int = 64 << 20


@dataclass
class Registry:
    parsers: dict[str, Parser] = field(default_factory=dict)

    def register(self, parser: Parser) -> Registry:
        if parser.parser_id in self.parsers:
            raise ValueError(f"parser {parser.parser_id} is registered already")
        self.parsers[parser.parser_id] = parser
        return self

    def ranked(self, media_type: str, size: int) -> list[Parser]:
        """Eligible parsers, the best first, ids breaking ties."""
        fit = [p for p in self.parsers.values() if media_type in p.media_types and p.evidence and size <= p.most_bytes]
        return sorted(fit, key=lambda p: (-p.score, p.parser_id))


def _lines(body: bytes) -> list[tuple]:
    return [("paragraph", None, line) for line in body.decode("utf-8", "replace").splitlines() if line.strip()]


def default_registry(converter: Callable[[bytes], list[tuple]] | None = None) -> Registry:
    """Parsers of plain text, HTML, DOCX and literal PDF, and a converter's, which is eligible only where one is given."""
    out = Registry().register(Parser("text-lines", ("txt", "md"), _lines, 0.9)).register(Parser("html-structure", ("html", "htm"), lambda b: B._html(b.decode("utf-8", "replace")), 0.9))
    out.register(Parser("docx-structure", ("docx",), B._docx, 0.9)).register(Parser("pdf-literal", ("pdf",), B._pdf_literals, 0.4))
    return out.register(Parser("pdf-converter", ("pdf",), converter or (lambda _: []), 0.8, evidence=converter is not None))


def labelled(items: list[tuple[str, str]]) -> list[tuple]:
    """(label, text) of a converter as blocks; an unknown label is a paragraph."""
    return [(LABELS.get(label, label if label in TYPES else "paragraph"), None, text) for label, text in items if text.strip()]


def _attempt(parser: Parser, body: bytes) -> tuple[list[tuple], list[str], float]:
    """(blocks, failures, quality) of one parser: the share of blocks of known type with text."""
    try:
        found = parser.parse(body)
    except Exception:  # a parser may fail in any way; the failure is its result
        return [], ["parser_crash"], 0.0
    good = [b for b in found if b[0] in TYPES and isinstance(b[2], str)]
    failures = (["invalid_ir"] if len(good) < len(found) else []) + ([] if any(b[2].strip() for b in good) else ["no_readable_content"])
    return good, failures, len(good) / len(found) if found else 0.0


PARSED = "path string, attempt int, parser_id string, quality double, failures array<string>, decision string, blocks array<struct<id:string,type:string,level:int,text:string,start:bigint,end:bigint>>"


def parse_files(files: DataFrame, registry: Registry, accept: float = ACCEPT, fallback: float = FALLBACK, attempts: int = ATTEMPTS) -> DataFrame:
    """Every attempt at every file (path, media_type, content): the best parser, then the next one while the result asks for it.

    accept: good enough, without failures; fallback: try another; quarantine: none left, or too bad. Only the accepted attempt has blocks. A
    file without an eligible parser is one rejected row. Blocks are numbered and carry offsets into their joined text.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for path, kind, body in zip(frame["path"], frame["media_type"], frame["content"], strict=True):
                body = bytes(body) if body is not None else b""
                ranked = registry.ranked(kind or "", len(body))[:attempts]
                if not ranked:
                    rows.append((path, 0, None, 0.0, ["no_eligible_parser"], "rejected", None))
                for n, parser in enumerate(ranked):
                    found, failures, quality = _attempt(parser, body)
                    good = quality >= accept and not failures
                    decision = "accept" if good else "fallback" if n + 1 < len(ranked) and (quality < accept or quality >= fallback) else "quarantine"
                    shown = [{"id": f"b{k}", "type": t, "level": level, "text": text, "start": a, "end": b} for _, k, t, level, text, a, b in B._rows(path, found)] if good else None
                    rows.append((path, n, parser.parser_id, quality, failures, decision, shown))
                    if decision != "fallback":
                        break
            yield pd.DataFrame(rows, columns=["path", "attempt", "parser_id", "quality", "failures", "decision", "blocks"])

    return files.select("path", "media_type", "content").mapInPandas(run, PARSED)


def document_ir(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Accepted parses as documents: document_id, source (resource, digest, media_type), parser_id, blocks, bound to the bytes they came from."""
    own = files.select("path", "media_type", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))
    done = parsed.filter("decision = 'accept'").join(own, "path")
    return done.select(F.concat(F.lit("document-"), F.substring("digest", 8, 16)).alias("document_id"), F.struct(F.col("path").alias("resource"), "digest", "media_type").alias("source"), "parser_id", "blocks")


def quality_report(components: Column) -> Column:
    """A map of component scores (null: not applicable) as a sorted array."""
    return F.array_sort(F.transform(F.map_entries(components), lambda x: F.struct(x["key"].alias("name"), x["value"].isNotNull().alias("applicable"), x["value"].alias("score"), F.when(x["value"].isNotNull(), "measured").otherwise("not applicable to format profile").alias("reason"))))


def distill(blocks: DataFrame, key: str, distiller: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any distiller of one document's blocks, run over all documents; mappings must name blocks of the document (an unknown block fails the row's check)."""
    made = blocks.groupBy(key).applyInPandas(distiller, schema)
    known = blocks.groupBy(key).agg(F.collect_set("block_id").alias("known"))
    return made.join(known, key).withColumn("bound", F.size(F.array_except("block_ids", "known")) == 0).drop("known")


def synthesize(ledger: DataFrame, group: str, synthesizer: Callable[[list[dict]], list[str]]) -> DataFrame:
    """(group, claim_ids, answer): a synthesiser picks and orders claims (claim_id, text, citation) of its group's verified ledger; ids of no ledger claim are dropped and counted."""
    listed = ledger.filter("verified").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", "claim_id", "text", "citation"))).alias("claims"))

    @F.pandas_udf("array<string>")
    def pick(claims: pd.Series) -> pd.Series:
        return pd.Series([[str(x) for x in synthesizer([dict(c) if isinstance(c, dict) else c.asDict() for c in own])] for own in claims])

    rows = listed.withColumn("picked", pick("claims"))
    known = F.filter("picked", lambda x: F.exists("claims", lambda c: c["claim_id"] == x))
    line = lambda x: F.concat(x["text"], F.lit(" ["), x["citation"], F.lit("]"))
    told = F.array_join(F.transform(known, lambda x: line(F.filter(F.col("claims"), lambda c: c["claim_id"] == x)[0])), "\n")
    return rows.select(group, known.alias("claim_ids"), (F.size("picked") - F.size(known)).alias("dropped"), told.alias("answer"))


def restore_signature(content: Column, kind: Column) -> Column:
    """Files whose signature was blanked: five zero bytes before a PDF's version, four before a package's entry."""
    head = F.hex(F.substring(content, 1, 5))
    pdf = F.concat(F.unhex(F.lit("255044462D")), F.substring(content, 6, 2_147_483_647))
    docx = F.concat(F.unhex(F.lit("504B0304")), F.substring(content, 5, 2_147_483_647))
    return F.when((kind == "pdf") & (head == "0000000000"), pdf).when((kind == "docx") & F.startswith(head, F.lit("00000000")), docx).otherwise(content)
