"""Contract queries of word-processing packages: every document's lines are written into a package, line i of it by i % 6 as a heading, a
list item, a link with text, a paragraph with a footnote, a table with merged cells and a table inside, or a paragraph with an image."""

from __future__ import annotations

import hashlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed
from factloom.plans.contract import _LINES, contract, lines
from factloom.sources import docx as D

PIXEL = b"\x89PNG one pixel"
_STYLES = '<w:style w:type="paragraph" w:styleId="Heading1"/><w:style w:type="paragraph" w:styleId="Kapitel"><w:outlineLvl w:val="1"/></w:style><w:style w:type="paragraph" w:styleId="Heading9"/>'
_NUMBERS = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num>'
_IMAGE = '<w:drawing><wp:inline><wp:extent cx="40" cy="30"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><a:blip r:embed="rImg"/></a:graphicData></a:graphic></wp:inline></w:drawing>'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _package(doc: str, texts: list[str]) -> bytes:
    body, notes, relations = [], [], [f'<Relationship Id="rImg" Type="{_REL}/image" Target="media/pixel.png"/>']
    run = lambda t: f"<w:r><w:t>{escape(t)}</w:t></w:r>"
    cell = lambda inner, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>"
    for i, text in enumerate(texts):
        kind, k = i % 6, i // 6
        words = text.split(" ")
        word = lambda n, words=words: f"<w:p>{run(words[n] if n < len(words) else '')}</w:p>"
        half = len(text) // 2
        if kind == 0:
            body.append(f'<w:p><w:pPr><w:pStyle w:val="{("Heading1", "Kapitel", "Heading9")[k % 3]}"/></w:pPr>{run(text[:half])}{run(text[half:])}</w:p>')
        elif kind == 1:
            body.append(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{k // 2 % 2}"/><w:numId w:val="{k % 2 + 1}"/></w:numPr></w:pPr>{run(text)}</w:p>')
        elif kind == 2:
            relations.append(f'<Relationship Id="r{i}" Type="{_REL}/hyperlink" Target="https://example.org/{doc}/{i}" TargetMode="External"/>')
            body.append(f'<w:p><w:hyperlink r:id="r{i}">{run(words[0])}</w:hyperlink>{run(text[len(words[0]) :])}</w:p>')
        elif kind == 3:
            notes.append(f'<w:footnote w:id="{i}"><w:p>{run(f"Note {i}")}</w:p><w:p>{run(f"of {doc} ")}</w:p></w:footnote>')
            body.append(f'<w:p>{run(text)}<w:r><w:footnoteReference w:id="{i}"/></w:r></w:p>')
        elif kind == 4:
            inner = f"<w:tbl><w:tr>{cell(word(3))}{cell(word(4))}</w:tr></w:tbl>"
            rows = [cell(word(0), '<w:gridSpan w:val="2"/>') + cell(word(1), '<w:vMerge w:val="restart"/>'), cell(word(2)) + cell(inner) + cell(word(5), "<w:vMerge/>"), cell(word(6)) + cell(word(7)) + cell(word(8))]
            body.append("<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>")
        else:
            body.append(f"<w:p>{run(text)}<w:r>{_IMAGE}</w:r></w:p>")
    return D.write_package("".join(body), _STYLES, _NUMBERS, "".join(notes), relations="".join(relations), types='<Default Extension="png" ContentType="image/png"/>', media={"word/media/pixel.png": PIXEL})


def packages(spark, d) -> DataFrame:
    """(path, content): a package for each document that has lines."""
    clean = D._stripped(F.regexp_replace("text", r"[\x00-\x08\x0e-\x1f\x{fffe}\x{ffff}]", ""))
    rows = lines(spark, d).select("doc_id", "line_no", clean.alias("text")).filter("text <> ''")
    texts = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"))

    def write(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["doc_id"].astype(str), "content": [_package(str(k), list(t)) for k, t in zip(frame["doc_id"], frame["texts"], strict=True)]})

    return texts.mapInPandas(write, "path string, content binary")


_SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _word(n: int) -> str:
    return _sql_strip(f"coalesce(w[{n + 1}], '')")


_PACKED = rf"""{_LINES}, c AS (SELECT doc_id, line_no, {_sql_strip(r"regexp_replace(text, '[\x00-\x08\x0e-\x1f\x{fffe}\x{ffff}]', '', 'g')")} AS text FROM blocks),
l AS (SELECT CAST(doc_id AS VARCHAR) AS doc, text, string_split(text, ' ') AS w, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i FROM c WHERE text <> ''),
g AS (SELECT doc, i, {", ".join(f"{_word(n)} AS w{n}" for n in range(9))} FROM l WHERE i % 6 = 4),
h AS (SELECT *, concat_ws(chr(9), nullif(w3, ''), nullif(w4, '')) AS inside FROM g)"""


@contract(f"""WITH {_PACKED},
b AS (SELECT doc, i, 1 AS half, CASE i % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' ELSE 'paragraph' END AS type, CASE WHEN i % 6 = 0 THEN [1, 2, 6][i // 6 % 3 + 1] END AS level, CASE WHEN i % 6 = 2 THEN {_sql_strip("substr(text, length(w[1]) + 1)")} ELSE text END AS text,
  CASE WHEN i % 6 = 1 THEN concat(i // 12 % 2, '/', i // 6 % 2 + 1, '/', CASE i // 6 % 2 WHEN 0 THEN ['decimal', 'bullet'][i // 12 % 2 + 1] ELSE ['lowerLetter', 'unknown'][i // 12 % 2 + 1] END) ELSE '' END AS said FROM l WHERE i % 6 <> 4
UNION ALL SELECT doc, i, 0, 'link', NULL, {_sql_strip("w[1]")}, 'external-hyperlink/https://example.org/' || doc || '/' || i FROM l WHERE i % 6 = 2
UNION ALL SELECT doc, i, 2, 'footnote', NULL, 'Note ' || i || chr(10) || 'of ' || doc, 'footnote/' || i FROM l WHERE i % 6 = 3
UNION ALL SELECT doc, i, 2, 'image', NULL, '', 'embedded-image/image/png/sha256:{hashlib.sha256(PIXEL).hexdigest()}/40/30' FROM l WHERE i % 6 = 5
UNION ALL SELECT doc, i, 1, 'table', NULL, concat_ws(chr(10), nullif(concat_ws(chr(9), nullif(w0, ''), nullif(w1, '')), ''), nullif(concat_ws(chr(9), nullif(w2, ''), nullif(inside, '')), ''), nullif(concat_ws(chr(9), nullif(w6, ''), nullif(w7, ''), nullif(w8, '')), '')), '3' FROM h),
o AS (SELECT *, row_number() OVER p - 1 AS ordinal, CAST(sum(length(text) + 1) OVER p - length(text) - 1 AS BIGINT) AS start FROM b WHERE type <> 'paragraph' OR text <> '' WINDOW p AS (PARTITION BY doc ORDER BY i, half))
SELECT doc, ordinal, type, level, text, start, start + length(text) AS "end", said FROM o""")
def docx_blocks(spark, d):
    fields = ("list_level", "list_id", "list_format", "relationship", "target", "note_kind", "note_id", "content_type", "digest", "width", "height", "columns")
    said = F.concat_ws("/", *[F.try_element_at("attributes", F.lit(f)) for f in fields])
    return D.docx_blocks(packages(spark, d)).select("doc", "ordinal", "type", "level", "text", "start", "end", F.coalesce(said, F.lit("")).alias("said"))


@contract(f"""WITH {_PACKED}, n AS (SELECT *, i // 6 AS table_no FROM h)
SELECT doc, table_no, depth, row_no, col, col_span, row_span, nested, text FROM (
  SELECT doc, table_no, 0 AS depth, unnest([0, 0, 1, 1, 2, 2, 2]) AS row_no, unnest([0, 2, 0, 1, 0, 1, 2]) AS col, unnest([2, 1, 1, 1, 1, 1, 1]) AS col_span, unnest([1, 2, 1, 1, 1, 1, 1]) AS row_span, unnest([0, 0, 0, 1, 0, 0, 0]) AS nested, unnest([w0, w1, w2, inside, w6, w7, w8]) AS text FROM n
  UNION ALL SELECT doc, table_no, 1, 0, unnest([0, 1]), 1, 1, 0, unnest([w3, w4]) FROM n)""")
def docx_cells(spark, d):
    cells = D.table_cells(checkpointed(D.shred(packages(spark, d), tags=D.CELL_TAGS)))
    number = F.dense_rank().over(Window.partitionBy("doc", "depth").orderBy("tbl")) - 1
    return cells.select("doc", number.alias("table_no"), "depth", "row_no", "col", "col_span", "row_span", "nested", "text")


@contract(f"""WITH {_PACKED} SELECT doc, count(*) FILTER (i % 6 = 4) * 2 AS tables, count(*) FILTER (i % 6 = 4) * 4 AS rows, count(*) FILTER (i % 6 = 4) * 9 AS cells, count(*) FILTER (i % 6 = 4) AS nested FROM l GROUP BY 1 HAVING nested > 0""")
def docx_table_sizes(spark, d):
    return D.table_sizes(checkpointed(D.shred(packages(spark, d), tags=D.GRID_TAGS)))
