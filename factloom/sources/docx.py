"""Word-processing packages as relations.

``shred`` is the only step that runs in Python: it opens a package and gives its parts and the elements of its XML parts as
rows, each with the elements that enclose it. All that a reader has to know is then joins, windows and aggregates over
these rows: relationships by id, numbering in two hops (number, abstract number, level), notes by reference, pieces of
paragraphs between links, notes and images, and the grid of a table with its merged cells and nested tables.

A file that is no package, a part that is no XML or declares a document type, a package over ``MOST_BYTES`` when
unpacked, ids that occur twice, links, notes and images that lead nowhere are faults: ``faults`` names them, and
``blocks`` gives nothing for such a file. Null contents are no package; an empty table gives empty relations.
"""

from __future__ import annotations

import functools
import hashlib
import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed

#: Bytes of a package's parts together, unpacked.
MOST_BYTES = 1 << 28
#: Rows that leave a task together.
BATCH = 20_000

# Name spaces of the format by the prefix used here, and the parts that are read.
SPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w:",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r:",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel:",
    "http://schemas.openxmlformats.org/package/2006/content-types": "type:",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a:",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp:",
    "http://schemas.microsoft.com/office/word/2010/wordprocessingShape": "wps:",
}
DOCUMENT, STYLES, NUMBERING, FOOTNOTES, ENDNOTES = (f"word/{n}.xml" for n in ("document", "styles", "numbering", "footnotes", "endnotes"))
RELATIONS, TYPES = "word/_rels/document.xml.rels", "[Content_Types].xml"
READ = (DOCUMENT, STYLES, NUMBERING, FOOTNOTES, ENDNOTES, RELATIONS, TYPES)
DIAGRAM, SHAPE, PICTURE = "http://schemas.openxmlformats.org/drawingml/2006/diagram", "http://schemas.microsoft.com/office/word/2010/wordprocessingShape", "http://schemas.openxmlformats.org/drawingml/2006/picture"
#: Formatting, which says nothing about the blocks.
SKIPPED = {"w:rPr", "w:sectPr", "w:tblPr", "w:trPr"}

#: Of an element: its number in its part, its parent's, and those of the nearest paragraph, the outermost paragraph of its cell or body, link, drawing, cell, row and table around it.
NODES = "doc string, part string, node int, parent int, tag string, attributes map<string,string>, text string, p int, top int, link int, drawing int, cell int, row int, tbl int"
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_AROUND = {"w:p", "w:hyperlink", "w:drawing", "w:tc", "w:tr", "w:tbl"}
_NOWHERE: tuple = (None,) * 7
_NONE: dict[str, str] = {}


@functools.lru_cache(1 << 14)
def _short(name: str) -> str:
    space, _, local = name.rpartition("}")
    return SPACES.get(space[1:], space[1:] + " " if space else "") + local


def _elements(root: ElementTree.Element):
    """(node, parent, tag, attributes, text, p, top, link, drawing, cell, row, tbl) of all elements, in document order."""
    todo, number = [(root, None, _NOWHERE)], 0
    while todo:
        element, parent, around = todo.pop()
        tag = _short(element.tag)
        if tag in SKIPPED:
            continue
        if tag in _AROUND:
            p, top, link, drawing, cell, row, tbl = around
            if tag == "w:p":
                p, top = number, number if top is None else top
            elif tag == "w:hyperlink":
                link = number
            elif tag == "w:drawing":
                drawing = number
            elif tag == "w:tr":
                row = number
            elif tag == "w:tc":
                p, top, cell = None, None, number
            else:
                p, top, tbl = None, None, number
            around = (p, top, link, drawing, cell, row, tbl)
        yield number, parent, tag, {_short(k): v for k, v in element.attrib.items()} if element.attrib else _NONE, element.text, *around
        todo.extend([(child, number, around) for child in reversed(element)])
        number += 1


def _package(body: bytes | None, tags: frozenset[str] | None = None) -> list[tuple]:
    """Rows (part, node, parent, tag, attributes, text, what is around it); a row of tag ``!`` is a fault, ``#`` a part. ``tags``: only these elements."""
    fault = lambda why, part=None: (part, None, None, "!", _NONE, why, *_NOWHERE)
    out: list[tuple] = []
    try:
        with zipfile.ZipFile(io.BytesIO(body or b"")) as z:
            entries = [e for e in z.infolist() if not e.is_dir()]
            if sum(e.file_size for e in entries) > MOST_BYTES:
                return [fault("package_too_large")]
            names = [e.filename for e in entries]
            if len(set(names)) < len(names):
                out.append(fault("part_repeated"))
            for entry in entries:
                with z.open(entry) as f:
                    content = f.read(entry.file_size + 1)
                out.append((entry.filename, None, None, "#", {"digest": "sha256:" + hashlib.sha256(content).hexdigest(), "bytes": str(len(content))}, None, *_NOWHERE))
                if entry.filename not in READ:
                    continue
                if b"<!DOCTYPE" in content:
                    out.append(fault("part_declares_type", entry.filename))
                    continue
                try:
                    out.extend([(entry.filename, *row) for row in _elements(ElementTree.fromstring(content)) if tags is None or row[2] in tags])
                except ElementTree.ParseError:
                    out.append(fault("part_malformed", entry.filename))
            out += [fault("part_missing", part) for part in (DOCUMENT, RELATIONS) if part not in names]
    except (zipfile.BadZipFile, NotImplementedError, OSError, RuntimeError, EOFError, ValueError):
        return [fault("no_package")]
    return out


def shred(files: DataFrame, key: str = "path", content: str = "content", tags: tuple[str, ...] | None = None) -> DataFrame:
    """Parts, elements and faults of packages (columns of NODES). ``tags``: elements of other tags need not leave the task, as a reader that asks for
    these alone does not look at them; numbers stay what they are."""
    wanted = None if tags is None else frozenset(tags)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc": pa.string(), "part": pa.string(), "tag": pa.string(), "text": pa.string(), "attributes": pa.map_(pa.string(), pa.string())}
        columns = dict(zip(_COLUMNS, zip(*rows, strict=True), strict=True))
        columns["attributes"] = [list(m.items()) for m in columns["attributes"]]
        return pa.record_batch([pa.array(columns[n], kinds.get(n, pa.int32())) for n in _COLUMNS], names=_COLUMNS)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for doc, body in zip(*batch.columns, strict=True):
                doc = doc.as_py()
                for row in _package(body.as_py(), wanted):
                    rows.append((doc, *row))
                    if len(rows) >= BATCH:
                        yield told(rows)
                        rows = []
        if rows:
            yield told(rows)

    return files.select(F.col(key).cast("string").alias("doc"), F.col(content)).mapInArrow(run, NODES)


def _value(name: str = "w:val") -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _told(order: str, text: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def relationships(nodes: DataFrame) -> DataFrame:
    """doc, id, kind (last step of its type), target (as a part, unless external), external, copies."""
    rows = nodes.filter((F.col("part") == RELATIONS) & (F.col("tag") == "rel:Relationship"))
    target = F.coalesce(_value("Target"), F.lit(""))
    part = F.regexp_replace(F.when(target.startswith("/"), F.substring(target, 2, 1 << 20)).otherwise(F.concat(F.lit("word/"), target)), r"[^/]+/\.\./", "")
    external = F.coalesce(_value("TargetMode") == "External", F.lit(False))
    kind = F.element_at(F.split(F.coalesce(_value("Type"), F.lit("")), "/"), -1)
    rows = rows.select("doc", _value("Id").alias("id"), kind.alias("kind"), F.when(external, target).otherwise(part).alias("target"), external.alias("external"))
    return rows.groupBy("doc", "id").agg(F.first("kind").alias("kind"), F.min("target").alias("target"), F.first("external").alias("external"), F.count("*").alias("copies"))


def _level(number: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), number)).cast("int")


def heading_styles(nodes: DataFrame) -> DataFrame:
    """doc, style, level: an outline level of its own, else a name of ``Heading`` and a number."""
    own = nodes.filter(F.col("part") == STYLES)
    outline = own.filter((F.col("tag") == "w:outlineLvl") & _value().rlike(r"^[0-9]{1,9}\z")).groupBy("doc", "parent").agg(F.min_by(_value(), "node").cast("int").alias("outline"))
    styles = own.filter((F.col("tag") == "w:style") & (_value("w:type") == "paragraph")).select("doc", F.col("node").alias("parent"), "node", _value("w:styleId").alias("style"))
    named = F.regexp_extract("style", r"^Heading([0-9]{1,9})\z", 1)
    level = F.when(F.col("outline").isNotNull(), _level(F.col("outline") + 1)).when(named != "", _level(named.try_cast("int")))
    return styles.join(outline, ["doc", "parent"], "left").groupBy("doc", "style").agg(F.max_by(level, F.when(level.isNotNull(), F.col("node"))).alias("level")).filter("level is not null")


def numbering(nodes: DataFrame) -> DataFrame:
    """doc, num, ilvl, format: a number names an abstract number, whose levels name their formats."""
    own = nodes.filter(F.col("part") == NUMBERING)
    within = lambda tag, name: own.filter(F.col("tag") == tag).groupBy("doc", F.col("parent").alias("node")).agg(F.min_by(_value(), "node").alias(name))
    level = own.filter((F.col("tag") == "w:lvl") & _value("w:ilvl").rlike(r"^[0-9]{1,9}\z")).select("doc", "node", F.col("parent").alias("holder"), _value("w:ilvl").cast("int").alias("ilvl"))
    level = level.join(within("w:numFmt", "format"), ["doc", "node"]).filter("format <> ''")
    holder = own.filter(F.col("tag") == "w:abstractNum").select("doc", F.col("node").alias("holder"), _value("w:abstractNumId").alias("abstract"))
    last = holder.groupBy("doc", "abstract").agg(F.max("holder").alias("holder"))
    levels = level.join(last, ["doc", "holder"]).groupBy("doc", "abstract", "ilvl").agg(F.max_by("format", "node").alias("format"))
    nums = own.filter(F.col("tag") == "w:num").select("doc", "node", _value("w:numId").alias("num")).join(within("w:abstractNumId", "abstract"), ["doc", "node"])
    return nums.groupBy("doc", "num").agg(F.max_by("abstract", "node").alias("abstract")).join(levels, ["doc", "abstract"]).select("doc", "num", "ilvl", "format")


def notes(nodes: DataFrame) -> DataFrame:
    """doc, note_kind, note_id, text: paragraphs of foot- and endnotes of positive number, by lines."""
    own = nodes.filter(F.col("part").isin(FOOTNOTES, ENDNOTES))
    said = own.filter("tag = 'w:t'").groupBy("doc", "part", F.col("top").alias("node")).agg(_told("node", "text").alias("text"))
    held = own.filter("tag = 'w:p'").select("doc", "part", "node", F.col("parent").alias("note")).join(said, ["doc", "part", "node"]).withColumn("text", _stripped(F.col("text"))).filter("text <> ''")
    kind = F.when(F.col("part") == FOOTNOTES, "footnote").otherwise("endnote")
    note = own.filter(F.col("tag") == F.concat(F.lit("w:"), kind)).filter(_value("w:id").rlike(r"^-*[0-9]{1,9}\z")).select("doc", "part", F.col("node").alias("note"), _value("w:id").alias("note_id")).filter(F.expr("try_cast(note_id as int) > 0"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "\n")
    each = held.join(note, ["doc", "part", "note"]).groupBy("doc", "part", "note", "note_id").agg(text.alias("text"))
    return each.groupBy("doc", "part", "note_id").agg(F.max_by("text", "note").alias("text")).select("doc", kind.alias("note_kind"), "note_id", "text")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """doc, node, kind, level, list_level, list_id, list_format of the body's paragraphs: lists before headings before the rest."""
    own = nodes.filter(F.col("part") == DOCUMENT)
    body = own.filter("tag = 'w:body'").select("doc", F.col("node").alias("parent"))
    rows = own.filter("tag = 'w:p'").join(body, ["doc", "parent"]).select("doc", "node")
    said = own.filter(F.col("tag").isin("w:pStyle", "w:numId", "w:ilvl")).groupBy("doc", F.col("top").alias("node")).agg(*[F.min_by(F.when(F.col("tag") == t, _value()), F.when(F.col("tag") == t, F.col("node"))).alias(n) for t, n in (("w:pStyle", "style"), ("w:numId", "num"), ("w:ilvl", "raw"))])
    rows = rows.join(said, ["doc", "node"], "left").withColumn("ilvl", F.when(F.col("raw").rlike(r"^[0-9]{1,9}\z"), F.col("raw")).cast("int"))
    rows = rows.join(numbering(nodes), ["doc", "num", "ilvl"], "left").join(heading_styles(nodes), ["doc", "style"], "left")
    listed = F.col("num").isNotNull() & F.col("ilvl").isNotNull()
    kind = F.when(listed, "list").when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    of_list = lambda c: F.when(listed, c)
    return rows.select("doc", "node", kind.alias("kind"), F.when(~listed, F.col("level")).alias("level"), of_list(F.col("ilvl")).alias("list_level"), of_list(F.col("num")).alias("list_id"), of_list(F.coalesce("format", F.lit("unknown"))).alias("list_format"))


def hyperlinks(nodes: DataFrame) -> DataFrame:
    """doc, node, text, relationship, target, problem of the body's links.

    A link goes to an anchor or, by its id, to an external hyperlink. Its text is that of its runs (tabs kept); a field in it
    begins, has an instruction, is separated, shows something and ends, in this order.
    """
    own = nodes.filter(F.col("part") == DOCUMENT)
    links = own.filter("tag = 'w:hyperlink'").select("doc", "node", _value("r:id").alias("id"), _value("w:anchor").alias("anchor"))
    field = F.element_at(F.create_map(*[F.lit(x) for x in ("begin", "b", "separate", "s", "end", "e")]), _value("w:fldCharType"))
    runs = own.filter("tag = 'w:r'").select("doc", F.col("node").alias("parent"), F.col("parent").alias("holder"))
    inner = own.filter("link is not null and tag not in ('w:hyperlink', 'w:r')").join(runs, ["doc", "parent"], "left")
    sign = F.when(F.col("tag") == "w:fldChar", F.coalesce(field, F.lit("?"))).when(F.col("tag") == "w:instrText", "i").when((F.col("tag") == "w:t") & (_stripped(F.col("text")) != ""), "t").when(F.col("tag").isin("w:t", "w:tab", "w:lastRenderedPageBreak"), "o").otherwise("?")
    shown = F.when(F.col("tag") == "w:t", F.coalesce("text", F.lit(""))).when(F.col("tag") == "w:tab", "\t").otherwise("")
    inner = inner.select("doc", F.col("link").alias("node"), F.col("node").alias("at"), F.when(F.col("holder") == F.col("link"), sign).otherwise("?").alias("sign"), shown.alias("shown"))
    said = inner.groupBy("doc", "node").agg(_told("at", "sign").alias("signs"), _stripped(_told("at", "shown")).alias("text"))
    rows = links.join(said, ["doc", "node"], "left").join(relationships(nodes), ["doc", "id"], "left")
    resolved = F.col("id").isNull() | F.coalesce((F.col("kind") == "hyperlink") & F.col("external"), F.lit(False))
    problem = F.when(F.col("id").isNull() & F.col("anchor").isNull(), "link_without_target").when(~resolved, "link_unresolved").when(~F.coalesce(F.col("signs"), F.lit("")).rlike(r"^(?:[to]|bis[to]*t[to]*e)*\z"), "link_malformed").when(F.coalesce("text", F.lit("")) == "", "link_without_text")
    return rows.select("doc", "node", "text", F.when(F.col("id").isNotNull(), "external-hyperlink").otherwise("internal-anchor").alias("relationship"), F.coalesce("target", "anchor").alias("target"), problem.alias("problem"))


def drawings(nodes: DataFrame) -> DataFrame:
    """doc, node, kind (image, text or nothing), text, relationship, content_type, digest, width, height, problem of the body's drawings."""
    own = nodes.filter(F.col("part") == DOCUMENT)
    first = lambda tag, value: F.min_by(F.when(F.col("tag") == tag, value), F.when(F.col("tag") == tag, F.col("node")))
    size = lambda name: first("wp:extent", F.when(_value(name).rlike(r"^[0-9]{1,18}\z"), _value(name)).cast("long"))
    rows = own.filter("drawing is not null").groupBy("doc", F.col("drawing").alias("node")).agg(first("a:graphicData", _value("uri")).alias("uri"), F.count_if(F.col("tag") == "a:graphicData").alias("graphics"), F.count_if(F.col("tag") == "a:blip").alias("blips"), first("a:blip", _value("r:embed")).alias("id"), first("a:blip", _value("r:link")).alias("other"), size("cx").alias("width"), size("cy").alias("height"))
    boxed = own.filter("tag = 'w:t' and drawing is not null").groupBy("doc", F.col("drawing").alias("node"), "p").agg(_stripped(_told("node", "text")).alias("text")).filter("text <> ''")
    boxed = boxed.groupBy("doc", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("text"))
    parts = nodes.filter("tag = '#'").select("doc", F.col("part").alias("target"), _value("digest").alias("digest"))
    types = nodes.filter(F.col("part") == TYPES)
    override = types.filter("tag = 'type:Override'").groupBy("doc", F.substring(_value("PartName"), 2, 1 << 20).alias("target")).agg(F.max_by(_value("ContentType"), "node").alias("own_type"))
    default = types.filter("tag = 'type:Default'").groupBy("doc", F.lower(_value("Extension")).alias("extension")).agg(F.max_by(_value("ContentType"), "node").alias("any_type"))
    rel = relationships(nodes)
    linked = rel.select("doc", F.col("id").alias("other"), ((F.col("kind") == "image") & F.col("external")).alias("linked"))
    rows = rows.join(rel.select("doc", "id", "kind", "target", "external"), ["doc", "id"], "left").join(linked, ["doc", "other"], "left").join(boxed, ["doc", "node"], "left").join(parts, ["doc", "target"], "left").join(override, ["doc", "target"], "left")
    rows = rows.withColumn("extension", F.lower(F.element_at(F.split("target", r"\."), -1))).join(default, ["doc", "extension"], "left")
    picture, shape = F.col("uri") == PICTURE, F.col("uri") == SHAPE
    embedded = F.coalesce((F.col("kind") == "image") & ~F.col("external") & F.col("digest").isNotNull(), F.lit(False))
    problem = F.when((F.col("graphics") != 1) | ~F.coalesce(F.col("uri").isin(PICTURE, SHAPE, DIAGRAM), F.lit(False)), "drawing_unknown").when(picture & ((F.col("blips") != 1) | F.coalesce("id", "other").isNull()), "image_without_source").when(picture & ((F.col("id").isNotNull() & ~embedded) | (F.col("other").isNotNull() & ~F.coalesce("linked", F.lit(False)))), "image_unresolved")
    here = picture & F.col("id").isNotNull()
    return rows.select("doc", "node", F.when(picture, "image").when(shape & F.col("text").isNotNull(), "text").alias("kind"), F.when(shape, F.col("text")).alias("text"), F.when(picture, F.when(here, "embedded-image").otherwise("external-linked-image")).alias("relationship"), F.when(here, F.coalesce("own_type", "any_type")).alias("content_type"), F.when(here, F.col("digest")).alias("digest"), F.when(here, F.col("width")).alias("width"), F.when(here, F.col("height")).alias("height"), problem.alias("problem"))


# Tables


def _grid(rows: DataFrame) -> DataFrame:
    """Cells (doc, tbl, row_no, cell, col, col_span, merge) with ``origin``: the cell that a continued cell belongs to, else the cell itself.

    The fold goes over a table's cells in order; its state are the merges that are open above and those opened in this row:
    a cell continues the merge that covers its first column in the row above.
    """
    shape = "struct<a:int,z:int,origin:int>"
    cells = F.array_sort(F.collect_list(F.struct("row_no", "col", "cell", "col_span", "merge")))
    state = F.struct(F.lit(-1).alias("row_no"), F.array().cast(f"array<{shape}>").alias("above"), F.array().cast(f"array<{shape}>").alias("here"), F.array().cast("array<int>").alias("out"))

    def step(now: Column, x: Column) -> Column:
        begins = now["row_no"] != x["row_no"]
        fresh = x["row_no"] == now["row_no"] + 1
        above = F.when(begins, F.when(fresh, now["here"]).otherwise(F.array().cast(f"array<{shape}>"))).otherwise(now["above"])
        here = F.when(begins, F.array().cast(f"array<{shape}>")).otherwise(now["here"])
        met = F.filter(above, lambda m: (m["a"] <= x["col"]) & (x["col"] < m["z"]))
        goes_on = (x["merge"] == "continue") & (F.size(met) > 0)
        origin = F.when(goes_on, F.element_at(F.transform(met, lambda m: m["origin"]), -1)).otherwise(x["cell"])
        span = F.struct(x["col"].alias("a"), (x["col"] + x["col_span"]).alias("z"), origin.alias("origin"))
        opens = goes_on | (x["merge"] == "restart")
        return F.struct(x["row_no"].alias("row_no"), above.alias("above"), F.when(opens, F.concat(here, F.array(span))).otherwise(here).alias("here"), F.concat(now["out"], F.array(origin)).alias("out"))

    met = rows.groupBy("doc", "tbl").agg(cells.alias("cells")).withColumn("origins", F.aggregate("cells", state, step, lambda s: s["out"]))
    return met.select("doc", "tbl", F.explode(F.arrays_zip("cells", "origins")).alias("x")).select("doc", "tbl", "x.cells.*", F.col("x.origins").alias("origin"))


def _placed(nodes: DataFrame) -> DataFrame:
    """Cells (doc, tbl, row_no, cell, col, col_span, merge) of all tables, continued ones too; row_no and col from 0."""
    own = nodes.filter(F.col("part") == DOCUMENT)
    rows = own.filter("tag = 'w:tr'").select("doc", "tbl", "node", "parent").filter("parent = tbl").select("doc", "tbl", F.col("node").alias("row"), (F.row_number().over(Window.partitionBy("doc", "tbl").orderBy("node")) - 1).alias("row_no"))
    span = F.when((F.col("tag") == "w:gridSpan") & _value().rlike(r"^[0-9]{1,9}\z"), F.greatest(F.lit(1), _value().cast("int")))
    merge = F.when(F.col("tag") == "w:vMerge", F.when(_value() == "restart", "restart").otherwise("continue"))
    props = own.filter(F.col("tag").isin("w:gridSpan", "w:vMerge")).groupBy("doc", "cell").agg(F.min_by(span, F.when(span.isNotNull(), F.col("node"))).alias("col_span"), F.min_by(merge, F.when(merge.isNotNull(), F.col("node"))).alias("merge"))
    cells = own.filter("tag = 'w:tc' and parent = row").select("doc", "tbl", "row", F.col("node").alias("cell")).join(rows, ["doc", "tbl", "row"]).join(props, ["doc", "cell"], "left")
    cells = cells.withColumn("col_span", F.coalesce("col_span", F.lit(1))).withColumn("merge", F.coalesce("merge", F.lit("")))
    before = Window.partitionBy("doc", "tbl", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum("col_span").over(before), F.lit(0)).cast("int"))


def table_grid(nodes: DataFrame) -> DataFrame:
    """doc, tbl, outer (the cell around the table, or null), row_no, cell, col, col_span, row_span: cells that are no continuation."""
    placed = _grid(_placed(nodes))
    spans = placed.groupBy("doc", "tbl", F.col("origin").alias("cell")).agg(F.count("*").cast("int").alias("row_span"))
    kept = placed.filter("origin = cell").join(spans, ["doc", "tbl", "cell"])
    outer = nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "w:tbl")).select("doc", "tbl", F.col("cell").alias("outer"))
    return kept.join(outer, ["doc", "tbl"]).select("doc", "tbl", "outer", "row_no", "cell", "col", "col_span", "row_span")


def _lines(order: str, text: str = "text", by: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def _tables(nodes: DataFrame) -> DataFrame:
    """doc, tbl, outer, around (the table around it) of tables that stand in the body or in a cell, not in what a cell wraps."""
    own = nodes.filter(F.col("part") == DOCUMENT)
    body = own.filter("tag = 'w:body'").select("doc", F.col("node").alias("body"))
    tables = own.filter("tag = 'w:tbl'").join(body, "doc").filter("parent = coalesce(cell, body)").select("doc", "tbl", F.col("cell").alias("outer"))
    cells = own.filter("tag = 'w:tc'").select("doc", F.col("cell").alias("outer"), F.col("tbl").alias("around"))
    return tables.join(cells, ["doc", "outer"], "left").select("doc", "tbl", "outer", "around")


def table_cells(nodes: DataFrame) -> DataFrame:
    """The grid with depth, nested (tables in the cell) and text: a cell's paragraphs and its tables' texts, by lines in order.

    A table's text are its rows by lines, their non-empty cells by tabs; nested tables are read first, one round a depth.
    """
    own = nodes.filter(F.col("part") == DOCUMENT)
    grid, tables = checkpointed(table_grid(nodes)), checkpointed(_tables(nodes))
    said = own.filter("tag = 'w:t' and cell is not null").groupBy("doc", "cell", F.col("top").alias("at")).agg(_stripped(_told("node", "text")).alias("text")).filter("text <> ''")
    direct = own.filter("tag = 'w:p' and parent = cell").select("doc", "cell", F.col("node").alias("at"))
    pieces = checkpointed(said.join(direct, ["doc", "cell", "at"]))
    levels = [tables.filter("around is null").select("doc", "tbl", F.lit(0).alias("depth"))]
    while True:
        above = levels[-1].select("doc", F.col("tbl").alias("around"), "depth")
        below = tables.join(above, ["doc", "around"]).select("doc", "tbl", (F.col("depth") + 1).alias("depth"))
        if below.isEmpty():
            break
        levels.append(below)
    done = []
    for level in reversed(levels):
        cells = grid.join(level, ["doc", "tbl"]).join(pieces.groupBy("doc", "cell").agg(_lines("at").alias("text")), ["doc", "cell"], "left")
        done.append(cells.withColumn("text", F.coalesce("text", F.lit(""))))
        inner = table_texts(done[-1].filter("outer is not null")).join(tables, ["doc", "tbl"])
        pieces = pieces.unionByName(inner.select("doc", F.col("outer").alias("cell"), F.col("tbl").alias("at"), "text"))
    out = done[0]
    for cells in done[1:]:
        out = out.unionByName(cells)
    nested = tables.filter("outer is not null").groupBy("doc", F.col("outer").alias("cell")).agg(F.count("*").alias("nested"))
    return out.join(nested, ["doc", "cell"], "left").withColumn("nested", F.coalesce("nested", F.lit(0)))


def table_texts(cells: DataFrame) -> DataFrame:
    """doc, tbl, text of tables with text."""
    rows = cells.filter("text <> ''").groupBy("doc", "tbl", "row_no").agg(_lines("cell", by="\t").alias("text"))
    return rows.groupBy("doc", "tbl").agg(_lines("row_no").alias("text"))


#: The elements that ``table_grid`` and ``table_sizes`` look at, and those of ``table_cells``.
GRID_TAGS = ("w:body", "w:tbl", "w:tr", "w:tc", "w:gridSpan", "w:vMerge")
CELL_TAGS = (*GRID_TAGS, "w:p", "w:t")


def table_sizes(nodes: DataFrame) -> DataFrame:
    """doc, tables, rows, cells, nested of all tables of a document, nested ones included."""
    own = nodes.filter(F.col("part") == DOCUMENT)
    rows = own.filter("tag = 'w:tr' and parent = tbl").join(_tables(nodes).select("doc", "tbl"), ["doc", "tbl"], "left_semi").groupBy("doc").agg(F.count("*").alias("rows"))
    tables = _tables(nodes).groupBy("doc").agg(F.count("*").alias("tables"), F.count("outer").alias("nested"))
    cells = table_grid(nodes).join(_tables(nodes).select("doc", "tbl"), ["doc", "tbl"], "left_semi").groupBy("doc").agg(F.count("*").alias("cells"))
    return tables.join(rows, "doc", "left").join(cells, "doc", "left").select("doc", "tables", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("cells", F.lit(0)).alias("cells"), "nested")


# Blocks


def _map(**fields: Column) -> Column:
    """The fields that are not null, as texts."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _items(nodes: DataFrame) -> DataFrame:
    """doc, p, at, kind (plain, link, footnote, image), text, attributes, problem: what the runs and links of the body's paragraphs hold, in order."""
    own = nodes.filter(F.col("part") == DOCUMENT)
    body = own.filter("tag = 'w:body'").select("doc", F.col("node").alias("parent"))
    top = own.filter("tag = 'w:p'").join(body, ["doc", "parent"]).select("doc", F.col("node").alias("parent"))
    runs = own.filter("tag = 'w:r'").join(top, ["doc", "parent"]).select("doc", F.col("node").alias("parent"), F.col("parent").alias("holder"))
    none, fine = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
    tokens = own.drop("p").join(runs, ["doc", "parent"]).select("doc", F.col("holder").alias("p"), F.col("node").alias("at"), "tag", "text", "attributes")
    plain = tokens.filter("tag = 'w:t'").select("doc", "p", "at", F.lit("plain").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), none.alias("attributes"), fine.alias("problem"))
    links = own.filter("tag = 'w:hyperlink'").join(top, ["doc", "parent"]).select("doc", F.col("parent").alias("p"), F.col("node").alias("at"))
    links = links.join(hyperlinks(nodes).withColumnRenamed("node", "at"), ["doc", "at"]).select("doc", "p", "at", F.lit("link").alias("kind"), "text", _map(relationship=F.col("relationship"), target=F.col("target")).alias("attributes"), "problem")
    kind = F.when(F.col("tag") == "w:footnoteReference", "footnote").otherwise("endnote")
    asked = tokens.filter(F.col("tag").isin("w:footnoteReference", "w:endnoteReference")).select("doc", "p", "at", kind.alias("note_kind"), _value("w:id").alias("note_id"))
    noted = asked.join(notes(nodes), ["doc", "note_kind", "note_id"], "left").select("doc", "p", "at", F.lit("footnote").alias("kind"), "text", _map(note_kind=F.col("note_kind"), note_id=F.col("note_id")).alias("attributes"), F.when(F.col("text").isNull(), "note_unresolved").alias("problem"))
    drawn = tokens.filter("tag = 'w:drawing'").select("doc", "p", "at").join(drawings(nodes).withColumnRenamed("node", "at"), ["doc", "at"]).filter("kind is not null or problem is not null")
    drawn = drawn.select("doc", "p", "at", F.when(F.col("kind") == "text", "plain").otherwise("image").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), _map(**{c: F.col(c) for c in ("relationship", "content_type", "digest", "width", "height")}).alias("attributes"), "problem")
    return plain.unionByName(links).unionByName(noted).unionByName(drawn)


def faults(nodes: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """doc, problem: why a file gives no blocks."""
    package = nodes.filter("tag = '!'").select("doc", F.col("text").alias("problem"))
    bodies = nodes.filter("tag = '#'").select("doc").distinct().join(nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "w:body")).select("doc"), "doc", "left_anti")
    twice = relationships(nodes).filter("copies > 1 or id is null").select("doc", F.lit("relationship_repeated").alias("problem"))
    inside = (_items(nodes) if items is None else items).filter("problem is not null").select("doc", "problem")
    return package.unionByName(bodies.select("doc", F.lit("body_missing").alias("problem"))).unionByName(twice).unionByName(inside).distinct()


def blocks(nodes: DataFrame) -> DataFrame:
    """doc, ordinal, type, level, text, start, end, attributes of the files without faults; ``nodes`` should be a written table, as it is read several times.

    A paragraph's plain text ends where a link, a note or an image stands: these are blocks of their own, and what follows is another one.
    """
    every = checkpointed(_items(nodes))
    upto = Window.partitionBy("doc", "p").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = every.withColumn("seg", F.sum(F.when(F.col("kind") != "plain", 1).otherwise(0)).over(upto))
    plain = marked.filter("kind = 'plain'").groupBy("doc", "p", "seg").agg(_stripped(_told("at", "text")).alias("text")).filter("text <> ''")
    styled = paragraphs(nodes).withColumnRenamed("node", "p")
    listed = _map(list_level=F.col("list_level"), list_id=F.col("list_id"), list_format=F.col("list_format"))
    plain = plain.join(styled, ["doc", "p"]).select("doc", "p", "seg", F.lit(1).alias("half"), F.col("kind").alias("type"), "level", "text", listed.alias("attributes"))
    no_level = F.lit(None).cast("int").alias("level")
    breaks = marked.filter("kind <> 'plain'").select("doc", "p", "seg", F.lit(0).alias("half"), F.col("kind").alias("type"), no_level, "text", "attributes")
    own = nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "w:tbl"))
    cells = checkpointed(table_cells(nodes).filter("outer is null"))
    texts = table_texts(cells)
    wide = checkpointed(_placed(nodes).groupBy("doc", "tbl").agg(F.max(F.col("col") + F.col("col_span")).alias("wide")))
    grid = nodes.filter((F.col("part") == DOCUMENT) & (F.col("tag") == "w:gridCol")).groupBy("doc", "tbl").agg(F.count("*").alias("columns"))
    shown = _tables(nodes).filter("outer is null").select("doc", "tbl").join(own.select("doc", "tbl"), ["doc", "tbl"]).join(texts, ["doc", "tbl"], "left").join(wide, ["doc", "tbl"], "left").join(grid, ["doc", "tbl"], "left")
    columns = F.greatest(F.coalesce("wide", F.lit(0)), F.coalesce("columns", F.lit(0)))
    tabled = shown.select("doc", F.col("tbl").alias("p"), F.lit(0).cast("long").alias("seg"), F.lit(0).alias("half"), F.lit("table").alias("type"), no_level, F.coalesce("text", F.lit("")).alias("text"), _map(columns=columns).alias("attributes"))
    rows = plain.unionByName(breaks).unionByName(tabled).join(faults(nodes, every).select("doc").distinct(), "doc", "left_anti")
    place = Window.partitionBy("doc").orderBy("p", "seg", "half")
    rows = rows.withColumn("ordinal", F.row_number().over(place) - 1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select("doc", "ordinal", "type", "level", "text", start.alias("start"), (start + F.length("text")).alias("end"), "attributes")


def docx_blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Blocks of packages in a table of files."""
    return blocks(checkpointed(shred(files, key, content)))


# Writing packages


def write_package(document: str, styles: str = "", numbers: str = "", footnotes: str = "", endnotes: str = "", relations: str = "", types: str = "", media: dict[str, bytes] | None = None) -> bytes:
    """A package of the given XML inside its parts' root elements."""
    names = " ".join(f'xmlns:{v[:-1]}="{k}"' for k, v in SPACES.items() if v in ("w:", "r:", "a:", "wp:", "wps:"))
    whole = lambda root, inner: f'<?xml version="1.0" encoding="UTF-8"?><w:{root} {names}>{inner}</w:{root}>'
    parts = {
        TYPES: f'<?xml version="1.0"?><Types xmlns="{next(k for k, v in SPACES.items() if v == "type:")}"><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        DOCUMENT: whole("document", f"<w:body>{document}</w:body>"),
        RELATIONS: f'<?xml version="1.0"?><Relationships xmlns="{next(k for k, v in SPACES.items() if v == "rel:")}">{relations}</Relationships>',
    }
    parts |= {part: whole(root, inner) for part, root, inner in ((STYLES, "styles", styles), (NUMBERING, "numbering", numbers), (FOOTNOTES, "footnotes", footnotes), (ENDNOTES, "endnotes", endnotes)) if inner}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in [*parts.items(), *(media or {}).items()]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()
