"""Word-processing packages against a second, sequential reader; grids, faults."""

import hashlib
import io
import random
import zipfile
from xml.etree import ElementTree

import pytest

from factloom.operators.graph import checkpointed
from factloom.sources import docx as D

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PICTURE, SHAPE, DIAGRAM = D.PICTURE, D.SHAPE, D.DIAGRAM


# A sequential reader


def said(element):
    return "".join(t.text or "" for t in element.iter(f"{W}t"))


def val(element, path):
    found = element.find(path)
    return None if found is None else found.get(f"{W}val")


def read_table(table):
    """(text, cells [(depth, row, col, col_span, row_span, nested, text)], columns)"""
    cells, lines, open_, own = [], [], {}, []
    columns = len(table.findall(f"{W}tblGrid/{W}gridCol"))
    for r, row in enumerate(table.findall(f"{W}tr")):
        col, now, told = 0, {}, []
        for cell in row.findall(f"{W}tc"):
            span = max(1, int(val(cell, f"{W}tcPr/{W}gridSpan") or 1))
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            parts, nested, inner = [], 0, []
            for child in cell:
                if child.tag == f"{W}p" and said(child).strip():
                    parts.append(said(child).strip())
                elif child.tag == f"{W}tbl":
                    text, below, _ = read_table(child)
                    nested, inner = nested + 1, inner + [(d + 1, *x) for d, *x in below]
                    parts += [text] * bool(text)
            cells += inner
            if merge is not None and merge.get(f"{W}val") != "restart" and col in open_:
                open_[col][4] += 1
                for c in range(col, col + span):
                    now[c] = open_[col]
            else:
                record = [0, r, col, span, 1, nested, "\n".join(parts)]
                own.append(record)
                told += [record[6]] * bool(record[6])
                if merge is not None and merge.get(f"{W}val") == "restart":
                    for c in range(col, col + span):
                        now[c] = record
            col += span
        lines += ["\t".join(told)] * bool(told)
        open_, columns = now, max(columns, col)
    return "\n".join(lines), cells + [tuple(x) for x in own], columns


def read(body):
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        part = {n: z.read(n) for n in z.namelist()}
    tree = lambda name: ElementTree.fromstring(part[name]) if name in part else ElementTree.Element("none")
    relation = {r.get("Id"): r for r in tree("word/_rels/document.xml.rels")}
    levels = {}
    for style in tree("word/styles.xml"):
        name, outline = style.get(f"{W}styleId"), val(style, f"{W}outlineLvl")
        if outline or name.startswith("Heading") and name[7:].isdigit():
            levels[name] = max(1, min(6, int(outline) + 1 if outline else int(name[7:])))
    abstract = {a.get(f"{W}abstractNumId"): {lvl.get(f"{W}ilvl"): val(lvl, f"{W}numFmt") for lvl in a.findall(f"{W}lvl")} for a in tree("word/numbering.xml").findall(f"{W}abstractNum")}
    numbers = {n.get(f"{W}numId"): abstract.get(val(n, f"{W}abstractNumId"), {}) for n in tree("word/numbering.xml").findall(f"{W}num")}
    note = {(kind, n.get(f"{W}id")): "\n".join(t for t in (said(p).strip() for p in n.findall(f"{W}p")) if t) for kind in ("footnote", "endnote") for n in tree(f"word/{kind}s.xml") if int(n.get(f"{W}id")) > 0}
    out, cells = [], []
    for child in tree("word/document.xml").find(f"{W}body"):
        if child.tag == f"{W}tbl":
            text, below, columns = read_table(child)
            cells += below
            out.append(("table", None, text, {"columns": str(columns)}))
        if child.tag != f"{W}p":
            continue
        num, ilvl, style = (val(child, f"{W}pPr/{W}{x}") for x in ("numPr/" + W + "numId", "numPr/" + W + "ilvl", "pStyle"))
        kind, level, fields = "paragraph", None, {}
        if num and ilvl:
            kind, fields = "list", {"list_level": ilvl, "list_id": num, "list_format": numbers.get(num, {}).get(ilvl, "unknown")}
        elif style in levels:
            kind, level = "heading", levels[style]
        held = []

        def flush(held=held, kind=kind, level=level, fields=fields):
            if "".join(held).strip():
                out.append((kind, level, "".join(held).strip(), fields))
            held.clear()

        for run in child:
            if run.tag == f"{W}hyperlink":
                flush()
                key = run.get(f"{R}id")
                text = "".join("\t" if t.tag == f"{W}tab" else t.text or "" for t in run.iter() if t.tag in (f"{W}t", f"{W}tab")).strip()
                out.append(("link", None, text, {"relationship": "external-hyperlink", "target": relation[key].get("Target")} if key else {"relationship": "internal-anchor", "target": run.get(f"{W}anchor")}))
            if run.tag != f"{W}r":
                continue
            for token in run:
                if token.tag == f"{W}t":
                    held.append(token.text or "")
                elif token.tag in (f"{W}footnoteReference", f"{W}endnoteReference"):
                    flush()
                    what = token.tag.removeprefix(W).removesuffix("Reference")
                    out.append(("footnote", None, note[what, token.get(f"{W}id")], {"note_kind": what, "note_id": token.get(f"{W}id")}))
                elif token.tag == f"{W}drawing":
                    blip = next((e for e in token.iter() if e.tag.endswith("}blip")), None)
                    boxes = [e for e in token.iter() if e.tag == f"{W}txbxContent"]
                    if boxes:
                        held.append("\n".join(t for t in (said(p).strip() for p in boxes[0]) if t))
                    elif blip is not None:
                        flush()
                        key = blip.get(f"{R}embed")
                        target = "word/" + relation[key].get("Target") if key else None
                        extent = next(e for e in token.iter() if e.tag.endswith("}extent"))
                        out.append(("image", None, "", {"relationship": "embedded-image", "content_type": "image/png", "digest": "sha256:" + hashlib.sha256(part[target]).hexdigest(), "width": extent.get("cx"), "height": extent.get("cy")} if key else {"relationship": "external-linked-image"}))
        flush()
    return out, cells


# Random packages

run = lambda t: f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>'


def drawing(inner, uri=PICTURE):
    return f'<w:r><w:drawing><wp:inline><wp:extent cx="70" cy="9"/><a:graphic><a:graphicData uri="{uri}">{inner}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


def random_table(r, depth=0):
    rows = []
    for _ in range(r.randrange(1, 5)):
        cells = []
        for _ in range(r.randrange(1, 5)):
            props = r.choice(["", "", f'<w:gridSpan w:val="{r.randrange(1, 4)}"/>']) + r.choice(["", "", '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:vMerge w:val="continue"/>'])
            inner = "".join(f"<w:p>{run(r.choice(['a', ' b ', '', 'c d', 'é']))}{run('x')}</w:p>" if r.random() < 0.7 else f"<w:p>{run(' ')}</w:p>" for _ in range(r.randrange(3)))
            if depth < 2 and r.random() < 0.2:
                inner += random_table(r, depth + 1) + f"<w:p>{run('after')}</w:p>"
            cells.append(f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>")
        rows.append(f"<w:tr>{''.join(cells)}</w:tr>")
    return f"<w:tbl><w:tblPr/><w:tblGrid>{'<w:gridCol/>' * r.randrange(4)}</w:tblGrid>{''.join(rows)}</w:tbl>"


def random_package(seed):
    r = random.Random(seed)
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    pieces = [
        lambda: run(r.choice(["some words ", " ", " más ", "x"])),
        lambda: f'<w:hyperlink r:id="r{r.randrange(2)}" w:history="1">{run("to ")}<w:r><w:tab/></w:r>{run("there")}</w:hyperlink>',
        lambda: f'<w:hyperlink w:anchor="part">{run("see ")}{field("begin")}<w:r><w:instrText xml:space="preserve"> PAGEREF x </w:instrText></w:r>{field("separate")}{run("12")}{field("end")}</w:hyperlink>',
        lambda: f'<w:r><w:footnoteReference w:id="{r.randrange(1, 3)}"/></w:r>',
        lambda: '<w:r><w:t>before</w:t><w:endnoteReference w:id="5"/><w:t>behind</w:t></w:r>',
        lambda: drawing('<a:blip r:embed="rImg"/>'),
        lambda: drawing('<a:blip r:link="rFar"/>'),
        lambda: drawing(f"<wps:wsp><w:txbxContent><w:p>{run(' boxed ')}</w:p><w:p>{run('')}</w:p><w:p>{run('text')}</w:p></w:txbxContent></wps:wsp>", SHAPE),
        lambda: drawing("", DIAGRAM),
        lambda: f"<w:ins>{run('inserted')}</w:ins>",
    ]
    props = ["", "", '<w:pStyle w:val="Heading2"/>', '<w:pStyle w:val="Title"/>', '<w:pStyle w:val="Odd"/>', '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr>', '<w:pStyle w:val="Heading2"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr>']
    body = "".join(random_table(r) if r.random() < 0.25 else f"<w:p><w:pPr>{r.choice(props)}</w:pPr>{''.join(r.choice(pieces)() for _ in range(r.randrange(6)))}</w:p>" for _ in range(r.randrange(1, 12)))
    return D.write_package(
        body + "<w:sectPr/>",
        '<w:style w:type="paragraph" w:styleId="Heading2"/><w:style w:type="paragraph" w:styleId="Title"><w:outlineLvl w:val="8"/></w:style><w:style w:type="character" w:styleId="Odd"/>',
        '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="4"><w:abstractNumId w:val="2"/></w:num>',
        f'<w:footnote w:id="-1"><w:p>{run("separator")}</w:p></w:footnote><w:footnote w:id="1"><w:p>{run(" one ")}</w:p><w:p>{run("")}</w:p><w:p>{run("more")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{run("two")}</w:p></w:footnote>',
        f'<w:endnote w:id="5"><w:p>{run("at the end")}</w:p></w:endnote>',
        f'<Relationship Id="r0" Type="{REL}/hyperlink" Target="https://example.org/a" TargetMode="External"/><Relationship Id="r1" Type="{REL}/hyperlink" Target="https://example.org/b" TargetMode="External"/><Relationship Id="rImg" Type="{REL}/image" Target="media/i.png"/><Relationship Id="rFar" Type="{REL}/image" Target="" TargetMode="External"/>',
        '<Default Extension="png" ContentType="image/png"/>',
        {"word/media/i.png": b"picture"},
    )


def test_packages_equal_a_sequential_reader(spark):
    bodies = {str(k): random_package(k) for k in range(40)}
    nodes = checkpointed(D.shred(spark.createDataFrame([*bodies.items()], "path string, content binary")))
    assert D.faults(nodes).collect() == []
    blocks, cells, kinds = {}, {}, set()
    for x in D.blocks(nodes).orderBy("doc", "ordinal").collect():
        blocks.setdefault(x["doc"], []).append(x)
    for x in D.table_cells(nodes).collect():
        cells.setdefault(x["doc"], []).append((x["depth"], x["row_no"], x["col"], x["col_span"], x["row_span"], x["nested"], x["text"]))
    for key, body in bodies.items():
        want, grid = read(body)
        got = blocks.get(key, [])
        assert [(x["type"], x["level"], x["text"], x["attributes"] or {}) for x in got] == want, key
        at = 0
        for k, x in enumerate(got):
            assert (x["ordinal"], x["start"], x["end"]) == (k, at, at + len(x["text"]))
            at = x["end"] + 1
        assert sorted(cells.get(key, [])) == sorted(grid), key
        kinds |= {x["type"] for x in got}
    assert kinds == {"paragraph", "heading", "list", "link", "footnote", "image", "table"}
    sizes = {x["doc"]: x for x in D.table_sizes(nodes).collect()}
    for key, body in bodies.items():
        if sum(len(c) for c in cells.get(key, [])):
            assert sizes[key]["cells"] == len(read(body)[1])


def test_faults(spark):
    good = lambda **more: D.write_package(f'<w:p>{more.pop("body", run("x"))}</w:p>', **more)
    link = lambda key, target="https://example.org": f'<Relationship Id="{key}" Type="{REL}/hyperlink" Target="{target}" TargetMode="External"/>'
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("word/document.xml", "<w:document")
        z.writestr("word/_rels/document.xml.rels", "<!DOCTYPE x><Relationships/>")
    files = {
        "good": (good(), set()),
        "null": (None, {"no_package"}),
        "text": (b"not a zip", {"no_package"}),
        "cut": (good()[:60], {"no_package"}),
        "broken": (broken.getvalue(), {"part_malformed", "part_declares_type", "body_missing"}),
        "unresolved": (good(body=f'<w:hyperlink r:id="r9">{run("x")}</w:hyperlink>'), {"link_unresolved"}),
        "wrong": (good(body=f'<w:hyperlink r:id="r1">{run("x")}</w:hyperlink>', relations=f'<Relationship Id="r1" Type="{REL}/image" Target="media/x"/>'), {"link_unresolved"}),
        "nowhere": (good(body=f"<w:hyperlink>{run('x')}</w:hyperlink>"), {"link_without_target"}),
        "empty": (good(body=f'<w:hyperlink w:anchor="a">{run(" ")}</w:hyperlink>'), {"link_without_text"}),
        "field": (good(body=f'<w:hyperlink w:anchor="a">{run("x")}<w:r><w:fldChar w:fldCharType="begin"/></w:r></w:hyperlink>'), {"link_malformed"}),
        "twice": (good(relations=link("r1") + link("r1", "https://example.org/2")), {"relationship_repeated"}),
        "note": (good(body='<w:r><w:footnoteReference w:id="4"/></w:r>'), {"note_unresolved"}),
        "image": (good(body=drawing('<a:blip r:embed="r1"/>'), relations=f'<Relationship Id="r1" Type="{REL}/image" Target="media/none.png"/>'), {"image_unresolved"}),
        "sourceless": (good(body=drawing("<a:blip/>")), {"image_without_source"}),
        "unknown": (good(body=drawing("", "urn:other")), {"drawing_unknown"}),
    }
    nodes = checkpointed(D.shred(spark.createDataFrame([(k, v) for k, (v, _) in files.items()], "path string, content binary")))
    found = {k: set() for k in files}
    for x in D.faults(nodes).collect():
        found[x["doc"]].add(x["problem"])
    assert found == {k: v for k, (_, v) in files.items()}
    assert [x["doc"] for x in D.blocks(nodes).collect()] == ["good"]


def test_large_and_absent_packages(spark, monkeypatch):
    assert D.docx_blocks(spark.createDataFrame([], "path string, content binary")).count() == 0
    monkeypatch.setattr(D, "MOST_BYTES", 100)
    assert D._package(D.write_package("<w:p/>"))[0][5] == "package_too_large"


@pytest.mark.parametrize("seed", range(3))
def test_grids(spark, seed):
    r = random.Random(100 + seed)
    bodies = {str(k): D.write_package(random_table(r)) for k in range(25)}
    nodes = checkpointed(D.shred(spark.createDataFrame([*bodies.items()], "path string, content binary")))
    got = {}
    for x in D.table_cells(nodes).collect():
        got.setdefault(x["doc"], []).append((x["depth"], x["row_no"], x["col"], x["col_span"], x["row_span"], x["nested"], x["text"]))
    for key, body in bodies.items():
        assert sorted(got[key]) == sorted(read(body)[1])
