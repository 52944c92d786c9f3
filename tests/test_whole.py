"""Queries do the whole job where their SQL leaves something out."""

import hashlib
import json
from html.parser import HTMLParser

from factloom.operators import ingest as I
from factloom.plans import contract
from factloom.sources import blocks as B

SF = "/root/testdata/sf0.001"


class _Reader(HTMLParser):
    """Brute force for well-formed pages: text from a heading's or paragraph's start to the next one or an end tag."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.out = False, []

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "p"):
            self.open = True
            self.out.append([tag, ""])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.open &= tag not in ("h1", "p", "article")

    def handle_data(self, data):
        if self.open:
            self.out[-1][1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_paragraphs_up_to_their_end(spark):
    page = "<!-- <p>no</p> --><script>'<p>no'</script><h1 id=a>A <i>b</i></h1><p><b>c</b> d<p class='x>y' title=\"it's\">e < f<br/>g <a href=z>h</a></div>i<pre>j</pre><P>k<!-- <p> --> &amp; l<div>m</div>" + "<p>" + "<b>n</b>" * 20_000
    got = B.html_paragraphs(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("ordinal").collect()
    assert [(r.heading, r.text) for r in got] == [(True, "A b"), (False, "c d"), (False, "e < f g h"), (False, "k &amp; l"), (False, "n" * 20_000)]


def test_paragraphs_of_the_pages(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        reader = _Reader()
        reader.feed(r.html)
        reader.close()
        concept = None
        for k, (tag, text) in enumerate(reader.out):
            concept = text if tag == "h1" else concept
            want.append((r.page_id, k, text, concept))
    got = contract.QUERIES["distill_forward_fill"](spark, SF).select("page_id", "ordinal", "text", "concept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_claim_for_every_body_block(spark):
    lines = ["before", "# Head", "a" * 512, "", "b" * 513, "## Next", "c" * 9000]
    got = I.distil(B.line_blocks(spark.createDataFrame([(7, "\n".join(lines))], "doc_id long, text string"))).orderBy("line_no").collect()
    digest = lambda k: "claim-" + hashlib.sha256(json.dumps(["7", str(k), lines[k]], separators=(",", ":")).encode()).hexdigest()[:24]
    want = [(0, "", lines[0]), (2, "Head", lines[2]), (4, "Head", None), (6, "Next", None)]
    assert [(r.line_no, r.concept, r.text, r.claim_id) for r in got] == [(k, c, t, digest(k)) for k, c, t in want]
