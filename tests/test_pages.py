"""Text of pages, on odd HTML and against a plain reader of the given pages."""

import hashlib
import html
import re

import pyarrow.parquet as pq
import pytest

from millrace.operators import pages
from millrace.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain", [("", "plain", 0)]),
        ('<p title="x>y">a &amp; b</p>', [("p", "a & b", 0)]),
        ("<p>1 &lt; 2 &#233;&#x1F600; &nosuch; &copy</p>", [("p", "1 < 2 é😀 &nosuch; ©", 0)]),
        ("<script>var t='</p>';</script><p>x<!-- <p>no</p> -->y</p>", [("p", "xy", 0)]),
        ("<style>p{}</style><p>a<br>b</p>tail", [("p", "a", 0), ("br", "b", 0), ("", "tail", 0)]),
        ("<li><a href='/x'>menu one</a></li><li>see <a>here</a> now</li>", [("li", "menu one", 7), ("li", "see here now", 4)]),
        ("<P>UPPER<p>never closed <b>bold", [("p", "UPPER", 0), ("p", "never closed bold", 0)]),
        ("a < b and c > d", [("", "a < b and c > d", 0)]),
        ("<div>\n one \t two \n</div>", [("div", "one two", 0)]),
        ("</a></script></p>lone ends", [("", "lone ends", 0)]),
    ],
)
def test_odd_html(page, want):
    assert pages.blocks_of(page) == want


def test_menus_are_left_out(spark):
    rows = [(1, "<title>T</title><nav><ul><li><a href='/a'>All goods</a></li><li><a>Help</a></li></ul></nav><p>Text with a <a>link</a> in it.</p><p>More &eacute;.</p>", "x"), (2, None, "y"), (2, "<p>twice</p>", "z"), (2, "<p>twice</p>", "z"), (None, "<p>no id</p>", "w"), (3, "<a>only</a>", "v")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").repartition(3)
    got = sorted(((r.page_id, r.n_blocks, r.kept, r.text) for r in pages.main_text(df).collect()), key=str)
    assert got == sorted([(1, 5, 2, "Text with a link in it.\nMore é."), (2, 0, 0, ""), (2, 1, 1, "twice"), (2, 1, 1, "twice"), (None, 1, 1, "no id"), (3, 1, 0, "")], key=str)
    assert pages.main_text(df.limit(0)).count() == 0
    assert pages.blocks(df).columns == ["page_id", "pos", "tag", "text", "linked"]


def plainly(page):
    """Blocks by a scan over letters, for pages whose tags are closed."""
    out, text, tag, at, links, linked = [], "", "", 0, 0, ""

    def end(new):
        nonlocal text, tag, linked
        t = " ".join(html.unescape(text).split())
        if t:
            out.append((tag, t, min(len(t), len("".join(html.unescape(linked).split())))))
        text, tag, linked = "", new, ""

    while at < len(page):
        if page.startswith("<!--", at):
            at = page.index("-->", at) + 3
        elif page.startswith("<!", at):
            at = page.index(">", at) + 1
        elif re.match(r"</?[a-zA-Z]", page[at : at + 3]):
            to, quote = at + 1, None
            while quote or page[to] != ">":
                quote = (None if page[to] == quote else quote) if quote else page[to] if page[to] in "\"'" else None
                to += 1
            name, closing = re.match(r"</?([a-zA-Z0-9]+)", page[at:])[1].lower(), page[at + 1] == "/"
            at = to + 1
            if name in ("script", "style") and not closing:
                at = re.compile(f"</{name} *>", re.I).search(page, at).end()
            elif name == "a":
                links += -1 if closing else 1
            elif name in pages.BLOCKS:
                end("" if closing else name)
        else:
            text += page[at]
            linked += page[at] if links > 0 else ""
            at += 1
    end("")
    return out


def test_given_pages_against_a_plain_reader(spark):
    got = {r.page_id: r for r in QUERIES["kb_page_text"](spark, SF).collect()}
    table = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    compared = 0
    for i, page in zip(table["page_id"], table["html"], strict=True):
        try:
            want = plainly(page or "")
        except (IndexError, ValueError, AttributeError):
            continue  # a page that is cut off within a tag
        compared += 1
        kept = [t for tag, t, n in want if tag != "title" and n / max(1, len("".join(t.split()))) <= pages.LINKED]
        assert (got[i].n_blocks, got[i].kept, got[i].digest) == (len(want), len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()), page[:300]
    assert compared > 0.9 * len(got) and len(got) == len(table["page_id"])
