"""Text of pages: blocks with the share of their text that lies in links, so that menus can be left out."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end blocks; those whose content is no text; share of link text up to which a block is kept.
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
LINKED = 0.5


class _Blocks(HTMLParser):
    """Collects (tag, text, letters of it in links) of a page; entities are decoded, runs of white space are one space.

    Quoted attributes, comments and declarations are the parser's matter; a tag that is never closed ends with the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, int]] = []
        self.said: list[tuple[str, bool]] = []
        self.tag, self.hidden, self.links = "", 0, 0

    def block(self, tag: str) -> None:
        text = " ".join("".join(s for s, _ in self.said).split())
        if text:
            self.out.append((self.tag, text, min(len(text), sum(len(w) for s, linked in self.said if linked for w in s.split()))))
        self.said, self.tag = [], tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS:
            self.block(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.block(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            self.block("")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.said.append((data, self.links > 0))


def blocks_of(html: str | None) -> list[tuple[str, str, int]]:
    """(tag, text, letters in links) of a page's blocks in their order; a null page has none."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.block("")
    return p.out


def blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, a row for each block: pos (from 0), tag, text, linked (share of its letters that lie in links). Pages
    without text have no rows; columns of these names are replaced."""
    rest = pages.drop("pos", "tag", "text", "linked")
    names = [c for c in rest.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch[html].to_pylist()):
                if found := blocks_of(page):
                    again = pa.array([i] * len(found))
                    letters = [max(1, sum(len(w) for w in t.split())) for _, t, _ in found]
                    told = [pa.array(range(len(found)), pa.int32()), pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([min(1.0, f[2] / n) for f, n in zip(found, letters, strict=True)], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(again) for c in names), *told], [*names, "pos", "tag", "text", "linked"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != html)
    return rest.mapInArrow(run, f"{kinds}, pos int, tag string, text string, linked double")


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", most: float = LINKED) -> DataFrame:
    """key, n_blocks, kept (blocks of at most that share of link text, but for titles), text (theirs, a line each) for each row
    of pages. Rows of one key with different pages are told apart; repeated ones give repeated rows. No text is ''."""
    row = F.xxhash64(key, html).alias("_row")
    each = blocks(pages.select(F.col(key), F.col(html).alias("_html"), row).distinct(), "_html")
    good = (F.col("linked") <= most) & (F.col("tag") != "title")
    both = each.groupBy("_row").agg(F.count("*").alias("n_blocks"), F.count_if(good).alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("text"))
    none = F.lit(0).cast("long")
    return pages.select(key, row).join(both, "_row", "left").select(key, F.coalesce("n_blocks", none).alias("n_blocks"), F.coalesce("kept", none).alias("kept"), F.coalesce("text", F.lit("")).alias("text"))
