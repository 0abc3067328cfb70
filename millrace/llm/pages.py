"""Main text of web pages with site templates removed.

Each page is parsed once into text blocks; a block carries the hashes of the
element subtrees that hold it. Spark counts, for each host, on how many different
pages every subtree occurs; subtrees on at least ``SHARE`` of a host's pages (and
on ``PAGES`` or more) are its template, and blocks inside them go. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments go by
element and by the words of class, id and role wherever they stand.

A host's template can't hold more than mean-subtrees-a-page / ``SHARE`` hashes,
so it is one small array; pages themselves are only dealt by host in a join
that adaptive execution splits.

Edge cases: null or empty html gives the empty text. A null or hostless url has
no template. Equal pages count once for the template, so copies of an article
never make it one. Broken and cut markup is read as far as it goes; an
unfinished tag at the end is no text. Pages of any length are read whole;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SHARE, PAGES = 0.5, 8

#: Elements that never hold main text.
GONE = set("nav header footer aside form script style noscript template iframe svg math button select textarea dialog menu canvas object audio video head title".split())
#: Words of class, id and role that mark what isn't the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe signup login comment comments disqus reply replies respond share sharing social related "
    "recommended widget toolbar complementary contentinfo search".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening element closes an open one of its kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HALF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_WORDS = re.compile(r"[A-Za-z]+")


class _Node:
    __slots__ = ("tag", "parent", "kids", "gone", "main", "hash")

    def __init__(self, tag: str, parent: _Node | None, gone: bool, main: int):
        self.tag, self.parent, self.gone, self.main = tag, parent, gone, main
        self.kids: list = []
        self.hash = 0


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None, False, 0)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.at.kids.append(" ")
            return
        if tag not in INLINE:
            closes, up = CLOSES.get(tag), self.at
            if closes is None and tag not in ("html", "body"):
                closes = {"p"}
            while closes and up.parent is not None:
                if up.tag in closes:
                    self.at = up.parent
                    break
                if up.tag not in INLINE and up.tag != "p":
                    break
                up = up.parent
        gone = self.at.gone or tag in GONE
        if not gone:
            for k, v in attrs:
                if k in ("class", "id", "role") and v and not MARKS.isdisjoint(w.lower() for w in _WORDS.findall(v)):
                    gone = tag not in ("html", "body", "article", "main")
                elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")):
                    gone = True
        node = _Node(tag, self.at, gone, 2 if tag == "article" else max(self.at.main, 1 if tag == "main" else 0))
        self.at.kids.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None:
            if up.tag == tag:
                self.at = up.parent
                return
            if up.tag in ("article", "main", "body") and tag in INLINE | {"p", "li"}:
                return
            up = up.parent

    def handle_data(self, data):
        if not self.at.gone:
            self.at.kids.append(data)


def _hash(node: _Node) -> int:
    """Hash of a subtree: its tags and words, without white space; iterative, so depth is no limit."""
    todo = [(node, False)]
    while todo:
        x, ready = todo.pop()
        kids = [k for k in x.kids if isinstance(k, _Node) and not k.gone]
        if not ready:
            todo.append((x, True))
            todo += [(k, False) for k in kids]
            continue
        h = blake2b(x.tag.encode(), digest_size=8)
        for k in x.kids:
            if isinstance(k, str):
                h.update(" ".join(k.split()).encode("utf-8", "surrogatepass"))
            elif not k.gone:
                h.update(k.hash.to_bytes(8, "little", signed=True))
        x.hash = int.from_bytes(h.digest(), "little", signed=True)
    return node.hash


def blocks_of(html: str | None) -> list[tuple[str, list[int]]]:
    """The main text's blocks in page order, each with the hashes of its element and those around it."""
    if not html:
        return []
    tree = _Tree()
    tree.feed(_HALF.sub("", html))
    tree.close()
    _hash(tree.root)
    found: list[tuple[int, str, list[int]]] = []
    run: list[str] = []

    def flush(node: _Node) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            path, up = [], node
            while up.parent is not None and up.tag not in ("html", "body"):
                path.append(up.hash)
                up = up.parent
            found.append((node.main, text, path))

    todo: list = [(tree.root, iter(tree.root.kids), tree.root)]
    while todo:
        node, kids, block = todo[-1]
        for k in kids:
            if isinstance(k, str):
                run.append(k)
            elif k.gone:
                if k.tag not in INLINE:
                    flush(block)
            else:
                inner = block if k.tag in INLINE else k
                if inner is k:
                    flush(block)
                todo.append((k, iter(k.kids), inner))
                break
        else:
            todo.pop()
            if node.tag not in INLINE:
                flush(node)
    top = max((m for m, _, _ in found), default=0)
    return [(text, path) for m, text, path in found if m == top]


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64()))]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            htmls = part.column(2).to_pylist()
            rows = [[{"text": t, "path": p} for t, p in blocks_of(h)] for h in htmls]
            marks = [int.from_bytes(blake2b((h or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for h in htmls]
            cols = [part.column(0), part.column(1), pa.array([host_of(u) for u in part.column(1).to_pylist()], pa.string()), pa.array(marks, pa.int64()), pa.array(rows, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "host", "page", "blocks"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that the host's template took) of each page."""
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = some.mapInArrow(_parse, "page_id long, url string, host string, page long, blocks array<struct<text:string,path:array<long>>>")
    parsed = materialize(parsed, "pages")
    hosted = parsed.where("host is not null")
    sizes = hosted.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    trees = hosted.select("host", "page", F.explode(F.array_distinct(F.flatten("blocks.path"))).alias("tree")).groupBy("host", "tree", "page").agg(F.lit(1).alias("one"))
    often = trees.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES)
    often = often.join(sizes, "host").where(F.col("n") >= SHARE * F.col("pages"))
    template = materialize(often.groupBy(F.col("host").alias("site")).agg(F.collect_set("tree").alias("trees")), "templates")
    out = parsed.join(template, F.col("host") == F.col("site"), "left")
    kept = F.when(F.col("trees").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(b["path"], F.col("trees"))))
    out = out.withColumn("kept", kept).withColumn("text", F.array_join(F.col("kept.text"), " "))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), (F.size("blocks") - F.size("kept")).cast("long").alias("n_template"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
