"""Main text of pages: site templates removed by counted subtrees.

Each page is cut into elements. Subtrees outside and inside the article are
hashed and counted per host in Spark, copies of a page or of an article counting
once; those that recur across many pages of the host are its template and are
deleted. Elements whose kind says so (menus, headers, footers, asides, forms,
scripts, adverts, notices, comments) are deleted as well. If a page marks its
article, the text is taken from there, and passages that some articles share
stay: inside an article only what far more pages have is template.

Defined cases: a null or empty html gives an empty text. Markup that never ends
is closed by the end of the page, and an article ends what was left open before
it. Null urls are one host. Repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelway.llm.common import table
from labelway.operators.joins import BROADCAST_BYTES
from labelway.session import planned_bytes, stage_table

# Element names of the HTML standard, by what they are to a reader.
RAW = "script style textarea title noscript iframe template svg math object select".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "nav header footer aside form button dialog menu head label fieldset audio video canvas".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr br input label".split()
)
MAIN = frozenset(["article", "main"])
# Words in class, id and role that name something else than the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|"
    r"breadcrumbs?|menu|nav|navbar|navigation|sidebar|footer|header|masthead|toolbar|pagination|pager|widget|"
    r"comments?|commentlist|disqus|respond|replies|search|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class TemplateConfig:
    """A subtree is template if at least ``min_pages`` different pages of its host
    and ``min_share`` of them have it, or ``many_pages`` of them whatever their share.
    The same holds for subtrees inside an article, with different articles for pages."""

    min_pages: int = 3
    min_share: float = 0.3
    many_pages: int = 100
    min_articles: int = 20
    article_share: float = 0.1
    many_articles: int = 1000


@dataclass
class Element:
    """An element and the running hash of its markup: its tag, its texts with white space
    folded, and the hashes of its children."""

    name: str
    dropped: bool
    main: bool
    hash: xxhash.xxh64


def named(rest: str) -> str:
    return " ".join(x for m in NAMES.finditer(rest) for x in m.groups() if x)


class Open:
    """The open elements, with counts by name and kind, so that a tag costs the same however
    deep it stands. A closed element's hash goes into its parent's."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.names: Counter[str] = Counter()
        self.dropped = self.main = 0
        # the outermost open paragraph, and the blocks other than paragraphs opened in it
        self.paragraph: int | None = None
        self.blocks = 0

    def push(self, e: Element) -> None:
        if self.paragraph is not None:
            self.blocks += self._is_block(e)
        elif e.name == "p":
            self.paragraph = len(self.stack)
        self.stack.append(e)
        self.names[e.name] += 1
        self.dropped += e.dropped
        self.main += e.main

    def pop(self) -> Element:
        e = self.stack.pop()
        self.names[e.name] -= 1
        self.dropped -= e.dropped
        self.main -= e.main
        if self.paragraph == len(self.stack):
            self.paragraph = None
        elif self.paragraph is not None:
            self.blocks -= self._is_block(e)
        self.add(e.hash.digest())
        return e

    def add(self, part: bytes | str) -> None:
        if self.stack:
            self.stack[-1].hash.update(part)

    @staticmethod
    def _is_block(e: Element) -> bool:
        return e.name != "p" and e.name not in INLINE


def walk(page: str) -> Iterator[tuple]:
    """Events of a page: ("text", str), ("open", Element), ("close", Element). The time is linear in
    the length of the page."""
    is_open = Open()
    stack = is_open.stack
    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            is_open.add(SPACE.sub(" ", page[at : m.start()]))
            yield "text", page[at : m.start()]
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or name in RAW:
            continue
        if m["close"]:
            if is_open.names[name]:
                while True:
                    e = is_open.pop()
                    yield "close", e
                    if e.name == name:
                        break
            continue
        if name in MAIN:  # what was left open before the article ends here
            while is_open.dropped:
                yield "close", is_open.pop()
        elif name not in INLINE:  # a new block ends an open paragraph and what it holds
            if is_open.paragraph is not None and not is_open.blocks:
                while True:
                    e = is_open.pop()
                    yield "close", e
                    if e.name == "p":
                        break
            elif name == "li" and stack and stack[-1].name == "li":
                yield "close", is_open.pop()
        top = name in MAIN or name in ("body", "html")
        if name == "header" and is_open.main:  # the headline of the article
            top = True
        drop = name in DROPPED and not top or not top and bool(m["rest"]) and bool(BOILERPLATE.search(named(m["rest"])))
        e = Element(name, drop, name in MAIN, xxhash.xxh64(SPACE.sub(" ", m[0])))
        yield "open", e
        if name in VOID or m["rest"].endswith("/"):
            is_open.add(e.hash.digest())
            yield "close", e
        else:
            is_open.push(e)
    if at < len(page):
        is_open.add(SPACE.sub(" ", page[at:]))
        yield "text", page[at:]
    while stack:
        yield "close", is_open.pop()


def subtree(e: Element, inside: bool = False) -> int:
    """Hash of a closed element; odd for one inside an article."""
    return (e.hash.intdigest() - (1 << 63)) & ~1 | inside


#: Stand for the page and for its article among the hashes: their counts are those of the host.
PAGE, ARTICLE = 0, 1


def subtrees(page: str | None) -> tuple[list[int], bytes]:
    """Hashes of all block elements, and the digest of the article."""
    page, out, inside, dropped = page or "", [PAGE], 0, 0
    article = xxhash.xxh3_128()
    for kind, e in walk(page):
        if kind == "open":
            inside += e.main
            dropped += e.dropped
        elif kind == "close":
            inside -= e.main
            dropped -= e.dropped
            if e.main:
                if not inside:
                    out.append(ARTICLE)
                    article.update(e.hash.digest())
            elif e.name not in INLINE and e.name not in ("html", "body", "head") and not (inside and dropped):
                out.append(subtree(e, inside > 0))
    return list(dict.fromkeys(out)), article.digest()


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the article, or of the body without template and boilerplate, joined by blank lines."""
    page = page or ""
    events = list(walk(page))
    only_main = any(kind == "open" and x.main for kind, x in events)
    blocks: list[str] = []
    marks: list[tuple[int, int]] = []  # blocks at the start of open elements, to take back a template
    part: list[str] = []
    dropped = inside = 0

    def end_block() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(part))).strip()
        if text:
            blocks.append(text)
        part.clear()

    for kind, x in events:
        if kind == "text":
            if not dropped and (inside or not only_main):
                part.append(x)
            continue
        if x.name == "br" or x.name == "hr":
            part.append(" ")
        if x.name not in INLINE or x.dropped:
            end_block()
        if kind == "open":
            dropped += x.dropped
            inside += x.main
            marks.append((id(x), len(blocks)))
        else:
            dropped -= x.dropped
            inside -= x.main
            _, first = marks.pop()
            if template and (inside or not only_main) and not x.main and x.name not in INLINE:
                if subtree(x, inside > 0) in template:
                    del blocks[first:]
    end_block()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, article, hash): all subtrees of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtrees(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x for _, x in found], pa.binary()),
                    pa.array([x for x, _ in found], pa.list_(pa.int64())),
                ],
                ["host", "page", "article", "hashes"],
            )

    found = pages.select("host", "page", "html").mapInArrow(
        run, "host string, page binary, article binary, hashes array<long>"
    )
    return found.select("host", "page", "article", F.explode("hashes").alias("hash"))


def templates(pages: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """Template subtrees (host, hash)."""
    each = page_subtrees(pages)
    inside = F.col("hash").bitwiseAND(F.lit(1)) == 1
    unit = F.when(inside, F.col("article")).otherwise(F.col("page"))
    counts = each.select("host", "hash", unit.alias("unit")).distinct().groupBy("host", "hash")
    counts = stage_table(
        counts.agg(F.count(F.lit(1)).alias("found")).filter(
            F.col("hash").isin(PAGE, ARTICLE) | (F.col("found") >= min(cfg.min_pages, cfg.min_articles))
        ),
        "counts",
    )
    whole = F.col("hash").isin(PAGE, ARTICLE)
    sizes = counts.filter(whole).select("host", inside.alias("inside"), F.col("found").alias("all"))

    def recurs(least: int, share: float, many: int) -> Column:
        n = F.col("found")
        return (n >= least) & ((n >= share * F.col("all")) | (n >= many))

    common = counts.filter(~whole).withColumn("inside", inside).join(sizes, ["host", "inside"])
    common = common.filter(
        F.when(F.col("inside"), recurs(cfg.min_articles, cfg.article_share, cfg.many_articles)).otherwise(
            recurs(cfg.min_pages, cfg.min_share, cfg.many_pages)
        )
    )
    return stage_table(common.select("host", "hash"), "templates")


def extract(
    pages: DataFrame, cfg: TemplateConfig = TemplateConfig(), broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``.

    Templates are counted over all pages. If they are few bytes, checked, each task gets
    them and no page moves; else the pages meet the hashes that they have by a join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), host_of(F.col("url")).alias("host"),
        F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("page"), F.coalesce("html", F.lit("")).alias("html"),
    )
    common = templates(rows, cfg)
    small = planned_bytes(common) <= broadcast_bytes
    shared = None
    if small:
        by_host: dict[str, set[int]] = {}
        for r in common.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(x) for h, x in by_host.items()})
        ready = rows.select("page_id", "url", "html", "host")
    else:
        each = page_subtrees(rows).select("host", "page", "hash").distinct()
        hits = each.join(common, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("template"))
        ready = rows.join(hits, ["host", "page"], "left").select(
            "page_id", "url", "html", F.coalesce("template", F.array().cast("array<long>")).alias("template")
        )
    none: frozenset[int] = frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, key in zip(batch.column(2), batch.column(3)):
                template = shared.value.get(key.as_py(), none) if small else frozenset(key.as_py())
                texts.append(main_text(page.as_py(), template))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    return ready.mapInArrow(run, "page_id long, url string, text string")


def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
