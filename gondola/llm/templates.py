"""Main text of web pages by removal of what the pages of a site share.

Every page's elements are hashed with all they contain; Spark counts each hash per host, copies
of a page once. What recurs on many pages of a host is template. Extraction then drops template
subtrees, elements that say by name that they are no article, and takes the articles that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.skew import per_key
from gondola.llm.html_blocks import BLOCKS, Element, elements, hash_subtrees, name_words, parse, tidy
from gondola.llm.shared import release_memory
from gondola.session import stage

# Never part of an article.
DROPPED = frozenset(
    "script style noscript template head title iframe object embed svg math canvas audio video map form button input "
    "select textarea datalist nav aside footer menu dialog search".split()
)
# Words in class, id or role of elements that surround an article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner banners breadcrumb breadcrumbs "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr disclaimer footer copyright "
    "masthead menu menus nav navbar navigation navigations newsletter notice notices notification notifications alert "
    "pagination pager popup modal overlay promo promos promoted promotion promotions related recommended recommendations "
    "search searchbox share sharing shares sharebar sidebar sidebars aside complementary contentinfo skip social socials "
    "sponsor sponsored sponsors subscribe subscription signup login toolbar topbar widget widgets hidden".split()
)
# Words of boxes whose articles are not the page's own.
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot comment comments commentlist disqus reply "
    "replies respond promo promos promoted promotion promotions related recommended recommendations sponsor sponsored "
    "sponsors teaser".split()
)
# An element with one of these words is looked into even if it has one of the words above.
ARTICLE_WORDS = frozenset("article entry post story main body content".split())
# Inside an article these hold its own words, whatever other pages of the site say.
OWN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong a span code q cite".split())


@dataclass(frozen=True)
class Settings:
    """A subtree is template when so many pages of its host, and so large a share of them, have it.

    Pages of a host with the same text, before any template is known, are copies and count as one.
    Templates of all hosts up to ``broadcast_bytes`` are sent to the tasks that read the pages; beyond
    that they are joined to the pages, which are shuffled for it.
    """

    min_pages: int = 3
    min_percent: float = 1.0
    broadcast_bytes: int = 16 << 20


def host_of(url: Column) -> Column:
    """Host in lower case without port; a URL without one has the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _tag(html: str) -> Column:
    return F.xxhash64(html)


def _signed(hash: int) -> int:
    return hash - (1 << 64) if hash >> 63 else hash


def page_hashes(pages: DataFrame) -> DataFrame:
    """host, page_id, tag, content and the distinct hashes of the page's subtrees with text in them.

    ``content`` is alike in copies: the hash of the page's text, or ``tag`` where it has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, hashes = [], []
            for tag, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                root = parse(page or "")
                hash_subtrees(root)
                hashes.append([_signed(h) for h in {e.hash for e in elements(root) if e.inside}])
                text = _text(root, frozenset())
                contents.append(_signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))) if text else tag)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(contents, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["host", "page_id", "tag", "content", "hashes"],
            )

    rows = pages.select(host_of(F.col("url")).alias("host"), "page_id", _tag("html").alias("tag"), "html")
    return rows.mapInArrow(run, "host string, page_id long, tag long, content long, hashes array<long>")


def templates(hashes: DataFrame, settings: Settings) -> DataFrame:
    """(host, hash) of the subtrees that recur across the pages of a host. Counted in part before any shuffle."""
    sizes = hashes.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    # of copies with different surroundings that of the smallest tag, whatever order the rows come in
    once = hashes.groupBy("host", "content").agg(F.min_by("hashes", "tag").alias("hashes"))
    counted = (
        once.select("host", F.explode("hashes").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= settings.min_pages)
    )
    return (
        counted.join(per_key(sizes, "host"), "host")
        .where(F.col("n") * 100 >= settings.min_percent * F.col("pages"))
        .select("host", "hash")
    )


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "")
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style


def _dropped(node: Element, in_article: bool, template: frozenset[int]) -> bool:
    if node.name in DROPPED:
        return True
    if node.name == "header" and not in_article:
        return True
    if node.hash in template and node.name not in ("html", "body", "article", "main"):
        # a site's articles may share sentences, but not whole boxes
        if not in_article or node.name not in OWN:
            return True
    if not node.attrs:
        return False
    attributes = node.attributes()
    if _hidden(attributes):
        return True
    words = name_words(attributes)
    if not words & DROPPED_WORDS and (in_article or "header" not in words):
        return False
    return node.name not in ("html", "body", "main", "article") and not (
        words & ARTICLE_WORDS and not words & {"comment", "comments", "sidebar", "ad", "ads", "footer", "nav", "menu"}
    )


def _blocks(
    top: Element,
    in_article: bool,
    template: frozenset[int],
    articles: frozenset[Element] = frozenset(),
    spared: frozenset[Element] = frozenset(),
) -> list[str]:
    """Texts of the blocks below ``top`` in page order; ``articles`` and what is ``spared`` are never dropped."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = tidy(line)
        line.clear()
        if text:
            out.append(text)

    stack: list[Element | str | None] = [top]
    while stack:
        node = stack.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            line.append(node)
        elif node in articles and node is not top:
            end()
            out += _blocks(node, True, template)
        elif node is not top and node not in spared and _dropped(node, in_article, template):
            if node.name in BLOCKS:
                end()
        elif node.name == "br":
            line.append(" ")
        else:
            block = node.name in BLOCKS
            if block:
                end()
                stack.append(None)
            stack += reversed(node.inside)
    end()
    return out


FREE, BELOW, FOREIGN, NEVER = range(4)


def _veto(node: Element, template: frozenset[int]) -> int:
    """What an ancestor says of an article: nothing, that it is dropped itself, that all in it is foreign, or hidden."""
    if not _dropped(node, False, template):
        return FREE
    if node.name == "header" or node.name in DROPPED and node.name != "form":
        return NEVER
    attributes = node.attributes() if node.attrs else {}
    if _hidden(attributes):
        return NEVER
    return FOREIGN if name_words(attributes) & FOREIGN_WORDS else BELOW


def _tops(found: list[Element], template: frozenset[int]) -> dict[int, list[Element]]:
    """The outermost of ``found`` in page order, by the strongest veto of their ancestors."""
    known: dict[Element, int] = {}
    vetoes = {}
    for e in found:
        path, up = [], e.parent
        while up is not None and up not in known:
            path.append(up)
            up = up.parent
        worst = known[up] if up is not None else FREE
        for up in reversed(path):
            known[up] = worst = max(worst, _veto(up, template))
        vetoes[e] = worst
    out: dict[int, list[Element]] = {}
    for level in range(NEVER):
        own = {e for e in found if vetoes[e] == level}
        inside: dict[Element, bool] = {}  # whether an element, or one around it, is of this level
        tops = []
        for e in found:
            if e not in own:
                continue
            path, up = [], e.parent
            while up is not None and up not in inside:
                path.append(up)
                up = up.parent
            within = inside[up] if up is not None else False
            for up in reversed(path):
                inside[up] = within = within or up in own
            if not within:
                tops.append(e)
        out[level] = tops
    return out


def _text(root: Element, template: frozenset[int]) -> str:
    def of(tops: list[Element], *kept: frozenset[Element], known: frozenset[int] = template) -> list[str]:
        return [b for e in tops for b in _blocks(e, e is not root, known, *kept)]

    def chars(blocks: list[str]) -> int:
        return sum(map(len, blocks))

    every = list(elements(root))
    articles = _tops([e for e in every if e.name == "article" and not _comment(e)], template)
    if out := of(articles[FREE]):
        return "\n\n".join(out)
    mains = _tops([e for e in every if e.name == "main" and not _comment(e)], template)
    tops = mains[FREE] or mains[BELOW]
    if not tops:
        tops = _tops([e for e in every if e.attrs and e.attributes().get("role") == "main"], frozenset())
        tops = tops[FREE] or tops[BELOW]
    rest = of(tops)
    if not rest:
        tops, rest = [root], of([root])
    # no article is free: those in dropped elements stand beside what else there is, and alone if they are more
    for level in (BELOW, FOREIGN):
        own = of(articles[level])
        if not own or level == FOREIGN and chars(own) <= chars(rest):
            continue
        if level == BELOW and chars(own) >= chars(rest):
            rest = own
            break
        spared = set()
        for e in articles[level]:
            up = e.parent
            while up is not None and up not in spared:
                spared.add(up)
                up = up.parent
        rest = of(tops, frozenset(articles[level]), frozenset(spared))
        break
    # nothing but template: rather the articles as they are than no text
    return "\n\n".join(rest or of(articles[FREE] or articles[BELOW], known=frozenset()))


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the articles in page order, joined by an empty line; a page without one gives all that is no template."""
    root = parse(page)
    if template:
        hash_subtrees(root)
    return _text(root, template)


def _comment(node: Element) -> bool:
    return bool(node.attrs and name_words(node.attributes()) & {"comment", "comments", "reply", "teaser", "related"})


def extract(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """page_id, url and main text for every row of ``pages`` (columns page_id, url, html).

    Null html is empty and has the empty text. Pages without a host share one. Repeated rows, and
    other copies, count as one page of their host; all come back.
    """
    settings = settings or Settings()
    rows = pages.select("page_id", "url", "html")
    hashes = stage(page_hashes(rows), "page-hashes")
    known = stage(templates(hashes, settings), "templates")
    held = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.lit(16)), F.lit(0)).alias("n")).head().n
    if held <= settings.broadcast_bytes:
        return _with_sent_templates(rows, known)
    return _with_joined_templates(rows, hashes, known)


_TEXTS = "page_id long, url string, text string"


def _with_sent_templates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pages are read where they lie; ``known`` is within broadcast_bytes, see extract."""
    of_host: dict[str, list[int]] = {}
    for row in known.groupBy("host").agg(F.collect_list("hash").alias("hashes")).collect():
        of_host[row.host] = row.hashes
    sent = rows.sparkSession.sparkContext.broadcast(of_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for host, page in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if host not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[host] = frozenset(h % (1 << 64) for h in sent.value.get(host, ()))
                texts.append(main_text(page or "", sets[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )
        release_memory()

    return rows.withColumn("host", host_of(F.col("url"))).mapInArrow(run, _TEXTS)


def _with_joined_templates(rows: DataFrame, hashes: DataFrame, known: DataFrame) -> DataFrame:
    each = hashes.select("host", "page_id", "tag", F.explode("hashes").alias("hash"))
    marked = each.join(per_key(known, "host", "hash"), ["host", "hash"])
    # rows of one id and html are alike, so one list serves them all
    of_page = marked.groupBy("page_id", "tag").agg(F.collect_set("hash").alias("template"))
    keyed = rows.withColumn("tag", _tag("html"))
    same = keyed["page_id"].eqNullSafe(of_page["page_id"]) & (keyed["tag"] == of_page["tag"])
    whole = keyed.join(of_page, same, "left").select(keyed["page_id"], "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page or "", frozenset(h % (1 << 64) for h in template or ()))
                for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return whole.mapInArrow(run, _TEXTS)
