"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of element paths (tags with their first class). Two importances, both entropies to
the base of the host's number of distinct pages m, are computed for every path:

* presentation: over the child sequences seen under it; one layout on every page gives 0, a new one on each page 1;
* content: a text seen on k pages counts 1 - log_m(k); the mean over the texts below the path.

A branch's importance is (1 - g^l) * presentation + g^l * content for l child sequences. On a host with few pages that says
little, so it is weighed against what the page's markup says, as if PRIOR more pages had said that: 1 inside a marked article or
main part, EVEN elsewhere. Branches that come out under LOW are removed, inside and outside marked parts; the root of a marked part
itself is never judged as a whole. Menus, footers, sidebars, notices, adverts, forms and comments that element or class names tell
go as well, as does text in links only outside marked parts. Of what is left, the marked article is the main text if it holds
SHARE of the characters; else the main part, by the same rule; else all of it.

Statistics count distinct pages (by digest), so copies weigh once; they are aggregated before they are shuffled, and only the
removable paths of a host travel to its pages.

Defined cases: null, empty and unparsable html gives the empty text; a null or odd url counts as host ''; unclosed elements end
with their parent, a block ends an open paragraph; repeated rows each get their row; an empty table gives an empty result;
extra columns are not read. A page is parsed as a whole, however long.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LOW, PRIOR, EVEN, SHARE, DECAY = 0.2, 8, 0.3, 0.3, 0.9
#: Blocks deeper than this count as part of the branch at this depth.
DEPTH = 12
#: Bytes of the removable paths of all hosts that are sent to every executor.
BROADCAST = 8 << 20

BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe title head object select button canvas audio video".split())
#: Of these, those that take everything up to the end of the page if they are not closed; the others are then ordinary elements.
TAKES_ALL = frozenset("script style textarea title".split())
#: Elements and class names that mark a branch as not part of the article.
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments disqus reply replies respond related recommended share sharing social login signup search toolbar widget alert".split()
)
#: Names that are no part of an article only outside of one.
OUTSIDE_NAMES = frozenset("alert banner breadcrumb breadcrumbs recommended related search toolbar widget".split())
#: A quote opens a value only after an equals sign.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))*+)>|<[!?][^>]*>""", re.S)
NAME = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
NO_DISPLAY = re.compile(r"""style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
#: Parts of class names and ids; what a page says that it has, or has not, is not that thing.
WORDS, ASIDES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), re.compile(r"\b(?:no|has|with|without)[-_][\w-]+", re.I)


class Element:
    __slots__ = ("children", "link", "main", "noise", "path", "rank", "tag")

    def __init__(self, tag: str, path: str, main: int, noise: bool, link: bool, rank: int):
        self.tag, self.path, self.main, self.noise, self.link, self.rank, self.children = tag, path, main, noise, link, rank, []


def _open(tag: str, attributes: str, parent: Element) -> Element:
    name, names, role = "", set(), ""
    if attributes:
        for m in NAME.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            role = value.lower() if m[1].lower() == "role" else role
            name = name or (value.lower().split() or [""])[0]
            names |= {w.lower() for w in WORDS.findall(ASIDES.sub("", value))}
    main = parent.main or (2 if tag == "article" else 1 if tag == "main" or role == "main" else 0)
    noise = parent.noise or tag in NOISE_TAGS or (tag == "header" or "header" in names) and not parent.main
    if names and not noise and tag not in ("article", "main", "body", "html"):
        noise = bool(names & (NOISE_NAMES - OUTSIDE_NAMES if main else NOISE_NAMES))
    if attributes and not noise:
        noise = bool(NO_DISPLAY.search(attributes)) or "hidden" in attributes.lower() and bool(HIDDEN.search(QUOTED.sub("", attributes)))
    style = f"{tag}.{name}" if name else tag
    deep = parent.rank + (tag in BLOCKS)
    path = f"{parent.path}>{style}" if tag in BLOCKS and deep <= DEPTH else parent.path
    return Element(tag, path, main, noise and not (tag in ("article", "main") and not parent.noise), parent.link or tag == "a", deep)


def parse(page: str | None) -> tuple[list[tuple[str, str, int, bool, float]], list[tuple[str, str]]]:
    """Blocks in page order: (path, text, 2 inside article, 1 inside main, else 0; noise, share of link text); and (path, child styles) of elements."""
    blocks: list[tuple] = []
    layout: list[tuple[str, str]] = []
    if not page:
        return blocks, layout
    stack = [Element("", "", 0, False, False, 0)]
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                top = stack[-1]
                blocks.append((top.path, text, top.main, top.noise, min(1.0, linked / max(1, len(raw.strip())))))
            parts.clear()
            linked = 0

    def close(at: int) -> None:
        while len(stack) > at:
            e = stack.pop()
            if e.tag in BLOCKS and e.children:
                layout.append((e.path, ",".join(e.children)))

    at, size, find = 0, len(page), TOKEN.search
    while at < size:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if stack[-1].link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if not m[3].endswith("/") else None
            if end or m[3].endswith("/") or tag in TAKES_ALL or tag == "head":
                at = end.end() if end else size if tag in TAKES_ALL and not m[3].endswith("/") else at
                parts.append(" ")
                continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or tag == "li" and stack[i].tag == "li":
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in VOID or m[3].endswith("/"):
            parts.append(" ")
            continue
        parent = stack[-1]
        e = _open(tag, m[3], parent)
        if tag in BLOCKS:
            style = e.path.rpartition(">")[2]
            holder = next((x for x in reversed(stack) if x.tag in BLOCKS or not x.tag))
            if not holder.children or holder.children[-1] != style:
                holder.children.append(style)
        stack.append(e)
    flush()
    close(1)
    return blocks, layout


def host_of(column: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, presentation, content, importance: the importances of the branches of every host's merged tree."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                blocks, layout = parse(page)
                digest = key(page or "")
                rows += {(host, p, key(text), digest, 0) for p, text, *_ in blocks} | {(host, p, key(c), digest, 1) for p, c in layout}
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int8())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "path", "feature", "digest", "layout"])

    found = materialize(pages.mapInArrow(features, "host string, path string, feature long, digest long, layout byte").distinct(), "features")
    counted = found.groupBy("host", "path", "feature", "layout").agg(F.count("*").alias("k"))
    sizes = found.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("m"))
    # a text counts for its own path and for all paths above
    steps = F.split("path", ">")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ">"))
    texts = counted.filter("layout = 0").groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    texts = texts.filter(F.size(steps) > 1).select("host", F.explode(prefixes).alias("path"), "n", "klogk").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("klogk").alias("klogk"))
    layouts = counted.filter("layout = 1").groupBy("host", "path").agg(F.sum("k").alias("seen"), F.sum(F.col("k") * F.log("k")).alias("slogs"), F.count("*").alias("styles"))
    tree = texts.join(layouts, ["host", "path"], "left").join(sizes, "host")
    log_m = F.greatest(F.log("m"), F.lit(1e-9))  # of one page every entropy is 0
    presentation = F.coalesce((F.log("seen") - F.col("slogs") / F.col("seen")) / log_m, F.lit(0.0))
    content = F.when(F.col("m") == 1, 1.0).otherwise(1 - F.col("klogk") / F.col("n") / log_m)
    g = F.pow(F.lit(DECAY), F.coalesce("styles", F.lit(0)))
    return tree.select("host", "path", F.col("m").alias("pages"), presentation.alias("presentation"), content.alias("content"), ((1 - g) * presentation + g * content).alias("importance"))


def low_paths(tree: DataFrame) -> DataFrame:
    """host, low: the removable paths, each with 1 if it is so even inside a marked part, after weighing with the prior."""
    weighed = lambda prior: (F.col("pages") * F.col("importance") + PRIOR * prior) / (F.col("pages") + PRIOR)
    found = tree.filter(weighed(EVEN) < LOW).select("host", F.concat("path", F.when(weighed(1.0) < LOW, "\t1").otherwise("\t0")).alias("path"))
    return found.groupBy("host").agg(F.collect_set("path").alias("low"))


def main_text(page: str | None, low: dict[str, bool]) -> str:
    """The page's main text. low: removable paths, and whether they are so inside a marked part as well."""
    blocks, _ = parse(page)
    roots = set()  # of marked parts
    for path in {path for path, _, main, _, _ in blocks if main}:
        steps = path.split(">")
        roots |= {">".join(steps[: k + 1]) for k, s in enumerate(steps) if s.partition(".")[0] in ("article", "main")}
    left = []
    for path, text, main, noise, linked in blocks:
        if noise or not main and linked > 0.8:
            continue
        above, gone = path, False
        while above and not gone:
            gone = above in low and (low[above] or not main) and above not in roots
            above = above.rpartition(">")[0]
        if not gone:
            left.append((main, text))
    for mark in (2, 1):
        if sum(len(t) for main, t in left if main >= mark) > SHARE * sum(len(t) for _, t in left):
            return "\n".join(t for main, t in left if main >= mark)
    return "\n".join(t for _, t in left)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    low = materialize(low_paths(style_tree(rows.select("host", "html"))), "low")
    size = low.agg(F.sum(F.length("host") + F.length(F.array_join("low", " ")))).first()[0] or 0
    low = F.broadcast(low) if size <= BROADCAST else low  # beyond that the pages are shuffled to their host's paths
    joined = rows.join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, {p[:-2]: p.endswith("1") for p in x or ()}) for page, x in zip(batch["html"].to_pylist(), batch["low"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
