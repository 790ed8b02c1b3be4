"""The operators on pages."""

from __future__ import annotations

import gzip
import html as entities
import re
import uuid
from pathlib import Path

import pytest

from gatewatch.llm import html, warc
from gatewatch.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><main><article><header><h1>Ti&amp;tle &lt;b&gt;</h1></header><p>One <b>two</b><br>three&nbsp; four<p>five<script>var t="</p>";</script>
<div class="ad">buy</div><ul><li>x<li>y</ul><form>name <input></form><section class="comments"><article><p>nice</p></article></section><p>last<!-- no --></article><aside>side</aside></main><footer>foot</footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE, {}) == "Ti&tle <b>\nOne two three four\nfive\nx\ny\nlast"


def test_names_of_noise():
    page = '<body><div class="wrap has-sidebar no-comments"><div id="siteHeader">h</div><div title="a hidden gem"><p>kept</p></div><div hidden>gone</div><p style="display: none">gone</p><div class="userComments"><p>c</p></div></div></body>'
    assert html.main_text(page, {}) == "kept"


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<a title=\"x>y", "<p>a</b></i><table><tr><td>b", "<script>", "<!-- open", "&#xZZ;&amp;"])
def test_broken_pages(page):
    html.parse(page)
    html.main_text(page, {})


def test_pages_of_the_table(spark, sf):
    pages = {r["page_id"]: r for r in table(spark, sf, "pages").collect()}
    rows = html.op1_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|br)>", inside[1]) if inside else []
        want = "\n".join(t for b in blocks if (t := " ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert r["text"] == want and r["n_chars"] == len(want)


def test_style_tree_removes_what_a_site_repeats(spark):
    body = "<div class=top>Welcome to our site</div><div class=story><p>Story {0} begins here with {0}.</p><p>It goes on for {0} days.</p></div><div class=low>Imprint and terms</div>"
    rows = [(i, "http://a.example/x", f"<body>{body.format(i)}</body>") for i in range(12)] + [(20, None, "<body><p>alone</p></body>"), (21, "bad url", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[3] == "Story 3 begins here with 3.\nIt goes on for 3 days." and got[20] == "alone" and got[21] == ""
    assert html.extract(df.limit(0)).count() == 0


ODD = {
    '<article><p class="a"">Hello there</p><p>x</p></article>': "Hello there\nx",
    "<article><p title=it's>Hello there</p><p>Don't drop</p><p>Last</p></article>": "Hello there\nDon't drop\nLast",
    "<article><p>let <math><mi>x</mi></math> be</p><button>go<p>after</p></article>": "let x be\ngo\nafter",
    "<article><p>Teaser</p></article><div><p>The story itself, which is much longer than the teaser that stands beside it.</p></div>": "Teaser\nThe story itself, which is much longer than the teaser that stands beside it.",
    '<article><div class="search-results"><p>found</p></div></article>': "found",
}


@pytest.mark.parametrize("page", ODD)
def test_odd_markup(page):
    assert html.main_text(page, {}) == ODD[page]


def site(n):
    body = "<div class=top>Welcome to our site</div>{1}<div class=hint>Rate this story</div><p>Story {0} begins here with {0}.</p><div class=deep><div>It goes on for {0} days.</div></div>{2}<div class=low>Imprint and terms</div>"
    return [(i, f"http://a.example/{i}", f"<body>{body.format(i, *(('<article>', '</article>') if i % 2 else ('', '')))}</body>") for i in range(n)]


def test_importances_by_hand(spark):
    """The tree's entropies against a plain computation, and the tree deciding inside and outside of marked articles."""
    from collections import Counter, defaultdict
    from math import log

    rows = site(120)
    tree = {r["path"]: r for r in html.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string").select(html.host_of().alias("host"), "html")).collect()}
    seen, layouts = defaultdict(Counter), defaultdict(Counter)
    for _, _, page in rows:
        blocks, layout = html.parse(page)
        for path, text in {(b[0], b[1]) for b in blocks}:
            steps = path.split(">")
            for k in range(2, len(steps) + 1):
                seen[">".join(steps[:k])][path, text] += 1
        for path, children in set(layout):
            layouts[path][children] += 1
    m = len(rows)
    assert set(tree) == set(seen)
    for path, counts in seen.items():
        content = sum(k * (1 - log(k) / log(m)) for k in counts.values()) / sum(counts.values())
        styles = layouts[path]
        presentation = -sum(k / styles.total() * log(k / styles.total()) for k in styles.values()) / log(m) if styles else 0
        g = html.DECAY ** len(styles)
        assert tree[path]["importance"] == pytest.approx((1 - g) * presentation + g * content, abs=1e-9)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} begins here with {i}.\nIt goes on for {i} days." for i in range(120))


def expected(rows):
    groups = {}
    for page, _, text in rows:
        groups.setdefault(warc.base32_sha1((text or "").encode()), []).append(page)
    out = []
    for page, _, text in rows:
        digest = warc.base32_sha1((text or "").encode())
        winner = max((p for p in groups[digest] if p is not None), default=None)
        out.append((page, len((text or "").encode()), digest, winner))
    return out


def test_archives(spark, tmp_path):
    rows = [(i, f"u{i}", t) for i, t in enumerate(["a", "a", None, "", "b" * 300_000, "é", "a", None])] + [(None, None, "a"), (9, "line\nbreak", "z"), (9, "line\nbreak", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder, shards=3, roll_bytes=100)
    got = warc.read_archives(manifest, folder).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in got) == sorted(str(x[:3]) for x in expected(rows))
    winner = {x[2]: x[3] for x in expected(rows)}
    for r in got:
        first = r["record_type"] == "response"
        assert r["refers_to"] == (None if first else winner[r["payload_digest"]]) and (not first or r["page_id"] == winner[r["payload_digest"]])
    assert sum(r["record_type"] == "response" for r in got) == len(winner)
    files = sorted(p.name for p in Path(tmp_path, "w").iterdir() if p.is_file())
    assert files == sorted(r["file"] for r in manifest.collect())
    assert gzip.decompress((tmp_path / "w" / files[0]).read_bytes()).startswith(b"WARC/1.1\r\n")


def test_cuts_despite_outlying_ids(spark):
    ids = [*range(1000), 10**15, -(10**14), 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "page_id long")
    cuts = warc._cuts(df, 8)
    sizes = [sum(1 for i in ids if sum(c <= i for c in cuts) == k) for k in range(8)]
    assert len(cuts) == 7 and max(sizes) < 1.5 * len(ids) / 8, sizes
    assert warc._cuts(df.limit(0), 8) == [] and len(set(warc._cuts(spark.createDataFrame([(5,)] * 50, "page_id long"), 8))) <= 1


def test_archives_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string, shard int, told int"), folder, shards=3)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0


def test_archives_are_deterministic(spark, sf, tmp_path):
    pages = table(spark, sf, "pages")
    seen = []
    for parts in (2, 5):
        folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
        warc.write_archives(pages.repartition(parts), folder, shards=3)
        seen.append({p.name: p.read_bytes() for p in Path(folder[7:]).glob("*.gz")})
    assert seen[0] == seen[1] and len(seen[0]) == 3


def test_a_broken_archive_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder, shards=1)
    path = next(Path(tmp_path, "w").glob("*.gz"))
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"\r\n\r\ntext", b"\r\n\r\ntexx")))
    with pytest.raises(Exception, match="digests"):
        warc.read_archives(manifest, folder).collect()
