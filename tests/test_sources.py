"""Stored pages as a data source, sitemaps as XML, page markup that isn't closed."""

import datetime as dt
import gc
import time
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volatide.sources import archive, sites

PAGE = '<html><head><meta property="article:published_time" content="{day}T09:00:00+07:00"></head><body><h1 class="title">Title {n}</h1><div class="detail-content"><p>Body {n}.</p></div></body></html>'


def stored(spark, folder, days, first=0):
    rows = [(f"https://cafef.vn/vi-mo/{first + n}.chn", PAGE.format(day=day, n=first + n), day) for n, day in enumerate(days)]
    archive.write_pages(spark.createDataFrame(rows, "url string, html string, day string"), folder)


DAYS = ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-05", "2024-01-09"]


def test_archive_equals_parsed_pages_and_filters_reach_the_reader(spark, tmp_path):
    folder = str(tmp_path / "pages")
    stored(spark, folder, DAYS)
    archive.register(spark)
    source = lambda **options: spark.read.format("news_pages").options(site="cafef", **options).load(folder)
    got = sorted(tuple(r) for r in archive.articles(source(), "cafef").collect())
    pages = spark.createDataFrame([(f"https://cafef.vn/vi-mo/{n}.chn", PAGE.format(day=d, n=n)) for n, d in enumerate(DAYS)], "url string, html string")
    assert got == sorted(tuple(r) for r in sites.parse_articles(pages, "cafef").collect()) and len(got) == 5
    late = source().where("day >= '2024-01-02' and day < '2024-01-09'")
    assert sorted(r["day"] for r in late.collect()) == ["2024-01-02", "2024-01-05"]
    assert late.rdd.getNumPartitions() < source().rdd.getNumPartitions()
    assert sorted(r["day"] for r in source(start="2024-01-05").collect()) == ["2024-01-05", "2024-01-09"] and source(start="2025-01-01").count() == 0
    with pytest.raises(Exception, match="No selectors"):
        spark.read.format("news_pages").option("site", "other").load(folder).collect()


def test_filters_choose_files():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThanOrEqual

    reader = archive.PageReader({"path": "/nowhere", "site": "plain"})
    url = EqualTo(("url",), "x")
    left = list(reader.pushFilters([GreaterThanOrEqual(("day",), "2024-01-02"), LessThanOrEqual(("day",), "2024-02-01"), GreaterThan(("day",), "2024-01-05"), url]))
    assert (reader.low, reader.high) == ("2024-01-05", "2024-02-01") and left == [GreaterThan(("day",), "2024-01-05"), url]
    assert len(reader.partitions()) == 1 and not list(reader.read(reader.partitions()[0]))


def test_archive_streams_what_is_added(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("pages", "out", "checkpoint"))
    archive.register(spark)

    def take():
        stream = archive.articles(spark.readStream.format("news_pages").option("site", "cafef").load(folder), "cafef")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["title"] for r in spark.read.schema("title string").parquet(out).collect())

    stored(spark, folder, DAYS[:2])
    assert take() == ["Title 0", "Title 1"]
    assert take() == ["Title 0", "Title 1"]
    stored(spark, folder, DAYS[2:], 2)
    assert take() == [f"Title {n}" for n in range(5)]


INDEX = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>{}</loc></sitemap><sitemap><loc> {} </loc></sitemap></sitemapindex>'


def test_sitemaps_of_all_kinds(spark):
    files = [
        ("root", INDEX.format("middle", "broken")),
        ("middle", INDEX.format("leaf", "root")),  # leads back
        ("leaf", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc><![CDATA[https://x/doanh-nghiep/a.chn?a=1&b=2]]></loc><lastmod>2024-01-01</lastmod></url><url><loc>\n https://x/vi-mo/b.chn?a=1&amp;b=2 </loc></url></urlset>'),
        ("prefixed", '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>https://x/vi-mo/c.chn</sm:loc></sm:url></sm:urlset>'),
        ("broken", "<urlset><url><loc>https://x/vi-mo/d.chn</loc></url"),
        ("empty", "<urlset></urlset>"),
        ("none", None),
    ]
    df = spark.createDataFrame(files, "sitemap_url string, xml string")
    by = {r["sitemap_url"]: r for r in sites.read_sitemaps(df).collect()}
    assert by["leaf"]["urls"] == ["https://x/doanh-nghiep/a.chn?a=1&b=2", "https://x/vi-mo/b.chn?a=1&b=2"] and by["prefixed"]["urls"] == ["https://x/vi-mo/c.chn"]
    assert by["root"]["children"] == ["middle", "broken"] and by["broken"]["broken"] and by["none"]["broken"] and not by["leaf"]["broken"]
    assert all(by[x]["urls"] == [] for x in ("root", "empty", "none"))
    found = sites.reachable_sitemaps(df, ["root"])
    assert sorted(r["sitemap_url"] for r in found.collect()) == ["broken", "leaf", "middle", "root"]
    assert {r["url"] for r in sites.sitemap_urls(found).collect()} >= {"https://x/doanh-nghiep/a.chn?a=1&b=2", "https://x/vi-mo/b.chn?a=1&b=2"}


def test_paragraphs_end_at_blocks():
    body = lambda inner: sites.parse(f"<h1>t</h1><div class='detail-content'>{inner}</div>", "cafef")[2]
    assert body("<p>one<p>two<p>three") == "one two three"
    assert body("<p>one <b>bold</b> on</p><p>two</p>") == "one bold on two"
    assert body("<p>one<div>out</div><p>two") == "one two"
    assert body("<p>one <i>x<p>two</i>") == "one x two"
    assert body("<p>a<table><tr><td><p>in</td></tr></table>") == "a in"
    began = time.time()
    assert len(body("<p>some text" * 20_000)) == 20_000 * 10 - 1 and time.time() - began < 20


def test_selectors():
    tree = sites._Tree()
    tree.feed("<div id=a class='x y'><section><p class=k>1</p></section><p>2</p></div><p>3</p>")
    texts = lambda s: [n.text() for n in sites.select(tree.nodes, s)]
    assert texts("#a p") == ["1", "2"] and texts(".x.y > p") == ["2"] and texts("div section > p.k") == ["1"] and texts("p") == ["1", "2", "3"] and texts("[id=a]") == ["1 2"] and texts("div:hover") == []


def test_pages_are_parsed_in_bounded_runs(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"url": [str(i) for i in range(300)], "html": ["x" * n for n in [10] * 200 + [700_000] * 3 + [3_000_000] + [10] * 95] + [None]})
    parts = list(sites._pieces(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows <= sites.TOGETHER and (p.num_rows == 1 or sum(map(len, filter(None, p["html"].to_pylist()))) <= sites.PARSED_BYTES) for p in parts)


def test_a_pages_tree_is_not_left_to_the_collector():
    made, inner = [], sites.Node.__init__

    def noted(self, *args, **kwargs):
        inner(self, *args, **kwargs)
        made.append(weakref.ref(self))

    gc.collect()
    gc.disable()
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sites.Node, "__init__", noted)
            assert sites.parse("<h1>t</h1><div class='detail-content'><p>a<b>b</b></p><p>c</p></div>", "cafef")[2] == "a b c"
        assert made and not [r for r in made if r() is not None]
    finally:
        gc.enable()
