"""Text, corpora, labels, splits, samples, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volatide.functions import dates, text
from volatide.operators import checks, classify, corpus, encoder, labels, stats
from volatide.operators.reconcile import reconcile_keys
from volatide.plans.registry import BLANK, DOCS, INK, NOTES, Registry, norm_sql, r, rounded
from volatide.sources import archive, domain, providers, sites
from volatide.storage import new_folder

REGISTRY = query = Registry()

TOKENS = f"len(list_filter(string_split({norm_sql('input_text')}, ' '), lambda x: x <> ''))::BIGINT"


def _input_sql(title: str, lead: str) -> str:
    return f"concat_ws(' . ', nullif({norm_sql(title)}, ''), nullif({norm_sql(lead)}, ''))"


CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body_text, '<[^>]+>', ' ', 'g'), 'https?://{INK}+|www\\.{INK}+', ' ', 'g'), '{INK}+@{INK}+\\.{INK}+', ' ', 'g'), '{BLANK}+', ' ', 'g'))"
LEAD = f"trim(substring({norm_sql('body_text')}, 1, 300))"
INPUTS = f"""{DOCS}, leads AS (SELECT *, {LEAD} AS body_lead FROM docs), joined AS (SELECT *, {_input_sql('title', 'body_lead')} AS input_text FROM leads),
  counted AS (SELECT *, {TOKENS} AS token_count FROM joined), prepared AS (SELECT * FROM counted WHERE token_count BETWEEN 5 AND 220)"""


@query(f"WITH {DOCS} SELECT article_id, {CLEAN} AS body_clean, length({CLEAN})::BIGINT AS body_len FROM docs")
def clean_body(spark, sf_dir):
    d = domain.corpus(spark, sf_dir)
    c = d.select("article_id", text.clean_body(F.col("body_text")).alias("body_clean"))
    return c.withColumn("body_len", F.length("body_clean").cast("long"))


@query(f"WITH {DOCS}, c AS (SELECT article_id, {CLEAN} AS b FROM docs) SELECT article_id, length(b)::BIGINT AS body_len FROM c WHERE length(b) >= 100")
def min_body_filter(spark, sf_dir):
    d = domain.corpus(spark, sf_dir)
    c = d.select("article_id", F.length(text.clean_body(F.col("body_text"))).cast("long").alias("body_len"))
    return c.where("body_len >= 100")


@query(f"WITH {DOCS} SELECT article_id, {LEAD} AS body_lead FROM docs")
def body_lead(spark, sf_dir):
    return domain.corpus(spark, sf_dir).select("article_id", text.body_lead(F.col("body_text")).alias("body_lead"))


@query(f"WITH {INPUTS} SELECT article_id, input_text FROM joined")
def build_input_text(spark, sf_dir):
    d = domain.corpus(spark, sf_dir)
    return d.select("article_id", text.input_text(F.col("title"), text.body_lead(F.col("body_text"))).alias("input_text"))


@query(f"WITH {DOCS}, i AS (SELECT article_id, body_text AS input_text FROM docs) SELECT article_id, {TOKENS} AS token_count FROM i")
def token_count(spark, sf_dir):
    return domain.corpus(spark, sf_dir).select("article_id", text.count_tokens(F.col("body_text")).alias("token_count"))


@query(f"WITH {INPUTS} SELECT article_id, source, category, body_lead, input_text, token_count FROM prepared")
def prepared_inputs(spark, sf_dir):
    return corpus.prepare_inputs(domain.corpus(spark, sf_dir)).select("article_id", "source", "category", "body_lead", "input_text", "token_count")


@query(f"""WITH {INPUTS} SELECT count(*)::BIGINT AS "count", {r('min(token_count)::DOUBLE "min"', 'max(token_count)::DOUBLE "max"', 'avg(token_count) "mean"', 'quantile_cont(token_count::DOUBLE, 0.95) "p95"')} FROM prepared""")
def token_stats(spark, sf_dir):
    return rounded(corpus.token_stats(corpus.prepare_inputs(domain.corpus(spark, sf_dir))))


@query(f"WITH {INPUTS} SELECT (SELECT count(*) FROM docs)::BIGINT AS raw_rows, count(*)::BIGINT AS prepared_rows, ((SELECT count(*) FROM docs) - count(*))::BIGINT AS dropped_rows, quantile_cont(token_count::DOUBLE, 0.95) < 200 AS p95_under_200 FROM prepared")
def input_report(spark, sf_dir):
    d = domain.corpus(spark, sf_dir)
    return corpus.input_report(d, corpus.prepare_inputs(d)).select("raw_rows", "prepared_rows", "dropped_rows", "p95_under_200")


def training(spark, sf_dir) -> DataFrame:
    d = domain.corpus(spark, sf_dir)
    first = d.select("article_id", "source", F.lit("documents").alias("source_dataset"), "category", "published_at", "title", "body_text")
    bench = domain.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("").alias("category"), F.concat(F.lit("2024-01-"), F.lpad((F.col("item_id") % 28 + 1).cast("string"), 2, "0")).alias("time"), F.substring("text", 1, 40).alias("title"), "text"
    )
    second = corpus.training_rows(bench, "benchmark", "id", "category", "time", "title", "text", max_date="2024-01-20")
    return corpus.training_corpus([first, second], check=False)


TRAINING = f"""{DOCS}, u AS (
    SELECT article_id, source, 'documents' AS source_dataset, category, published_at, title, body_text FROM docs
    UNION ALL SELECT 'b' || item_id, 'benchmark', 'benchmark', '', '2024-01-' || lpad((item_id % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00', substring(text, 1, 40), text FROM benchmark WHERE item_id % 28 + 1 <= 20),
  t AS (SELECT article_id, {norm_sql('source')} AS source, {norm_sql('category')} AS category, published_at, {norm_sql('title')} AS title, {norm_sql('substring(body_text, 1, 1200)')} AS body_text, source_dataset FROM u),
  corpus AS (SELECT *, {_input_sql('title', 'body_text')} AS input_text FROM t)"""


@query(f"WITH {TRAINING} SELECT article_id, source, category, published_at, title, body_text, input_text, source_dataset FROM corpus")
def training_corpus(spark, sf_dir):
    return training(spark, sf_dir)


@query(f"WITH {TRAINING} SELECT source_dataset, year(published_at::TIMESTAMP)::BIGINT AS year, count(*)::BIGINT AS n FROM corpus GROUP BY 1, 2")
def corpus_report(spark, sf_dir):
    year = F.year(F.try_to_timestamp("published_at")).cast("long").alias("year")
    return training(spark, sf_dir).groupBy("source_dataset", year).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)) AS day FROM orders")
def extract_date(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd'T'10:00")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("on "), F.date_format(day, "d/M/yyyy"), F.lit(", late"))).otherwise(F.date_format(day, "dd-MM-yyyy"))
    return o.select(F.col("o_orderkey").alias("k"), dates.extract_date(raw).alias("day"))


@query("SELECT o_orderkey AS k, (TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 86413))::DATE AS day FROM orders")
def date_from_unix(spark, sf_dir):
    return domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.date_from_unix(F.col("o_orderkey") * 86413).alias("day"))


@query("SELECT o_orderkey AS k, epoch(o_orderdate::DATE)::BIGINT AS first_second, epoch(o_orderdate::DATE)::BIGINT + 86399 AS last_second FROM orders")
def unix_seconds(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.unix_seconds(day).alias("first_second"), dates.unix_seconds(day, True).alias("last_second"))


_CASES = " ".join(f"WHEN contains(url, '{k}') THEN '{v}'" for k, v in sites.BUSINESS_KEYWORDS.items())


@query(f"SELECT p_partkey AS k, CASE {_CASES} ELSE '{sites.DEFAULT_CATEGORY}' END AS category FROM (SELECT p_partkey, '/' || ['vi-mo', 'kinh-te-vi-mo', 'tai-chinh-ngan-hang', 'x-chung-khoan', 'doanh-nghiep', 'the-thao', 'bat-dong-san'][p_partkey % 7 + 1] || '/' || p_partkey AS url FROM part)")
def infer_category(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    names = F.array(*[F.lit(x) for x in ("vi-mo", "kinh-te-vi-mo", "tai-chinh-ngan-hang", "x-chung-khoan", "doanh-nghiep", "the-thao", "bat-dong-san")])
    url = F.concat(F.lit("/"), F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("/"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("k"), text.infer_category(url, sites.BUSINESS_KEYWORDS, sites.DEFAULT_CATEGORY).alias("category"))


SPANS = "spans AS (SELECT c_custkey AS k, DATE '2015-01-01' + (c_custkey % 700)::INTEGER AS a, DATE '2015-01-01' + (c_custkey % 700 + 10 + c_custkey % 90)::INTEGER AS b FROM customer)"


def spans(spark, sf_dir) -> DataFrame:
    c, start = F.col("c_custkey"), F.lit("2015-01-01").cast("date")
    return domain.table(spark, sf_dir, "customer").select(c.alias("k"), F.date_add(start, (c % 700).cast("int")).alias("a"), F.date_add(start, (c % 700 + 10 + c % 90).cast("int")).alias("b"))


@query(f"WITH {SPANS}, d AS (SELECT k, b, unnest(generate_series(a, b, INTERVAL 15 DAY))::DATE AS block_start FROM spans) SELECT k, block_start, least(block_start + 14, b) AS block_end FROM d")
def date_blocks(spark, sf_dir):
    return dates.date_blocks(spans(spark, sf_dir), "a", "b", 15).select("k", "block_start", "block_end")


@query(f"WITH {SPANS}, m AS (SELECT *, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH))::DATE AS m FROM spans) SELECT k, greatest(m, a) AS month_start, least(last_day(m), b) AS month_end FROM m")
def month_ranges(spark, sf_dir):
    return dates.month_ranges(spans(spark, sf_dir), "a", "b").select("k", "month_start", "month_end")


@query(f"""WITH {SPANS}, m AS (SELECT *, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH))::DATE AS m FROM spans), f AS (SELECT *, unnest([1, 6, 11, 16, 21, 26]) AS d FROM m),
    e AS (SELECT k, (m + (d - 1)::INTEGER) AS s, CASE WHEN d = 26 THEN last_day(m) ELSE m + (d + 3)::INTEGER END AS t FROM f)
    SELECT k, s AS block_start, t AS block_end, 'https://cafef.vn/sitemaps/sitemaps-' || year(s) || '-' || month(s) || '-' || day(s) || '-' || day(t) || '.xml' AS sitemap_url FROM e""")
def five_day_blocks(spark, sf_dir):
    return sites.sitemap_blocks(spans(spark, sf_dir), "a", "b", "https://cafef.vn").select("k", "block_start", "block_end", "sitemap_url")


@query("""WITH x AS (SELECT DISTINCT 'https://cafef.vn/' || ['doi-song', 'doanh-nghiep', 'vi-mo', 'the-gioi'][p_size % 4 + 1] || '/' || p_size || CASE WHEN p_size % 5 = 0 THEN '.html' ELSE '.chn' END AS url FROM part)
  SELECT url FROM x WHERE contains(url, '.chn') AND (contains(url, 'doanh-nghiep') OR contains(url, 'vi-mo'))""")
def sitemap_urls(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    names = F.array(*[F.lit(x) for x in ("doi-song", "doanh-nghiep", "vi-mo", "the-gioi")])
    url = F.concat(F.lit("https://cafef.vn/"), F.element_at(names, F.col("p_size") % 4 + 1), F.lit("/"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, ".html").otherwise(".chn"))
    return sites.sitemap_urls(p.select(F.concat(F.lit("<urlset><url><loc> "), url, F.lit(" </loc></url></urlset>")).alias("xml")))


@query("SELECT page_id, nullif(regexp_replace(url, '#.*$', ''), '') AS url FROM pages")
def normalize_url(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


SITE_PATHS = ("vi-mo", "bat-dong-san", "tin-khac")
#: A page of each site's markup around a document's lines.
SITE_PAGES = {
    "cafef": ('<html><head><meta property="article:published_time" content="{day}T08:30:00+07:00"></head><body><h1 class="title">{title}</h1><p class="sapo">{lead}</p><div class="detail-content">{body}</div><p>Outside</p></body></html>', True),
    "vnexpress": ('<html><head><meta name="pubdate" content="{day}T08:30:00+07:00"></head><body><h1 class="title-detail">{title}</h1><p class="description">{lead}</p><article class="fck_detail">{body}</article><p>Outside</p></body></html>', True),
    "vietstock": ('<html><body><h1 class="article-title">{title}</h1><span class="date">{day}</span><p>{lead}</p><div class="article-body">{body}</div></body></html>', False),
}


def site_pages(spark, sf_dir, site: str) -> DataFrame:
    """(url, html): every document as a page of a site."""
    d = domain.table(spark, sf_dir, "documents")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(300)).cast("int")).cast("string")
    path = F.element_at(F.array(*[F.lit(p) for p in SITE_PATHS]), (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))
    filled = {"day": day, "title": F.concat(F.lit("Title "), F.col("doc_id").cast("string")), "lead": F.concat(F.lit("Lead "), F.col("lang")), "body": F.concat(F.lit("<p>"), F.replace(plain, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))}
    parts = [part for piece in SITE_PAGES[site][0].split("{") for part in piece.split("}")]  # text, name, text, name, ...
    html = F.concat(*[filled[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    return d.select(F.concat(F.lit(f"https://{site}.vn/"), path, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".htm")).alias("url"), html.alias("html"))


def _site_sql(site: str) -> str:
    stamp = "(DATE '2024-01-01' + (doc_id % 300)::INTEGER)::VARCHAR"
    with_lead = SITE_PAGES[site][1]
    body = f"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g'), '{BLANK}+', ' ', 'g'))"
    # Three of vnexpress' selectors pick the same paragraphs, which the rules take each time.
    bodies = ", ".join([f"nullif({body}, '')"] * (3 if site == "vnexpress" else 1))
    whole = f"concat_ws(' ', 'Lead ' || lang, {bodies})" if with_lead else body
    return f"""WITH d AS (SELECT *, {stamp} AS day, doc_id % 3 AS k FROM documents)
    SELECT 'https://{site}.vn/' || CASE k WHEN 0 THEN 'vi-mo' WHEN 1 THEN 'bat-dong-san' ELSE 'tin-khac' END || '/' || doc_id || '.htm' AS url, '{site}' AS source,
      CASE k WHEN 0 THEN 'Vĩ mô' WHEN 1 THEN 'Bất động sản' ELSE 'Kinh doanh' END AS category, 'Title ' || doc_id AS title, day AS date, {"day || 'T08:30:00+07:00'" if with_lead else "day"} AS published_at, {whole} AS body
    FROM d WHERE {whole} <> ''"""


@query(_site_sql("cafef"))
def html_articles_cafef(spark, sf_dir):
    return sites.parse_articles(site_pages(spark, sf_dir, "cafef"), "cafef")


@query(_site_sql("vnexpress"))
def html_articles_vnexpress(spark, sf_dir):
    return sites.parse_articles(site_pages(spark, sf_dir, "vnexpress"), "vnexpress")


@query(_site_sql("vietstock"))
def html_articles_vietstock(spark, sf_dir):
    return sites.parse_articles(site_pages(spark, sf_dir, "vietstock"), "vietstock")


def _archive(spark, sf_dir, site: str) -> str:
    """The site's pages in an archive: a folder a day of January."""
    folder = new_folder(spark, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64("url"), F.lit(31)).cast("int")).cast("string")
    archive.write_pages(site_pages(spark, sf_dir, site).withColumn("day", day), folder)
    archive.register(spark)
    return folder


@query(_site_sql("cafef"))
def archive_articles(spark, sf_dir):
    """html_articles_cafef through the data source of stored pages."""
    return archive.articles(spark.read.format("news_pages").option("site", "cafef").load(_archive(spark, sf_dir, "cafef")), "cafef")


@query(_site_sql("vietstock"))
def archive_stream_articles(spark, sf_dir):
    """html_articles_vietstock through the stream of stored pages."""
    folder, out = _archive(spark, sf_dir, "vietstock"), new_folder(spark, "articles")
    stream = spark.readStream.format("news_pages").option("site", "vietstock").load(folder)
    archive.articles(stream, "vietstock").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query()
def html_articles(spark, sf_dir):
    return sites.parse_articles(domain.table(spark, sf_dir, "pages"), "plain", require_date=False)


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\\s*>', ' ', 'g'), '(?is)<style.*?</style\\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{BLANK}+', ' ', 'g')) AS visible FROM pages")
def clean_html(spark, sf_dir):
    return domain.table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("visible"))


HASHED = f"{DOCS}, h AS (SELECT article_id, source, title, substring(sha256(lower(regexp_replace(title, '^{BLANK}+|{BLANK}+$', '', 'g')) || '|' || substring(published_at, 1, 10)), 1, 16) AS title_hash FROM docs)"


@query(f"WITH {HASHED} SELECT article_id, title_hash FROM h")
def title_hash(spark, sf_dir):
    d = domain.corpus(spark, sf_dir)
    return d.select("article_id", text.title_hash(F.col("title"), F.substring("published_at", 1, 10)).alias("title_hash"))


@query(
    f"""WITH {DOCS}, h AS (SELECT article_id AS url, source, substring(sha256(lower(regexp_replace(title, '^{BLANK}+|{BLANK}+$', '', 'g')) || '|' || category), 1, 16) AS title_hash FROM docs),
    n AS (SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY CASE source WHEN 'src1' THEN 1 WHEN 'src0' THEN 2 ELSE 3 END, url) AS i FROM h) SELECT url, source, title_hash FROM n WHERE i = 1"""
)
def title_hash_dedupe(spark, sf_dir):
    from volatide.operators.reconcile import title_dedupe

    d = domain.corpus(spark, sf_dir).select(F.col("article_id").alias("url"), "source", "title", F.col("category").alias("date"))
    return title_dedupe(d, ["src1", "src0"]).select("url", "source", "title_hash")


# --- labels and splits ----------------------------------------------------------------------------------------

MERGED = f"""{TRAINING}, {NOTES}, kept AS (SELECT * FROM notes WHERE confidence >= 0.8),
  merged AS (
    SELECT c.article_id, c.source, c.source_dataset, c.published_at, CASE WHEN v.article_id IS NOT NULL THEN 'positive' ELSE k.label END AS label,
      CASE WHEN v.article_id IS NOT NULL THEN 1.0::DOUBLE ELSE k.confidence END AS confidence, CASE WHEN v.article_id IS NOT NULL THEN 'reviewed' WHEN k.article_id IS NOT NULL THEN 'bootstrap' END AS label_source
    FROM corpus c LEFT JOIN kept k USING (article_id) LEFT JOIN (SELECT article_id FROM notes WHERE doc_id % 10 = 0) v USING (article_id)
    WHERE v.article_id IS NOT NULL OR k.article_id IS NOT NULL),
  days AS (SELECT published_at::DATE AS day, row_number() OVER (ORDER BY published_at::DATE) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT published_at::DATE AS published_at FROM merged)),
  split AS (SELECT m.*, CASE WHEN i <= least(greatest(1, round_even(n * 0.8::DOUBLE, 0)), n - 1) THEN 'train' WHEN i <= least(greatest(1, round_even(n * 0.8::DOUBLE, 0)), n - 1) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
    FROM merged m JOIN days ON day = published_at::DATE)"""


def merged(spark, sf_dir) -> DataFrame:
    m = labels.merge_annotations(training(spark, sf_dir), domain.annotations(spark, sf_dir), domain.reviews(spark, sf_dir), check=False)
    return labels.assign_splits(m, train=0.8, val=0.1)


@query(f"WITH {MERGED} SELECT article_id, label, {r('confidence')}, label_source, split FROM split")
def merge_annotations(spark, sf_dir):
    return rounded(labels.labelled_corpus(merged(spark, sf_dir)).select("article_id", "label", "confidence", "label_source", "split"))


@query(f"WITH {MERGED} SELECT split, min(published_at::DATE) AS first_day, max(published_at::DATE) AS last_day, count(*)::BIGINT AS n FROM split GROUP BY 1")
def temporal_split_days(spark, sf_dir):
    day = F.to_date(F.try_to_timestamp("published_at"))
    return merged(spark, sf_dir).groupBy("split").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


@query(f"WITH {MERGED} SELECT source, {', '.join(f'''sum((split = '{s}')::INTEGER)::BIGINT AS n_{s}''' for s in ('train', 'val', 'test'))} FROM split GROUP BY 1")
def split_source_crosstab(spark, sf_dir):
    return checks.crosstab(merged(spark, sf_dir), "source", "split", ["train", "val", "test"])


@query(f"WITH {NOTES} SELECT article_id, label, {r('confidence')} FROM notes WHERE confidence >= 0.8")
def confidence_filter(spark, sf_dir):
    return rounded(labels.clean_annotations(domain.annotations(spark, sf_dir), "annotation file", 0.8, check=False).drop("label_source"))


@query(f"WITH {TRAINING}, {NOTES} SELECT article_id FROM corpus WHERE article_id NOT IN (SELECT article_id FROM notes)")
def unlabeled_rows(spark, sf_dir):
    t = training(spark, sf_dir).select("article_id").join(domain.annotations(spark, sf_dir).select("article_id", "label"), "article_id", "left")
    return labels.unlabeled(t).select("article_id")


@query(f"WITH {DOCS}, {NOTES} SELECT CASE WHEN n.article_id IS NOT NULL THEN 'both' ELSE 'left_only' END AS merge, count(*)::BIGINT AS n FROM docs d LEFT JOIN notes n USING (article_id) GROUP BY 1")
def label_coverage(spark, sf_dir):
    return reconcile_keys(domain.corpus(spark, sf_dir), domain.annotations(spark, sf_dir), ["article_id"])


BUCKETS = f"{DOCS}, b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY category) >= 1000 THEN 'high' WHEN count(*) OVER (PARTITION BY category) >= 100 THEN 'mid' ELSE 'low' END AS category_bucket FROM docs)"


@query(f"WITH {BUCKETS} SELECT article_id, category, category_bucket FROM b")
def category_frequency_bucket(spark, sf_dir):
    return labels.category_bucket(domain.corpus(spark, sf_dir)).select("article_id", "category", "category_bucket")


@query(f"WITH {DOCS}, k AS (SELECT article_id, row_number() OVER (ORDER BY published_at::DATE, doc_id) AS i, count(*) OVER () AS n FROM docs) SELECT article_id, 'period_' || (floor(least(i / n, 0.999999::DOUBLE) * 4) + 1)::INTEGER AS period FROM k")
def period_bucket(spark, sf_dir):
    return stats.period_bucket(domain.corpus(spark, sf_dir), F.to_date(F.try_to_timestamp("published_at"))).select("article_id", "period")


@query(
    f"""WITH {BUCKETS}, t AS (SELECT article_id, source, year(published_at::TIMESTAMP) AS y, category_bucket, row_number() OVER (PARTITION BY source, year(published_at::TIMESTAMP), category_bucket ORDER BY md5('42:' || article_id), article_id) AS turn FROM b)
    SELECT article_id FROM t ORDER BY turn, source, y, category_bucket LIMIT 200"""
)
def stratified_sample(spark, sf_dir):
    return labels.stratified_sample(domain.corpus(spark, sf_dir), 200).select("article_id")


@query(
    f"""WITH {DOCS}, p AS (SELECT article_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || article_id), article_id) AS i, md5('42:' || article_id) AS h FROM docs),
    q AS (SELECT source, 210 // count(*) OVER () + (row_number() OVER (ORDER BY source) <= 210 % count(*) OVER ())::INTEGER AS quota FROM (SELECT DISTINCT source FROM docs))
    SELECT article_id, source FROM p JOIN q USING (source) ORDER BY (i > quota)::INTEGER, CASE WHEN i > quota THEN h END NULLS FIRST, source, i LIMIT 210"""
)
def source_balanced_sample(spark, sf_dir):
    return labels.source_balanced_sample(domain.corpus(spark, sf_dir), 210).select("article_id", "source")


@query(f"WITH {DOCS} SELECT source, count(*)::BIGINT AS n FROM docs GROUP BY 1")
def value_counts(spark, sf_dir):
    return checks.value_counts(domain.corpus(spark, sf_dir), "source")


@query(f"WITH {DOCS} SELECT category, {r('count(*) / sum(count(*)) OVER () share')} FROM docs GROUP BY 1")
def normalized_counts(spark, sf_dir):
    return rounded(checks.value_shares(domain.corpus(spark, sf_dir), "category"))


@query("SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20")
def top20_categories(spark, sf_dir):
    return checks.top_categories(domain.table(spark, sf_dir, "part"), "p_type")


@query(f"WITH {DOCS} SELECT source, {', '.join(f'sum((year(published_at::TIMESTAMP) = {y})::INTEGER)::BIGINT AS n_{y}' for y in range(1995, 2002))} FROM docs GROUP BY 1")
def crosstab_source_year(spark, sf_dir):
    d = domain.corpus(spark, sf_dir).withColumn("year", F.coalesce(F.year(F.try_to_timestamp("published_at")), F.lit(-1)))
    return checks.crosstab(d, "source", "year", list(range(1995, 2002)))


# --- classes --------------------------------------------------------------------------------------------------

VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label % 3 AS k FROM embeddings),
  e AS (SELECT k, i, avg(x[i]) AS m FROM (SELECT k, x, unnest(range(1, len(x) + 1)) AS i FROM v) GROUP BY 1, 2),
  c AS (SELECT k, list(m ORDER BY i) AS m FROM e GROUP BY 1),
  z AS (SELECT vec_id, v.k, list(4.0::DOUBLE * list_dot_product(x, m) ORDER BY c.k) AS z FROM v, c GROUP BY vec_id, v.k),
  p AS (SELECT vec_id, k, list_transform(z, lambda a: exp(a - list_max(z)) / list_sum(list_transform(z, lambda b: exp(b - list_max(z))))) AS p FROM z),
  scored AS (SELECT vec_id, k, p[1] AS prob_negative, p[2] AS prob_neutral, p[3] AS prob_positive, p[3] - p[1] AS sentiment_score,
    CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 'negative' WHEN p[2] >= p[3] THEN 'neutral' ELSE 'positive' END AS sentiment_label FROM p)"""


def scored(spark, sf_dir) -> DataFrame:
    e = domain.table(spark, sf_dir, "embeddings").withColumn("k", F.col("label") % 3)
    z = classify.centroid_logits(e, "embedding", "k").withColumn("p", classify.softmax(F.col("logits")))
    return classify.score_rows(z, "p")


@query(f"WITH {VECTORS} SELECT vec_id, {r('prob_negative', 'prob_neutral', 'prob_positive')} FROM scored")
def centroid_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("vec_id", "prob_negative", "prob_neutral", "prob_positive"))


@query(f"WITH {VECTORS} SELECT vec_id, sentiment_label, {r('sentiment_score')} FROM scored")
def softmax_labels(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("vec_id", "sentiment_label", "sentiment_score"))


GOLD = "['negative', 'neutral', 'positive'][k + 1]"


def _gold():
    return F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (F.col("k") + 1).cast("int"))


@query(f"WITH {VECTORS} SELECT {GOLD} AS gold, {', '.join(f'''sum((sentiment_label = '{x}')::INTEGER)::BIGINT AS predicted_{x}''' for x in ('negative', 'neutral', 'positive'))} FROM scored GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return classify.confusion(scored(spark, sf_dir).withColumn("gold", _gold()), "gold")


@query(f"WITH {VECTORS} SELECT k, count(*)::BIGINT AS n, {r(f'avg((sentiment_label = {GOLD})::INTEGER::DOUBLE) accuracy')} FROM scored GROUP BY 1")
def accuracy_by_group(spark, sf_dir):
    return rounded(classify.accuracy(scored(spark, sf_dir).withColumn("gold", _gold()), ["k"], "gold"))


@query()
def text_classifier(spark, sf_dir):
    rows = merged(spark, sf_dir)
    model = classify.train(rows.where("split = 'train'"))
    return classify.predict(model, rows).select("article_id", "split", "label", "sentiment_label", "sentiment_score", "prob_negative", "prob_neutral", "prob_positive")


@query()
def encoder_classifier(spark, sf_dir):
    """The same labels by sub-word embeddings with attention."""
    rows = merged(spark, sf_dir)
    model = encoder.train(rows, workers=2)
    return encoder.predict(model, rows).select("article_id", "split", "label", "sentiment_label", "sentiment_score", "prob_negative", "prob_neutral", "prob_positive")


# --- language-model labelling ---------------------------------------------------------------------------------


@query(f"WITH {NOTES} SELECT article_id, label, {r('least(confidence, 1) confidence')}, CASE WHEN doc_id % 11 = 0 THEN 'invalid_label' ELSE 'ok' END AS status FROM (SELECT article_id, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'bullish' ELSE label END AS label, confidence FROM notes)")
def llm_json_salvage(spark, sf_dir):
    a = domain.annotations(spark, sf_dir)
    one = F.struct("article_id", F.when(F.col("doc_id") % 11 == 0, "bullish").otherwise(F.col("label")).alias("label"), "confidence", F.lit("because").alias("rationale"))
    body = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(one))).otherwise(F.to_json(one))
    answers = a.select(F.concat(F.lit("Sure, here it is:\n"), body, F.lit("\nHope that helps.")).alias("answer"))
    rows = answers.select(F.explode(text.salvage_json(F.col("answer"))).alias("a")).select("a.*")
    return rounded(rows.select("article_id", "label", "confidence", text.answer_status(F.col("label"), F.col("confidence"), F.col("rationale")).alias("status")))


@query("SELECT conv_id, string_agg('[' || i || '] ' || text, chr(10) || chr(10) ORDER BY i) AS prompt, count(*)::BIGINT AS n_items FROM (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS i FROM conversations) GROUP BY 1")
def llm_batch_prompts(spark, sf_dir):
    return labels.batch_prompts(domain.table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")


@query()
def bootstrap_labels(spark, sf_dir):
    def short_first(rows: list[dict]) -> list[dict]:
        """Stands in for a model: fails on batches with a long text."""
        if any(len(row["title"]) > 50 for row in rows):
            raise RuntimeError("too long")
        return any_length(rows)

    def any_length(rows: list[dict]) -> list[dict]:
        return [{"article_id": row["article_id"], "label": "positive" if "a" in row["title"] else "neutral", "confidence": 0.9, "rationale": "letters"} for row in rows]

    return labels.bootstrap_labels(domain.corpus(spark, sf_dir).select("article_id", "title"), [("short", short_first), ("any", any_length)])


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'https://x/' || p_partkey ELSE 'vnstock://vci/S' || p_size || '/' || p_partkey END AS url, trim(p_name) AS title, '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS date,
  CASE WHEN p_partkey % 3 = 0 THEN '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') || 'T08:30:00' ELSE '' END AS published_at, CASE WHEN p_partkey % 5 = 0 THEN trim(p_name) ELSE trim(p_type) END AS body FROM part""")
def provider_first_present(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    k = F.col("p_partkey")
    raw = p.select(
        F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("symbol"),
        F.lit(" ").alias("news_title"),
        F.col("p_name").alias("newsTitle"),
        F.when(k % 3 == 0, F.concat(day, F.lit("T08:30:00"))).alias("published_at"),
        day.alias("public_date"),
        F.when(k % 5 != 0, F.col("p_type")).alias("newsFullContent"),
        F.when(k % 2 == 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("newsSourceLink"),
        k.cast("string").alias("id"),
    )
    return providers.normalize_rows(raw, "VCI").select("url", "title", "date", "published_at", "body")


@query("SELECT s_suppkey AS id, 'S' || s_nationkey AS symbol, CASE WHEN s_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS provider FROM supplier")
def provider_fallback(spark, sf_dir):
    s = domain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("symbol"))
    first = s.where(F.col("s_nationkey") % 2 == 0).withColumn("provider", F.lit("first"))
    return providers.with_fallback([first, s.withColumn("provider", F.lit("second"))]).select("id", "symbol", "provider")


@query("SELECT id, symbol, n > 100 AS capped FROM (SELECT o_orderkey AS id, o_orderpriority AS symbol, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i <= 100")
def provider_pagination(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"))
    return providers.paginate(o, 50, 2, ["id"])
