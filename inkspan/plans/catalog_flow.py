"""Queries of sources, sinks, views, pipelines and streams on made cases, with their SQL twins.

What a source reads is landed first, in the folder that driver and executors share, by the sink of the same form.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tags, text
from ..functions.taxonomy import DEFAULT, EARLIER
from ..operators import chunks, dedup, joins
from ..sources import html, notices, readers, releases, rules, web, writers
from ..streaming import aggregates, incremental, precedence
from . import analytics, dashboard, pipelines, views
from .catalog_text import CASES, cases, comma, keyword_sql, or_other, pattern_sql, primary_sql, table

QUERIES = {}
ORACLE_SQL = {}
#: Rows of an index file, about.
INDEX_ROWS = 50_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_NATION = T.StructType([T.StructField("id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("source"), F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit('say "é", '), F.col("n_name"), F.lit("\nline"))).alias("text"))


_NATIONS = """n AS (SELECT n_nationkey AS id, n_name AS source, CASE WHEN n_nationkey % 4 > 0 THEN 'say "é", ' || n_name || chr(10) || 'line' END AS text FROM nation)"""


# --- sources and sinks -------------------------------------------------------------------------------------------


@query(f"WITH {_NATIONS} SELECT id, 'desk' AS source, source AS source_detail, text FROM n")
def json_lines_scan(spark, d):
    path = readers.landing(spark, "lines")
    writers.json_lines(_nations(spark, d), path)
    return readers.json_lines(spark, path, _NATION, "desk")


@query(f"WITH {_NATIONS} SELECT id, source, text FROM n")
def json_array_scan(spark, d):
    path = readers.landing(spark, "array")
    writers.json_array(_nations(spark, d)).coalesce(1).write.text(path)
    return readers.json_array(spark, path, _NATION)


@query(f"WITH {_NATIONS} SELECT CAST(id AS VARCHAR) AS id, coalesce(text, 'null') AS text, '[\"' || source || '\",\"' || id || '\"]' AS list, CASE WHEN id % 2 = 0 THEN '{{\"a\":' || id || '}}' ELSE 'null' END AS object FROM n")
def csv_round_trip(spark, d):
    path = readers.landing(spark, "csv")
    rows = _nations(spark, d).select("id", "text", F.array("source", F.col("id").cast("string")).alias("list"), F.when(F.col("id") % 2 == 0, F.struct(F.col("id").alias("a"))).alias("object"))
    writers.csv(rows, path)
    return readers.csv(spark, path).na.fill("null")


@query(f"WITH {_NATIONS} SELECT id, source, text, 'there' AS found FROM n")
def optional_sources(spark, d):
    path = readers.landing(spark, "there")
    writers.json_lines(_nations(spark, d), path)
    parts = [readers.optional(spark, p, _NATION).withColumn("found", F.lit(name)) for p, name in ((path, "there"), (path + "-not", "absent"))]
    return joins.union_all(parts)


@query("SELECT 1 AS place, 'report' AS kind, 'https://r.org/2021' AS url UNION ALL SELECT 2, 'report', 'https://r.org/2022'")
def constant_listing(spark, d):
    return readers.constants(spark, [(1, "report", "https://r.org/2021"), (2, "report", "https://r.org/2022")], "place int, kind string, url string")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """Two items a nation, of which the later wins; odd ones have a guid in place of a link; one has neither."""
    i = F.col("n_nationkey")
    address = F.concat(F.lit("https://f.org/"), i)
    link = F.when(i % 2 == 0, F.concat(F.lit("<link>"), address, F.lit("</link><guid>x</guid>"))).otherwise(F.concat(F.lit("<link></link><guid>"), address, F.lit("</guid>")))
    item = F.concat(*[F.concat(F.lit(f"<item><title> T{k} "), F.col("n_name"), F.lit("</title>"), link, F.lit(f"<pubDate>2024-01-0{k}</pubDate><description>&lt;p&gt;Body{k}  &lt;b&gt;"), i, F.lit("&lt;/b&gt;&lt;/p&gt;</description><category>z</category><category> a </category><category>z</category></item>")) for k in (1, 2)])
    body = table(spark, d, "nation").agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    path = readers.landing(spark, "feed")
    body.select(F.concat(F.lit("<rss><channel>"), "items", F.lit("<item><title>no link</title><guid>tag:7</guid></item></channel></rss>")).alias("value")).coalesce(1).write.text(path)
    return readers.feed(spark, path, "office")


@query("SELECT 'https://f.org/' || n_nationkey AS url, 'T' || k || ' ' || n_name AS title, '2024-01-0' || k AS published_raw, 'rss' AS data_source FROM nation, (VALUES (1), (2)) v(k)")
def feed_items(spark, d):
    return _feed(spark, d).select("url", F.col("title_hint").alias("title"), "published_raw", "data_source")


@query("SELECT substring(sha1('https://f.org/' || n_nationkey), 1, 14) AS doc_id, 'https://f.org/' || n_nationkey AS url, 'T2 ' || n_name AS title, 'Body2 ' || n_nationkey AS body_raw, '2024-01-02' AS published_raw, 'office' AS source, 'a,z' AS topics FROM nation")
def feed_articles(spark, d):
    return readers.feed_articles(_feed(spark, d)).withColumn("topics", comma(F.col("topics")))


_CAPTURES = "c AS (SELECT 'https://w.org/' || n_regionkey || '/' || (n_nationkey % 6) AS url, CAST(20200101000000 + CAST(n_nationkey AS BIGINT) * 100000000 % 1200000000 AS VARCHAR) AS ts, n_nationkey % 5 <> 0 AS good FROM nation)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("n_nationkey").cast("long")
    row = F.array(F.lit("k"), (F.lit(20200101000000) + i * 100000000 % 1200000000).cast("string"), F.concat(F.lit("https://w.org/"), F.col("n_regionkey"), F.lit("/"), i % 6, F.lit("/")), F.when(i % 5 != 0, F.lit("200")).otherwise(F.lit("404")))
    head = F.array(*[F.lit(x) for x in ("urlkey", "timestamp", "original", "statuscode")])
    return table(spark, d, "nation").agg(F.to_json(F.concat(F.array(head), F.collect_list(row))).alias("body"))


@query(f"WITH {_CAPTURES} SELECT url, min(ts) AS wayback_ts, substring(min(ts), 1, 4) || '-' || substring(min(ts), 5, 2) || '-' || substring(min(ts), 7, 2) AS published_raw FROM c WHERE good GROUP BY url")
def archive_captures(spark, d):
    return readers.archive_index(_index(spark, d)).select("url", "wayback_ts", "published_raw")


@query(f"WITH {_CAPTURES}, f AS (SELECT url, min(ts) AS ts FROM c WHERE good GROUP BY url), l AS (SELECT DISTINCT url FROM c UNION SELECT 'https://w.org/none') SELECT l.url, strftime(strptime(substring(ts, 1, 8), '%Y%m%d'), '%Y-%m-%d') AS first_capture FROM l LEFT JOIN f ON l.url = f.url")
def first_captures(spark, d):
    i = F.col("n_nationkey")
    listing = table(spark, d, "nation").select(F.concat(F.lit("https://w.org/"), F.col("n_regionkey"), F.lit("/"), i % 6).alias("url")).union(spark.createDataFrame([("https://w.org/none",)], "url string")).distinct()
    return readers.first_capture(listing, readers.archive_index(_index(spark, d))).select("url", F.date_format("first_capture", "yyyy-MM-dd").alias("first_capture"))


def _data_url(page: str) -> str:
    return "data:text/html;charset=utf-8," + quote(page)


@query("SELECT 'p' || k AS page, k <> 2 AS fetched, k = 2 AS failed FROM (VALUES (1), (2), (3)) v(k)")
def fetched_pages(spark, d):
    web.register(spark)
    urls = [_data_url("<p>p1</p>"), "unknown:p2", _data_url("<p>p3</p>")]
    rows = spark.read.format("webpages").option("urls", "\n".join(urls)).option("pause", "0").option("perPartition", "2").load()
    return rows.select(F.coalesce(html.strip_tags(F.nullif("html", F.lit(""))), F.lit("")).alias("p"), F.col("html").isNotNull().alias("fetched"), F.col("error").isNotNull().alias("failed")).select(F.when(F.col("p") == "", F.lit("p2")).otherwise(F.col("p")).alias("page"), "fetched", "failed")


@query("SELECT 'https://l.org/n/' || n_nationkey AS url, n_nationkey // 10 + 1 AS page_no, n_name AS title FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'https://l.org/n/0', 99, 'pages 3'")
def crawled_listing(spark, d):
    """Ten links a page; the third page has none, so the fourth isn't read; page 2 repeats a link of page 1."""
    names = {r["n_nationkey"]: r["n_name"] for r in table(spark, d, "nation").where("n_nationkey < 30").select("n_nationkey", "n_name").collect()}

    def page(n: int) -> str:
        own = [*range(10 * n - 10, 10 * n), 0] if n != 3 else []
        return _data_url("".join(f'<a href="https://l.org/n/{i}">{names.get(i, "")}</a>' for i in own) + '<a href="/list/page/2">2</a><a href="/list/page/3">3</a>')

    def links(pages: DataFrame) -> DataFrame:
        return html.extract_links(pages, "page_no", include=r"^https://l\.org/n/").select("page_no", "url", "title_hint")

    found = web.crawl(spark, page, links, pages=6, pause="0").select("url", "page_no", F.col("title_hint").alias("title"))
    last = spark.createDataFrame([(page(1),)], "url string").select(web.last_page(F.lit('<a href="/list/page/2">2</a><a href="/list/page/3">3</a>')).alias("n"))
    return found.union(last.select(F.lit("https://l.org/n/0"), F.lit(99), F.concat(F.lit("pages "), "n")))


_NOTICES = "v AS (SELECT n_nationkey AS i, n_name AS name FROM nation)"


@query(f"WITH {_NOTICES} SELECT 'FIN-20' || (18 + i % 8) || '-Alert00' || (i // 8 + 1) AS notice_id, 'About ' || name AS title, 'Alert' AS doc_type, '01/0' || (i % 9 + 1) || '/2024' AS date, 'https://n.org/f/' || i || '.pdf' AS pdf_url FROM v WHERE 18 + i % 8 >= 22 AND i <> 24")
def listing_tables(spark, d):
    """A table row a nation; rows of other years and without an id fall away, a Spanish twin of each too."""
    i = F.col("n_nationkey")
    row = lambda title: F.concat(F.lit("<tr><td>January "), i % 9 + 1, F.lit(", 2024</td><td>"), F.when(i == 24, F.lit("none")).otherwise(F.concat(F.lit("FIN-20"), 18 + i % 8, F.lit("-Alert00"), F.floor(i / 8) + 1)), F.lit('</td><td><a href="/f/'), i, F.lit('.pdf">'), title, F.lit("</a></td></tr>"))
    page = F.concat(F.lit("<table><tr><th>Date</th></tr>"), row(F.concat(F.lit("Aviso en español "), "n_name")), row(F.concat(F.lit("About "), "n_name")), F.lit("</table>"))
    pages = table(spark, d, "nation").select(F.col("n_nationkey").alias("page_id"), page.alias("html"))
    return notices.from_tables(pages, "Alert", "https://n.org/list")


@query(f"WITH {_NOTICES} SELECT CASE WHEN i % 3 = 0 THEN 'FIN-2023-A00' || i % 9 WHEN i % 3 = 1 THEN 'FIN-2022-A00' || i % 9 ELSE 'FIN-2021-A00' || i % 9 END AS notice_id, 'Advisory on ' || name AS title, 'Advisory' AS doc_type, '03/0' || (i % 9 + 1) || '/2023' AS date, 'https://n.org/d/' || CASE WHEN i % 3 = 2 THEN 'fin-x/FIN-2021-A00' || i % 9 || '/' ELSE '' END || i AS source_page, '/f/' || i || '.pdf' AS pdf_url FROM v")
def detail_pages(spark, d):
    """The id stands in the text, in the anchor that led there, or in the address."""
    i = F.col("n_nationkey")
    n = (i % 9).cast("string")
    page = F.concat(F.lit("<html><h1>Advisory on "), "n_name", F.lit("</h1><p>"), F.when(i % 3 == 0, F.concat(F.lit("No. FIN-2023-A00"), n)).otherwise(F.lit("text")), F.lit(" of March "), i % 9 + 1, F.lit(', 2023</p><a href="/f/'), i, F.lit('.pdf">file</a></html>'))
    url = F.concat(F.lit("https://n.org/d/"), F.when(i % 3 == 2, F.concat(F.lit("fin-x/FIN-2021-A00"), n, F.lit("/"))).otherwise(F.lit("")), i)
    pages = table(spark, d, "nation").select(i.alias("page_id"), url.alias("url"), page.alias("html"))
    anchors = pages.join(table(spark, d, "nation").select(i.alias("page_id"), F.when(i % 3 == 1, F.concat(F.lit("FIN-2022-A00"), n)).alias("title_hint")), "page_id").select("url", "title_hint")
    return notices.from_details(pages, anchors)


def _print_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases as files of two pages, a folder each, and a listing that names two files more than there are."""
    path = readers.landing(spark, "prints")
    rows = cases(spark, d).where("doc_id < 40").withColumn("value", F.concat(F.lit("Alert on "), "t", F.lit(" "), F.repeat(F.concat(F.col("t"), F.lit(" ")), 20), F.lit("\f"), "t", F.lit(" "), "t"))
    rows.where("doc_id < 38").select("doc_id", "value").repartition(4, "doc_id").write.partitionBy("doc_id").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    at = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace("path", "^file:/+", "/").alias("local_pdf_path"))
    listing = rows.join(at, "doc_id", "left").select(F.concat(F.lit("N-"), "doc_id").alias("notice_id"), F.lit("Alert").alias("doc_type"), F.concat(F.lit("On "), "doc_id").alias("title"), F.lit("01/02/2024").alias("date"), F.coalesce("local_pdf_path", F.concat(F.lit("/none/"), "doc_id")).alias("local_pdf_path"), F.lit("https://n.org/f").alias("pdf_url"))
    return files.select("path", "content"), listing


_PRINTS = rf"""{CASES}, raw AS (SELECT doc_id, 'Alert on ' || t || ' ' || repeat(t || ' ', 20) AS p1, t || ' ' || t AS p2 FROM cases WHERE doc_id < 38),
cleaned AS (SELECT doc_id, trim(regexp_replace(regexp_replace(p1, '\b(?:[A-Z]\s+){{3,}}[A-Z]\b', ' ', 'g'), '\s+', ' ', 'g')) AS p1, trim(p2) AS p2 FROM raw),
texts AS (SELECT doc_id, p1 || chr(10) || chr(10) || p2 AS full_text, regexp_replace(regexp_replace(p1 || ' ' || p2, '([A-Za-z])(\d{{1,2}})\b', '\1', 'g'), '\s+', ' ', 'g') AS clean FROM cleaned)"""


@query(f"WITH {_PRINTS} SELECT 'N-' || doc_id AS notice_id, length(full_text) AS text_length_raw, length(clean) AS text_length_clean, 'native_plus_ocr_fallback' AS method, 0 AS ocr_pages, 2 AS page_count FROM texts UNION ALL SELECT 'N-' || doc_id, 0, 0, 'missing', 0, 0 FROM cases WHERE doc_id IN (38, 39)")
def notice_texts(spark, d):
    found = pipelines.notices(*_print_files(spark, d))
    gone = found["missing"].select("notice_id", F.lit(0).alias("text_length_raw"), F.lit(0).alias("text_length_clean"), F.lit("missing").alias("method"), F.lit(0).alias("ocr_pages"), F.lit(0).alias("page_count"))
    return found["text_summary"].drop("title", "doc_type", "date").unionByName(gone)


@query(rf"WITH {_PRINTS}, s AS (SELECT doc_id, unnest(range(0, greatest(length(t), 1), 1000)) AS p, t FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(clean, '([A-Za-z.,)])\d{{1,2}}\b', '\1', 'g'), '\s+', ' ', 'g')) AS t FROM texts)), c AS (SELECT doc_id, p, trim(substring(t, p + 1, 1200)) AS c FROM s), k AS (SELECT doc_id, p, c, unnest({or_other(keyword_sql(DEFAULT, 'c'))}) AS tag FROM c WHERE length(c) > 150), g AS (SELECT doc_id, tag, min(p) AS seen FROM k GROUP BY doc_id, tag), u AS (SELECT doc_id, string_agg(tag, ',' ORDER BY seen, tag) AS tags FROM g GROUP BY doc_id) SELECT 'N-' || c.doc_id AS doc_id, count(*) AS total_chunks, min(length(c)) AS min_chunk_length, max(length(c)) AS max_chunk_length, any_value(tags) AS tags FROM c JOIN u ON c.doc_id = u.doc_id WHERE length(c) > 150 GROUP BY c.doc_id")
def notice_chunks(spark, d):
    found = pipelines.notices(*_print_files(spark, d))
    whole = found["documents"].select("doc_id", comma(F.col("fraud_tags")).alias("tags"))
    return found["chunk_summary"].join(whole, "doc_id").select("doc_id", "total_chunks", "min_chunk_length", "max_chunk_length", "tags")


@query(f"WITH {CASES} SELECT 'keywords' AS kind, count(*) AS n, 'text' AS detail FROM (VALUES {', '.join(f'({i})' for i in range(len(DEFAULT.keyword_rows())))}) UNION ALL SELECT 'signals', {len(DEFAULT.signal_rows())}, 'text' UNION ALL SELECT 'earlier', {len(EARLIER.keyword_rows())}, 'text' UNION ALL SELECT 'appended', 2 * count(*), 'lines' FROM nation UNION ALL SELECT 'good', count(*), 'rows' FROM nation WHERE n_nationkey % 4 > 0 UNION ALL SELECT 'failed', count(*), 'rows' FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'nulls written', count(*), 'lines' FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'ragged', count(*), 'lines' FROM cases")
def sinks(spark, d):
    """What comes back of dictionaries, appended lines, null fields, ragged rows and failures."""
    rows, out = _nations(spark, d), []

    def counted(kind: str, df: DataFrame, detail: str) -> None:
        out.append(df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.lit(detail).alias("detail")))

    for kind, df in zip(("keywords", "signals", "earlier"), (*writers.dictionaries(spark, DEFAULT), writers.dictionaries(spark, EARLIER)[0])):
        path = readers.landing(spark, "dictionary")
        writers.csv(df, path)
        counted(kind, readers.csv(spark, path), "text")
    path = readers.landing(spark, "append")
    for _ in range(2):
        writers.json_lines(rows, path, "append")
    counted("appended", readers.json_lines(spark, path, _NATION), "lines")
    good, bad = writers.split_failures(rows, "text is not null")
    counted("good", good, "rows")
    counted("failed", bad, "rows")
    one = readers.landing(spark, "nulls")
    writers.json_lines(rows, one)
    counted("nulls written", spark.read.text(one).where(F.col("value").contains('"text":null')), "lines")
    path = readers.landing(spark, "ragged")
    ragged = cases(spark, d).select("doc_id", F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda k: F.concat(F.col("t"), k.cast("string"))).alias("chunks"))
    writers.json_lines(ragged, path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunks", T.ArrayType(T.StringType()))])
    counted("ragged", readers.json_lines(spark, path, schema).where(F.size("chunks") == F.col("doc_id") % 3 + 1), "lines")
    return joins.union_all(out)


# --- pages to articles -------------------------------------------------------------------------------------------


def _made_pages(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("doc_id"), F.col("doc_id") % 4
    date = F.when(k == 0, F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"datePublished":"2024-01-'), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit('"}]}</script>'))).when(k == 1, F.lit('<meta property="article:published_time" content="2023-05-06">')).otherwise(F.lit(""))
    stamp = F.when(k == 2, F.lit('<time datetime="2022-02-02">x</time>')).when(k == 3, F.lit('<span class="byline">March 3, 2021</span>')).otherwise(F.lit(""))
    head = F.concat(F.lit("<html><head><title>Site "), i, F.lit("</title>"), date, F.lit("</head><body><nav><a href='/menu'>menu words that are no body</a></nav><div class=\"sidebar\"><div>noise</div></div>"))
    title = F.when(i % 3 > 0, F.concat(F.lit("<h1>Heading  <b>"), i, F.lit("</b> here</h1>"))).otherwise(F.lit("<h1>No</h1>"))
    body = F.when(i % 5 > 0, F.concat(F.lit("<article><p>"), "t", F.lit("</p><script>var a;</script></article>"))).otherwise(F.concat(F.lit("<p>short</p><p>"), "t", F.lit("</p>")))
    links = F.concat(F.lit('<a href="/topics/b">Beta</a><a href="/topics/a">Alpha</a><a href="/topics/b">Beta</a><a href="mailto:x">m</a><a href="#top">t</a><a href="../r/'), i, F.lit('.pdf">Report</a>'))
    return cases(spark, d).select(i.alias("page_id"), F.concat(F.lit("https://s.org/d/"), i).alias("url"), F.concat(head, title, stamp, body, links, F.lit("</body></html>")).alias("html"))


@query(f"WITH {CASES} SELECT doc_id AS page_id, CASE WHEN doc_id % 3 > 0 THEN 'Heading ' || doc_id || ' here' ELSE 'Site ' || doc_id END AS title, CASE doc_id % 4 WHEN 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN '2023-05-06' WHEN 2 THEN '2022-02-02' ELSE 'March 3, 2021' END AS published_raw, t AS body_raw, 'Alpha,Beta' AS topics FROM cases")
def made_articles(spark, d):
    return html.extract_articles(_made_pages(spark, d)).withColumn("topics", comma(F.col("topics")))


_SAID = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,]+', ' ', 'g'))"
#: What each source's rules make of one and the same page.
_BY_SOURCE = {
    "agency_blog": ("'Heading ' || i || ' of a page'", "CASE WHEN i % 2 = 0 THEN '2024-01-05' ELSE 'stamp' END", "'Lead ' || i || ' ' || t || ' Section'", "'Beta'"),
    "payments_news": ("'Heading' || i || 'of a page'", "CASE WHEN i % 2 = 0 THEN '2024-01-05' ELSE '2023-05-06' END", "t || ' frame'", "''"),
    "vendor_blog": ("'Heading ' || i || ' of a page'", "CASE WHEN i % 3 = 0 THEN '2022-02-02' ELSE '2023-05-06' END", "CASE WHEN letters > 50 THEN t ELSE array_to_string(list_filter(['Lead ' || i, t], lambda x: length(x) > 40), ' ') END", "''"),
    "security_news": ("'Section'", "'March 3, 2021'", "''", "''"),
    "complaint_center": ("'Heading ' || i || ' of a page'", "CASE WHEN i % 2 = 0 THEN '2024-01-05' ELSE 'stamp' END", "'Lead ' || i || ' ' || t || ' Section'", "'Alpha,Beta'"),
    "bureau_news": ("'Heading ' || i || ' of a page'", "''", "'Lead ' || i || ' ' || t || ' Section'", "''"),
}


def _page_of_all(spark: SparkSession, d: str) -> DataFrame:
    """A page of a document's words with something for the rules of every source; some elements only on some pages."""
    i, said = F.col("doc_id"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.,]+", " "))
    some = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(""))
    page = F.concat(
        F.lit("<html><head><title>Site</title>"), some(i % 3 == 0, '<script type="application/ld+json">[{"@type":"A"},{"dateModified":"2022-02-02"}]</script>'),
        F.lit('<meta property="article:published_time" content="2023-05-06"></head><body><header><a class="tag" href="/topics/a">Alpha</a></header>'),
        F.lit("<h1>Heading <b>"), i, F.lit("</b> of a page</h1>"), F.when(i % 2 == 0, F.lit('<time datetime="2024-01-05">x</time>')).otherwise(F.lit("<time>stamp</time>")),
        F.lit('<ul><li class="cz-news-date">March 3, 2021</li></ul><span class="post-date">May 1, 2020</span><main><p>Lead '), i,
        F.lit('</p><div class="post-content wide"><p>'), said, F.lit('</p><nav>frame</nav></div><h1 class="article_section">Section</h1></main><a class="label" href="/scams/b">Beta</a></body></html>'))
    return table(spark, d, "documents").select(i.alias("page_id"), page.alias("html"))


@query(f"""WITH p AS (SELECT doc_id AS i, {_SAID} AS t, length({_SAID}) AS letters FROM documents),
{", ".join(f"{name} AS (SELECT i, '{name}' AS source, {title} AS title, {date} AS published_raw, trim(regexp_replace({body}, ' +', ' ', 'g')) AS body, {topics} AS topics FROM p)" for name, (title, date, body, topics) in _BY_SOURCE.items())}
SELECT i AS page_id, source, title, published_raw, length(body) AS body_length, sha256(body) AS body_sha256, topics
FROM ({" UNION ALL ".join(f"SELECT * FROM {name}" for name in _BY_SOURCE)})""")
def articles_by_source(spark, d):
    """The page of every document read by the rules of each of six sources: they differ in order and least lengths."""
    found = rules.extract_by_source(_page_of_all(spark, d), F.array(*map(F.lit, _BY_SOURCE)))
    return found.select("page_id", "source", "title", "published_raw", F.length("body_raw").cast("long").alias("body_length"), F.sha2("body_raw", 256).alias("body_sha256"), comma(F.col("topics")).alias("topics"))


@query("SELECT doc_id AS page_id, url, title_hint, position FROM documents, LATERAL (VALUES ('https://s.org/menu', 'menu words that are no body', 0), ('https://s.org/topics/b', 'Beta', 1), ('https://s.org/topics/a', 'Alpha', 2), ('https://s.org/r/' || doc_id || '.pdf', 'Report', 3)) v(url, title_hint, position)")
def made_links(spark, d):
    return html.extract_links(_made_pages(spark, d))


_ARTICLES = f"{CASES}, a AS (SELECT doc_id AS i, 'Title ' || doc_id % 60 AS title, 'https://x.org/' || doc_id % 90 AS url, CAST(DATE '2020-01-01' + CAST(doc_id AS INTEGER) AS DATE) AS date, 'Body of ' || t || ' ' || t || ' ' || t AS body FROM cases), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date) AS r FROM a) WHERE r = 1)"


def _articles(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return cases(spark, d).select(F.concat(F.lit(" Title  "), i % 60).alias("title"), F.concat(F.lit("https://x.org/"), i % 90).alias("url"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), i.cast("int")), "MMMM d, yyyy").alias("published_raw"), F.concat_ws(" ", F.lit("Body  of\n"), "t", "t", "t").alias("body_raw"))


def _document_columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "published_year", "published_month", "title", "body_length", comma(F.col("fraud_tags")).alias("tags"))


@query(f"WITH {_ARTICLES} SELECT substring(sha1(url), 1, 14) AS doc_id, strftime(date, '%Y-%m-%d') AS date, year(date) AS published_year, month(date) AS published_month, title, length(body) AS body_length, array_to_string({or_other(pattern_sql(DEFAULT, chr(40) + 'title || chr(32) || body' + chr(41)))}, ',') AS tags FROM u")
def articles_of_a_blog(spark, d):
    return _document_columns(pipelines.articles_to_documents(_articles(spark, d), pipelines.SOURCES["agency_blog"]))


@query(f"WITH {_ARTICLES}, w AS (SELECT * EXCLUDE (r) FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY title ORDER BY date) AS r FROM u) WHERE r = 1) SELECT substring(sha1(url), 1, 14) AS doc_id, strftime(date, '%Y-%m-%d') AS date, year(date) AS published_year, month(date) AS published_month, title, length(body) AS body_length, array_to_string({or_other(pattern_sql(DEFAULT, chr(40) + 'title || chr(32) || body' + chr(41)))}, ',') AS tags FROM w WHERE length(body) > 50")
def articles_of_the_news(spark, d):
    """By url, then by title; newest first."""
    out = pipelines.articles_to_documents(_articles(spark, d), pipelines.SOURCES["payments_news"])
    return _document_columns(out.orderBy(F.desc_nulls_last("date")))


@query(f"WITH {_ARTICLES} SELECT substring(sha1(url), 1, 14) AS doc_id, 0 AS chunk_id, array_to_string(list_sort({keyword_sql(EARLIER, 'c')}), ',') AS tags FROM (SELECT url, trim(regexp_replace(regexp_replace(body, '([A-Za-z.,)])\\d{{1,2}}\\b', '\\1', 'g'), '\\s+', ' ', 'g')) AS c FROM u) WHERE length(c) > 150")
def bureau_chunks(spark, d):
    """The bureau's documents in chunks, on the earlier edition and without a fallback."""
    source = pipelines.SOURCES["bureau_news"]
    rows = chunks.chunk_rows(pipelines.articles_to_documents(_articles(spark, d), source), "body_1", ["doc_id"])
    return chunks.tag_chunks(rows, source.taxonomy, source.fallback).select("doc_id", "chunk_id", comma(F.col("fraud_tags")).alias("tags"))


@query("SELECT 'agency_blog: no articles to work on' AS error")
def empty_source(spark, d):
    try:
        pipelines.articles_to_documents(_articles(spark, d).limit(0), pipelines.SOURCES["agency_blog"])
        said = "nothing was said"
    except ValueError as error:
        said = str(error)
    return spark.createDataFrame([(said,)], "error string")


@query("SELECT 'FIN-' || n_nationkey AS notice_id, strftime(DATE '2024-03-01' + CAST(n_nationkey AS INTEGER), '%m/%d/%Y') AS date, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END DESC NULLS LAST, 'FIN-' || n_nationkey) AS place FROM nation")
def publication_union(spark, d):
    """Two listings that share notices, by real date, undated ones last."""
    i = F.col("n_nationkey")
    day = F.date_add(F.lit("2024-03-01").cast("date"), i.cast("int"))
    rows = table(spark, d, "nation").select(F.concat(F.lit("FIN-"), i).alias("notice_id"), F.when(i % 5 > 0, F.date_format(day, "MMMM d, yyyy")).alias("date"))
    out = pipelines.publications([rows, rows.where("length(notice_id) = 5")])
    numbered = out.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)
    number = F.regexp_extract("notice_id", r"(\d+)", 1).cast("int")
    return numbered.select("notice_id", F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), number), "MM/dd/yyyy").alias("date"), "place")


# --- views -------------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of different columns: chunks with tags of their own, and articles whose tags and signals are text."""
    i = F.col("doc_id")
    day = F.date_add(F.lit("2021-01-31").cast("date"), (i % 900).cast("int"))
    own = cases(spark, d).where("doc_id % 2 = 0").select(F.concat(F.lit("d"), F.floor(i / 6)).alias("doc_id"), (F.floor(i / 2) % 3).alias("chunk_id"), F.date_format(F.date_add(F.lit("2021-01-31").cast("date"), (F.floor(i / 6) * 7 % 900).cast("int")), "yyyy-MM-dd").alias("date"), F.concat("t", F.lit(" mail a@b.org")).alias("chunk_text"), tags.pattern_tags("t").alias("fraud_tags"))
    other = cases(spark, d).where("doc_id % 2 = 1").select(F.concat(F.lit("e"), i).alias("doc_id"), F.when(i % 3 > 0, F.date_format(day, "MM/dd/yyyy")).otherwise(F.lit("")).alias("published"), F.when(i % 7 > 0, F.col("t")).otherwise(F.lit("too short")).alias("body"), F.lit('{"urls":["u1","u2"]}').alias("fraud_signals"), F.array(F.lit(" x "), F.lit("")).alias("fraud_tags"))
    return joins.union_all([views.normalized(own, "chunk_text", "first", None), views.normalized(other, "body", "second")])


_ROWS = f"""{CASES}, own AS (SELECT 'd' || doc_id // 6 AS id, doc_id // 2 % 3 AS chunk_id, 'first' AS source, DATE '2021-01-31' + CAST(doc_id // 6 * 7 % 900 AS INTEGER) AS date, t || ' mail a@b.org' AS text, {or_other(pattern_sql(DEFAULT))} AS tags, 0 AS n_signals, FALSE AS has_url FROM cases WHERE doc_id % 2 = 0),
other AS (SELECT 'e' || doc_id AS id, 0 AS chunk_id, 'second' AS source, CASE WHEN doc_id % 3 > 0 THEN DATE '2021-01-31' + CAST(doc_id % 900 AS INTEGER) END AS date, t AS text, ['x'] AS tags, 2 AS n_signals, TRUE AS has_url FROM cases WHERE doc_id % 2 = 1 AND doc_id % 7 > 0),
rows AS (SELECT * FROM own UNION ALL SELECT * FROM other)"""


@query(f"WITH {_ROWS} SELECT id AS doc_id, chunk_id, source, year(date) AS year, month(date) AS month, year(date) || 'Q' || quarter(date) AS quarter, length(text) AS text_length, len(tags) AS tag_count, n_signals AS signal_count, has_url, round(1.0 / count(*) OVER (PARTITION BY id), 6) AS weight FROM rows")
def master_rows(spark, d):
    return views.master(_rows(spark, d)).select("doc_id", "chunk_id", "source", "year", "month", "quarter", "text_length", "tag_count", "signal_count", "has_url", F.round("chunk_weight", 6).alias("weight"))


_DOCS = f"""{_ROWS}, tagged AS (SELECT id, chunk_id, unnest(tags) AS tag FROM rows), firsts AS (SELECT id, tag, min(chunk_id) AS seen FROM tagged GROUP BY id, tag), tag_lists AS (SELECT id, list(tag ORDER BY seen, tag) AS tags FROM firsts GROUP BY id),
whole AS (SELECT id, source, date, sum(length(text)) AS text_length, bool_or(has_url) AS has_url, string_agg(text, ' ' ORDER BY chunk_id) AS t, count(*) AS num_chunks, max(n_signals) AS signal_count FROM rows GROUP BY id, source, date), docs AS (SELECT w.*, l.tags FROM whole w JOIN tag_lists l ON w.id = l.id)"""


@query(f"WITH {_DOCS} SELECT d.id AS doc_id, source, strftime(date, '%Y-%m-%d') AS date, text_length, has_url, md5(t) AS text_md5, num_chunks, signal_count, array_to_string(tags, ',') AS tags, CASE WHEN source = 'second' THEN 'x' ELSE primary_tag END AS primary_tag FROM docs d JOIN {primary_sql(DEFAULT, 'docs', 'id')} p ON d.id = p.id")
def master_documents(spark, d):
    out = views.documents(views.master(_rows(spark, d)))
    return out.select("doc_id", "source", F.date_format("date", "yyyy-MM-dd").alias("date"), "text_length", "has_url", F.md5("text").alias("text_md5"), "num_chunks", "signal_count", comma(F.col("fraud_tags")).alias("tags"), "primary_tag")


@query(f"WITH {_ROWS}, f AS (SELECT id, max(text) FILTER (WHERE chunk_id = 0) AS b1, max(text) FILTER (WHERE chunk_id = 1) AS b2, max(text) FILTER (WHERE chunk_id = 2) AS b3 FROM own GROUP BY id), l AS (SELECT DISTINCT id FROM rows) SELECT l.id AS doc_id, md5(coalesce(b1, o.text)) AS body_1, md5(b2) AS body_2, md5(b3) AS body_3 FROM l LEFT JOIN f ON l.id = f.id LEFT JOIN other o ON l.id = o.id")
def master_with_bodies(spark, d):
    """Wide bodies of both sources beside the documents; the second source has fewer columns and keeps its own."""
    rows = views.master(_rows(spark, d))
    wide = []
    for name, n in (("first", 3), ("second", 1)):
        own = rows.where(F.col("source") == name).select("doc_id", "chunk_id", F.col("text").alias("chunk_text"), "fraud_tags", F.array().cast("array<string>").alias("fraud_signals"))
        wide.append(chunks.wide(chunks.documents_of_chunks(own, ["doc_id"]), n))
    out = views.with_bodies(views.documents(rows), wide)
    return out.select("doc_id", *[F.md5(f"body_{k}").alias(f"body_{k}") for k in (1, 2, 3)])


@query(f"WITH {_DOCS}, t AS (SELECT unnest(tags) AS tag FROM docs), w AS (SELECT unnest(tags) AS tag, 1.0::DOUBLE / n AS weight FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM rows)) SELECT 'docs' AS view, tag, CAST(count(*) AS DOUBLE) AS count FROM t WHERE tag <> 'other' GROUP BY tag UNION ALL SELECT 'weighted', tag, round(sum(weight), 6) FROM w WHERE tag <> 'other' GROUP BY tag UNION ALL SELECT 'master', 'doc_id,source,date,year,month,quarter,primary_tag,fraud_tags,text_length,has_url,has_email,has_phone,has_ip,has_crypto', count(*) FROM docs")
def exported_run(spark, d):
    """Both views analysed and written; what is read back of their distributions, and the flat master's first columns."""
    at = readers.landing(spark, "run")
    pipelines.export_run(_rows(spark, d), at)
    at = releases.current(spark, at)
    parts = [readers.csv(spark, f"{at}/category_distribution_{v}").select(F.lit(v).alias("view"), F.col("fraud_tag").alias("tag"), F.round(F.col("count").cast("double"), 6).alias("count")) for v in ("docs", "weighted")]
    flat = readers.csv(spark, f"{at}/master_docs")
    head = ",".join(flat.columns[:14])
    return joins.union_all([*parts, flat.agg(F.lit("master").alias("view"), F.lit(head).alias("tag"), F.count("*").cast("double").alias("count"))])


@query(f"WITH {_DOCS}, p AS (SELECT * FROM {primary_sql(DEFAULT, 'docs', 'id')}), q AS (SELECT CASE WHEN id LIKE 'e%' THEN 'x' ELSE primary_tag END AS primary_tag FROM p) SELECT primary_tag, count(*) AS count, round_even(CAST(count(*) * 100 AS DOUBLE) / sum(count(*)) OVER (), 2) AS pct FROM q GROUP BY primary_tag")
def exported_primary_tags(spark, d):
    at = readers.landing(spark, "run")
    pipelines.export_run(_rows(spark, d), at)
    at = releases.current(spark, at)
    return readers.csv(spark, f"{at}/primary_tag_distribution_docs").select("primary_tag", F.col("count").cast("long").alias("count"), F.col("pct").cast("double").alias("pct"))


# --- dashboard, joins --------------------------------------------------------------------------------------------


@query("SELECT event_id, upper(trim(event_type)) AS source, CASE WHEN user_id % 3 = 0 THEN 'Uncategorized' WHEN user_id % 3 = 1 THEN 'Money_Laundering' ELSE 'Ai_Fraud' END AS primary_tag FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND user_id % 4 > 0 AND event_type IN ('click', 'view')")
def dashboard_rows(spark, d):
    k = F.col("user_id") % 3
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("date"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("source"), F.when(F.col("user_id") % 4 == 0, F.lit("other")).when(k == 1, F.lit("money_laundering")).when(k == 2, F.lit("AI_fraud")).alias("primary_tag"))
    out = dashboard.loaded(rows, F.lit("2024-01-15").cast("timestamp"))
    return dashboard.chosen(out, ["CLICK", "VIEW"]).select("event_id", "source", "primary_tag")


@query("WITH l AS (SELECT n_nationkey AS id, n_regionkey AS k FROM nation) SELECT l.id, coalesce(r.r_name, 'none') AS name, coalesce(c.n, 0) AS previous_n, CASE WHEN l.id % 3 = 0 THEN 'feed' WHEN l.id % 3 = 1 THEN 'archive' END AS way FROM l LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON l.k = r.r_regionkey LEFT JOIN (SELECT s_nationkey AS id, count(*) AS n FROM supplier GROUP BY 1) c ON l.id = c.id WHERE l.id % 3 < 2")
def looked_up(spark, d):
    """A lookup with defaults, counts aligned to the left side's keys, and rows routed by how they were found."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("rss")).when(F.col("n_nationkey") % 3 == 1, F.lit("cdx")).otherwise(F.lit("live")).alias("data_source"))
    names = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("n"))
    out = joins.aligned(joins.lookup(rows, names, "k", {"name": "none"}), counts, "id", "n")
    ways = joins.routed(out, "data_source", {"rss": lambda x: x.withColumn("way", F.lit("feed")), "cdx": lambda x: x.withColumn("way", F.lit("archive"))})
    return ways.select("id", "name", "previous_n", "way")


@query("WITH r AS (SELECT o_custkey % 200 AS id, o_orderkey % 4 = 0 AS es, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS date, o_orderkey AS k FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY es, date NULLS LAST) AS n FROM r) SELECT id, es, strftime(date, '%Y-%m-%d') AS date FROM b WHERE n = 1")
def language_preferred(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("id"), (k % 4 == 0).alias("es"), F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("date"))
    return dedup.prefer_language(rows, "id", "es", "date").select("id", "es", F.date_format("date", "yyyy-MM-dd").alias("date"))


# --- streams and runs --------------------------------------------------------------------------------------------


@query("SELECT 'stream' AS way, user_id AS id, 1 AS n FROM events GROUP BY user_id UNION ALL SELECT 'capped', event_id, 1 FROM (SELECT event_id FROM events WHERE event_id % 2 = 1 ORDER BY event_id LIMIT 20)")
def resumed_load(spark, d):
    """A folder that grows between two runs of a stream that keeps each id once, and a capped batch of unseen rows."""
    events = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("title"))
    source, target, checkpoint = (readers.landing(spark, x) for x in ("in", "out", "state"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType())])
    for part in (events.where("title <> 'click'"), events):
        part.repartition(3).write.mode("append").json(source)
        stream = incremental.once_per_id(incremental.stream_of(spark, source, schema, files_per_run=2))
        incremental.append(stream, target, checkpoint).awaitTermination()
    once = spark.read.parquet(target).groupBy(F.lit("stream").alias("way"), F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    known = readers.landing(spark, "known")
    ids = table(spark, d, "events").select(F.col("event_id").alias("doc_id"))
    ids.where("doc_id % 2 = 0").write.parquet(known)
    return once.union(incremental.run_batch(ids, known, limit=20).select(F.lit("capped"), "doc_id", F.lit(1).cast("long")))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period_start, event_type AS fraud_tag, count(*) AS count FROM events WHERE date_trunc('week', ts) < (SELECT date_trunc('week', max(ts)) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2")
def streamed_tag_counts(spark, d):
    """Weekly counts of a stream; weeks that a later row may still reach are left out on both sides."""
    source, target, checkpoint = (readers.landing(spark, x) for x in ("in", "out", "state"))
    table(spark, d, "events").select("ts", F.array("event_type").alias("fraud_tags")).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = incremental.stream_of(spark, source, schema, format="parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")) if dict(stream.dtypes)["ts"] != "timestamp" else stream
    counts = incremental.windowed_tag_counts(stream, "ts", "7 days", "1 hour", "4 days")
    incremental.append(counts, target, checkpoint).awaitTermination()
    out = spark.read.parquet(target)
    last = F.date_sub(F.date_trunc("week", F.lit(table(spark, d, "events").agg(F.max("ts")).head()[0])).cast("date"), 7)
    return out.where(F.col("period_start").cast("date") < last).select(F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "fraud_tag", "count")


@query("SELECT run, name, status FROM (VALUES (1, 'slow', 'late'), (1, 'first', 'done'), (1, 'torn', 'failed'), (1, 'after', 'blocked'), (1, 'off', 'off'), (1, 'detector', 'done'), (2, 'first', 'skipped'), (3, 'first', 'done'), (4, 'first', 'ready'), (4, 'none', 'absent')) v(run, name, status)")
def steps_of_a_run(spark, d):
    at = readers.landing(spark, "steps")
    nation = lambda s: table(s, d, "nation")

    def torn(s: SparkSession) -> DataFrame:
        raise RuntimeError("torn")

    def slow(s: SparkSession) -> DataFrame:
        return s.range(10**13).where("sqrt(id) + sin(id) > 9e9")

    steps = [
        pipelines.Step("slow", slow, f"{at}/slow", timeout=1.0), pipelines.Step("first", nation, f"{at}/first"), pipelines.Step("torn", torn, f"{at}/torn"),
        pipelines.Step("after", nation, f"{at}/after", after=("torn",)), pipelines.Step("off", nation, f"{at}/off", enabled=False), pipelines.Step("detector", nation, f"{at}/detector", after=("first",)),
    ]
    runs = [pipelines.run_steps(spark, steps), pipelines.run_steps(spark, steps[1:2]), pipelines.run_steps(spark, steps[1:2], force=True)]
    parts = [r.select(F.lit(i).alias("run"), "name", "status") for i, r in enumerate(runs, 1)]
    there = pipelines.ready(spark, [steps[1], pipelines.Step("none", nation, f"{at}/none")])
    return joins.union_all([*parts, there.select(F.lit(4).alias("run"), "name", F.when(F.col("ready"), F.lit("ready")).otherwise(F.lit("absent")).alias("status"))])


@query("SELECT n_regionkey AS k, count(*) AS n, 1 AS made FROM nation GROUP BY n_regionkey")
def remembered_table(spark, d):
    """A table that a session makes once and then holds."""
    made = []

    def make(s: SparkSession) -> DataFrame:
        made.append(1)
        return table(s, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))

    name = readers.landing(spark, "memo")
    for _ in range(3):
        out = joins.remembered(spark, name, make)
    return out.withColumn("made", F.lit(len(made)))


@query("SELECT year, o_orderpriority AS tag, count(*) AS count FROM (SELECT year(o_orderdate) AS year, o_orderpriority FROM orders) GROUP BY 1, 2")
def analysed_trend(spark, d):
    """One of the results that ``analyse`` returns for a view, read as a chart's data would be."""
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.lit("2000Q1").alias("quarter"), F.lit("s").alias("source"), F.array("o_orderpriority").alias("fraud_tags"), F.col("o_orderpriority").alias("primary_tag"))
    return analytics.analyse(rows)["trend_by_year"].select("year", F.col("fraud_tag").alias("tag"), "count")


@query("""WITH r AS (SELECT year(o_orderdate) AS year, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, o_orderstatus AS source, o_orderpriority AS p, (o_custkey % 2) || '-' || o_orderstatus AS t FROM orders),
t AS (SELECT year, quarter, source, unnest([p, t]) AS fraud_tag FROM r)
SELECT CASE WHEN grouping(year) = 0 THEN 'year' WHEN grouping(quarter) = 0 THEN 'quarter' WHEN grouping(source) = 0 THEN 'source' ELSE 'tag' END AS kind, fraud_tag, year, quarter, source, count(*) AS count
FROM t GROUP BY GROUPING SETS ((fraud_tag), (fraud_tag, year), (fraud_tag, quarter), (fraud_tag, source))
UNION ALL SELECT 'primary', p, NULL, NULL, NULL, count(*) FROM r GROUP BY p""")
def counts_of_a_view(spark, d):
    """Everything that is counted of a view's tags, from one scan of it."""
    rows = table(spark, d, "orders")
    tags_of = F.array("o_orderpriority", F.concat_ws("-", F.col("o_custkey") % 2, "o_orderstatus"), F.lit("other"), F.lit(None), F.lit(""))
    quarter = F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate"))
    view = rows.select(F.year("o_orderdate").alias("year"), quarter.alias("quarter"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("primary_tag"), tags_of.alias("fraud_tags"))
    return analytics.tag_cube(view)


@query("""WITH r AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS source, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS rank FROM events)
SELECT doc_id, source, seq FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, seq) = 1""")
def sources_across_runs(spark, d):
    """Two runs of a stream, the worse sources first: what is kept in the end is what one batch would keep."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("source"))
    source, target, checkpoint = (readers.landing(spark, x) for x in ("in", "out", "state"))
    for part in (rows.where("source not in ('purchase', 'click')"), rows.where("source in ('purchase', 'click')")):
        part.repartition(2).write.mode("append").parquet(source)
        found = precedence.changes(incremental.stream_of(spark, source, rows.schema, format="parquet"), "doc_id", "source", ["purchase", "click", "view"], "seq")
        precedence.follow(spark, found, target, checkpoint)
    return precedence.current_of(spark.read.parquet(target), "doc_id").select("doc_id", "source", "seq")


_EVENT_DAYS = "e AS (SELECT CAST(ts AS DATE) AS day, ts, event_type AS source, 'user ' || user_id % 7 AS primary_tag FROM events)"


@query(f"""WITH {_EVENT_DAYS} SELECT 'source' AS panel, source AS name, count(*) AS records, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM e GROUP BY source
UNION ALL SELECT 'tag', primary_tag, count(*), NULL, NULL FROM e GROUP BY primary_tag
UNION ALL SELECT 'week', strftime(date_trunc('week', day) + INTERVAL 6 DAY, '%Y-%m-%d'), count(*), NULL, NULL FROM e GROUP BY date_trunc('week', day)""")
def maintained_panels(spark, d):
    """Panels of a dashboard from counts that a stream keeps up, one batch of which is run twice, and half folded."""
    rows = table(spark, d, "events").select("ts", F.col("event_type").alias("source"), F.concat(F.lit("user "), F.col("user_id") % 7).alias("primary_tag"))
    source, target, checkpoint = (readers.landing(spark, x) for x in ("in", "counts", "state"))
    for k in range(2):
        rows.where(F.pmod(F.hash("ts"), F.lit(2)) == k).write.mode("append").parquet(source)
        stream = incremental.stream_of(spark, source, rows.schema, format="parquet")
        aggregates.maintain(stream, target, checkpoint, date="ts").awaitTermination()
        if k == 0:
            aggregates.compact(spark, target)
            aggregates.write_batch(rows.where(F.pmod(F.hash("ts"), F.lit(2)) == 0), 0, target, date="ts")
    counts = aggregates.read(spark, target)
    panels = dashboard.of_maintained(counts, F.current_timestamp(), "W")
    none = F.lit(None).cast("string")
    parts = [
        panels["source_audit"].select(F.lit("source").alias("panel"), F.col("source").alias("name"), "records", "first_seen", "last_seen"),
        panels["top_tags"].select(F.lit("tag"), "primary_tag", "count", none, none),
        panels["filled_trend"].where("count > 0").select(F.lit("week"), F.date_format("period", "yyyy-MM-dd"), "count", none, none),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH r AS (SELECT 'https://x.org/' || CASE WHEN user_id % 2 = 0 THEN 'news/' ELSE 'tag/' END || user_id % 40 AS url, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CASE WHEN event_id % 5 = 0 THEN '404' ELSE '200' END AS status FROM events)
SELECT url, min(stamp) AS wayback_ts, substr(min(stamp), 1, 4) || '-' || substr(min(stamp), 5, 2) || '-' || substr(min(stamp), 7, 2) AS published_raw
FROM r WHERE status = '200' AND stamp >= '20240105' AND stamp <= '20240125' AND starts_with(url, 'https://x.org/news') GROUP BY url""")
def indexed_captures(spark, d):
    """Index files of a web archive, made of a table, each a partition of a data source that takes the filters. A larger
    table makes more files, not longer ones."""
    url = F.concat(F.lit("https://x.org/"), F.when(F.col("user_id") % 2 == 0, F.lit("news/")).otherwise(F.lit("tag/")), F.col("user_id") % 40, F.when(F.col("event_id") % 3 == 0, F.lit("/")).otherwise(F.lit("")))
    status = F.when(F.col("event_id") % 5 == 0, F.lit("404")).otherwise(F.lit("200"))
    events = table(spark, d, "events")
    number = max(4, -(-events.count() // INDEX_ROWS))
    rows = events.select(F.pmod(F.xxhash64("event_id"), F.lit(number)).alias("file"), F.array(F.date_format("ts", "yyyyMMddHHmmss"), url, status).alias("row"))
    head = F.array(F.array(F.lit("timestamp"), F.lit("original"), F.lit("statuscode")))
    answers = rows.groupBy("file").agg(F.to_json(F.concat(head, F.collect_list("row"))).alias("value"))
    path = readers.landing(spark, "index")
    answers.select("value").write.option("maxRecordsPerFile", 1).text(path)
    files = [r["path"] for r in readers.stored_files(spark, path, "*.txt").select("path").collect()]
    return web.captures(spark, files, since="20240105", until="20240125", prefix="https://x.org/news")
