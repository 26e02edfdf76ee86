import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from inkspan.functions import sql
from inkspan.functions.tags import pattern_tags
from inkspan.operators import dedup
from inkspan.plans import catalog_flow, dashboard, pipelines
from inkspan.sources import html, notices, readers, rules, web, writers
from inkspan.sources.html import parse
from inkspan.sources.rules import RULES, Chain, Compiled, Rules, Take
from inkspan.streaming import aggregates, incremental, precedence

PAGE = """<html><head><title>Site</title><script type="application/ld+json">{"@graph":[{"datePublished":"2024-01-02"}]}</script></head>
<body><nav><a href="/x">menu</a></nav><div class="sidebar"><div>noise</div></div><h1>Scam <b>alert</b> rises</h1>
<article><p>Money was lost to a romance scam by many people this year.</p><script>var a = 1;</script></article>
<a href="/topics/scams">Scams</a><a href="https://o.org/r.pdf">Report</a><a href="/topics/scams">Again</a>
<table><tr><td>FIN-2024-A001</td><td><a href="/n">N</a></td></tr></table></body></html>"""


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id":"1","source":"fine","title":"é"}\n\n{"doc_id":"2"}\n')
    df = readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.DOCUMENT, "s")
    assert [(r["doc_id"], r["source"], r["source_detail"]) for r in df.orderBy("doc_id").collect()] == [("1", "s", "fine"), ("2", "s", None)]
    (tmp_path / "a.json").write_text(json.dumps([{"doc_id": "1"}, {"doc_id": "2"}]))
    assert readers.json_array(spark, str(tmp_path / "a.json"), readers.DOCUMENT).count() == 2
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny ""q"""\n')
    assert readers.csv(spark, str(tmp_path / "a.csv")).collect()[0]["b"] == 'x\ny "q"'
    assert readers.optional(spark, str(tmp_path / "none.jsonl"), readers.DOCUMENT).count() == 0


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link></link><guid>https://x/1</guid><category>b</category><category>a</category><pubDate>d</pubDate></item><item><title>U</title><guid>id-7</guid></item></channel></rss>")
    rows = readers.feed(spark, str(tmp_path / "f.xml"), "news").collect()
    assert [(r["url"], r["topics"]) for r in rows] == [("https://x/1", ["a", "b"])]


def test_archive_index(spark):
    body = json.dumps([["urlkey", "timestamp", "original", "statuscode"], ["k", "20240105000000", "https://x/1/", "200"], ["k", "20230105000000", "https://x/1", "200"], ["k", "20240101000000", "https://x/2", "404"]])
    df = spark.createDataFrame([(body,)], "body string")
    rows = readers.archive_index(df).collect()
    assert [(r["url"], r["published_raw"]) for r in rows] == [("https://x/1", "2023-01-05")]
    assert readers.archive_index(df, since="20240101").collect()[0]["wayback_ts"] == "20240105000000"


def test_html(spark):
    pages = spark.createDataFrame([(1, "https://s.org/d/", PAGE), (2, None, None), (3, "u", "<p>broken <b>tag")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html.extract_articles(pages).collect()}
    assert rows[1]["title"] == "Scam alert rises" and rows[1]["published_raw"] == "2024-01-02" and rows[1]["topics"] == ["Again", "Scams"]
    assert rows[1]["body_raw"] == "Money was lost to a romance scam by many people this year." and rows[2]["body_raw"] == ""
    links = [(r["url"], r["title_hint"]) for r in html.extract_links(pages).where("page_id = 1").orderBy("position").collect()]
    assert links == [("https://s.org/x", "menu"), ("https://s.org/topics/scams", "Scams"), ("https://o.org/r.pdf", "Report"), ("https://s.org/n", "N")]
    cells = html.extract_tables(pages).collect()[0]
    assert cells["cells"] == ["FIN-2024-A001", "N"] and cells["links"] == ["/n"]
    native = pages.select(html.heading("html"), html.first_pdf("html")).collect()[0]
    assert tuple(native) == ("Scam alert rises", "https://o.org/r.pdf")


def test_a_reference_that_a_cut_left_open_stays_as_written(spark):
    page = "<html><head><title>Frauds &amp; scams &amp</title><script type='application/ld+json'>{\"datePublished\": \"a & b &amp\"}</script></head><body><!-- <script> & --><h1>Frauds &amp; scams &amp</h1><article><p>Losses &quo &ampx; &lt;b&gt; &#38; of a year that nobody has counted until now &am</p></article><a href='/r?a=1&copy=2'>R&amp</a></body></html>"
    pages = spark.createDataFrame([(1, "https://s.org/", page)], "page_id long, url string, html string")
    row = html.extract_articles(pages, ended_only=True).collect()[0]
    assert row["title"] == "Frauds & scams &amp" and row["published_raw"] == "a & b &amp"
    assert row["body_raw"] == "Losses &quo &ampx; <b> & of a year that nobody has counted until now &am"
    assert [(r["url"], r["title_hint"]) for r in html.extract_links(pages, ended_only=True).collect()] == [("https://s.org/r?a=1&copy=2", "R&amp")]
    assert html.extract_articles(pages).collect()[0]["title"] == "Frauds & scams &"
    sql.register(spark)
    hints = [spark.sql(f"SELECT l.title_hint FROM {{rows}} r, LATERAL page_links(r.html, r.url{more}) l", rows=pages).collect()[0][0] for more in ("", ", true")]
    assert hints == ["R&", "R&amp"]


def test_web_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text(PAGE)
    web.register(spark)
    urls = f"file://{tmp_path}/p.html\nfile://{tmp_path}/none.html"
    rows = spark.read.format("webpages").option("urls", urls).option("pause", "0").option("perPartition", "1").load().collect()
    assert sorted((r["html"] is not None, r["error"] is not None) for r in rows) == [(False, True), (True, False)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a"], None, "b1", "b2")], "doc_id string, fraud_tags array<string>, body string, body_2 string, body_1 string")
    assert writers.flat_master(df).columns == ["doc_id", "fraud_tags"]
    assert writers.flat_master(df, True).columns == ["doc_id", "fraud_tags", "body", "body_1", "body_2"]
    writers.json_lines(df, str(tmp_path / "o"))
    assert json.loads("".join(x.read_text() for x in (tmp_path / "o").glob("part*")))["body"] is None
    assert json.loads("".join(r[0] for r in writers.json_array(df).collect()))[0]["doc_id"] == "1"
    empty = [r[0] for r in writers.json_array(df.limit(0)).collect()]
    assert json.loads("".join(empty)) == []
    good, bad = writers.split_failures(df, "body is not null")
    assert (good.count(), bad.count()) == (0, 1)


def test_incremental(spark, tmp_path):
    where, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = [("1", "2024-01-01", "a scam"), ("1", "2024-01-01", "a scam"), ("2", "2024-01-09", "phishing")]
    df = spark.createDataFrame(rows, "doc_id string, date string, text string")
    df.write.json(where)
    stream = incremental.once_per_id(incremental.stream_of(spark, where, df.schema))
    incremental.append(incremental.tagged(stream, "text"), out, mark).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["1", "2"]
    spark.createDataFrame([("2", "d", "t"), ("3", "2024-01-10", "scam")], df.schema).write.mode("append").json(where)
    again = incremental.once_per_id(incremental.stream_of(spark, where, df.schema))
    incremental.append(incremental.tagged(again, "text"), out, mark).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]
    assert incremental.run_batch(df.withColumn("doc_id", F.lit("9")), out).count() == 3


def test_windowed_stream_equals_batch(spark, tmp_path):
    where = str(tmp_path / "in")
    df = spark.createDataFrame([("2024-01-01", "scam"), ("2024-01-03", "scam"), ("2024-01-10", "phishing")], "d string, text string").select(F.to_timestamp("d").alias("ts"), "text")
    df.write.parquet(where)
    stream = incremental.tagged(incremental.stream_of(spark, where, df.schema, format="parquet"), "text")
    q = incremental.windowed_tag_counts(stream, "ts").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = df.select("ts", F.explode(pattern_tags("text")).alias("fraud_tag")).groupBy(F.window("ts", "7 days"), "fraud_tag").count()
    assert sorted((r["fraud_tag"], r["count"]) for r in spark.table("w").collect()) == sorted((r["fraud_tag"], r["count"]) for r in batch.collect())


def test_notices(spark):
    listing = "<table><tr><td>FIN-2023-Alert001</td><td>01/05/2023</td><td>Mail theft</td><td><a href='/a.pdf'>x</a></td></tr><tr><td>FIN-2023-Alert001</td><td>01/05/2023</td><td>Aviso</td></tr><tr><td>FIN-2019-Alert009</td><td>old</td></tr><tr><td>none</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://g.gov/list", listing)], "page_id long, url string, html string")
    rows = notices.from_tables(pages, "Alert", "https://g.gov/list").collect()
    assert [(r["notice_id"], r["date"]) for r in rows] == [("FIN-2023-Alert001", "01/05/2023")]
    detail = "<h1>Advisory on checks</h1><p>FIN-2024-A002 issued March 3, 2024</p><a href='/x.html'>x</a><a href=\"/d/FIN.PDF\">pdf</a>"
    pages = spark.createDataFrame([(1, "https://g.gov/1", detail), (2, "https://g.gov/fin-2021-a004", "<p>no number</p>"), (3, "https://g.gov/3", None)], "page_id long, url string, html string")
    rows = {r["source_page"]: r for r in notices.from_details(pages).collect()}
    assert rows["https://g.gov/1"]["notice_id"] == "FIN-2024-A002" and rows["https://g.gov/1"]["date"] == "03/03/2024" and rows["https://g.gov/1"]["pdf_url"] == "/d/FIN.PDF"
    assert set(rows) == {"https://g.gov/1", "https://g.gov/fin-2021-a004"}
    doc = spark.createDataFrame([([(1, "native", "word " * 40), (2, "native", "x")],)], "pages array<struct<page_num int, method string, text string>>")
    assert notices.with_page_decisions(doc).collect()[0]["ocr_wanted"] == [2]


def test_a_crawl_ends_where_nothing_is_new(spark):
    """With ``stop_without_new`` at the first page that only repeats; pages fetched together give the same rows."""
    def page(n):
        return "data:text/html," + "".join(f'<a href="https://l.org/{i}">t</a>' for i in range(min(n, 3)))

    def links(pages):
        return html.extract_links(pages, "page_no").select("page_no", "url")

    for at_once in (1, 3):
        rows = web.crawl(spark, page, links, pages=6, at_once=at_once, stop_without_new=True, pause="0").collect()
        assert sorted(tuple(r) for r in rows) == [(1, "https://l.org/0"), (2, "https://l.org/1"), (3, "https://l.org/2")]


# Characters of cleaned documents, and their chunks: how many, the shortest, the longest.
CHUNKED = [(3452, 4, 452, 1200), (12818, 13, 800, 1200), (19958, 20, 905, 1200), (27269, 28, 221, 1200), (31186, 31, 1113, 1200), (38231, 38, 1134, 1200), (47258, 47, 1075, 1200)]


def test_chunk_counts_of_known_documents(spark):
    """Windows of 1200 characters every 1000. Cleaning takes characters away first, so a last window may fall away."""
    from inkspan.operators import chunks

    made = spark.createDataFrame([(n, "x" * n) for n, *_ in CHUNKED], "n int, body string")
    own = {r["n"]: r for r in chunks.chunk_summary(chunks.chunk_rows(made, "body", ["n"], clean=False), ["n"]).collect()}
    for n, total, least, most in CHUNKED:
        assert own[n]["total_chunks"] - total in (0, 1) and own[n]["max_chunk_length"] == most and 150 < least <= most


def article(source, body, head=""):
    return Compiled(RULES[source]).article(f"<html><head>{head}</head><body>{body}</body></html>")


def test_a_payments_page_takes_its_time_before_its_meta_date():
    meta = '<meta property="article:published_time" content="2023-05-06">'
    post = '<div class="post-content">text <b>of</b> it<script>var x;</script></div>'
    assert article("payments_news", '<h1>A <b>B</b></h1><time datetime="2024-01-05">x</time>' + post, meta) == ("AB", "2024-01-05", "text of it", [])
    assert article("payments_news", "<time>no attribute</time>" + post, meta)[1] == "2023-05-06"
    assert article("payments_news", '<div class="the-Byline">May <i>1</i></div>' + post)[1] == "May1"
    assert article("payments_news", "<article>other</article>" + post)[2] == "text of it"
    assert article("payments_news", "<p>no container</p>")[2] is None


def test_a_vendors_page_takes_linked_data_first_and_its_first_container():
    linked = '<script type="application/ld+json">{"@graph":[{"x":1},{"datePublished":"2021-01-01"}]}</script><meta property="article:published_time" content="2023-05-06">'
    assert article("vendor_blog", "<time>May 1</time>", linked)[1] == "2021-01-01"
    assert article("vendor_blog", '<time> May  1 </time><span class="Published">x</span>', '<script type="application/ld+json">{bad</script>')[1] == "May 1"
    assert article("vendor_blog", '<span class="x-date">June</span>')[1] == "June"
    long = "word " * 11
    assert article("vendor_blog", f'<main>{long}</main><div class="my-blog-x">short</div><p>{"p" * 41}</p><p>{"q" * 40}</p>')[2] == "p" * 41
    assert article("vendor_blog", f'<article>{long}</article><div class="entry-content">{"e" * 51}</div><aside>noise</aside>')[2] == "e" * 51


def test_other_sources_pages():
    assert article("complaint_center", '<span class="Date">May 2</span><div class="field-body">a<nav>n</nav> b</div><a class="Tags">T</a><a class="x">U</a>', '<meta name="dc.date" content="m">') == ("", "May 2", "a b", ["T"])
    assert article("complaint_center", "<time></time><article>x</article>", '<meta name="date" content="m">')[1] == ""
    assert article("bureau_news", '<h1>fbi.gov home</h1><div class="field-items">short</div><article>' + "a" * 201 + "</article>", "<title>Long enough title</title>")[::2] == ("Long enough title", "a" * 201)
    assert article("bureau_news", '<div id="wm-ipp"><h1>Archive bar</h1></div><h1>Tiny</h1><main>left<div class="breadcrumb">b</div></main>', "<title>fbi.gov</title>")[::2] == ("fbi.gov", "left")
    assert article("security_news", '<h1>T</h1><time datetime="d">t</time><div class="articleBody">a<div class="ad">ad</div>b</div>') == ("T", "d", "a b", [])
    assert article("agency_blog", '<nav><a href="/topics/n">Nav</a></nav><main>m</main><a href="/scams/x">Scams</a><a href="/topics/y">Ads</a><a href="/topics/z">x</a>') == ("", "", "m", ["Ads", "Scams"])
    for source in RULES:
        assert article(source, "")[0] == "" and Compiled(RULES[source]).article(None)[3] == []


def test_selectors():
    root, _ = parse('<div class="a"><p id="x" data-k="Some Value">1<span>2</span></p></div><section><span class="b c">3</span><p>4</p></section>')
    cases = {
        "span": "2 3", "div span": "2", ".a p span": "2", "p": "1 2 4", "#x": "1 2", "p#x": "1 2", "span.b.c": "3", "[data-k]": "1 2", "p[data-k*=ome]": "1 2", "p[data-k*=OME]": "",
        "[class~B]": "3", "[data-k~value$]": "1 2", "section p": "4", "section .a": "", "div div": "", "[class=a]": "1 2", "[class=b]": "",
    }
    for selector, want in cases.items():
        own = Compiled(Rules(Chain((Take(selector, each=True, least=0),)), Chain(())))
        assert own._field(own.rules.title, own.found(root), []) == want, selector
    with pytest.raises(ValueError):
        Compiled(Rules(Chain((Take("p > b"),)), Chain(())))


def test_pages_of_a_source_become_its_documents(spark):
    """Listed dates stand in, or go first; pages without the body that rules need fall away."""
    html = '<h1>A scam warning</h1><div class="post-content">A romance scam took money from many people who wrote to us.</div>'
    pages = spark.createDataFrame([("https://x/1", html, "2024-01-02"), ("https://x/2", "<p>none</p>", None), ("https://x/3", '<time datetime="2020-02-03">t</time>' + html.replace("A scam", "Another"), "2024-01-04"), ("https://x/4", None, None)], "url string, html string, published_raw string")
    rows = pipelines.articles_of_pages(pages, pipelines.SOURCES["payments_news"])
    assert {r["url"]: r["published_raw"] for r in rows.collect()} == {"https://x/1": "2024-01-02", "https://x/3": "2020-02-03"}
    out = {r["url"]: r for r in pipelines.run_source(rows, pipelines.SOURCES["payments_news"]).collect()}
    assert out["https://x/1"]["fraud_tags"] == ["consumer_fraud"] and out["https://x/3"]["published_year"] == 2020
    vendor = pipelines.articles_of_pages(pages.where("url like '%3'"), pipelines.SOURCES["vendor_blog"])
    assert [r["published_raw"] for r in vendor.collect()] == ["2024-01-04"]
    assert rules.extract_by_source(pages, F.lit("unknown"), "url").count() == 0


def test_a_page_of_several_sources_is_sent_and_parsed_once(spark):
    schema = "page_id long, html string, of array<string>, note string"
    pages = spark.createDataFrame([(i, f"<h1>Page {i} of all</h1><time>day</time><main><p>{'word ' * 60}</p></main>" if i % 7 else None, [*RULES, "unknown"][i % 5 :], f"n{i}") for i in range(300)] + [(999, "x", None, "n"), (998, "x", [], "n")], schema)
    once = rules.extract_by_source(pages, "of", keep=("note",))
    each = rules.extract_by_source(pages.withColumn("of", F.explode("of")), "of", keep=("note",))
    assert once.schema.names == each.schema.names and sorted(map(str, once.collect())) == sorted(map(str, each.collect())) and once.count() > 900
    plan = catalog_flow.articles_by_source(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


RANKED = "doc_id string, source string, seq long, note string"


def _followed(spark, tmp_path, runs, **how):
    """What is kept after the runs, and the changes, each a row file of the stream in this order."""
    at = tmp_path / "x"
    for rows in runs:
        spark.createDataFrame(rows, RANKED).repartition(2).write.mode("append").parquet(f"{at}/in")
        stream = incremental.stream_of(spark, f"{at}/in", spark.createDataFrame([], RANKED).schema, format="parquet")
        precedence.follow(spark, precedence.changes(stream, "doc_id", "source", ["best", "good", "fair"], "seq", **how), f"{at}/out", f"{at}/mark")
    found = spark.read.parquet(f"{at}/out")
    return {r["doc_id"]: (r["source"], r["seq"], r["note"]) for r in precedence.current_of(found, "doc_id").collect()}, [(r["doc_id"], r["source"], r["change"], r["version"]) for r in found.collect()]


@pytest.mark.parametrize("turned", [False, True])
def test_first_source_wins_across_runs_in_either_order(spark, tmp_path, turned):
    runs = [
        [("a", "good", 5, "x"), ("a", "good", 4, "y"), ("b", "fair", 1, "x"), ("c", "none listed", 1, "x"), (None, "fair", 1, "n"), ("d", "good", None, "x")] + [("hot", "fair", i, "h") for i in range(500)],
        [("a", "best", 9, "z"), ("b", "fair", 2, "y"), ("c", "fair", 7, "y"), (None, "good", 3, "m"), ("d", "good", 8, "y"), ("e", None, 1, "x"), ("hot", "best", 3, "k")],
    ]
    runs = runs[::-1] if turned else runs
    kept, found = _followed(spark, tmp_path, runs)
    order = {"best": 0, "good": 1, "fair": 2}
    rows = sorted((r for run in runs for r in run), key=lambda r: (order.get(r[1], 3), r[2] is None, r[2] or 0))
    want = {}
    for d, source, seq, note in rows:
        want.setdefault(d, (source, seq, note))
    assert kept == want
    batch = dedup.first_source_wins([spark.createDataFrame([r for r in rows if r[1] == s], RANKED) for s in order], "doc_id", "seq")
    assert {r["doc_id"]: (r["source"], r["seq"], r["note"]) for r in batch.collect() if r["doc_id"] not in ("d", "e")} == {k: v for k, v in want.items() if k not in ("d", "e")}
    of_a = sorted(x[1:] for x in found if x[0] == "a")
    assert of_a == ([("best", "new", 1)] if turned else [("best", "replaced", 2), ("good", "new", 1)])
    assert len([x for x in found if x[0] == "hot"]) <= 2


def test_choices_settle_and_are_forgotten(spark, tmp_path):
    """After its time a choice is final; a key that has been forgotten starts anew."""
    runs = [[("a", "fair", 1, "x")], [("b", "fair", 1, "x")], [("a", "best", 1, "y")]]
    kept, _ = _followed(spark, tmp_path / "1", runs, settle_days=1e-8)
    assert kept["a"] == ("fair", 1, "x")
    kept, _ = _followed(spark, tmp_path / "2", runs, settle_days=30)
    assert kept["a"] == ("best", 1, "y")
    _, found = _followed(spark, tmp_path / "3", [[("a", "best", 1, "x")], [("a", "fair", 1, "y")]], forget_days=1e-8)
    assert [x[2:] for x in found] == [("new", 1), ("new", 1)]


def test_maintained_counts_equal_those_of_the_rows(spark, tmp_path):
    """Three batches, one of them replayed with other partitions, another torn and run again; before and after folding."""
    days = ["2024-01-05", "2024-02-11", "2024-03-01", "2024-03-09", "2023-03-02", None]
    rows = [(days[i % 6], f"s{i % 3}", ["scam", "theft", None][i % 5 % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "date string, source string, primary_tag string").withColumn("date", F.to_timestamp("date"))
    at, as_of = str(tmp_path / "t"), F.lit("2024-03-20").cast("timestamp")
    assert aggregates.read(spark, at).count() == 0
    parts = [df.where(F.pmod(F.hash(*df.columns), F.lit(3)) == k) for k in range(3)]
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{at}-in")
        stream = incremental.stream_of(spark, f"{at}-in", df.schema, format="parquet")
        aggregates.maintain(stream, at, f"{at}-mark").awaitTermination()

    def same():
        counts = aggregates.read(spark, at)
        got = dashboard.of_maintained(counts, as_of, "M")
        want = {
            "volume_trend": dashboard.volume_trend(df, "M", as_of), "filled_trend": dashboard.filled_trend(df, "M"), "period_change": dashboard.period_change(df, "M"),
            "year_to_date": dashboard.year_to_date(df), "top_tags": dashboard.counts_of(df, "primary_tag"), "source_audit": dashboard.source_audit(df), "totals": dashboard.totals(df),
        }
        for name in want:
            assert sorted(map(tuple, got[name].collect()), key=str) == sorted(map(tuple, want[name].collect()), key=str), name

    same()
    aggregates.write_batch(parts[1].repartition(5), 1, at)
    same()
    assert aggregates.compact(spark, at) == 2
    aggregates.write_batch(parts[2], 2, at)
    same()
    df = df.union(df.limit(7))
    aggregates.write_batch(df.limit(7), 3, at)
    counts = aggregates.read(spark, at).agg(F.sum("records")).first()[0]
    assert counts == 97 and aggregates.compact(spark, at) == 3 and aggregates.read(spark, at).agg(F.sum("records")).first()[0] == 97


def test_filters_on_an_archive_index_reach_its_service(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            own = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append(own)
            rows = [["20240101", "https://x.org/a/", "200"], ["20240301", "https://x.org/a", "200"], ["20240302", "https://x.org/b", "404"], ["20240303", "https://y.org/c", "200"], ["2024", "https://x.org/d", "200"]]
            answer = [["timestamp", "original", "statuscode"], *rows] if own["url"] != "none" else []
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/cdx"
    try:
        out = web.captures(spark, [at], ("x.org/*", "none"), since="20240201", until="20240401", prefix="https://x.org/", limit="7")
        assert [tuple(r) for r in out.collect()] == [("https://x.org/a", "20240301", "2024-03-01")]
        assert {a["url"] for a in asked} == {"x.org/*", "none"} and all((a["from"], a["to"], a["filter"], a["limit"], a["collapse"]) == ("20240201", "20240401", "statuscode:200", "7", "urlkey") for a in asked)
        assert "Filter (" not in out._jdf.queryExecution().executedPlan().toString()
        asked.clear()
        rows = spark.read.format("archiveindex").schema("wayback_ts string, url string").options(endpoint=at).load().where("url like 'https://x%' and length(wayback_ts) = 4")
        assert [tuple(r) for r in rows.collect()] == [("2024", "https://x.org/d")]
        assert asked[-1]["fl"] == "timestamp,original" and asked[-1]["matchType"] == "prefix" and asked[-1]["url"] == "https://x"
    finally:
        server.shutdown()


def test_an_index_is_read_row_by_row():
    rows = [["timestamp", "original"], *[[str(i), 'é"],[' + "x" * (i % 50)] for i in range(3000)]]
    for text in (json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=1), "[]", " ", "[[]]"):
        for size in (1, 7, 1 << 18):
            assert list(web.matrix_rows(io.BytesIO(text.encode()), size)) == (json.loads(text) if text.strip() else [])
    for text in ('[["a"],', '[["a"]', '[["a"] ["b"]]', '[["a"],]', '{"a": 1}', '[["a"]] x', '[["a', "[,]", "[1]"):
        with pytest.raises(ValueError):
            list(web.matrix_rows(io.BytesIO(text.encode()), 2))


def test_a_long_index_is_not_held(tmp_path):
    with open(tmp_path / "i.json", "w") as out:
        out.write('[["timestamp","original","statuscode"]')
        for i in range(300_000):
            out.write(f',\n["2024010100{i % 10000:04d}","https://x.org/{i}","200"]')
        out.write("]")
    reader = web.ArchiveIndex({"endpoint": f"file:{tmp_path}/i.json"}).reader(web.ArchiveIndex({}).schema())
    tracemalloc.start()
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 300_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_a_larger_table_makes_more_index_files(spark, tmp_path, monkeypatch):
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.lit("2024-01-10 00:00:00").cast("timestamp").alias("ts"), F.lit(2).cast("long").alias("user_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(catalog_flow, "INDEX_ROWS", 100)
    monkeypatch.setattr(web, "captures", lambda s, files, **how: seen.append(files))
    catalog_flow.indexed_captures(spark, str(tmp_path))
    sizes = [len(json.loads(r["value"])) - 1 for r in spark.read.text(seen[0]).collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 200


def test_a_hosts_pages_are_fetched_by_one_task():
    urls = [f"https://{h}.org/{i}" for i in range(4) for h in ("a", "B", "c")] + ["https://b.org/x", "bad url", "http://[x"]
    reader = web._Reader({"urls": "\n".join(urls), "perpartition": "5"})
    parts = [p.urls for p in reader.partitions()]
    assert sorted(sum(parts, [])) == sorted(urls)
    for host in ("a.org", "b.org", "c.org"):
        assert len([p for p in parts if any(web._host(u) == host for u in p)]) == 1
    assert max(map(len, parts)) <= 6
