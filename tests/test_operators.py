import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from inkspan.operators import chunks, dedup, joins
from inkspan.plans import analytics, dashboard, pipelines, views
from inkspan.sources import releases


def test_chunk_edges(spark):
    sizes = [0, 150, 151, 1000, 1001, 1200, 1201, 2200]
    df = spark.createDataFrame([(n, "x" * n) for n in sizes] + [(-1, None)], "n int, t string")
    out = {r["n"]: [len(c) for c in r["c"]] for r in df.select("n", chunks.chunk_array("t").alias("c")).collect()}
    assert out == {0: [], 150: [], 151: [151], 1000: [1000], 1001: [1001], 1200: [1200, 200], 1201: [1200, 201], 2200: [1200, 1200, 200], -1: []}
    with pytest.raises(ValueError):
        chunks.chunk_array("t", 100, 100)


def test_wide_documents(spark):
    df = spark.createDataFrame([("d", "scam " * 250 + "phishing " * 120)], "doc_id string, body string")
    rows = chunks.chunk_rows(df, "body", ["doc_id"])
    doc = chunks.documents_of_chunks(chunks.tag_chunks(rows), ["doc_id"]).collect()[0]
    assert doc["num_chunks"] == 3 and doc["fraud_tags"] == ["consumer_fraud", "cybercrime"] and doc["fraud_signals"] == ["phishing"]
    wide = chunks.wide(chunks.documents_of_chunks(chunks.tag_chunks(rows), ["doc_id"]), 4).collect()[0]
    assert wide["body_1"].startswith("scam") and wide["body_4"] is None
    assert chunks.chunk_summary(rows, ["doc_id"]).collect()[0]["total_chunks"] == 3


def test_pages(spark):
    df = spark.createDataFrame([([(2, "ocr", "b"), (1, "native", "a"), (3, "native", " ")],)], "pages array<struct<page_num int, method string, text string>>")
    r = chunks.assemble_pages(df).collect()[0]
    assert (r["full_text"], r["page_count"], r["ocr_pages"]) == ("a\n\nb", 3, 1)


def test_dedup(spark):
    df = spark.createDataFrame([("u", "t1", 2), ("u", "t2", 1), ("v", "t2", 3), (None, "t3", 4)], "url string, title string, seq int")
    assert sorted(r["seq"] for r in dedup.keep_first(df, ["url"], ["seq"]).collect()) == [1, 3, 4]
    assert sorted(r["seq"] for r in dedup.keep_first_chain(df, [["url"], ["title"]], ["seq"]).collect()) == [1, 4]
    last = {r["url"]: (r["title"], r["seq"]) for r in dedup.keep_last_value(df, "url", "seq").collect()}
    assert last["u"] == ("t1", 1)
    a = spark.createDataFrame([("u", 5)], "url string, seq int")
    b = spark.createDataFrame([("u", 1), ("w", 2)], "url string, seq int")
    assert sorted((r["url"], r["seq"]) for r in dedup.first_source_wins([a, b], "url", "seq").collect()) == [("u", 5), ("w", 2)]
    notices = spark.createDataFrame([("A", True, "01/01/2020"), ("A", False, None), ("A", False, "05/05/2021")], "id string, es boolean, date string")
    assert dedup.prefer_language(notices, "id", "es", "date").collect()[0]["date"] == "05/05/2021"


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("y", 5), ("z", 6)], "k string, n int")
    assert sorted(map(tuple, joins.both_sides(a, b, "k", "n").collect())) == [("x", 1, 0), ("y", 2, 5), ("z", 0, 6)]
    assert sorted(map(tuple, joins.aligned(a, b, "k", "n").collect())) == [("x", 1, 0), ("y", 2, 5)]
    assert joins.lookup(a, b.withColumnRenamed("n", "m"), "k", {"m": 0}).where("k = 'x'").collect()[0]["m"] == 0
    assert joins.routed(a, "k", {"x": lambda d: d.withColumn("r", F.lit(1))}).count() == 1


def _rows(spark):
    return spark.createDataFrame([
        ("a", 0, "s1", datetime(2022, 3, 1), "u", "a romance scam was seen by many here", ["consumer_fraud"]),
        ("a", 1, "s1", datetime(2022, 3, 1), "u", "phishing mail to a@b.co and more text", ["cybercrime", "consumer_fraud"]),
        ("b", 0, "s2", datetime(2024, 3, 1), "v", "bitcoin at 10.0.0.1 and nothing besides", ["crypto_fraud"]),
        ("c", 0, "s2", None, "w", "nothing of note in this long enough text", ["other"]),
        ("d", 0, "s2", None, "w", "short", ["other"]),
    ], "doc_id string, chunk_id int, source string, date timestamp, url string, text string, fraud_tags array<string>")


def test_views(spark):
    from inkspan.functions.signals import indicators

    rows = views.normalized(_rows(spark).withColumn("fraud_signals", indicators("text")), "text")
    m = views.master(rows).cache()
    assert m.count() == 4 and sorted(r["chunk_weight"] for r in m.collect()) == [0.5, 0.5, 1.0, 1.0]
    docs = {r["doc_id"]: r for r in views.documents(m).collect()}
    assert docs["a"]["fraud_tags"] == ["consumer_fraud", "cybercrime"] and docs["a"]["has_email"] and docs["a"]["num_chunks"] == 2
    assert docs["b"]["primary_tag"] == "crypto_fraud" and docs["b"]["has_ip"] and docs["c"]["primary_tag"] == "other"
    assert views.documents(m, keep_undated=False).count() == 2
    tagged = views.tag_rows(m)
    assert {r["fraud_tag"]: r["count"] for r in analytics.distribution(tagged, weight="chunk_weight").collect()} == {"consumer_fraud": 1.0, "cybercrime": 0.5, "crypto_fraud": 1.0}
    assert [r["fraud_tag"] for r in analytics.new_categories(tagged).collect()] == ["crypto_fraud"]
    change = {r["fraud_tag"]: (r["previous"], r["current"], r["pct_change"]) for r in analytics.year_on_year(tagged).collect()}
    assert change == {"consumer_fraud": (2, 0, -66.7), "cybercrime": (1, 0, -50.0), "crypto_fraud": (0, 1, 100.0)}
    results = analytics.analyse(m, "chunk_weight")
    assert results["rising"].collect()[0]["fraud_tag"] == "crypto_fraud" and results["falling"].count() == 2
    square = {(r[0], r[1]): r[2] for r in analytics.cooccurrence(m).collect()}
    assert all(square[a, b] == square[b, a] for a, b in square) and square["has_ip", "has_ip"] == 1
    assert analytics.view_summary(m).where("source = 's1'").collect()[0]["avg_chunks"] == 2.0
    assert analytics.tag_multiplicity(m).collect()[0]["multi_tag"] == 1


def test_periods(spark):
    rows = [(d, "x") for d in ("2024-01-05", "2024-03-01", "2024-03-09", "2024-04-02")]
    df = spark.createDataFrame(rows, "date string, primary_tag string").withColumn("date", F.to_timestamp("date"))
    filled = [(r["period"], r["count"]) for r in dashboard.filled_trend(df, "M").collect()]
    assert filled == [(date(2024, 1, 31), 1), (date(2024, 2, 29), 0), (date(2024, 3, 31), 2), (date(2024, 4, 30), 1)]
    r = dashboard.period_change(df, "M").collect()[0]
    assert (r["previous"], r["current"], r["delta"], r["pct"]) == (1, 2, 1, 100.0)
    shown = dashboard.volume_trend(df, "M", F.lit("2024-04-10").cast("timestamp"))
    assert [r["period"] for r in shown.collect()] == [date(2024, 1, 31), date(2024, 3, 31)]
    assert dashboard.volume_trend(df, "M", F.lit("2024-04-10").cast("timestamp"), compat=True).count() == 1


def test_pipeline_of_a_source(spark):
    raw = spark.createDataFrame([("T", "https://x/1", "2024-01-02", "A romance scam.  Comments closed. z"), ("T", "https://x/1", "2024-01-03", "again"), ("U", "https://x/2", "bad", "b@c.de wrote")], "title string, url string, published_raw string, body_raw string")
    out = {r["url"]: r for r in pipelines.run_source(raw, pipelines.SOURCES["agency_blog"]).collect()}
    assert len(out) == 2 and out["https://x/1"]["body_1"] == "A romance scam." and out["https://x/1"]["fraud_tags"] == ["consumer_fraud"]
    assert out["https://x/2"]["date"] is None and out["https://x/2"]["fraud_signals"]["emails"] == ["b@c.de"]
    with pytest.raises(ValueError):
        pipelines.run_source(raw.limit(0), pipelines.SOURCES["agency_blog"])


def test_steps(spark, tmp_path):
    def bad(_):
        raise RuntimeError("no")

    steps = [pipelines.Step("a", lambda s: s.range(3), str(tmp_path / "a")), pipelines.Step("b", bad, str(tmp_path / "b")), pipelines.Step("c", lambda s: s.range(1), str(tmp_path / "c"), after=("b",)), pipelines.Step("d", bad, str(tmp_path / "d"), enabled=False)]
    assert [r["status"] for r in pipelines.run_steps(spark, steps).collect()] == ["done", "failed", "blocked", "off"]
    assert [r["status"] for r in pipelines.run_steps(spark, steps).collect()][0] == "skipped"
    assert [r["ready"] for r in pipelines.ready(spark, steps).collect()] == [True, False, False, False]


def _counted(view, weight):
    """The cube in plain Python."""
    out = {}
    for r in view:
        amount = 1 if weight is None else r[weight]
        keys = [("primary", r["primary_tag"], None, None, None)]
        for t in r["fraud_tags"] or []:
            if t not in (None, "", "other"):
                keys += [("tag", t, None, None, None), ("year", t, r["year"], None, None), ("quarter", t, None, r["quarter"], None), ("source", t, None, None, r["source"])]
        for k in keys:
            out[k] = out.get(k, 0) + amount
    return out


def _cube_view(spark, n=400):
    r = random.Random(5)
    tags = ["a", "b", "c", "other", "", None]
    rows = [(r.choice([None, 2020, 2021, 2022]), r.choice([None, "2020-Q1", "2021-Q4"]), r.choice(["s1", "s2", None]), r.choice([None, [], r.sample(tags, r.randint(1, 6))]), r.choice(["a", "b", "other"]), r.choice([0.5, 0.25, 1.0])) for _ in range(n)]
    return spark.createDataFrame(rows, "year int, quarter string, source string, fraud_tags array<string>, primary_tag string, chunk_weight double")


@pytest.mark.parametrize("weight", [None, "chunk_weight"])
def test_cube(spark, weight):
    view = _cube_view(spark)
    cube = analytics.tag_cube(view, weight)
    got = {(r["kind"], r["fraud_tag"], r["year"], r["quarter"], r["source"]): r["count"] for r in cube.collect()}
    assert got == _counted([r.asDict() for r in view.collect()], weight)
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate [") == 1 and plan.count("LogicalRDD") == 1


@pytest.mark.parametrize("weight", [None, "chunk_weight"])
def test_analyses_come_from_one_scan_and_equal_separate_ones(spark, weight):
    """Each analysis equals that of the tag rows themselves, and none reads the view again."""
    view = _cube_view(spark)
    rows = views.tag_rows(view)
    rising, falling = analytics.emerging(rows, weight=weight)
    want = {
        "category_distribution": analytics.distribution(rows, weight=weight), "trend_by_year": analytics.trend(rows, "year", weight=weight), "trend_by_quarter": analytics.trend(rows, "quarter", weight=weight),
        "source_by_category": analytics.by_source(rows, weight=weight), "rising": rising, "falling": falling, "new_categories": analytics.new_categories(rows),
        "primary_tag_distribution": analytics.distribution(view, "primary_tag", weight, 2),
    }
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = analytics.analyse(view.mapInArrow(counted, view.schema), weight)
    assert set(got) == set(want)
    for name, df in want.items():
        assert [tuple(r) for r in got[name].collect()] == [tuple(r) for r in df.collect()], name
    assert read.value == 400
    empty = analytics.analyse(view.limit(0), weight)
    assert all(df.count() == 0 for df in empty.values())


def test_outputs_are_published_together(spark, tmp_path):
    at = str(tmp_path / "out")
    assert releases.current(spark, at) is None and releases.outputs(spark, at) == [] and releases.prune(spark, at) == []

    def numbers(n):
        return {name: lambda path, k=k: spark.range(n + k).write.parquet(path) for k, name in enumerate(("one", "two"))}

    def read():
        here = releases.current(spark, at)
        return [spark.read.parquet(f"{here}/{name}").count() for name in releases.outputs(spark, at)]

    first = releases.publish(spark, at, numbers(3))
    assert read() == [3, 4]

    def fails(path):
        assert read() == [3, 4]
        raise RuntimeError("half-way")

    with pytest.raises(RuntimeError):
        releases.publish(spark, at, numbers(7) | {"three": fails})
    assert read() == [3, 4] and releases.current(spark, at) == first
    second = releases.publish(spark, at, numbers(5))
    assert read() == [5, 6] and spark.read.parquet(f"{first}/one").count() == 3
    assert len(releases.prune(spark, at, keep=1)) == 2 and read() == [5, 6] and releases.current(spark, at) == second


def test_a_failing_export_leaves_the_former_one_whole(spark, tmp_path, monkeypatch):
    from inkspan.functions.signals import indicators
    from inkspan.sources import writers

    at = str(tmp_path / "run")
    rows = views.normalized(_rows(spark).withColumn("fraud_signals", indicators("text")), "text")
    assert pipelines.export_run(rows, at)["category_distribution_docs"].count() == 3
    before, names = releases.current(spark, at), releases.outputs(spark, at)
    assert len(names) == 12

    def broken(df, path, mode="overwrite"):
        if path.endswith("source_by_category_weighted"):
            raise OSError("disk")
        return plain(df, path, mode)

    plain = writers.csv
    monkeypatch.setattr(writers, "csv", broken)
    with pytest.raises(OSError):
        pipelines.export_run(rows.where("source = 's2'"), at)
    assert releases.current(spark, at) == before and releases.outputs(spark, at) == names
    assert all(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{before}/{n}").count() > 0 for n in names)
