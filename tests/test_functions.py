import re

import pytest
from pyspark.sql import functions as F

from inkspan.functions import dates, dictionary, signals, tags, text
from inkspan.functions.taxonomy import DEFAULT, EARLIER, KEYWORDS, SIGNALS


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_dictionary_sizes():
    assert len(DEFAULT.keyword_rows()) == 103 and len(DEFAULT.signal_rows()) == 73
    assert sum(map(len, EARLIER.keywords.values())) == 56 and len(DEFAULT.patterns) == 14 and len(SIGNALS) == 10
    assert set(DEFAULT.severity) == {*KEYWORDS, "other"}


def test_spaces(spark):
    assert values(spark, ["  a \u00a0b\n\tc ", None, ""], text.normalize_space("x")) == ["a b c", "", ""]
    assert values(spark, ["a \t b\nc"], text.collapse_blanks("x")) == ["a b\nc"]


def test_boilerplate(spark):
    rows = ["Pay nothing.  Comments closed. Old stuff", "A Return to top B"]
    assert values(spark, rows, text.strip_boilerplate("x", "agency_blog")) == ["Pay nothing.", "A B"]
    assert values(spark, ["Case won. Submit a Tip here"], text.strip_boilerplate("x", "bureau_news")) == ["Case won."]
    assert values(spark, ["Loss Page 3 of 9 grew"], text.strip_boilerplate("x", "complaint_center")) == ["Loss grew"]
    assert values(spark, ["Patch now. Related Articles more\nlines"], text.strip_boilerplate("x", "security_news")) == ["Patch now."]


def test_layout_and_pages(spark):
    assert values(spark, ["a\u00a0b\u00adc \ufb01ne\n\n\n\nend "], text.normalize_layout("x")) == ["a bc fine\n\nend"]
    page = "F I N C E N\n12\nMoney laun-\ndering grew\nin May."
    assert values(spark, [page], text.clean_page("x")) == ["Money laundering grew in May."]
    assert values(spark, ["front matter Alert on mail theft12 grew ( )"], text.clean_document("x")) == ["Alert on mail theft grew"]


def test_references_and_titles(spark):
    assert values(spark, ["fraud.12 rose,3 in 2024 b)4"], text.drop_reference_numbers("x")) == ["fraud. rose, in 2024 b)"]
    assert values(spark, ["money_laundering", "a-b c"], text.title_case("x")) == ["Money_Laundering", "A-B C"]
    assert values(spark, ["romance scam scam"], text.occurrences("x", "scam")) == [2]
    assert values(spark, ["Aviso 1", "spanishes", "no", None], text.looks_spanish("x")) == [True, True, False, False]


def test_ids_and_urls(spark):
    assert values(spark, ["https://x.y/a"], text.stable_id("x"))[0].__len__() == 14
    assert values(spark, ["see FIN-2024-Alert003 now", "none"], text.notice_id(F.col("x"))) == ["FIN-2024-Alert003", None]
    assert values(spark, ["/a", "b.html", "https://q/z", "//h/p"], text.absolute_url("x", "https://s.org/d/i.html")) == ["https://s.org/a", "https://s.org/d/b.html", "https://q/z", "https://h/p"]
    assert values(spark, ["x.org/", "http://y/"], text.tidy_url("x")) == ["https://x.org", "http://y"]
    assert values(spark, ["https://h/contact-us/field-offices/new-york/news"], text.office_label("x")) == ["New York"]


def test_ocr_and_lists(spark):
    assert values(spark, ["word " * 30, "12 34 " * 40, "", None], text.needs_ocr("x")) == [False, True, True, True]
    assert values(spark, ["['a', 'b']", '["c"]', "no"], text.literal_list("x")) == [["a", "b"], ["c"], None]


def test_dates(spark):
    iso = F.date_format(dates.to_utc("x"), "yyyy-MM-dd")
    rows = ["2024-01-02", "Tue, 02 Jan 2024 10:00:00 +0000", "01/02/2024", "January 2, 2024", "soon", None]
    assert values(spark, rows, iso) == ["2024-01-02"] * 4 + [None, None]
    epoch = F.date_format(dates.coerce_date("x"), "yyyy-MM-dd")
    assert values(spark, ["1704153600000", "1704153600", "5", "2024-01-02", None], epoch) == ["2024-01-02", "2024-01-02", None, "2024-01-02", None]
    assert values(spark, ["Jan 2, 2024", "2024-01-02", "x"], dates.us_date("x")) == ["01/02/2024", "01/02/2024", None]
    assert values(spark, ["by Bo on March 5, 2023, 10 AM", "n/a"], dates.fuzzy_date("x")) == ["2023-03-05", ""]
    ends = [values(spark, ["2024-02-14"], dates.period_end("x", i))[0].isoformat() for i in "WMQY"]
    assert ends == ["2024-02-18", "2024-02-29", "2024-03-31", "2024-12-31"]
    assert values(spark, ["2024-05-01", None], dates.quarter_label(F.to_date("x"))) == ["2024Q2", None]
    assert values(spark, ["20240102030405", "2024"], F.date_format(dates.capture_date("x"), "yyyy-MM-dd")) == ["2024-01-02", None]


def test_word_and_substring_tags(spark):
    rows = ["A romance scam.", "barbecue", "éscam", "Bitcoin wallet address, PHISHING!", None]
    assert values(spark, rows, tags.pattern_tags("x")) == [["consumer_fraud"], ["other"], ["other"], ["crypto_fraud", "cybercrime"], ["other"]]
    assert values(spark, rows, tags.keyword_tags("x")) == [["consumer_fraud"], ["cybercrime"], ["consumer_fraud"], ["crypto_fraud", "cybercrime"], ["other"]]
    assert values(spark, ["plain"], tags.keyword_tags("x", fallback=False)) == [[]]
    assert values(spark, ["scam by wire transfer"], tags.keyword_signals("x")) == [["wire transfer"]]


def test_patterns_agree_with_plain_regexes(spark):
    texts = ["pii", "spii", "pii_", "PII.", "x pii", "pii ", "a\npii\nb", "ünpii", "pii9", "(pii)"]
    want = [bool(re.search(r"\b(pii)\b", t, re.I)) for t in texts]
    assert [v == ["data_privacy"] for v in values(spark, texts, tags.pattern_tags("x"))] == want


def test_primary_tags(spark):
    df = spark.createDataFrame([("romance scam phishing", ["consumer_fraud", "cybercrime"]), ("nothing", ["ai_fraud", "data_privacy"]), ("x", ["other"]), ("x", []), (None, ["cybercrime", "sanctions"]), ("x", ["zz", "yy"])], "x string, t array<string>")
    assert [r[0] for r in df.select(tags.primary_tag("x", "t")).collect()] == ["consumer_fraud", "ai_fraud", "other", "other", "sanctions", "yy"]
    assert [r[0] for r in df.select(tags.severest_tag("t")).collect()] == ["cybercrime", "ai_fraud", "other", "other", "sanctions", "zz"]


def test_tag_shapes(spark):
    assert values(spark, ["['a','b']", '[["a"],["b"]]', "c", "", None], tags.parse_tags("x")) == [["a", "b"], ["a", "b"], ["c"], ["other"], ["other"]]


def test_tags_by_table(spark):
    df = spark.createDataFrame([(1, "big SCAM here"), (2, "none"), (3, None)], "id int, x string")
    words = spark.createDataFrame([("scam", "s"), ("here", "h")], "keyword string, family string")
    out = {r["id"]: r["fraud_tags"] for r in tags.tagged_by_table(df, "x", "id", words).collect()}
    assert out == {1: ["h", "s"], 2: ["other"], 3: ["other"]}


def test_indicators(spark):
    t = "See HTTPS://Ex.org:80/a). mail A@b.co and a@b.co, +1 212-555-0100, 10.0.0.256 10.0.0.25, 0x" + "a" * 40
    (out,) = values(spark, [t], signals.indicators("x"))
    assert out["urls"] == ["HTTPS://Ex.org:80/a"] and out["domains"] == ["ex.org:80"] and out["emails"] == ["a@b.co"]
    assert out["phones"] == ["+1 212-555-0100"] and out["ip_addresses"] == ["10.0.0.25"] and out["crypto_wallets"] == ["0x" + "a" * 40]
    assert values(spark, [t, None], signals.signal_count(signals.indicators("x"))) == [6, 0]
    assert values(spark, ['{"urls":["u"]}', '["u"]', "no", None], signals.signal_count(signals.parse_signals("x"))) == [1, 0, 0, 0]


def test_tags_by_table_do_not_depend_on_the_dictionarys_size(spark):
    """Keywords of one, two and more letters, null keys, equal keys; a dictionary on either side of the limit."""
    rows = [(1, "the p2 gang"), (2, "Q"), (None, "p2 and scam"), (None, "nothing"), (3, None), (3, "xq scam"), (4, "")]
    df = spark.createDataFrame(rows, "id int, x string")
    words = [("P2", "two"), ("q", "one"), ("scam", "four"), ("sca", "three")]
    many = spark.createDataFrame(words + [(f"zz{i}", "none") for i in range(10_002)], "keyword string, family string")
    want = {(1, "the p2 gang"): ["two"], (2, "Q"): ["one"], (None, "p2 and scam"): ["four", "three", "two"], (None, "nothing"): ["other"], (3, None): ["other"], (3, "xq scam"): ["four", "one", "three"], (4, ""): ["other"]}
    for dictionary in (many, spark.createDataFrame(words, "keyword string, family string")):
        assert {(r["id"], r["x"]): r["fraud_tags"] for r in tags.tagged_by_table(df, "x", "id", dictionary).collect()} == want


def test_dictionaries_of_any_size_give_the_same_tags_without_moving_texts(spark):
    """One, ten thousand and a million keywords, each with the same few that occur; and beyond the automaton's limit."""
    df = spark.createDataFrame([(1, "alpha scam beta SCAMS"), (2, "nothing"), (None, "ponzi and scam"), (None, None), (4, "")], "id int, x string").repartition(1)
    want = {(1, "alpha scam beta SCAMS"): ["fraud"], (2, "nothing"): ["other"], (None, "ponzi and scam"): ["fraud"], (None, None): ["other"], (4, ""): ["other"]}
    for n in (0, 10_000, 1_000_000):
        words = spark.range(n).selectExpr("concat('zq', id, 'x') AS keyword", "concat('f', id % 7) AS family")
        words = words.union(spark.createDataFrame([("Scam", "fraud"), ("", "none"), (None, "none")], "keyword string, family string"))
        out = tags.tagged_by_table(df, "x", "id", words)
        assert {(r["id"], r["x"]): r["fraud_tags"] for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "ArrowEvalPython" in plan and plan.count("Repartition") == 1
    joined = tags.tagged_by_table(df, "x", "id", words.where("family <> 'f1'").limit(500), most=10)
    assert joined.where("id = 4").first()["fraud_tags"] == ["other"] and "Join" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_hits_count_like_plain_python(spark):
    """Nested, overlapping, repeated and shared keywords in odd scripts; places count characters from 1."""
    words = [("aa", "x"), ("aaa", "x"), ("ab", "y"), ("a", "z"), ("ß", "y"), ("straße", "s"), ("AA", "x"), ("ab", "x"), ("日本", "j"), ("𝒳", "j")]
    texts = ["aaaaa", "abaab", "", None, "STRASSE straße", "日本日本 𝒳 aa", "b" * 5000 + "aab", "AaAaB"]
    keys = {(k.lower(), f) for k, f in words}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r["i"]: [tuple(h) for h in r["hits"]] for r in dictionary.dictionary_hits(df, "x", spark.createDataFrame(words, "keyword string, family string")).collect()}
    for i, t in enumerate(texts):
        low, want = (t or "").lower(), {}
        for k, f in keys:
            if k in low:
                n, at = want.get(f, (0, len(low)))
                want[f] = (n + low.count(k), min(at, low.index(k)))
        assert got[i] == [(f, n, at + 1) for f, (n, at) in sorted(want.items())]


def test_primary_tag_of_hits(spark):
    """Most hits, then priority, then name; 'other', null and unknown tags; no tags at all."""
    hits = "array(named_struct('family', 'b', 'hits', 2, 'place', 1), named_struct('family', 'c', 'hits', 2, 'place', 1), named_struct('family', 'd', 'hits', 9, 'place', 1))"
    cases = [("array('b', 'c', 'a')", "c"), ("array('b', 'a', 'other')", "b"), ("array('y', 'x')", "x"), ("array('other')", "other"), ("array(null, 'a')", "a"), ("cast(array() as array<string>)", "other")]
    for tags_sql, want in cases:
        assert spark.sql(f"SELECT {hits} AS h, {tags_sql} AS t").select(dictionary.primary_of_hits("h", "t", ("d", "c"))).first()[0] == want


def test_primary_tags_count_the_earlier_keywords(spark):
    """Words that came into the dictionary later tag a text, but don't count as hits."""
    df = spark.createDataFrame([("bitcoin ethereum smishing dark web phishing", ["crypto_fraud", "cybercrime"]), ("bitcoin bitcoin wallet", ["crypto_fraud", "cybercrime"])], "x string, t array<string>")
    assert [r[0] for r in df.select(tags.primary_tag("x", "t")).collect()] == ["cybercrime", "crypto_fraud"]


def test_dates_anywhere_in_a_text(spark):
    cases = {
        "3rd of March 2021": ["2021-03-03"], "Mar 3rd, 2021": ["2021-03-03"], "3 March 2021 10:00": ["2021-03-03"], "2021/03/03": ["2021-03-03"], "SEPT. 9, 2021 and 9 sep 2022": ["2021-09-09", "2022-09-09"],
        "25/12/2020, 12/25/2020": ["2020-12-25", "2020-12-25"], "4/10/24": ["2024-04-10"], "Feb 30, 2021 then Feb 28, 2021": ["2021-02-28"], "": [], None: [], "maypole 3 2021": [], "xMay 3, 2021": [], "May 3, 20211": [],
        "12021-01-02": [], "2021-01-023": [], "2021-01/02": [], "20210102": ["2021-01-02"], "120210102": [], "le 3 mai 2021": [], "Saturday 5 June 2021": ["2021-06-05"], "1st May 2021": ["2021-05-01"], "2 of august 2020.": ["2020-08-02"],
        "May 5, 2021May 6, 2021": ["2021-05-05"], "10-Apr-2024": ["2024-04-10"], "10.04.2024": ["2024-10-04"], "31.04.2024": [], "0000-01-01": [],
    }
    got = values(spark, list(cases), F.transform(dates.dates_in("x"), lambda x: x.cast("string")))
    assert dict(zip(cases, got)) == cases


def test_plurals_fold_into_words_that_occur(spark):
    from inkspan.plans import dashboard

    df = spark.createDataFrame([("Scam scams SCAMS bus class classs as loans loan's 2024 go",), (None,), ("a as buss gos go",)], "x string")
    out = {r["word"]: r["count"] for r in dashboard.narrative_themes(df, "x", ["class"], fold_plurals=True).collect()}
    assert out == {"scam": 3, "bus": 1, "buss": 1, "classs": 1, "as": 2, "loan": 2, "go": 3}


def test_signals_of_every_shape_in_one_column(spark):
    from inkspan.plans import views

    cases = {
        '{"urls":["u",null],"emails":"x"}': (["u"], []), '["a",1,null]': ([], ["a", "1"]), "word": ([], ["word"]), '"in quotes"': ([], ["in quotes"]), '"[\\"b\\"]"': ([], ["b"]), "": ([], []), " ": ([], []), None: ([], []), "{bad": ([], ["{bad"]),
        "12": ([], []), "[]": ([], []), "{}": ([], []), "null": ([], []), '"{\\"urls\\":[\\"v\\"]}"': (["v"], []),
    }
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(cases)], "doc_id string, x string")
    rows = df.select("doc_id", F.lit("text").alias("t"), signals.from_text("x").alias("fraud_signals"))
    got = {r["doc_id"]: (r["signals"]["urls"], r["keyword_signals"]) for r in views.normalized(rows, "t").collect()}
    assert got == {str(i): want for i, want in enumerate(cases.values())}


def test_functions_for_sql(spark):
    from pyspark.errors import AnalysisException

    from inkspan.functions import sql
    from inkspan.functions.signals import indicators

    names = sql.register(spark, prefix="x_")
    assert "x_fraud_tags" in names and len(names) == 10
    texts = ["A romance scam, BEC of a@B.co", None, "", "it's 10.0.0.1 and https://x.org/a) or +1  212-555-0100", "bc1" + "q" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    own = df.select("x", tags.pattern_tags("x").alias("p"), tags.keyword_tags("x").alias("k"), indicators("x").alias("i"))
    own = own.selectExpr("p", "k", "i.urls", "i.emails", "i.phones", "i.ip_addresses", "i.crypto_wallets").collect()
    got = spark.sql("SELECT x_fraud_tags(x), x_keyword_tags(x), x_urls_in(x), x_emails_in(x), x_phones_in(x), x_ip_addresses_in(x), x_crypto_wallets_in(x) FROM {df}", df=df).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in own]
    page = "<table><tr><td>1</td><td>b</td><td>c</td></tr><tr><th>x</th></tr></table>"
    rows = spark.sql("SELECT t.* FROM VALUES (:page), (NULL) v(h), LATERAL x_table_rows(h, 'id, name') t", args={"page": page}).collect()
    assert [r.asDict() for r in rows] == [{"table_no": 0, "row_no": 0, "id": "1", "name": "b"}, {"table_no": 0, "row_no": 1, "id": "x", "name": None}]
    assert spark.sql("SELECT * FROM x_document_chunks(NULL, 10, 2, 0)").count() == 0
    for bad in ("x_document_chunks('a', 2, 2, 0)", "x_document_chunks('a', 'b', 2, 0)", "x_table_rows('a', 'b,b')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()
    with pytest.raises(ValueError):
        sql.register(spark, prefix="a b")


def test_texts_go_to_the_automaton_in_small_batches(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "10000")
        spark.conf.set(names[1], str(64 << 20))
        words = spark.createDataFrame([("scam", "fraud")], "keyword string, family string")
        rows = dictionary.dictionary_hits(spark.range(3000, numPartitions=1).select("id", F.concat(F.lit("a scam "), "id").alias("text")), "text", words)
        assert int(spark.conf.get(names[0])) <= 512 and int(spark.conf.get(names[1]).rstrip("b")) <= 8 << 20
        assert rows.where("size(hits) = 1 and hits[0].place = 3").count() == 3000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
