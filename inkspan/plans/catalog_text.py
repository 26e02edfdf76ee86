"""Queries of the text, tag, indicator and date functions on made cases, with their SQL twins.

Cases are made of the driver's tables by the same rule on both sides, so that every family, form and boilerplate
occurs; some twins then state what must come out by how the case was made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, signals, tags, text
from ..functions.taxonomy import DEFAULT, EARLIER, KEYWORDS, SIGNALS, Taxonomy
from ..operators import chunks
from ..sources import html, printed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def comma(x: Column) -> Column:
    return F.array_join(x, ",")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


#: Words that cases are made of: every keyword of the default taxonomy, near misses, and signals.
WORDS = [*[w for ws in KEYWORDS.values() for w in ws], "bitcoins", "embec", "imposter", "crypto", "ssns", "nothing at all"]
SIGNAL_WORDS = [w for ws in SIGNALS.values() for w in ws]


def _nth(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    made = F.concat(F.lit("Case "), i.cast("string"), F.lit(" of "), _nth(WORDS, i), F.lit(", then "), F.upper(_nth(WORDS, i * 7 + 3)), F.lit("; near "), _nth(WORDS, i * 13 + 5), F.lit("-"), _nth(SIGNAL_WORDS, i * 3), F.lit(". "), _nth(WORDS, i), F.lit(" again."))
    return table(spark, d, "documents").select("doc_id", "source", made.alias("t"))


def _nth_sql(words: list[str], at: str) -> str:
    return f"{listed(words)}[CAST(({at}) % {len(words)} + 1 AS INTEGER)]"


CASES = f"cases AS (SELECT doc_id, source, 'Case ' || doc_id || ' of ' || {_nth_sql(WORDS, 'doc_id')} || ', then ' || upper({_nth_sql(WORDS, 'doc_id * 7 + 3')}) || '; near ' || {_nth_sql(WORDS, 'doc_id * 13 + 5')} || '-' || {_nth_sql(SIGNAL_WORDS, 'doc_id * 3')} || '. ' || {_nth_sql(WORDS, 'doc_id')} || ' again.' AS t FROM documents)"


def _present(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {quoted(name)} END" for name, t in tests) + "], lambda x: x IS NOT NULL)"


def pattern_sql(taxonomy: Taxonomy, t: str = "t") -> str:
    return _present([(f, rf"regexp_matches(lower({t}), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)})([^\p{{L}}\p{{N}}_]|$)')") for f, ws in taxonomy.patterns.items()])


def keyword_sql(taxonomy: Taxonomy, t: str = "t") -> str:
    return _present([(f, "(" + " OR ".join(f"contains(lower({t}), {quoted(w.lower())})" for w in ws) + ")") for f, ws in taxonomy.keywords.items()])


def or_other(x: str, order: bool = True) -> str:
    return f"CASE WHEN len({x}) = 0 THEN ['other'] ELSE {f'list_sort({x})' if order else x} END"


def primary_sql(taxonomy: Taxonomy, source: str, key: str, t: str = "t", tag_list: str = "tags") -> str:
    """(key, primary_tag) as a subquery over rows with a text and its tags."""
    families = sorted({*taxonomy.keywords, *taxonomy.patterns})

    def hits(f: str) -> str:
        return " + ".join(f"(length(lower({t})) - length(replace(lower({t}), {quoted(w)}, ''))) // {len(w)}" for w in taxonomy.counted().get(f, ())) or "0"

    rows = ", ".join(f"({quoted(f)}, {hits(f)}, {taxonomy.priority.index(f) if f in taxonomy.priority else 99})" for f in families)
    return f"""(SELECT {key}, coalesce(arg_min(family, rank) FILTER (WHERE list_contains({tag_list}, family)), 'other') AS primary_tag
      FROM (SELECT s.{key}, s.{tag_list}, f.family, (1000000 - f.hits) * 1000000 + f.place * 1000 + row_number() OVER (PARTITION BY s.{key} ORDER BY f.family) AS rank
            FROM {source} s, LATERAL (VALUES {rows}) f(family, hits, place)) GROUP BY {key})"""


# --- tags --------------------------------------------------------------------------------------------------------


@query(f"WITH {CASES}, w AS (SELECT doc_id, {or_other(pattern_sql(DEFAULT))} AS tags FROM cases) SELECT doc_id, array_to_string(tags, ',') AS tags, CASE {' '.join(f'WHEN list_contains(tags, {quoted(f)}) THEN {quoted(f)}' for f in DEFAULT.severity)} END AS severest FROM w")
def tags_default(spark, d):
    rows = cases(spark, d).select("doc_id", tags.pattern_tags("t").alias("tags"))
    return rows.select("doc_id", comma(F.col("tags")).alias("tags"), tags.severest_tag("tags").alias("severest"))


@query(f"WITH {CASES}, w AS (SELECT doc_id, {or_other(keyword_sql(DEFAULT))} AS tags, list_sort({_present([(k, f'contains(lower(t), {quoted(k)})') for k, _ in DEFAULT.signal_rows()])}) AS signals FROM cases) SELECT doc_id, array_to_string(tags, ',') AS tags, array_to_string(signals, ',') AS signals, len(signals) AS n_signals FROM w")
def keyword_tags_default(spark, d):
    rows = chunks.tag_chunks(cases(spark, d).withColumnRenamed("t", "chunk_text"))
    return rows.select("doc_id", comma(F.col("fraud_tags")).alias("tags"), comma(F.col("fraud_signals")).alias("signals"), F.col("fraud_signal_count").alias("n_signals"))


_TAGGED = f"tagged AS (SELECT doc_id, source, t, {or_other(pattern_sql(DEFAULT))} AS tags FROM cases)"


@query(f"WITH {CASES}, {_TAGGED} SELECT * FROM {primary_sql(DEFAULT, 'tagged', 'doc_id')}")
def primary_tag_default(spark, d):
    rows = cases(spark, d).select("doc_id", "t", tags.pattern_tags("t").alias("tags"))
    return rows.select("doc_id", tags.primary_tag("t", "tags").alias("primary_tag"))


@query(f"WITH {CASES} SELECT doc_id, array_to_string({or_other(pattern_sql(EARLIER), False)}, ',') AS tags, array_to_string(list_sort({keyword_sql(EARLIER)}), ',') AS chunk_tags FROM cases")
def bureau_tags(spark, d):
    return cases(spark, d).select("doc_id", comma(tags.pattern_tags("t", EARLIER, ordered=False)).alias("tags"), comma(tags.keyword_tags("t", EARLIER, fallback=False)).alias("chunk_tags"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'a' || doc_id || ',b' WHEN 1 THEN 'x,y' || doc_id WHEN 2 THEN 'n1,n2,n3' WHEN 3 THEN 'bare' || doc_id WHEN 6 THEN 'other' ELSE 'other' END AS tags, CASE doc_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS n_literal FROM documents")
def tag_lists(spark, d):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 7
    raw = F.when(k == 0, F.concat(F.lit('["a'), i, F.lit('", " b ", ""]'))).when(k == 1, F.concat(F.lit("['x', 'y"), i, F.lit("']"))).when(k == 2, F.lit('[["n1"], ["n2", "n3"]]')).when(k == 3, F.concat(F.lit("  bare"), i)).when(k == 4, F.lit("")).when(k == 6, F.lit("[]"))
    return table(spark, d, "documents").select("doc_id", comma(tags.parse_tags(raw)).alias("tags"), F.when(k < 2, F.size(text.literal_list(raw))).alias("n_literal"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'old' || doc_id ELSE 'other' END AS tags, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS n FROM documents")
def legacy_tags(spark, d):
    k = F.col("doc_id") % 3
    own = F.when(k == 0, F.array(F.lit("new")))
    both = tags.type_as_tags(own, F.when(k < 2, F.concat(F.lit("old"), F.col("doc_id").cast("string"))))
    return table(spark, d, "documents").select("doc_id", comma(tags.normalize_tags(both)).alias("tags"), F.size(both).alias("n"))


# --- indicators --------------------------------------------------------------------------------------------------

_INDICATED = "ind AS (SELECT doc_id, 'See HTTP://User@Host' || doc_id % 9 || '.Example.org:80' || doc_id % 5 || '/p?q=1, https://b.c/x) and http://b.c/y; mail A.B' || doc_id % 7 || '@X.org or a.b' || doc_id % 7 || '@x.ORG, from 10.0.' || doc_id % 300 || '.7' AS t FROM documents)"
_URLS_SQL = r"list_distinct(regexp_extract_all(t, '(?i)\bhttps?://[^\s)>\]]+'))"
_MAILS_SQL = r"list_distinct(list_transform(regexp_extract_all(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), lambda x: lower(x)))"
_DOMAINS_SQL = rf"list_distinct(list_transform({_URLS_SQL}, lambda u: lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1))))"
_IPS_SQL = rf"list_distinct(regexp_extract_all(t, '{signals.IP}'))"


@query(f"WITH {_INDICATED} SELECT doc_id, array_to_string(list_sort({_URLS_SQL}), ' ') AS urls, array_to_string(list_sort({_DOMAINS_SQL}), ' ') AS domains, array_to_string(list_sort({_MAILS_SQL}), ' ') AS emails, array_to_string(list_sort({_IPS_SQL}), ' ') AS ips, len({_URLS_SQL}) + len({_DOMAINS_SQL}) + len({_MAILS_SQL}) + len({_IPS_SQL}) AS n_signals, len({_IPS_SQL}) > 0 AS has_ip FROM ind")
def indicator_details(spark, d):
    i = F.col("doc_id")
    t = F.concat(F.lit("See HTTP://User@Host"), i % 9, F.lit(".Example.org:80"), i % 5, F.lit("/p?q=1, https://b.c/x) and http://b.c/y; mail A.B"), i % 7, F.lit("@X.org or a.b"), i % 7, F.lit("@x.ORG, from 10.0."), i % 300, F.lit(".7"))
    rows = table(spark, d, "documents").select("doc_id", signals.indicators(t).alias("s"))
    return rows.select("doc_id", *[F.array_join(F.col("s")[f], " ").alias(n) for n, f in (("urls", "urls"), ("domains", "domains"), ("emails", "emails"), ("ips", "ip_addresses"))], signals.signal_count("s").alias("n_signals"), signals.has("s", "ip_addresses").alias("has_ip"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n_urls, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 0 END AS n_all, CASE WHEN doc_id % 4 = 1 THEN 'email address,wire ' || doc_id ELSE '' END AS names, doc_id % 4 = 1 AS has_email, doc_id % 4 = 0 AS has_url FROM documents")
def parsed_signals(spark, d):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"urls":["u'), i, F.lit('"],"emails":["e1","e2"],"more":1}'))).when(k == 1, F.concat(F.lit('["email address","wire '), i, F.lit('"]'))).when(k == 2, F.lit("no json"))
    rows = table(spark, d, "documents").select("doc_id", signals.parse_signals(raw).alias("s"), signals.parse_names(raw).alias("names"))
    return rows.select("doc_id", F.size("s.urls").alias("n_urls"), signals.signal_count("s").alias("n_all"), comma(F.col("names")).alias("names"), signals.listed(F.col("names"), "email", "e-mail").alias("has_email"), signals.has("s", "urls").alias("has_url"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'ARRAY' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'STRING' WHEN 4 THEN 'ARRAY' ELSE 'none' END AS shape,
CASE WHEN doc_id % 6 IN (0, 2) THEN 'https://x.org/' || doc_id ELSE '' END AS urls, CASE WHEN doc_id % 6 IN (0, 2) THEN 2 ELSE 0 END AS n_all,
CASE doc_id % 6 WHEN 1 THEN 'wire transfer,7' WHEN 3 THEN 'phishing' WHEN 4 THEN 'gift card' ELSE '' END AS names FROM documents""")
def mixed_signals(spark, d):
    """One column with signals as objects, lists, words, and text that holds an object or a list, read from JSON lines."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    an_object = F.concat(F.lit('{"urls":["https://x.org/'), i, F.lit('"],"phones":[5551234],"emails":null,"more":{"a":1}}'))
    in_text = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    value = F.when(k == 0, an_object).when(k == 1, F.lit('["wire transfer",7,null]')).when(k == 2, in_text(an_object)).when(k == 3, F.lit('"phishing"')).when(k == 4, in_text(F.lit('["gift card"]'))).otherwise(F.lit("null"))
    lines = table(spark, d, "documents").select(F.concat(F.lit('{"doc_id":'), i, F.lit(',"fraud_signals":'), value, F.lit("}")).alias("line"))
    rows = lines.select(F.from_json("line", "doc_id long, fraud_signals variant").alias("r")).select("r.doc_id", signals.opened("r.fraud_signals").alias("v"))
    own = rows.select("doc_id", F.schema_of_variant("v").alias("kind"), signals.variant_signals("v").alias("s"), signals.variant_names("v").alias("names"))
    shape = F.coalesce(F.nullif(F.regexp_extract("kind", "^(OBJECT|ARRAY|STRING)", 1), F.lit("")), F.lit("none"))
    return own.select("doc_id", shape.alias("shape"), comma(F.col("s.urls")).alias("urls"), signals.signal_count("s").alias("n_all"), comma(F.col("names")).alias("names"))


# --- cleaning ----------------------------------------------------------------------------------------------------


def _space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def _stripped(x: str, kind: str) -> str:
    out = _space(x)
    for pattern, new in text.BOILERPLATE[kind]:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return _space(out)


_TAILS = {
    "bureau_news": ["Return to top and more. More from the FBI. All news", "Submit a Tip now", "see Contact Your Local FBI Office in town"],
    "complaint_center": ["Page 3 of 12 and 2023 Internet Crime Report text. Additional resources: many", "To file a complaint go to www.ic3.gov today", "If you have been victimized, write to ic3.gov soon", "This PSA is provided for informational purposes only"],
    "security_news": ["Advertisement here. Subscribe to our letter", "Related Articles:\nOne\nTwo", "You can follow us, BleepingComputer, there"],
}


@query("WITH t AS (SELECT doc_id, " + ", ".join(f"'Body  ' || doc_id || ' tells. ' || {_nth_sql(v, 'doc_id')} AS {k}" for k, v in _TAILS.items()) + " FROM documents) SELECT doc_id, " + ", ".join(f"{_stripped(k, k)} AS {k}" for k in _TAILS) + " FROM t")
def boilerplate_tails(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", *[text.strip_boilerplate(F.concat(F.lit("Body  "), i, F.lit(" tells. "), _nth(v, i)), k).alias(k) for k, v in _TAILS.items()])


@query("SELECT doc_id, 'a b c fine flow' || chr(10) || chr(10) || doc_id AS layout, 'The quick broken line ' || doc_id || ' ends. Next' AS page, 'Alert on thing ' || doc_id || ' rises today, end' AS document, 'tabs run' || chr(10) || 'on' AS blanks FROM documents")
def printed_cleaning(spark, d):
    i = F.col("doc_id").cast("string")
    layout = F.concat(F.lit("  a b­  \tc ﬁne ﬂow\n\n\n\n\n"), i, F.lit(" \n "))
    page = F.concat(F.lit("F I N C E N\nFIN-2020-A001\n12\nJanuary 5, 2024\nA B C D E\nThe quick bro-\nken line "), i, F.lit(" ends.\nNext\n  7  "))
    document = F.concat(F.lit("Cover, Notice: words Alert on thing "), i, F.lit(" rises12 today, ( ) one of ’s end"))
    return table(spark, d, "documents").select("doc_id", text.normalize_layout(layout).alias("layout"), text.clean_page(page).alias("page"), text.clean_document(document).alias("document"), text.collapse_blanks(F.lit(" tabs \t run\non ")).alias("blanks"))


@query("SELECT doc_id, md5(substring(text, 1, 1000)) AS short_md5, doc_id % 3 = 0 AS spanish, CASE WHEN doc_id % 2 = 0 THEN 'New York' ELSE 'National' END AS office, CASE doc_id % 4 WHEN 0 THEN 'FIN-2023-Alert00' || doc_id % 9 WHEN 1 THEN 'FIN-2021-A00' || doc_id % 9 WHEN 2 THEN 'FIN-2022-NTC' || doc_id % 9 END AS notice, 'T' || doc_id || ' ' || lang AS both, CASE doc_id % 4 WHEN 0 THEN 'https://h.org/a/b' WHEN 1 THEN 'https://h.org/d/rel' WHEN 2 THEN 'https://o.org/x' ELSE 'mailto:a' END AS absolute, CASE WHEN doc_id % 2 = 0 THEN '/f/' || doc_id || '.PDF?x' END AS pdf, 'doc_' || substring(sha1(concat_ws('#', source, '', CAST(doc_id AS VARCHAR))), 1, 14) AS made_id, CASE WHEN lang IS NULL THEN 'none' ELSE lang END AS first FROM documents")
def small_texts(spark, d):
    i, k = F.col("doc_id"), F.col("doc_id") % 4
    n = (i % 9).cast("string")
    number = F.when(k == 0, F.concat(F.lit("see FIN-2023-Alert00"), n)).when(k == 1, F.concat(F.lit("FIN-2021-A00"), n, F.lit(" and FIN-2020-A001")))
    link = F.when(k == 0, F.lit("/a/b")).when(k == 1, F.lit("rel")).when(k == 2, F.lit("//o.org/x")).otherwise(F.lit("mailto:a"))
    page = F.when(i % 2 == 0, F.concat(F.lit('<a href="/x.html">x</a> <a href="/f/'), i, F.lit('.PDF?x">y</a><a href="/z.pdf">'))).otherwise(F.lit("<p>none</p>"))
    title = F.when(i % 3 == 0, F.lit("Un aviso EN Español")).otherwise(F.lit("A notice"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text.shortened("text")).alias("short_md5"), text.looks_spanish(title).alias("spanish"), text.office_label(F.when(i % 2 == 0, F.lit("https://x/contact-us/field-offices/new-york/news/a")).otherwise(F.lit("https://x/news/a"))).alias("office"),
        text.notice_id(number, F.when(k == 2, F.concat(F.lit("anchor FIN-2022-NTC"), n))).alias("notice"), text.joined(F.concat(F.lit("T"), i), "lang").alias("both"), text.absolute_url(link, "https://h.org/d/page").alias("absolute"),
        html.first_pdf(page).alias("pdf"), text.fallback_id("source", F.lit(None).cast("string"), i.cast("string")).alias("made_id"), text.first_of(F.lit(""), F.col("lang"), F.lit("none")).alias("first"),
    )


# --- dates -------------------------------------------------------------------------------------------------------

_DAY = "CAST(o_orderdate AS DATE)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime({_DAY}, '%m/%d/%Y') END AS us, strftime({_DAY}, '%Y-%m-%d') AS fuzzy, 2000 + o_orderkey % 100 AS year_in, year({_DAY}) AS leading, strftime({_DAY}, '%Y-%m-%d') AS capture, CASE WHEN o_orderkey % 2 = 0 THEN 'April 1, ' || (year({_DAY}) + 1) ELSE 'May 2, 2020' END AS report, strftime({_DAY}, '%B %-d, %Y') AS page, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN strftime({_DAY}, '%Y-%m-%d') ELSE strftime({_DAY} + 1, '%Y-%m-%d') END AS coerced FROM orders")
def listing_dates(spark, d):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    long = F.date_format(day, "MMMM d, yyyy")
    form = F.when(k == 0, F.date_format(day, "MM/dd/yyyy")).when(k == 1, long).when(k == 2, F.date_format(day, "MMM d, yyyy")).when(k == 3, day.cast("string")).otherwise(F.lit("soon"))
    fuzzy = F.when(k == 0, F.concat(F.lit("Posted "), long, F.lit(" by staff"))).when(k == 1, F.concat(F.lit("on "), F.date_format(day, "M/d/yyyy"))).otherwise(F.concat(F.lit("at "), day.cast("string"), F.lit("T10:00")))
    m = F.col("o_orderkey") % 3
    mixed = F.when(m == 0, F.lit("no date")).when(m == 1, F.unix_timestamp(day.cast("timestamp")).cast("string")).otherwise((F.unix_timestamp(F.date_add(day, 1).cast("timestamp")) * 1000).cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", dates.us_date(form).alias("us"), dates.fuzzy_date(fuzzy).alias("fuzzy"), dates.year_in(F.concat(F.lit("No. 1999, in "), 2000 + F.col("o_orderkey") % 100)).alias("year_in"), dates.leading_year(F.concat(F.lit("y"), F.year(day), F.lit("2031"))).alias("leading"),
        F.date_format(dates.capture_date(F.date_format(day, "yyyyMMdd'120000'")), "yyyy-MM-dd").alias("capture"), dates.report_date(F.when(F.col("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("May 2, 2020")), F.concat(F.lit("Unit - Annual Report "), F.year(day))).alias("report"),
        dates.page_date(F.concat(F.lit("01/01/1990 text "), long, F.lit(" and May 1, 1991"))).alias("page"), F.date_format(dates.coerce_date(mixed), "yyyy-MM-dd").alias("coerced"),
    )


#: Forms of a date in running text: what stands before it, its pattern, what stands after it. The last are none.
_DATE_FORMS = (
    ("", "yyyy-MM-dd", ""), ("at ", "yyyy-MM-dd", "T10:00:00Z"), ("", "yyyy/MM/dd", ""), ("v ", "yyyy.MM.dd", " build"), ("seen ", "yyyyMMdd", "."), ("", "yyyy-M-d", ""),
    ("", "MMMM d, yyyy", ""), ("Posted ", "MMMM d, yyyy", " by staff"), ("", "MMM d, yyyy", " 03:15 PM"), ("on ", "MMM d yyyy", ""), ("(", "MMM. d, yyyy", ")"), ("", "MMMM d'th', yyyy", ""), ("Sat, ", "MMMM  d , yyyy", ""),
    ("", "d MMMM yyyy", ""), ("", "d MMMM yyyy", " 10:00"), ("Fri, ", "d MMM yyyy", " 07:00:00 GMT"), ("the ", "d'rd of' MMMM yyyy", ""), ("", "d'st' MMM, yyyy", ""), ("", "dd-MMM-yyyy", ""), ("", "d MMM. yyyy", ""), ("it was the ", "d'th of the' MMMM, yyyy", "!"),
    ("", "MM/dd/yyyy", ""), ("by ", "M/d/yyyy", ", at noon"), ("", "MM-dd-yyyy", ""), ("x: ", "M.d.yyyy", ""), ("", "MM/dd/yy", ""), ("2020-13-45 or 99/99/2020, then ", "yyyy-MM-dd", " and May 1, 1991"), ("call 212-555-0100 ", "d MMM yyyy", ""),
    ("Maybe ", "'no date in' yyyy", ""), ("id a1", "yyyyMMdd", "0"),
)
_NO_DATE = 2


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_DATE_FORMS)} < {len(_DATE_FORMS) - _NO_DATE} THEN strftime({_DAY}, '%Y-%m-%d') ELSE '' END AS found FROM orders")
def dates_in_texts(spark, d):
    """Thirty forms of a date, each somewhere in a text; of two dates the first counts, and what is none is passed over."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % len(_DATE_FORMS)
    forms = [F.concat(F.lit(before), F.date_format(day, pattern), F.lit(after)) for before, pattern, after in _DATE_FORMS]
    year = F.year(day)
    # A year of two figures is read as one of this century: the century is put back for the comparison.
    text_of = F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)])
    found = dates.fuzzy_date(text_of)
    two = [i for i, f in enumerate(_DATE_FORMS) if f[1] == "MM/dd/yy"][0]
    found = F.when((k == two) & (year < 2000), F.date_format(F.add_months(F.to_date(found), -1200), "yyyy-MM-dd")).otherwise(found)
    return table(spark, d, "orders").select("o_orderkey", found.alias("found"))


@query(f"WITH o AS (SELECT o_orderkey, {_DAY} AS d FROM orders) SELECT o_orderkey, strftime(CAST(date_trunc('week', d) AS DATE) + 6, '%d %b %y') AS label_W, strftime(last_day(d), '%b %y') AS label_M, 'Q' || quarter(d) || ' ' || year(d) AS label_Q, CAST(year(d) AS VARCHAR) AS label_Y FROM o")
def period_labels(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", *[dates.period_label(dates.period_end(day, i), i).alias(f"label_{i}") for i in "WMQY"])


# --- pages -------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, 'first ' || doc_id || chr(10) || chr(10) || 'second' AS full_text, 3 AS page_count, 1 AS ocr_pages, length(trim(coalesce(text, ''))) < 80 OR length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) / greatest(length(coalesce(text, '')), 1) < 0.45 AS wants_ocr FROM documents")
def page_assembly(spark, d):
    page = lambda n, method, t: F.struct(F.lit(n).alias("page_num"), F.lit(method).alias("method"), t.alias("text"))
    rows = table(spark, d, "documents").withColumn("pages", F.array(page(2, "ocr", F.lit("second")), page(3, "native", F.lit("  ")), page(1, "native", F.concat(F.lit("first "), F.col("doc_id")))))
    return chunks.assemble_pages(rows).select("doc_id", "full_text", "page_count", "ocr_pages", text.needs_ocr("text").alias("wants_ocr"))


@query(r"SELECT doc_id, 'Notice: of thing ' || doc_id || ' first' || repeat(' word', 20) || '. Broken line.' AS clean, 2 AS page_count, 1 AS ocr_pages, '2' AS wanted, 'native_plus_ocr_fallback' AS method, NULL AS error FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '', 0, 0, '', 'failed', 'ValueError: torn file' FROM documents WHERE doc_id % 2 = 1")
def printed_files(spark, d):
    """Even files have two pages, the second too thin for its own text; odd ones can't be read."""
    i = F.col("doc_id")
    content = F.when(i % 2 == 0, F.concat(F.lit("Cover. Notice: of thing "), i, F.lit(" first" + " word" * 20 + ".\fx")))
    files = table(spark, d, "documents").select("doc_id", F.encode(content, "utf-8").alias("content"))

    def extract(data: bytes) -> list[str]:
        if not data:
            raise ValueError("torn file")
        return printed.form_feeds(data)

    out = printed.full_text(printed.with_pages(files, extract, lambda data, place: "Bro-\nken line."))
    return out.select("doc_id", F.regexp_replace("full_text_clean", r"\s+", " ").alias("clean"), "page_count", "ocr_pages", comma(F.transform("ocr_wanted", lambda x: x.cast("string"))).alias("wanted"), F.col("extraction_method").alias("method"), "error")
