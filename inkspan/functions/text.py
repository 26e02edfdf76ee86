"""Text cleaning, identity and label expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_space(x: Column | str) -> Column:
    """Runs of Unicode white space become one space, ends are bare; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?U)\s+", " "))


def collapse_blanks(x: Column | str) -> Column:
    """Only spaces and tabs run together; line ends stay."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"[ \t]+", " "))


def replace_all(x: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        x = F.regexp_replace(x, pattern, new)
    return x


# What each kind of source appends to or prints into its texts.
BOILERPLATE = {
    "agency_blog": [(r"(?i)Comments closed\..*$", ""), (r"(?i)Return to top$", ""), (r"(?i)Topics\s+.*$", ""), (r"(?i)Return to top", "")],
    "bureau_news": [(r"(?i)More from the FBI\..*$", ""), (r"(?i)Contact Your Local FBI Office.*$", ""), (r"(?i)Submit a Tip.*$", ""), (r"(?i)Return to top", "")],
    "complaint_center": [
        (r"(?i)The IC3 accepts online Internet crime complaints.*$", ""), (r"(?i)If you have been victimized.*?ic3\.gov.*?$", ""),
        (r"(?i)This PSA is provided for informational purposes.*$", ""), (r"(?i)To file a complaint.*ic3\.gov.*$", ""), (r"(?i)Additional resources.*$", ""),
        (r"(?i)\bPage \d+ of \d+\b", ""), (r"(?i)\b20\d{2} Internet Crime Report\b", ""),
    ],
    "security_news": [(r"(?is)Related Articles.*$", ""), (r"(?i)Subscribe to our.*$", ""), (r"(?i)\bAdvertisement\b.*$", ""), (r"(?i)You can follow.*BleepingComputer.*$", "")],
}


def strip_boilerplate(x: Column | str, kind: str) -> Column:
    return normalize_space(replace_all(normalize_space(x), BOILERPLATE[kind]))


def normalize_layout(x: Column | str) -> Column:
    """No-break spaces, soft hyphens and ligatures go; blanks run together; at most one empty line in a row."""
    plain = F.replace(F.replace(F.translate(F.coalesce(_col(x), F.lit("")), "\u00a0\u00ad", " "), F.lit("\ufb01"), F.lit("fi")), F.lit("\ufb02"), F.lit("fl"))
    return F.regexp_replace(replace_all(plain, [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]), r"^\s+|\s+$", "")


# Running heads and lines of printed notices.
PAGE_STEPS = [
    (r"(?i)\bF\s*I\s*N\s*C\s*E\s*N\b", " "), (r"(?i)\bFINCEN\s+(ALERT|ADVISORY|NOTICE)\b", " "), (r"\b(?:[A-Z]\s+){3,}[A-Z]\b", " "),
    (r"(?m)^\s*\d+\s*$", " "), (r"(?m)^\s*FIN-\d{4}-(?:A\d+|Alert\d+|NTC\d+)\s*$", " "), (r"(?m)^\s*[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\s*$", " "),
    (r"(?<!\n)\n(?!\n)", " "), (r"(\w)-\s+(\w)", "$1$2"), (r"\s+", " "),
]
TITLE_MARKERS = ("Alert on ", "Advisory on ", "Notice on ", "Alert:", "Advisory:", "Notice:")
DOCUMENT_STEPS = [
    (r"(?i)Suspicious Activity Report\s*\(SAR\)\s*Filing Request:.*?(?=Treasury.?s 2024 National Money Laundering Risk Assessment|Overview of|$)", " "),
    (r"([A-Za-z])(\d{1,2})\b", "$1"), (r"(?i)\b\d+\.\s*See\b.*?(?=(Alert on|Advisory on|Notice on|Overview of|$))", " "), (r"(?i)\b\d+\.\s*Id\.\b", " "),
    (r"\(\s*\)", " "), (r"(?i)\bone of\s+[’']s\b", " "), (r"\bFinancial Crimes Enforcement Network\s*\(\s*\)", "Financial Crimes Enforcement Network"), (r"\s+", " "),
]


def clean_page(x: Column | str) -> Column:
    return F.trim(replace_all(normalize_layout(x), PAGE_STEPS))


def from_title(x: Column, markers: tuple[str, ...] = TITLE_MARKERS, within: int = 4000) -> Column:
    """The text from its first marker on, taking markers in order of rank, if one begins within so many characters."""
    at = F.coalesce(*[F.when(F.locate(m, x).between(1, within), F.locate(m, x)) for m in markers], F.lit(1))
    return F.substring(x, at, F.length(x))


def clean_document(x: Column | str) -> Column:
    return F.trim(replace_all(from_title(normalize_layout(x)), DOCUMENT_STEPS))


def drop_reference_numbers(x: Column | str) -> Column:
    """One- or two-digit notes glued to a word or mark go; white space collapses."""
    return normalize_space(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?<=[A-Za-z.,)])\d{1,2}\b", ""))


def shortened(x: Column | str, size: int = 1000) -> Column:
    return F.substring(_col(x), 1, size)


def title_case(x: Column | str) -> Column:
    """Capitals after spaces, underscores and hyphens alike."""
    words = F.initcap(F.lower(_col(x)))
    for mark in ("_", "-"):
        words = F.array_join(F.transform(F.split(words, mark), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), mark)
    return words


def occurrences(x: Column | str, word: str) -> Column:
    """How often a string occurs, without overlap."""
    x = _col(x)
    return ((F.length(x) - F.length(F.replace(x, F.lit(word), F.lit("")))) / len(word)).cast("int")


def looks_spanish(x: Column | str) -> Column:
    return F.coalesce(_col(x).rlike(r"(?iU)\bAviso\b|spanish|espanol|español"), F.lit(False))


def first_of(*candidates: Column) -> Column:
    """The first candidate that isn't null or empty, in order."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def office_label(url: Column | str, default: str = "National") -> Column:
    """The office that a press release's path names."""
    name = F.nullif(F.regexp_extract(_col(url), r"field-offices/([^/]+)", 1), F.lit(""))
    return F.coalesce(F.initcap(F.replace(name, F.lit("-"), F.lit(" "))), F.lit(default))


def notice_id(*texts: Column) -> Column:
    """The first notice number (advisory, alert, notice) in any of the texts, in order."""
    return first_of(*[F.regexp_extract(t, r"(?i)(FIN-\d{4}-(?:A\d+|Alert\d+|NTC\d*|CTA\d*))", 1) for t in texts])


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(_col(p), F.lit("")) for p in parts])


def absolute_url(href: Column | str, base: str) -> Column:
    href = _col(href)
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(base.split("//")[0]), href)).when(href.startswith("/"), F.concat(F.lit("/".join(base.split("/")[:3])), href)).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), href))


def tidy_url(url: Column | str) -> Column:
    """With a scheme, without closing slashes."""
    bare = F.rtrim(_col(url), F.lit("/"))
    return F.when(bare.rlike(r"^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def stable_id(url: Column | str) -> Column:
    return F.substring(F.sha1(F.encode(_col(url), "utf-8")), 1, 14)


def fallback_id(*parts: Column | str) -> Column:
    """For rows without an id: of what they hold, not of where they stand."""
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat_ws("#", *[F.coalesce(_col(p), F.lit("")) for p in parts])), 1, 14))


def needs_ocr(page: Column | str) -> Column:
    """Whether a page has too little text, or too few letters, to be its own text."""
    page = F.coalesce(_col(page), F.lit(""))
    letters = F.length(F.regexp_replace(page, r"[^\p{L}]", ""))
    return (F.length(F.trim(page)) < 80) | (letters / F.greatest(F.length(page), F.lit(1)) < 0.45)


def literal_list(x: Column | str) -> Column:
    """A list that was printed as text, with either kind of quotes; null if it is none."""
    x = _col(x)
    return F.coalesce(F.from_json(x, "array<string>"), F.from_json(F.translate(x, "'", '"'), "array<string>"))
