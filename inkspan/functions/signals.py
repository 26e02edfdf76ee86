"""Indicators in texts: URLs, domains, e-mail addresses, phone numbers, IPv4 addresses, wallets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("urls", "domains", "emails", "phones", "ip_addresses", "crypto_wallets")

# What an indicator looks like.
URL = r"(?i)\bhttps?://[^\s)>\]]+"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:(?:\+?1[\s\-\.])?)(?:\(?\d{3}\)?[\s\-\.]?)\d{3}[\s\-\.]?\d{4}\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b"
BTC = r"\b(bc1[0-9a-z]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
ETH = r"\b0x[a-fA-F0-9]{40}\b"

# Combinations whose joint presence is counted.
COMPOUNDS = (("url", "email"), ("url", "phone"), ("url", "crypto"), ("email", "phone"), ("email", "crypto"), ("phone", "crypto"), ("url", "email", "phone"), ("url", "email", "crypto"))
FLAGS = {"has_url": "urls", "has_email": "emails", "has_phone": "phones", "has_ip": "ip_addresses", "has_crypto": "crypto_wallets"}


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def _unique(x: Column) -> Column:
    return F.sort_array(F.array_distinct(x))


def urls(text: Column | str) -> Column:
    return _unique(_all(_text(text), URL))


def domains(text: Column | str) -> Column:
    """The authority of each URL, lower-cased, with user and port if it has them."""
    found = F.transform(_all(_text(text), URL), lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#]*)", 1)))
    return _unique(F.filter(found, lambda d: d != ""))


def emails(text: Column | str) -> Column:
    return _unique(F.transform(_all(_text(text), EMAIL), lambda e: F.lower(e)))


def phones(text: Column | str) -> Column:
    return _unique(F.transform(_all(_text(text), PHONE), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))))


def ip_addresses(text: Column | str) -> Column:
    return _unique(_all(_text(text), IP))


def crypto_wallets(text: Column | str) -> Column:
    return _unique(F.concat(_all(_text(text), BTC, 1), _all(_text(text), ETH)))


def indicators(text: Column | str) -> Column:
    """All six kinds as one struct of sorted, unique lists."""
    return F.struct(urls(text).alias("urls"), domains(text).alias("domains"), emails(text).alias("emails"), phones(text).alias("phones"), ip_addresses(text).alias("ip_addresses"), crypto_wallets(text).alias("crypto_wallets"))


def has(signals: Column | str, field: str) -> Column:
    own = (F.col(signals) if isinstance(signals, str) else signals)[field]
    return F.coalesce(F.size(own) > 0, F.lit(False))


def listed(names: Column, *keys: str) -> Column:
    """For signals that are a plain list of names: whether one of the keys occurs in them."""
    whole = F.array_join(names, " ")
    return F.coalesce(reduce(lambda a, b: a | b, [whole.contains(k) for k in keys]), F.lit(False))


def signal_count(signals: Column | str) -> Column:
    own = F.col(signals) if isinstance(signals, str) else signals
    return reduce(lambda a, b: a + b, [F.greatest(F.coalesce(F.size(own[f]), F.lit(0)), F.lit(0)) for f in FIELDS])


def parse_signals(text: Column | str) -> Column:
    """Indicators from text that holds an object of lists; a list, or what is no JSON, gives empty indicators.

    Lists of names are keyword signals: parse_names reads those.
    """
    own = F.from_json(F.col(text) if isinstance(text, str) else text, "struct<" + ", ".join(f"{f}:array<string>" for f in FIELDS) + ">")
    return F.struct(*[F.coalesce(own[f], F.array().cast("array<string>")).alias(f) for f in FIELDS])


def parse_names(text: Column | str) -> Column:
    return F.coalesce(F.from_json(F.col(text) if isinstance(text, str) else text, "array<string>"), F.array().cast("array<string>"))


def opened(value: Column | str) -> Column:
    """Signals as a VARIANT, whatever their shape: JSON text is read, also where a JSON string holds it; a word that is
    no JSON stays a string. A null, blank or unreadable value is null."""
    v = F.col(value) if isinstance(value, str) else value
    word = F.try_variant_get(v, "$", "string")
    inner = F.try_parse_json(F.nullif(F.trim(word), F.lit("")))
    is_word = F.schema_of_variant(v) == "STRING"
    return F.when(is_word & inner.isNotNull(), inner).when(~(is_word & (F.trim(word) == "")), v)


def from_text(text: Column | str) -> Column:
    """The VARIANT of a text column, for ``opened``: its JSON or, where it is none, the text as a JSON string."""
    x = F.col(text) if isinstance(text, str) else text
    as_string = F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(F.when(F.trim(x) != "", as_string)))


def variant_signals(opened_value: Column | str) -> Column:
    """Indicators of an ``opened`` value that is an object of lists; of any other shape they are empty."""
    v = F.col(opened_value) if isinstance(opened_value, str) else opened_value
    empty = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(F.filter(F.try_variant_get(v, f"$.{f}", "array<string>"), lambda x: x.isNotNull()), empty).alias(f) for f in FIELDS])


def variant_names(opened_value: Column | str) -> Column:
    """Keyword signals of an ``opened`` value that is a list, or a single word; an object has none."""
    v = F.col(opened_value) if isinstance(opened_value, str) else opened_value
    names = F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull())
    word = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    return F.coalesce(names, word, F.array().cast("array<string>"))
