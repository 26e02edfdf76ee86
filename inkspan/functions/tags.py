"""Tagging expressions: a taxonomy folded into one projection, no dictionary join and no Python per row."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionary import AUTOMATON_CHARS, families_of, fits, keyword_rows, matcher
from .taxonomy import DEFAULT, OTHER, Taxonomy
from .text import occurrences


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_pattern(words: tuple[str, ...]) -> str:
    """Any of the words, bounded by what is no letter, digit or underscore in any script.

    Written out, as engines differ on what a word boundary is beside an accented letter.
    """
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words) + r")([^\p{L}\p{N}_]|$)"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _or_other(found: Column, fallback: bool) -> Column:
    return bound(found, lambda x: F.when(F.size(x) == 0, F.array(F.lit(OTHER))).otherwise(x)) if fallback else found


def _present(tests: list[tuple[str, Column]], ordered: bool) -> Column:
    found = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests]), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(found)) if ordered else found


def pattern_tags(text: Column | str, taxonomy: Taxonomy = DEFAULT, fallback: bool = True, ordered: bool = True) -> Column:
    """Families with a whole word in the text, sorted, else ['other']; unordered, as the taxonomy lists them."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return _or_other(_present([(f, low.rlike(word_pattern(ws))) for f, ws in taxonomy.patterns.items()], ordered), fallback)


def keyword_tags(text: Column | str, taxonomy: Taxonomy = DEFAULT, fallback: bool = True) -> Column:
    """Families with a keyword anywhere in the text, inside words too; sorted."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    tests = []
    for family, words in taxonomy.keywords.items():
        test = low.contains(words[0].lower())
        for w in words[1:]:
            test = test | low.contains(w.lower())
        tests.append((family, test))
    return _or_other(_present(tests, True), fallback)


def keyword_signals(text: Column | str, taxonomy: Taxonomy = DEFAULT) -> Column:
    """The signal keywords themselves that the text holds, sorted."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return _present([(k, low.contains(k)) for k, _ in taxonomy.signal_rows()], True)


def _letters(n: int, place: Column) -> Column:
    return F.substring("_low", place, F.lit(n))


def tagged_by_table(df: DataFrame, text: str, key: str, dictionary: DataFrame, fallback: bool = True, most: int = AUTOMATON_CHARS) -> DataFrame:
    """keyword_tags with the dictionary (keyword, family) as a table; for dictionaries that users keep as data.

    Up to ``most`` characters of keywords one automaton reads each text once, and no text is shuffled. A dictionary
    beyond that is joined (``_tagged_by_join``), with the same tags; it alone needs ``key``.
    """
    rows = keyword_rows(dictionary)
    if not fits(rows, most):
        return _tagged_by_join(df, text, key, rows, fallback)
    return df.withColumn("fraud_tags", _or_other(families_of(matcher(rows, most)(text)), fallback))


def _tagged_by_join(df: DataFrame, text: str, key: str, rows: DataFrame, fallback: bool) -> DataFrame:
    """Texts and keywords meet by the first one, two or three letters that a keyword has: only keys and those letters
    go through the join, and the candidates of a row are verified by its text. Rows of one key, or of none, are told
    apart by their text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    marked = df.withColumns({"_low": low, "_at": F.xxhash64(low)})
    places = F.sequence(F.lit(1), F.length("_low"))
    letters = [F.transform(places, partial(_letters, n)) for n in (1, 2, 3)]
    grams = marked.where("_low <> ''").select(key, "_at", F.explode(F.array_distinct(F.concat(*letters))).alias("_gram"))
    met = grams.join(rows.withColumn("_gram", F.substring("keyword", 1, 3)), "_gram")
    found = met.groupBy(F.col(key).alias("_key"), F.col("_at").alias("_of")).agg(F.collect_set(F.struct("keyword", "family")).alias("_found"))
    joined = marked.join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_of")), "left")
    own = F.filter(F.coalesce("_found", F.array().cast("array<struct<keyword:string,family:string>>")), lambda x: F.col("_low").contains(x["keyword"]))
    tags = F.sort_array(F.array_distinct(F.transform(own, lambda x: x["family"])))
    return joined.withColumn("fraud_tags", _or_other(tags, fallback)).select(*df.columns, "fraud_tags")


def severest_tag(tags: Column | str, taxonomy: Taxonomy = DEFAULT) -> Column:
    """The tag of the best severity rank; unknown tags rank last, the first of equals wins, no tags are 'other'."""
    rank = F.create_map(*[x for i, t in enumerate(taxonomy.severity) for x in (F.lit(t), F.lit(i))])
    ranked = F.transform(_col(tags), lambda t, i: F.struct(F.coalesce(F.try_element_at(rank, t), F.lit(len(taxonomy.severity))).alias("r"), i.alias("i"), t.alias("t")))
    return F.coalesce(F.array_min(ranked)["t"], F.lit(OTHER))


def primary_tag(text: Column | str, tags: Column | str, taxonomy: Taxonomy = DEFAULT) -> Column:
    """The tag whose keywords the text holds most often; ties by the taxonomy's priority, then by name.

    Only the row's own tags count, 'other' doesn't; nested keywords count each; without a tag it is 'other'.
    """
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    scored = []
    families, counted = list(dict.fromkeys([*taxonomy.keywords, *taxonomy.patterns])), taxonomy.counted()
    for family in sorted(families):
        hits = F.lit(0)
        for word in counted.get(family, ()):
            hits = hits + occurrences(low, word)
        place = taxonomy.priority.index(family) if family in taxonomy.priority else 99
        # The first of equals by name: array_max takes the largest, so names count down.
        scored.append(F.when(F.array_contains(_col(tags), family), F.struct(hits.alias("hits"), F.lit(-place).alias("place"), F.lit(-sorted(families).index(family)).alias("order"), F.lit(family).alias("family"))))
    known = F.array_max(F.array(*scored))["family"]
    unknown = F.array_min(F.array_except(_col(tags), F.array(F.lit(OTHER))))
    return F.coalesce(known, unknown, F.lit(OTHER))


def normalize_tags(tags: Column | str) -> Column:
    """Blank and null tags go, others are trimmed; nothing left is ['other']."""
    clean = F.filter(F.transform(_col(tags), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.coalesce(F.size(clean), F.lit(0)) <= 0, F.array(F.lit(OTHER))).otherwise(clean)


def parse_tags(text: Column | str) -> Column:
    """normalize_tags of lists that arrive as text: JSON or printed lists, nested ones flattened, or one bare tag."""
    x = F.trim(_col(text))
    marked = F.translate(x, "'", '"')
    nested = F.when(x.rlike(r"^\[\s*\["), F.flatten(F.from_json(marked, "array<array<string>>")))
    flat = F.when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.from_json(marked, "array<string>")))
    return normalize_tags(F.coalesce(nested, flat, F.when(x != "", F.array(x))))


def type_as_tags(tags: Column | str, legacy: Column | str) -> Column:
    """Tags, else a single legacy type as the one tag, else none."""
    return F.coalesce(_col(tags), F.when(_col(legacy).isNotNull(), F.array(_col(legacy))), F.array().cast("array<string>"))
