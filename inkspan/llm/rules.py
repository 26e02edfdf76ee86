"""Quality rules: statistics of a text and a learned decision list over them, all in DataFrame functions.

The statistics are columns; a bounded sample of labelled statistics goes to the driver, where sequential covering
grows conjunctions of thresholds on two thirds of it and prunes them on the rest. The list that comes out is one
ordered ``CASE WHEN`` expression, so judging a corpus needs neither Python nor a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, one_text_each, pick, table

#: Labelled rows that a decision list is learned from, at most.
SAMPLE_ROWS = 20_000
#: Bits of a window's sort key that hold its place; where they or the rest don't do, whole hashes are sorted.
_PLACE = 24

#: The ratios that conditions speak of, by name: SQL over the statistics.
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "words": "double(n_words)",
}


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_upper.

    Null and empty texts have no words and all counts 0. Columns of these names that the table had are replaced.
    Words are hashed once, and windows are made of those hashes, so words aren't carried from one step to the next.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({
        "_words": words,
        "_lines": lines,
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_words": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_lines")
    window = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_keys", F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(F.slice(window, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(1)))))
    return _with_repeats(out).drop("_words", "_keys")


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside a 3-word window that the text holds twice or more.

    Only texts with equal windows are looked into. A text's windows are sorted as numbers whose high bits are the low
    bits of the hash and whose low bits the place, so equal windows are neighbours. Where that cut of the hash makes
    two of the text's windows one, or places don't fit, windows are sorted by their words' whole hashes instead.
    """
    low = (1 << _PLACE) - 1
    short = F.transform("_keys", lambda h: F.shiftleft(h, _PLACE))
    kinds = F.size(F.array_distinct("_keys"))
    some = kinds < F.size("_keys")
    told_apart = (F.size("_keys") <= low) & (F.size(F.array_distinct(short)) == kinds)
    narrow = F.transform("_keys", lambda h, i: F.shiftleft(h, _PLACE).bitwiseOR(i.cast("long")))
    full = F.transform("_keys", lambda h, i: F.struct(F.get("_words", i).alias("a"), F.get("_words", i + 1).alias("b"), F.get("_words", i + 2).alias("c"), i.alias("i")))
    df = df.withColumns({"_sorted": F.when(some & told_apart, F.sort_array(narrow)), "_wide": F.when(some & ~told_apart, F.sort_array(full))})

    def place(v: Column) -> Column:
        return v.bitwiseAND(F.lit(low)).cast("int")

    def twin(v: Column, other: Column) -> Column:
        return F.coalesce(F.shiftright(v, _PLACE) == F.shiftright(other, _PLACE), F.lit(False))

    def same(v: Column, other: Column) -> Column:
        return F.coalesce((v["a"] == other["a"]) & (v["b"] == other["b"]) & (v["c"] == other["c"]), F.lit(False))

    found = F.filter("_sorted", lambda v, i: twin(v, F.get("_sorted", i - 1)) | twin(v, F.get("_sorted", i + 1)))
    wide = F.filter("_wide", lambda v, i: same(v, F.get("_wide", i - 1)) | same(v, F.get("_wide", i + 1)))
    df = df.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.transform(found, place)).when(F.col("_wide").isNotNull(), F.transform(wide, lambda v: v["i"])))
    near = F.concat("_places", F.transform("_places", lambda p: p + 1), F.transform("_places", lambda p: p + 2))
    return df.withColumn("n_repeat_words", F.when(F.col("_places").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(near))).cast("long")).drop("_sorted", "_wide", "_places")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else at most the threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int  # of the sample's rows that it was the first to cover
    good: int

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _best(rows: list[tuple[dict, int]], cuts: int) -> Condition | None:
    """The condition of the largest information gain towards label 0."""
    bad = sum(not y for _, y in rows)
    if not bad or bad == len(rows):
        return None
    base, best, gain = math.log2(bad / len(rows)), None, 0.0
    for name in FEATURES:
        ordered = sorted((r[name], y) for r, y in rows)
        step, p, n = max(1, len(ordered) // cuts), 0, 0
        for i, (value, y) in enumerate(ordered[:-1]):
            p, n = p + (not y), n + (y != 0)
            if value == ordered[i + 1][0] or not (i % step == 0 or y != ordered[i + 1][1]):
                continue
            middle = (value + ordered[i + 1][0]) / 2
            for above, pos, neg in ((False, p, n), (True, bad - p, len(rows) - bad - n)):
                if pos and (g := pos * (math.log2(pos / (pos + neg)) - base)) > gain + 1e-12:
                    best, gain = Condition(name, above, middle), g
    return best


def learn(rows: list[tuple[dict, int]], precision: float = 0.98, least: int = 5, longest: int = 4, cuts: int = 64) -> list[Rule]:
    """Sequential covering: rules for label 0 in the order found; each covers ``least`` rows that earlier ones left,
    at this precision on the growing and on the pruning rows. No rows, or one label only: no rules."""
    grow, prune = [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while True:
        inside, conditions = grow, []
        while len(conditions) < longest and (c := _best(inside, cuts)) is not None:
            conditions.append(c)
            inside = [x for x in inside if c.holds(x[0])]
        if not conditions:
            return rules

        def worth(cs: list[Condition]) -> float:
            covered = [y for r, y in prune if all(c.holds(r) for c in cs)]
            return (sum(1 - 2 * bool(y) for y in covered) / len(covered)) if covered else -1.0

        def covers(cs: list[Condition]) -> tuple[int, int]:
            covered = [y for r, y in grow + prune if all(c.holds(r) for c in cs)]
            return sum(not y for y in covered), len(covered)

        grown = list(conditions)
        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        bad, size = covers(conditions)
        if size and bad / size < precision:  # pruned too far
            conditions, (bad, size) = grown, covers(grown)
        if bad < least or bad / size < precision:
            return rules
        rules.append(Rule(tuple(conditions), bad, size - bad))
        grow, prune = [x for x in grow if not rules[-1].holds(x[0])], [x for x in prune if not rules[-1].holds(x[0])]


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most about ``rows`` labelled documents outside the held-out fifth (crc32 of the id modulo 5)."""
    sample = labelled_sample(labels, "quality", rows)
    marked = one_text_each(pick(documents, "doc_id", "text").join(F.broadcast(sample), "doc_id"))
    found = with_stats(marked).selectExpr("doc_id", "label", *[f"cast({sql} as double) as {name}" for name, sql in FEATURES.items()])
    data = sorted(found.collect(), key=lambda r: (r["doc_id"], *[r[k] for k in FEATURES]))
    return learn([({k: r[k] for k in FEATURES}, r["label"]) for r in data])


def rule_column(rules: list[Rule]) -> Column:
    """The text of the first rule that rejects a row, else null: one ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].column(), F.lit(str(rules[0])))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(str(rule)))
    return out


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds the statistics, base_failed, rejected_by (null: no rule) and kept.

    The partition's number, never negative, keeps a filter on ``kept`` above the projections: pushed below them it
    would compute every statistic again for each use of it.
    """
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return with_stats(df).withColumns({"base_failed": base, "rejected_by": rule_column(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull() & (F.spark_partition_id() >= 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by learned rules. Null texts have no words and fail the base limits, as do empty ones; rows of one
    id are judged each by itself."""
    documents = table(spark, sf_dir, "documents")
    rules = fit(documents, table(spark, sf_dir, "labels"))
    out = judge(pick(documents, "doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
