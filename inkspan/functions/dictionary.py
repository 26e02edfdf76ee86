"""Dictionaries kept as data: an Aho-Corasick automaton of all keywords, run once over each text.

The automaton is built in each Python worker from the dictionary's rows, which are broadcast up to a checked number of
characters; texts stay where they are, and only they go to Python. What comes back for a text are its families, each
with the number of hits and the place of the first.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import arrow_batches

#: Characters of all keywords that one automaton may have. A worker needs about 30 bytes for each, so half a GB.
AUTOMATON_CHARS = 1 << 24
HITS = "array<struct<family:string,hits:int,place:int>>"
_HITS = pa.list_(pa.struct([("family", pa.string()), ("hits", pa.int32()), ("place", pa.int32())]))
#: The automaton that this worker made last, by the dictionary's name.
_made: dict[str, Matcher] = {}


class Matcher:
    """Keywords with the families that have them."""

    def __init__(self, keywords: list[str], families: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths: list[int] = []
        self.families: list[tuple[str, ...]] = []
        for keyword, family in zip(keywords, families):
            at = self.automaton.get(keyword, -1)
            if at < 0:
                self.automaton.add_word(keyword, len(self.lengths))
                self.lengths.append(len(keyword))
                self.families.append((family,))
            else:
                self.families[at] += (family,)
        if self.lengths:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[dict[str, object]]:
        """Families by name. A keyword's hits don't overlap, the leftmost first, those of different keywords may; the
        place is that of the first character, counted from 1."""
        found: dict[str, list[int]] = {}
        free: dict[int, int] = {}
        for end, i in self.automaton.iter(text) if self.lengths else ():
            start = end - self.lengths[i] + 1
            if start >= free.get(i, 0):
                free[i] = end + 1
                for family in self.families[i]:
                    own = found.setdefault(family, [0, start])
                    own[0] += 1
                    own[1] = min(own[1], start)
        return [{"family": f, "hits": n, "place": at + 1} for f, (n, at) in sorted(found.items())]


def keyword_rows(dictionary: DataFrame) -> DataFrame:
    """(keyword, family) in lower case, each pair once; empty or null ones are none."""
    return dictionary.select(F.lower("keyword").alias("keyword"), "family").where("keyword <> '' and family is not null").distinct()


def fits(rows: DataFrame, most: int = AUTOMATON_CHARS) -> bool:
    """Whether keywords are few enough for an automaton: a sum over the dictionary, which is what gets broadcast."""
    return (rows.agg(F.sum(F.length("keyword"))).first()[0] or 0) <= most


def matcher(rows: DataFrame, most: int = AUTOMATON_CHARS):
    """A function from a text column to its ``HITS``, by the automaton of ``keyword_rows``; null texts have none.

    Texts are lowered as Spark does it, so places are those in the lowered text. They go to Python a few MB at a time.
    """
    arrow_batches(rows.sparkSession)
    if not fits(rows, most):
        raise ValueError(f"the dictionary has more than {most} characters; use tags.tagged_by_table, which joins it")
    table, sink = rows.select("keyword", "family").toArrow(), io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared, name = rows.sparkSession.sparkContext.broadcast(sink.getvalue()), uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _made:
            _made.clear()
            own = pa.ipc.open_stream(shared.value).read_all()
            _made[name] = Matcher(own["keyword"].to_pylist(), own["family"].to_pylist())
        hits = _made[name].hits
        for texts in batches:
            yield pa.array([hits(t) if t else [] for t in texts.to_pylist()], _HITS)

    return lambda text: matched(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def dictionary_hits(df: DataFrame, text: str, dictionary: DataFrame, name: str = "hits") -> DataFrame:
    """Adds what of a dictionary (keyword, family) each text holds, as substrings."""
    return df.withColumn(name, matcher(keyword_rows(dictionary))(text))


def families_of(hits: Column | str) -> Column:
    """The families that have a hit, by name."""
    return F.transform(hits, lambda h: h["family"])


def primary_of_hits(hits: Column | str, tags: Column | str, priority: tuple[str, ...], other: str = "other") -> Column:
    """The tag of most hits; ties by ``priority``, then by name. Only the row's own tags count and ``other`` doesn't;
    without a tag it is ``other``."""
    hits, tags = [F.col(x) if isinstance(x, str) else x for x in (hits, tags)]
    place = F.create_map(*[x for i, f in enumerate(priority) for x in (F.lit(f), F.lit(i))]) if priority else F.lit(None).cast("map<string,int>")
    own = F.filter(tags, lambda t: t.isNotNull() & (t != other))
    ranked = F.transform(own, lambda t: F.struct(
        (-F.coalesce(F.get(F.filter(hits, lambda h: h["family"] == t), F.lit(0))["hits"], F.lit(0))).alias("few"),
        F.coalesce(F.try_element_at(place, t), F.lit(99)).alias("place"), t.alias("tag")))
    return F.coalesce(F.array_min(ranked)["tag"], F.lit(other))
