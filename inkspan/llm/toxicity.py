"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the words around each hit.

The lexicon is learned from labelled texts: words and word stems that toxic texts hold far more often than chance
lets them. Its trie and the Levenshtein automata of its longer words are multiplied out into one deterministic table,
which all words of a batch run through at once; stems end in a state of their own whatever follows. A hit counts by
its kind (word, stem, misspelled) and by its surroundings: address to a person speaks for abuse, quotation marks and
verbs of saying for quotation. A logistic model over these counts gives the score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, labelled_sample, one_text_each, pick, table

#: Labelled texts that lexicon and model are fitted on, at most.
SAMPLE_ROWS = 12_000
#: Words of at least so many letters are also caught with one letter wrong, missing or too many.
FUZZY_FROM = 5
#: Chance below which a term's excess in toxic texts is taken for real, as a power of ten.
CHANCE = -7.0
STEMS = range(3, 9)
#: Words on either side of a hit that are its context.
WINDOW = 5

# Words of address, words of quoting, and a lexicon for when no text is labelled.
ADDRESS = frozenset("you your you're u du dein deine ihr tu tus usted te toi ton vous votre".split())
QUOTING = frozenset("said says quoted quote called wrote word term report reported alleged sagte nannte dijo llamó dit appelé".split())
SEEDS = ("disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "worthless")

#: What is counted in a text: hits by kind, hits among words of address or of quoting, and all words.
NAMES = ("words", "stems", "fuzzy", "address", "quoted", "n_words")
#: A misspelled hit counts for so much of a word.
MISSPELLED = 0.5
#: What the weights are drawn to where labels say nothing: constant, words, stems, density, address, quoted.
PRIOR = np.array([-3.0, 2.0, 1.0, 1.0, 0.5, -1.5])
#: Times as frequent in toxic texts' words as in others'.
EXCESS = 15.0
_WORD, _STEM, _FUZZY = 1, 2, 3
_DEAD, _START = 0, 1


@dataclass(frozen=True)
class Lexicon:
    words: tuple[str, ...]
    stems: tuple[str, ...]


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])


class Matcher:
    """The product of the lexicon's trie with the Levenshtein automata of its words, as one table."""

    def __init__(self, lexicon: Lexicon):
        trie: list[dict[str, int]] = [{}]
        ends: dict[int, tuple[int, int]] = {}  # node: (kind, letters)

        def add(term: str, kind: int) -> None:
            node = 0
            for c in term:
                if c not in trie[node]:
                    trie[node][c] = len(trie)
                    trie.append({})
                node = trie[node][c]
            ends.setdefault(node, (kind, len(term)))

        for term in lexicon.stems:
            add(term, _STEM)
        for term in lexicon.words:
            add(term, _WORD)
        # Below a node, the longest word decides whether an edit is worth following.
        reach = [0] * len(trie)
        for node in range(len(trie) - 1, -1, -1):
            own = ends[node][1] if node in ends and ends[node][0] == _WORD else 0
            reach[node] = max([own, *[reach[k] for k in trie[node].values()]])
        letters = sorted({c for node in trie for c in node})
        self.classes = _alnum().astype(np.int32)
        codes = {c: i + 2 for i, c in enumerate(letters)}
        for c, i in codes.items():
            self.classes[ord(c)] = i
        # A state is a set of (node, edits); reading c follows the trie, or spends the edit.
        start = frozenset({(0, 0)} | {(k, 1) for k in trie[0].values() if reach[k] >= FUZZY_FROM})
        number, rows, accepts, todo = {frozenset(): _DEAD, start: _START}, [], [], [frozenset(), start]
        for state in todo:
            accepts.append(self._accepts(state, ends))
            row = [_DEAD] * (len(letters) + 2)
            if accepts[-1] == _STEM:
                row = [len(rows)] * len(row)
            elif state:
                for c, i in [("", 1), *codes.items()]:
                    reached = set()
                    for node, edits in state:
                        if c in trie[node]:
                            reached.add((trie[node][c], edits))
                        if not edits and reach[node] >= FUZZY_FROM:
                            reached.add((node, 1))  # one too many
                            reached.update((k, 1) for k in trie[node].values() if reach[k] >= FUZZY_FROM)  # wrong
                    # One missing: after an exact step, the next letter may be passed over.
                    reached |= {(k, 1) for node, edits in reached if not edits for k in trie[node].values() if reach[k] >= FUZZY_FROM}
                    best = frozenset(x for x in reached if not (x[1] and (x[0], 0) in reached))
                    if best not in number:
                        number[best] = len(number)
                        todo.append(best)
                    row[i] = number[best]
            rows.append(row)
        self.table, self.accepts = np.array(rows, np.int32), np.array(accepts, np.int8)

    @staticmethod
    def _accepts(state: frozenset, ends: dict[int, tuple[int, int]]) -> int:
        own = [(edits, *ends[node]) for node, edits in state if node in ends]
        for edits, kind, _ in own:
            if not edits:
                return kind
        return _FUZZY if any(kind == _WORD and size >= FUZZY_FROM for _, kind, size in own) else 0

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts, kinds) of the hits in a lower-cased text, in code points."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        own = np.zeros(len(points) + 1, np.int32)
        own[:-1] = self.classes[points]
        at = np.flatnonzero((own[:-1] > 0) & np.concatenate([[True], own[:-2] == 0])) if len(points) else np.zeros(0, np.int64)
        begin, state, found = at, np.full(len(at), _START, np.int32), []
        while len(at):
            c = own[at]
            over = c == 0
            if over.any():
                kind = self.accepts[state]
                hit = over & (kind > 0)
                found.append((begin[hit], kind[hit]))
            state = np.where(over, _DEAD, self.table[state, c])
            stem = self.accepts[state] == _STEM
            if stem.any():
                found.append((begin[stem], np.full(stem.sum(), _STEM, np.int8)))
            alive = (state != _DEAD) & ~stem
            begin, state, at = begin[alive], state[alive], at[alive] + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int8)
        starts, kinds = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(starts)
        return starts[order], kinds[order]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row of NAMES for each text. Texts of a batch are matched in one go."""
        low = [(t or "").lower() for t in texts]
        out = np.zeros((len(texts), len(NAMES)))
        starts, kinds = self.find("\0".join(low))
        ends = np.cumsum([len(t) + 1 for t in low])
        owner = np.searchsorted(ends, starts, "right")
        for i, (k, at) in zip(owner.tolist(), zip(kinds.tolist(), starts.tolist())):
            text, at = low[i], at - int(ends[i]) + len(low[i]) + 1
            out[i, k - 1] += 1
            before, after = text[max(0, at - 60) : at], text[at : at + 80]
            words = [w.strip(".,;:!?\"'()«»“”") for w in (before.split()[-WINDOW:] + after.split()[: WINDOW + 1])]
            out[i, 3] += any(w in ADDRESS for w in words)
            marks = before.count('"') % 2 == 1 and '"' in after or before.rfind("“") > before.rfind("”") or before.rfind("«") > before.rfind("»")
            out[i, 4] += marks or any(w in QUOTING for w in words)
        out[:, 5] = [len(t.split()) for t in low]
        return out


def inputs(words, stems, fuzzy, address, quoted, n_words, log1p, most):
    """The model's inputs, of columns or of arrays alike."""
    own = words + fuzzy * MISSPELLED
    return log1p(own), log1p(stems), log1p((own + stems) * 100 / most(n_words)), log1p(address), log1p(quoted)


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), *inputs(*features.T, np.log1p, lambda n: np.maximum(n, 1))])


def _log10_tail(hits: int, n: int, share: float) -> float:
    """Chance of at least ``hits`` of ``n`` at this share, by its leading term, as a power of ten."""
    return (lgamma(n + 1) - lgamma(hits + 1) - lgamma(n - hits + 1) + hits * log(share) + (n - hits) * log(1 - share)) / log(10)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems of ``sample`` (label, text) whose count in toxic texts is beyond chance; purest stems first.

    Counts are made where the texts are; only terms of toxic texts come to the driver, of which the bounded sample has
    a bounded number (sf0.1 keeps 56 words).
    """
    words = sample.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("word"))
    by_word = words.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") != 1).alias("good"))
    totals = words.agg(F.count_if(F.col("label") == 1), F.count("*")).head()
    if not totals[0] or totals[0] == totals[1]:
        return Lexicon(SEEDS, ())
    share = totals[0] / totals[1]
    stems = by_word.select("bad", "good", F.explode(F.transform(F.lit(list(STEMS)), lambda n: F.when(F.length("word") > n, F.struct(F.substring("word", F.lit(1), n).alias("term"))))).alias("s")).where("s is not null")
    terms = by_word.select(F.col("word").alias("term"), F.lit(False).alias("stem"), "bad", "good").union(stems.groupBy("s.term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select("term", F.lit(True), "bad", "good"))
    least = EXCESS * share / (1 - share)  # of bad to good
    likely = terms.where((F.col("bad") >= 5) & (F.col("bad") >= least * F.col("good")) & (F.length("term") >= 3))
    found = likely.collect()
    chances = {(r["term"], r["stem"]): _log10_tail(r["bad"], r["bad"] + r["good"], share) for r in found}
    real = sorted((r for r in found if chances[r["term"], r["stem"]] < CHANCE), key=lambda r: (chances[r["term"], r["stem"]], r["term"]))
    chosen: list[str] = []
    for r in sorted((r for r in real if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        # A stem counts if more than one word shares it: else it is the word.
        whole = max((w["bad"] for w in real if not w["stem"] and w["term"].startswith(r["term"])), default=0)
        if whole < 0.8 * r["bad"] and not any(r["term"].startswith(s) for s in chosen):
            chosen.append(r["term"])
    # A word that begins with a stem is caught by it, but misspelled only as a word of its own.
    plain = [r["term"] for r in real if not r["stem"] and (len(r["term"]) >= FUZZY_FROM or not any(r["term"].startswith(s) for s in chosen))]
    return Lexicon(tuple(sorted(plain)), tuple(sorted(chosen)))


def fit_weights(features: np.ndarray, labels: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR; without both labels PRIOR itself."""
    if not len(labels) or labels.min() == labels.max():
        return PRIOR
    x, w = _scaled(features), PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (labels - p) - ridge * (w - PRIOR))
        w = w + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return w


def _counted(lexicon: Lexicon, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            rows = matcher.features(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], *[pa.array(rows[:, i]) for i in range(len(NAMES))]], names=[*batch.schema.names[:extra], *NAMES])

    return run


_COUNTS = ", ".join(f"{n} double" for n in NAMES)


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from about ``rows`` labelled texts at most, none of them held out."""
    arrow_batches(documents.sparkSession)
    sample = labelled_sample(labels, "toxic", rows)
    marked = pick(documents, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    marked = one_text_each(marked).select("label", "text")
    lexicon = learn_lexicon(marked)
    found = marked.mapInArrow(_counted(lexicon, 1), f"label int, {_COUNTS}").collect()
    data = np.array(sorted(tuple(map(float, r)) for r in found), float).reshape(-1, len(NAMES) + 1)
    return lexicon, fit_weights(data[:, 1:], data[:, 0])


def scored(documents: DataFrame, lexicon: Lexicon, weights: Iterable[float]) -> DataFrame:
    """(doc_id, score, counts) of every row; null and empty texts have no hits and the score of a clean text."""
    arrow_batches(documents.sparkSession)
    texts = pick(documents, "doc_id", "text")
    counts = texts.mapInArrow(_counted(lexicon, 1), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_COUNTS}")
    first, *others = map(float, weights)
    total = F.lit(first)
    for value, w in zip(inputs(*map(F.col, NAMES), F.log1p, lambda n: F.greatest(n, F.lit(1.0))), others):
        total = total + value * w
    return counts.withColumn("score", 1 / (1 + F.exp(-total)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``. Null and empty texts score as clean ones do; rows of one id are scored each by
    itself, and a null id is not held out."""
    documents = table(spark, sf_dir, "documents")
    out = scored(documents, *fit(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *NAMES)
