"""Language-model scoring with a small gated recurrent network over words.

Counts of all training tokens are gathered first: they give the smoothed unigram base, and the vocabulary. The network
predicts a token in two steps, its class, then the word in the class. Words beyond its vocabulary fall into classes of
their own by how they end, inside which the smoothed counts decide, so each text has a proper probability and no word
is unknown. Texts are turned into ids once; training and scoring both read those.

Weights start at the unigram model and are fitted by truncated backpropagation in numpy over all training texts. A
hash of its id says which replica a text trains, whatever the partitions. One replica begins; the next eight start
from its weights, the next sixty-four, of more texts each, from the average of those, and so on. Scoring runs texts side by side, a window
at a time, and carries each text's state on, so whole texts are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, held_out, pick, table, written

MODULUS, REST = 7, 2
#: The network's own words; all others are in classes by their last two bytes.
WORDS = 2048
CLASSES, KINDS = 32, 32
HIDDEN = 16
#: Words whose counts every worker has at hand; of the others, counts are joined.
FREQUENT = 131_072
#: Steps that gradients run back, and streams trained side by side.
WINDOW, LANES = 16, 512
#: Tokens of one part of the training texts, about, and tokens that are in memory at once.
PART_TOKENS, GROUP_TOKENS = 1 << 20, 1 << 20
#: The first rounds: replicas, parts that each trains on, streams side by side. Later rounds have GROWTH times as many
#: replicas as the one before, of as many parts as the last of these.
ROUNDS, GROWTH = ((1, 1, 64), (8, 1, 128), (64, 4, LANES)), 8
#: Texts scored side by side, and states whose outputs are made at once.
SIDE, ROWS = 16_384, 4096
#: Entries of a worker's counter before it is handed on.
COUNTED = 300_000
#: The end of a text as a token: no word holds a space.
END = b" "


def tokens(text: bytes | None) -> list[bytes]:
    return [*text.lower().split(), END] if text else [END]


def kind_of(word: bytes) -> int:
    return crc32(word[-2:]) % KINDS


def _kind() -> Column:
    return F.crc32(F.substring("word", -2, 2)) % KINDS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words, counts = list(own.keys()), list(own.values())
        own.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            own.update(tokens(text))
            if len(own) >= COUNTED:
                yield out()
    yield out()


def token_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all training texts, ends included; summed where the texts are before any shuffle."""
    train = documents.where(~held_out("doc_id", MODULUS, REST)).select("text")
    return train.mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words with exact counts, by falling count, the end of a text apart; the first are the network's."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    ends: int = 0
    #: Of each kind, the counts and number of its words, the end not among them.
    kinds: dict[int, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.own = [END, *self.words[: WORDS - 1]]
        size = len(self.own)
        self.own_counts = np.array([self.ends, *self.counts[: size - 1]], np.int64)
        self.classes = max(1, min(CLASSES, size // 8))
        # Words of like frequency share a class.
        order = np.argsort(-self.own_counts, kind="stable")
        self.class_of = np.empty(size + KINDS, np.int64)
        self.class_of[order] = np.arange(size) * self.classes // size
        self.class_of[size:] = self.classes + np.arange(KINDS)
        self.members = [np.flatnonzero(self.class_of[:size] == c) for c in range(self.classes)]
        self.place = np.zeros(size + KINDS, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        #: Smoothed mass of each kind's words beyond the network's, one unseen word included.
        self.mass = np.ones(KINDS)
        for k, (n, words) in self.kinds.items():
            self.mass[k] += n + words
        for w, n in zip(self.own[1:], self.own_counts[1:].tolist()):
            self.mass[kind_of(w)] -= n + 1

    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Word to id: the network's words, then the other frequent ones; of each id the network's input, the count."""
        size, others = len(self.own), self.words[len(self.own) - 1 :]
        ids = {w: i for i, w in enumerate(self.own)} | {w: size + i for i, w in enumerate(others)}
        return ids, np.array([*range(size), *[size + kind_of(w) for w in others]], np.int64), np.concatenate([self.own_counts, self.counts[size - 1 :]])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words from some count on, FREQUENT of them at most; ``counts`` is read four times."""
    level = F.floor(F.log2("n") * 16).cast("int")
    ends = sum(r["n"] for r in counts.where(F.col("word") == F.lit(END)).collect())
    words = counts.where(F.col("word") != F.lit(END))
    kinds = {r["kind"]: (r["n"], r["words"]) for r in words.groupBy(_kind().alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    steps = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for r in steps:
        if taken + r["words"] > FREQUENT:
            break
        taken, least = taken + r["words"], r["level"]
    rows = words.where(level >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    total, distinct = ends + sum(n for n, _ in kinds.values()), bool(ends) + sum(w for _, w in kinds.values())
    return Vocabulary([bytes(r["word"]) for r in rows], np.array([r["n"] for r in rows], np.int64), total, distinct, ends, kinds)


class Network:
    """Weights and both passes. Input rows hold a word's part of all three gates, so a step is one small product."""

    NAMES = ("inputs", "recurrent", "to_class", "to_word")

    def __init__(self, v: Vocabulary):
        self.v, size, rng = v, len(v.own), np.random.default_rng(1)
        f = np.float32
        self.inputs = rng.normal(0, 0.1, (size + KINDS, 3 * HIDDEN)).astype(f)
        self.recurrent = (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / HIDDEN**0.5 / 2).astype(f)
        # The last part of each is the bias: states are followed by a one.
        self.to_class = np.zeros((HIDDEN + 1, v.classes + KINDS), f)
        self.to_word = np.zeros((size, HIDDEN + 1), f)
        mass = np.concatenate([np.bincount(v.class_of[:size], v.own_counts + 1.0, v.classes), v.mass])
        self.to_class[HIDDEN] = np.log(mass / mass.sum())
        self.to_word[:, HIDDEN] = np.log((v.own_counts + 1) / mass[v.class_of[:size]])
        #: Sums of squared gradients, which set the step sizes.
        self.squares = {n: np.full_like(getattr(self, n), 1e-3) for n in self.NAMES}

    def packed(self) -> bytes:
        return b"".join(getattr(self, n).tobytes() for n in self.NAMES) + b"".join(self.squares[n].tobytes() for n in self.NAMES)

    def unpack(self, data: bytes) -> Network:
        at = 0
        for target in (self.__dict__, self.squares):
            for n in self.NAMES:
                old = target[n]
                target[n] = np.frombuffer(data, np.float32, old.size, at).reshape(old.shape).copy()
                at += old.nbytes
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from inputs x (rows of 3 gates, a column a text) and states h: new state, update gate, reset gate,
        candidate."""
        u = self.recurrent.T @ h
        gates = x[: 2 * HIDDEN] + u[: 2 * HIDDEN]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, part = gates[:HIDDEN], gates[HIDDEN:], u[2 * HIDDEN :]
        c = r * part
        c += x[2 * HIDDEN :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, part

    @staticmethod
    def _exp(logits: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials, in the place of the logits, their sums, and the logs of the goals' shares.

        Weights keep logits small; what would overflow nevertheless is cut.
        """
        np.minimum(logits, 80, out=logits)
        own = logits[np.arange(len(goal)), goal]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        return logits, total, own - np.log(total)

    def heads(self, h: np.ndarray, goal: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of the goals' probabilities, inside a kind none; with ``grad``, which is filled, the states'
        gradients too. ``h`` has states and a one after each."""
        own, v = self.v.class_of[goal], self.v
        p, total, logs = self._exp(h @ self.to_class, own)
        scale, back = np.float32(1 / max(1, len(goal))), None
        if grad is not None:
            p *= (scale / total)[:, None]
            p[np.arange(len(goal)), own] -= scale
            back = p @ self.to_class[:HIDDEN].T
            grad |= {"to_class": h.T @ p, "to_word": np.zeros_like(self.to_word)}
        # Rows by class, those of kinds last.
        order = np.argsort(own.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(own[order], np.arange(v.classes + 1))
        order = order[: cuts[-1]]
        states, places, more = h[order], v.place[goal[order]], np.empty(len(order), np.float32)
        inner = None if grad is None else np.empty((len(order), HIDDEN), np.float32)
        for c, members in enumerate(v.members):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                weights = self.to_word[members]
                q, total, more[a:b] = self._exp(states[a:b] @ weights.T, places[a:b])
                if grad is not None:
                    q *= (scale / total)[:, None]
                    q[np.arange(b - a), places[a:b]] -= scale
                    np.matmul(q, weights[:, :HIDDEN], out=inner[a:b])
                    grad["to_word"][members] = q.T @ states[a:b]
        logs[order] += more
        if grad is not None:
            back[order] += inner
        return logs, back

    def train(self, stream: np.ndarray, lanes: int = LANES) -> int:
        """Truncated backpropagation over a stream of ids, cut into lanes; how many tokens were predicted.

        Tokens that don't fill all lanes evenly are left for the caller: they begin at the returned place.
        """
        n = len(stream) - 1
        lanes = min(lanes, max(1, n // (4 * WINDOW)))
        length = n // lanes
        given, goal = (stream[k : k + lanes * length].reshape(lanes, length).T for k in (0, 1))
        h = np.zeros((HIDDEN, lanes), np.float32)
        for begin in range(0, length, WINDOW):
            h = self._window(given[begin : begin + WINDOW], goal[begin : begin + WINDOW], h)
        return lanes * length

    def _window(self, given: np.ndarray, goal: np.ndarray, h: np.ndarray, rate: float = 0.3, eps: float = 1e-6) -> np.ndarray:
        """One step of the weights; the states that the next window begins with. Texts are columns."""
        size, lanes = given.shape
        x = np.ascontiguousarray(self.inputs[given].transpose(0, 2, 1))
        inside = (given != 0).astype(np.float32)  # a text begins with a state of its own
        past, steps = [], []
        for t in range(size):
            past.append(h * inside[t])
            steps.append(self.step(x[t], past[-1]))
            h = steps[-1][0]
        grad: dict[str, np.ndarray] = {}
        _, back = self.heads(with_one([s[0].T for s in steps]), goal.ravel(), grad)
        back = np.ascontiguousarray(back.reshape(size, lanes, HIDDEN).transpose(0, 2, 1))
        dh = np.zeros((HIDDEN, lanes), np.float32)
        dx, du = np.empty((size, 3 * HIDDEN, lanes), np.float32), np.empty((3 * HIDDEN, lanes), np.float32)
        grad["recurrent"] = np.zeros_like(self.recurrent)
        for t in range(size - 1, -1, -1):
            _, z, r, c, part = steps[t]
            dh += back[t]
            keep, own = 1 - z, dx[t]
            dc = np.multiply(dh, keep, out=own[2 * HIDDEN :])
            dc *= 1 - c * c
            dz = np.multiply(past[t] - c, dh, out=own[:HIDDEN])
            dz *= z
            dz *= keep
            du[2 * HIDDEN :] = dc * r
            dr = np.multiply(du[2 * HIDDEN :], part, out=own[HIDDEN : 2 * HIDDEN])
            dr *= 1 - r
            du[: 2 * HIDDEN] = own[: 2 * HIDDEN]
            grad["recurrent"] += past[t] @ du.T
            dh *= z
            dh += self.recurrent @ du
            dh *= inside[t]
        for n, g in grad.items():
            self._move(n, slice(None), g, rate, eps)
        flat = given.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        cuts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        rows = dx.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order]
        self._move("inputs", flat[cuts], np.add.reduceat(rows, cuts, 0), rate, eps)
        return h

    def _move(self, name: str, rows, g: np.ndarray, rate: float, eps: float) -> None:
        g = np.clip(g, -1, 1)
        self.squares[name][rows] += g * g
        getattr(self, name)[rows] -= np.float32(rate) * g / (np.sqrt(self.squares[name][rows]) + np.float32(eps))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each text's ids (its end last), SIDE at a time, states carried from window to
        window; inside a kind nothing is added."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        out = np.empty(len(docs))
        for begin in range(0, len(order), SIDE):
            own = order[begin : begin + SIDE]
            out[own] = self._side_by_side([docs[i] for i in own])
        return out

    def _side_by_side(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of texts that come longest first."""
        sizes = np.array([len(d) for d in docs], np.int64)
        out, flat, begins = np.zeros(len(docs)), np.concatenate(docs), np.cumsum(sizes) - sizes
        h = np.zeros((HIDDEN, len(docs)), np.float32)
        states, goals, size, longest = [], [], 0, int(sizes.max(initial=0))
        active = np.searchsorted(-sizes, -np.arange(longest)).tolist()  # texts with more than t tokens
        done = 0
        for t, n in enumerate(active):
            at = begins[:n] + t
            given = flat[at - 1] if t else np.zeros(n, np.int64)
            h = self.step(np.ascontiguousarray(self.inputs[given].T), h[:, :n])[0]
            states.append(h.T)
            goals.append(flat[at])
            size += n
            if size >= ROWS or t == longest - 1:
                every, goal = with_one(states), np.concatenate(goals)
                logs = np.concatenate([self.heads(every[k : k + ROWS], goal[k : k + ROWS])[0] for k in range(0, size, ROWS)])
                k = 0
                for m in active[done : t + 1]:
                    out[:m] += logs[k : k + m]
                    k += m
                states, goals, size, done = [], [], 0, t + 1
        return out


def with_one(states: list[np.ndarray]) -> np.ndarray:
    """All states in one, each followed by a one."""
    out = np.ones((sum(map(len, states)), HIDDEN + 1), np.float32)
    np.concatenate(states, out=out[:, :HIDDEN])
    return out


_ENCODED = {"row": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "dealt": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_sum": pa.float64(), "rest_sum": pa.float64(), "ids": pa.binary(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int32())}
_ENCODED_SQL = "row bigint, doc_id bigint, train boolean, dealt bigint, n_tokens bigint, n_known bigint, base_sum double, rest_sum double, ids binary, words array<binary>, counts array<int>"


def _encoding(v):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = v.value
        ids, to_net, counts = vocab.tables()
        size, logs, masses = len(vocab.own), np.log10(counts + 1.0), np.log10(vocab.mass)
        row = TaskContext.get().partitionId() << 33

        def rows_of(some: list[tuple], words: list[bytes], ends: list[int]) -> pa.RecordBatch:
            """Of some texts, all of whose tokens stand in ``words``, each up to its end."""
            own = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
            known, rare = own >= 0, np.flatnonzero(own < 0)
            names = [words[i] for i in rare.tolist()]
            net = to_net[own]
            net[rare] = np.fromiter(map(kind_of, names), np.int64, len(names)) + size
            base, beyond = np.where(known, logs[own], 0.0), net >= size
            rest = np.where(beyond, base - masses[np.where(beyond, net - size, 0)], 0.0)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            cuts = np.searchsorted(rare, [0, *ends]).tolist()
            rarer = [Counter(names[a:b]) for a, b in zip(cuts, cuts[1:])]
            packed = net.astype("<u2").tobytes()
            columns = [
                [s[0] for s in some], [s[1] for s in some], [s[2] for s in some], [s[0] if s[1] is None else s[3] for s in some], np.diff([0, *ends]),
                np.add.reduceat((known & (counts[own] > 0)).astype(np.int64), begins), np.add.reduceat(base, begins), np.add.reduceat(rest, begins),
                [packed[2 * a : 2 * b] for a, b in zip(begins.tolist(), ends)], [list(c.keys()) for c in rarer], [list(c.values()) for c in rarer],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENCODED.values())], names=list(_ENCODED))

        for batch in batches:
            some, words, ends = [], [], []
            for doc, train, dealt, text in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3).cast(pa.binary()).to_pylist()):
                words += tokens(text)
                ends.append(len(words))
                some.append((row, doc, train, dealt))
                row += 1
                if len(words) >= GROUP_TOKENS // 4:
                    yield rows_of(some, words, ends)
                    some, words, ends = [], [], []
            if some:
                yield rows_of(some, words, ends)

    return run


def encoded(documents: DataFrame, v) -> DataFrame:
    """A row for each of documents: ids for the network, sums over counts at hand, and the rarer words, each once.

    ``dealt`` says which replica a training text belongs to: a hash of id and text; without an id, where it stands.
    """
    train = ~held_out("doc_id", MODULUS, REST)
    rows = documents.select("doc_id", train.alias("train"), F.xxhash64("doc_id", "text").alias("dealt"), "text")
    return rows.mapInArrow(_encoding(v), _ENCODED_SQL)


def _replica(v, weights, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, key, seen, rest = None, None, 0, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([seen + net.train(rest, 1)], pa.int64()), pa.array([net.packed()], pa.binary())], names=["replica", "n", "weights"])

        def streams(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for replica, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield replica, np.frombuffer(ids, "<u2")

        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for replica, ids in streams(batch):
                if replica != key:
                    if net is not None:
                        rest = np.concatenate([rest, *parts])
                        at = net.train(rest, lanes)
                        seen, rest = seen + at, rest[at:]
                        yield done()
                    net, key, seen, rest, parts, size = Network(v.value), replica, 0, np.zeros(1, np.int64), [], 0
                    if weights is not None:
                        net.unpack(weights.value)
                parts.append(ids.astype(np.int64))
                size += len(ids)
                if size >= GROUP_TOKENS:
                    stream = np.concatenate([rest, *parts])
                    at = net.train(stream, lanes)
                    seen, rest, parts, size = seen + at, stream[at:], [], 0
        if net is not None:
            rest = np.concatenate([rest, *parts])
            at = net.train(rest, lanes)
            seen, rest = seen + at, rest[at:]
            yield done()

    return run


def _mean(rows: Iterable[tuple[int, int, bytes]]) -> tuple[int, bytes] | None:
    """Tokens and mean of (replica, tokens, weights), taken in the replicas' order."""
    total, seen = None, 0
    for _, n, w in sorted(rows, key=lambda r: r[0]):
        own = np.frombuffer(w, np.float32).astype(np.float64) * n
        total, seen = own if total is None else total + own, seen + n
    return (seen, (total / seen).astype(np.float32).tobytes()) if seen else None


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, eight replicas or so, in one."""
    rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
    found = _mean(rows)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([min(r[0] for r in rows) // 8], pa.int64()), pa.array([found[0]], pa.int64()), pa.array([found[1]], pa.binary())], names=["replica", "n", "weights"])


_REPLICAS = "replica bigint, n bigint, weights binary"


def fit(texts: DataFrame, v: Vocabulary, shared=None) -> bytes:
    """Weights after all training rows of ``texts`` (train, dealt, ids), each trained on once.

    Texts are dealt into parts of about PART_TOKENS tokens. The replicas of a round start from the last round's
    average, and their own is taken eight at a time, so few reach the driver.
    """
    spark = texts.sparkSession
    shared = shared or spark.sparkContext.broadcast(v)
    parts = max(1, -(-v.total // PART_TOKENS))
    rows = texts.where("train").select(F.pmod("dealt", F.lit(parts)).alias("part"), "ids", "dealt")
    low, weights, rounds = 0, None, list(ROUNDS)
    while low < parts:
        replicas, each, lanes = rounds.pop(0)
        high = min(parts, low + replicas * each)
        replicas = -(-(high - low) // each)
        own = rows.where(F.col("part").between(low, high - 1)).withColumn("replica", F.floor((F.col("part") - low) / each).cast("long"))
        dealt = own.repartitionById(replicas, F.col("replica").cast("int")).sortWithinPartitions("replica", "dealt", "ids").select("replica", "ids")
        found, left = written(dealt.mapInArrow(_replica(shared, weights, lanes), _REPLICAS), "replicas"), replicas
        while left > 8:
            left = -(-left // 8)
            found = found.repartitionById(left, F.floor(F.col("replica") / 8).cast("int")).mapInArrow(_averaged, _REPLICAS)
        mean = _mean([(r["replica"], r["n"], bytes(r["weights"])) for r in found.collect()])
        if mean:
            weights = spark.sparkContext.broadcast(mean[1])
        low = high
        rounds = rounds or [(replicas * GROWTH, each, lanes)]
    return weights.value if weights is not None else Network(v).packed()


_SCORED = {"row": pa.int64(), "net": pa.float64()}


def _scored(v, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(v.value).unpack(weights.value)
        rows: list[int] = []
        docs: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = net.score(docs) / np.log(10)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found)], names=list(_SCORED))

        for batch in batches:
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append(row)
                docs.append(np.frombuffer(ids, "<u2").astype(np.int64))
                size += len(docs[-1])
                if size >= 4 * GROUP_TOKENS:
                    yield out()
                    rows, docs, size = [], [], 0
        if rows:
            yield out()

    return run


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    A null or empty text is its end alone. Rows without an id train like others. Without training texts all counts
    are 0 and each token's base probability is 1.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    texts = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = written(token_counts(texts), "counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    rows = written(encoded(texts, shared), "encoded")
    weights = spark.sparkContext.broadcast(fit(rows, v, shared))
    net = rows.select("row", "ids").mapInArrow(_scored(shared, weights), "row bigint, net double")
    # Of a text's rarer words, each once with how often it is there; frequent ones never come this way.
    rare = rows.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("k"))
    looked = rare.join(counts, "word", "left").select("row", (F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rare_sum"), F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("rare_known"))
    own = rows.select("row", "doc_id", "n_tokens", "n_known", "base_sum", "rest_sum")
    # All three hang on the row's number; one aggregate takes the place of two joins.
    parts = [
        own.withColumns({"net": F.lit(0.0), "rare_sum": F.lit(0.0), "rare_known": F.lit(0).cast("long")}),
        net.select("row", F.lit(None).cast("long").alias("doc_id"), *[F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_sum", "double"), ("rest_sum", "double"))], "net", F.lit(0.0).alias("rare_sum"), F.lit(0).cast("long").alias("rare_known")),
        looked.groupBy("row").agg(F.sum("rare_sum").alias("rare_sum"), F.sum("rare_known").cast("long").alias("rare_known")).select("row", F.lit(None).cast("long").alias("doc_id"), *[F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_sum", "double"), ("rest_sum", "double"), ("net", "double"))], "rare_sum", "rare_known"),
    ]
    both = parts[0].union(parts[1]).union(parts[2]).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in parts[0].columns[2:]])
    per_token = float(np.log10(v.total + v.distinct + 1))
    return both.select(
        "doc_id", held_out("doc_id", MODULUS, REST).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.col("rare_sum") - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("net") + F.col("rest_sum") + F.col("rare_sum")).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of those not held out. A null or empty text is the end alone; rows of one id
    are scored, and learned from, each by itself; a null id is not held out."""
    return score_documents(table(spark, sf_dir, "documents"))
