"""Byte-pair encoding by a token automaton, and decoding by its arc labels.

A merge (u, v) -> w adds a gadget: a state w entered wherever u could be entered, left wherever v could be left,
while the arc from u to v closes. After all merges, a token sequence is the encoding of its bytes exactly if the
automaton has an arc between each two neighbours. Nearly all pairs of states have one, billions in all, so arcs are
not listed: the gadgets are kept as three tables (left, right, rank), by which an arc is open unless taking gadgets
apart, from the latest on, meets a merge that closes it. Each answer is stored as a transition.

A word is read byte by byte. A second table, the automaton of all states' labels, says which states end at each place;
as every prefix has one encoding, just one of them has an arc from the state that the place of its first byte led to.
So every byte leads to one state, and no step is taken back. Decoding emits the bytes on the arcs.

Words are what the vocabulary's pre-split pattern cuts; special tokens written out in a text are taken as such, as
the public library does.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, pick, table

#: Words that a worker has at hand, beside as many that it had before them, and transitions: some 35 MB in all.
REMEMBERED, ARCS = 75_000, 75_000
#: White space as the public library's pattern engine has it.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the published pre-split pattern of byte-level vocabularies.
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# Fixed value: the same pattern for texts of Latin-1 alone, with its letters, numbers and white space listed.
_LATIN_LETTERS, _LATIN_NUMBERS, _LATIN_SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r\x20\x85\xa0"
_LATIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN_LETTERS}]+| ?[{_LATIN_NUMBERS}]+| ?[^{_LATIN_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+|[{_LATIN_SPACE}]+(?![^{_LATIN_SPACE}])|[{_LATIN_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files write for bytes: printable Latin-1 itself, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Compiled merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = byte_letters(), file["model"]
        spelled = {name: bytes(letters[c] for c in name) for name in model["vocab"]}
        self.token = {spelled[name]: i for name, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*self.token.values(), *self.special.values()]) + 1
        self.label: list[bytes] = [b""] * size
        for b, i in self.token.items():
            self.label[i] = b
        for s, i in self.special.items():
            self.label[i] = s.encode()
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        entered = [len(b) == 1 for b in self.label]
        for k, pair in enumerate(model["merges"]):
            u, v = (self.token[spelled[x]] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = self.token[self.label[u] + self.label[v]]
            if self.rank[w] < 0 and len(self.label[w]) > 1:
                # The gadget's state can be entered only if no earlier merge takes its middle apart.
                entered[w] = entered[u] and entered[v] and self.open_until(u, v, k)
                self.left[w], self.right[w], self.rank[w] = u, v, k
            self.merged[u, v] = w
        self.state = {b: i for b, i in self.token.items() if entered[i]}
        self._compile_labels()
        self._ready()

    def _compile_labels(self) -> None:
        """The automaton of the states' labels: ``step`` of (place, byte), ``back`` to the longest shorter end of what
        was read, and by place the states (with sizes, longest first) whose labels end there."""
        self.step: dict[int, int] = {}
        back, own, depth = [0], [-1], [0]
        by_depth: list[list[tuple[int, int, int]]] = []
        for label, t in sorted(self.state.items()):
            at = 0
            for d, b in enumerate(label):
                to = self.step.get(at << 8 | b)
                if to is None:
                    to = self.step[at << 8 | b] = len(own)
                    own.append(-1)
                    back.append(0)
                    depth.append(d + 1)
                    if d == len(by_depth):
                        by_depth.append([])
                    by_depth[d].append((at, b, to))
                at = to
            own[at] = t
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for d, places in enumerate(by_depth):
            for at, b, to in places:
                if d:
                    x = back[at]
                    while x and x << 8 | b not in self.step:
                        x = back[x]
                    back[to] = self.step.get(x << 8 | b, 0)
                ends[to] = (((own[to], d + 1),) if own[to] >= 0 else ()) + ends[back[to]]
        self.back, self.longer, self.shortest = back, [e[:-1] for e in ends], [e[-1] if e else None for e in ends]

    def _ready(self) -> None:
        self.arcs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words, self.latin_words = regex.compile(_WORDS), re.compile(_LATIN_WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "known", "before", "words", "latin_words", "cut", "token")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def open_until(self, s: int, t: int, limit: float) -> bool:
        """Whether no merge of a rank under ``limit`` joins what touches between the tokens s and t.

        Gadgets are undone from the latest on. Of equal pairs the left one merges first, so what t was made of must
        not have merged with s at t's own rank either.
        """
        rank, merged = self.rank, self.merged
        while True:
            w = merged.get((s, t))
            if w is not None and rank[w] < limit:
                return False
            if rank[s] > rank[t]:
                limit, s = rank[s], self.right[s]
            elif rank[t] >= 0:
                limit, t = rank[t] + 1, self.left[t]
            else:
                return True

    def arc(self, key: int) -> bool:
        """Whether there is an arc from the state of the key's high bits to that of its low ones."""
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
        known = self.arcs[key] = self.open_until(key >> 32, key & 0xFFFFFFFF, float("inf"))
        return known

    def _resumed(self, at: int, b: int) -> int:
        """Where a byte leads that the labels' trie has no step for; the answer becomes a step."""
        x, step = at, self.step
        while x and x << 8 | b not in step:
            x = self.back[x]
        to = step.get(x << 8 | b, 0)
        if len(step) < len(self.back) + ARCS:
            step[at << 8 | b] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The states on the word's way, one for each prefix; those of the whole word are read off from its end."""
        whole = self.state.get(word)
        if whole is not None:
            return [whole]
        step, longer, shortest, arcs, at, i = self.step.get, self.longer, self.shortest, self.arcs, 0, 0
        led, sizes = [-1], [0]
        for b in word:
            i += 1
            to = step(at << 8 | b)
            at = self._resumed(at, b) if to is None else to
            # One of the states must do, so the last need not be asked about.
            t, size = shortest[at]
            for longer_t, n in longer[at]:
                if n == i:
                    t, size = longer_t, n
                    break
                key = led[i - n] << 32 | longer_t
                known = arcs.get(key)
                if self.arc(key) if known is None else known:
                    t, size = longer_t, n
                    break
            led.append(t)
            sizes.append(size)
        out = []
        while i:
            out.append(led[i])
            i -= sizes[i]
        out.reverse()
        return out

    def _packed(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            ids = self.encode_word(word.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.before, self.known = self.known, {}
            self.known[word] = out
        return out

    def cut_up(self, text: str) -> list[str]:
        """The words that the pre-split pattern cuts, by the faster engine where the text is of Latin-1 alone."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return self.latin_words.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                words = self.cut_up(part)
                found = list(map(self.known.get, words))
                if None in found:
                    packed = self._packed
                    found = [packed(w) if f is None else f for w, f in zip(words, found)]
                out += found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        label = self.label
        return b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): each row's ids as little-endian unsigned 32-bit integers; a null or empty text has none.

    The automaton is bounded by the vocabulary file, whatever the corpus.
    """
    spark = documents.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    texts = pick(documents, "doc_id", "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(ids: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text): adds the text that the ids spell; bytes that are no UTF-8 become U+FFFD."""
    spark = ids.sparkSession
    shared = spark.sparkContext.broadcast(Automaton(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "ids", "text"])

    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, and decoded from the ids, in one pass, so
    a task has one worker and one automaton. Null and empty texts have no tokens and the digests of nothing; repeated
    rows stay, each by itself."""
    spark = documents.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                sizes.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = pick(documents, "doc_id", "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded; ``round_trip`` says how nulls, empty texts and repeated rows count."""
    return round_trip(table(spark, sf_dir, "documents"))
