"""SimHash near-dedup with pivot distance tables.

A fingerprint has 64 bits by majority over its shingles' hashes. Equal fingerprints are folded first, so the search
runs over different ones. Each gets a row of distances to many reference fingerprints (pivots); two whose distances
to any pivot differ by more than the radius can't be within it, and only pairs that no pivot rules out are verified.

On random fingerprints pivot distances cluster about 32, so the tables alone would leave all pairs to look at. They
are therefore applied within partitions that lose no pair: the 64 bits fall into ``radius + k`` blocks, two
fingerprints within the radius agree on at least k blocks, and each k blocks are a partition key; k is 2, and more if
there are so many fingerprints that keys would be crowded. A partition
larger than one task should hold is cut into pieces, and each two pieces meet in a task of their own. A task sends on
a spanning forest of its links, never all pairs of a group, so what is sent grows with fingerprints, not pairs.
Components are then found by star contraction on the links.

A radius wide enough for texts that share four fifths of their shingles has no such blocks. ``one_of_each`` therefore
takes wide fingerprints (four words of 64 bits) and, as partition keys, pairs of the text's smallest shingle hashes
under six orders: texts of similarity 0.8 agree on at least two of the six in 998 of 1000 cases. Distances to random
pivots tell nothing at that radius, so pivots are taken from the partition's own fingerprints, each as far from the
others as can be: what is near one of them is ruled out for all that is not. What is left is verified by the shingles
themselves. First each text meets the nearest of its partitions' leaders, which connects most copies at the cost of
one pair a text. Partitions that still hold more than one component are then searched with their shingles at hand:
a task sends on the links that it finds, never the pairs that it looks at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, bitmaps, pick, table, with_mark, written

SEED = 42
RADIUS = 4
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Words and radius of wide fingerprints: at a similarity of 0.8 on average 39 of 256 bits differ, give or take 6 (of
#: four and five shingles 48), so the radius is four deviations off and only a filter.
WIDE, WIDE_RADIUS = 4, 64
#: Near copies share so much of their shingles: a fraction.
ALIKE = (4, 5)
#: Orders whose smallest shingle hashes are partition keys of wide fingerprints.
ORDERS = 6
#: Fingerprints of one partition key that a task takes at once, and shingles of one piece.
PIECE, PIECE_SHINGLES = 4096, 1 << 19

_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, joined by spaces; of all words if they are fewer."""
    n, h = len(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([h(b" ".join(words), SEED)] if n else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[: n - size]]).tolist()
    return np.fromiter((h(text[a:b], SEED) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist())), "<u8", n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none: 0."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_POWERS[2 * total > len(hashes)].sum(dtype=np.uint64))


def rehashed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each value."""
    x = (hashes ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)) * np.uint64(0xE7037ED1A0B428DB)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(29))


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(t.lower().split() if t else [], size)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, print) of each row; A-Z lower-cased words, shingles of ``size`` words. Null, empty and blank texts
    have fingerprint 0."""
    arrow_batches(documents.sparkSession)
    texts = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(_fingerprints(size), "doc_id bigint, print bigint")


def _digest(hashes: np.ndarray) -> int:
    """One number for a set of shingles, given sorted."""
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.lower().split() if text else [], size))


def _wide(size: int):
    names = ["doc_id", "place", "node", "n", *[f"p{k}" for k in range(WIDE)], *[f"m{k}" for k in range(ORDERS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = [], []
            for doc, place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                hashes = shingle_set(text, size)
                if len(hashes):
                    docs.append(doc)
                    more = [hashes, *[rehashed(hashes, k) for k in range(1, ORDERS)]]
                    own = [*[majority(more[k]) for k in range(WIDE)], *[int(m.min()) for m in more]]
                    rows.append([place, _digest(hashes), len(hashes), *map(signed, own)])
            table = np.array(rows, np.int64).reshape(-1, len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(names) - 1)]], names=names)

    return run


def placed(documents: DataFrame) -> DataFrame:
    """(doc_id, place, text) of rows with an id; id and place, a hash of the text, tell rows of one id apart."""
    texts = pick(documents, "doc_id", "text").where("doc_id is not null")
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), "text")


def wide_fingerprints(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, place, node, n, p0.., m0..): of rows with an id and a word the digest and number of different
    shingles, wide fingerprints and smallest hashes; others have none."""
    arrow_batches(documents.sparkSession)
    return placed(documents).mapInArrow(_wide(size), ", ".join(f"{n} bigint" for n in ["doc_id", "place", "node", "n", *[f"p{k}" for k in range(WIDE)], *[f"m{k}" for k in range(ORDERS)]]))


def agreeing(n: int, radius: int) -> int:
    """How many blocks a key takes, so that a key has about PIECE of ``n`` fingerprints spread evenly, at most. Any
    number loses no pair; more blocks make longer keys, and more of them."""
    return next((k for k in range(2, 8) if n >> 64 * k // (radius + k) <= PIECE), 8)


def blocks(radius: int, agree: int = 2) -> list[int]:
    """Masks of radius + agree runs of bits that make up all 64: within the radius so many of them agree."""
    cuts = np.linspace(0, 64, radius + agree + 1).round().astype(int)
    return [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def pivots(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (n, width), dtype=np.uint64, endpoint=False)


def links(a: np.ndarray, b: np.ndarray | None, radius: int, count: int = PIVOTS) -> np.ndarray:
    """A spanning forest of the links within ``a``, or between ``a`` and ``b``: rows (i, j) of places in a, then b.

    Fingerprints are rows of 64-bit words. Pairs already in one tree are no news. Of the others, those whose largest
    difference of pivot distances exceeds the radius fall away, and what is left is verified.
    """
    every = a if b is None else np.concatenate([a, b])
    far = np.stack([np.bitwise_count(every ^ p).sum(1, dtype=np.int16) for p in pivots(count, every.shape[1])], 1)
    tree = np.arange(len(every))
    later = np.arange(len(a), len(every)) if b is not None else np.arange(len(every))
    later = later[np.argsort(far[later, 0], kind="stable")]
    first, out = far[later, 0], []
    for i in range(len(a)):
        low, high = np.searchsorted(first, [far[i, 0] - radius, far[i, 0] + radius + 1])
        near = later[low:high]
        near = near[tree[near] != tree[i]]
        near = near[np.abs(far[near] - far[i]).max(1) <= radius]
        near = near[np.bitwise_count(every[near] ^ every[i]).sum(1, dtype=np.int16) <= radius]
        if len(near):
            others, at = np.unique(tree[near], return_index=True)
            out += [(i, j) for j in near[at].tolist()]
            tree[np.isin(tree, others)] = tree[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _grouped_links(radius: int):
    """Rows sorted by (key, code, pair), then side, node and fingerprint: each run is a group of at most two pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        key = None

        def solve(group: np.ndarray) -> np.ndarray:
            side, node, prints = group[:, 0], group[:, 1], np.ascontiguousarray(group[:, 2:]).view(np.uint64)
            order = np.argsort(side, kind="stable")
            n = int((side == 0).sum())
            if not n or len(side) < 2:
                return np.zeros((0, 2), np.int64)
            prints, node = prints[order], node[order]
            return node[links(prints[:n], prints[n:] if n < len(prints) else None, radius)].reshape(-1, 2)

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(1) if len(pairs) else pairs[:, 0]), pa.array(pairs.max(1) if len(pairs) else pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            table = np.stack([np.asarray(c) for c in batch.columns], 1)
            if not len(table):
                continue
            cuts = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(1)) + 1
            found = []
            for own in np.split(table, cuts):
                if key is not None and (own[0, :3] != key).any():
                    found.append(solve(np.concatenate(rest)))
                    rest = []
                key = own[0, :3]
                rest.append(own[:, 3:])
            yield batch_of(found)
        if rest:
            yield batch_of([solve(np.concatenate(rest))])

    return run


def _meeting(rows: DataFrame, columns: list[str], keys: list[Column], agree: int) -> DataFrame:
    """(key, code, pieces, own, node, columns): each row under each ``agree`` of ``keys`` that another row has too."""
    own = [F.struct(F.lit(k).cast("long").alias("code"), F.xxhash64(*some).alias("key")) for k, some in enumerate(combinations(keys, agree))]
    keyed = rows.select("node", *columns, F.explode(F.array(*own)).alias("c")).select("node", *columns, "c.code", "c.key")
    sizes = keyed.groupBy("code", "key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    # Keys of one fingerprint alone fall away here; the rest is cut into pieces by a hash.
    pieces = F.ceil(F.col("n_rows") / PIECE).cast("long")
    met = keyed.join(sizes, ["code", "key"]).withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("node"), "pieces"))
    return met.select("key", "code", "pieces", "own", "node", *columns)


def _tasks(met: DataFrame, columns: list[str]) -> DataFrame:
    """(key, code, pair, side, node, columns): each two pieces of a key meet."""
    other = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    pair = F.transform(other, lambda o: F.struct((F.least(o, F.col("own")) * F.col("pieces") + F.greatest(o, F.col("own"))).alias("pair"), (o < F.col("own")).cast("long").alias("side")))
    return met.select("key", "code", "node", *columns, F.explode(pair).alias("p")).select("key", "code", "p.pair", "p.side", "node", *columns)


def _dealt(tasks: DataFrame) -> DataFrame:
    return tasks.repartition("key", "code", "pair").sortWithinPartitions("key", "code", "pair")


def near_links(rows: DataFrame, words: list[str], keys: list[Column], radius: int, agree: int = 2) -> DataFrame:
    """(a, b): links between nodes that connect all that are within the radius and agree on so many of ``keys``.

    ``rows`` has a column node and the fingerprints' ``words``. Not each link is listed, but each component is.
    """
    tasks = _tasks(_meeting(rows, words, keys, agree), words)
    return _dealt(tasks).mapInArrow(_grouped_links(radius), "a bigint, b bigint").distinct()


def far_apart(prints: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Distances of each fingerprint to ``count`` of them, each pivot the one farthest from those before it."""
    out, nearest, at = [], np.full(len(prints), 1 << 14, np.int16), 0
    for _ in range(min(count, len(prints))):
        out.append(np.bitwise_count(prints ^ prints[at]).sum(1, dtype=np.int16))
        nearest = np.minimum(nearest, out[-1])
        at = int(nearest.argmax())
        if not nearest[at]:
            break
    return np.stack(out, 1)


_CODES = list(combinations(range(ORDERS), 2))
#: Of each set of agreeing orders, as bits, the first of its pairs: only there the two texts are compared.
_FIRST = np.array([next((k for k, (x, y) in enumerate(_CODES) if bits >> x & bits >> y & 1), -1) for bits in range(1 << ORDERS)])


class Group:
    """Rows that share a key, or two pieces of them: columns node, label, n, fingerprint, smallest hashes; and sets."""

    def __init__(self, columns: np.ndarray, sets: list[np.ndarray]):
        self.node, self.n = columns[:, 0], columns[:, 2]
        self.tree = np.unique(columns[:, 1], return_inverse=True)[1]
        self.prints = np.ascontiguousarray(columns[:, 3 : 3 + WIDE]).view(np.uint64)
        self.least = columns[:, 3 + WIDE :]
        # For each shingle the rows that have it.
        self.begins = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), np.diff(self.begins))[np.argsort(self.ids, kind="stable")]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(self.ids))])

    def shared(self, i: int) -> np.ndarray:
        """How many shingles each row shares with row i."""
        own = self.ids[self.begins[i] : self.begins[i + 1]]
        sizes = self.lists[own + 1] - self.lists[own]
        at = np.repeat(self.lists[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.owners[at], minlength=len(self.node))


def alike(group: Group, code: int, split: int | None = None, tally: Counter | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between near copies that connect all that this group connects, labels taken for connected.

    With ``split``, rows from that place on are another piece, and only pairs across are looked at. A pair is looked
    at under the first of its common keys. Pairs whose distances to a pivot differ by more than the radius are
    discarded; of the others fingerprints are compared, and what is within the radius is verified by shared shingles.
    ``tally`` counts each.
    """
    (part, whole), tree, n = ALIKE, group.tree, len(group.node)
    far = far_apart(group.prints)
    other, out = np.ascontiguousarray(far.T), []
    for begin in range(0, n if split is None else split, 64):
        end = min(begin + 64, n if split is None else split)
        rows = np.arange(begin, end)
        possible = (np.arange(n) > rows[:, None]) if split is None else np.broadcast_to(np.arange(n) >= split, (len(rows), n)).copy()
        possible &= tree[rows][:, None] != tree
        pairs = int(possible.sum())
        for k in range(len(other)):
            possible &= np.abs(far[rows, k : k + 1] - other[k]) <= WIDE_RADIUS
        x, y = np.nonzero(possible)
        apart = np.bitwise_count(group.prints[rows[x]] ^ group.prints[y]).sum(1, dtype=np.int16)
        near = (apart <= WIDE_RADIUS) & (whole * np.minimum(group.n[rows[x]], group.n[y]) >= part * np.maximum(group.n[rows[x]], group.n[y]))
        if tally is not None:
            tally.update(pairs=pairs, compared=len(x), near=int(near.sum()))
        x, y = x[near], y[near]
        agree = ((group.least[rows[x]] == group.least[y]) << np.arange(ORDERS)).sum(1)
        here = _FIRST[agree] == code
        x, y = x[here], y[here]
        cuts = np.searchsorted(x, np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            i, js = int(rows[k]), y[cuts[k] : cuts[k + 1]]
            js = js[tree[js] != tree[i]]
            if not len(js):
                continue
            both = group.shared(i)[js]
            js = js[whole * both >= part * (group.n[i] + group.n[js] - both)]
            trees, first = np.unique(tree[js], return_index=True)
            out += [(i, j) for j in js[first].tolist()]
            if len(trees):
                tree[np.isin(tree, trees)] = tree[i]
    return out


def _grouped_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, pair), then code, side, the columns of ``Group`` and hashes."""
    key, numbers, sets = None, [], []

    def solve() -> pa.RecordBatch:
        table = np.concatenate(numbers)
        order = np.argsort(table[:, 1], kind="stable")
        split = int((table[:, 1] == 0).sum())
        pairs = []
        if len(order) > 1 and split:
            group = Group(table[order, 2:], [sets[i] for i in order.tolist()])
            pairs = alike(group, int(table[0, 0]), split if split < len(order) else None)
            pairs = [(int(group.node[i]), int(group.node[j])) for i, j in pairs]
        columns = list(zip(*[(min(p), max(p)) for p in pairs])) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([np.asarray(c) for c in batch.columns[:-1]], 1)
        cuts = [0, *(np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(1)) + 1).tolist(), len(table)]
        hashes = batch.column(batch.num_columns - 1)
        for a, b in zip(cuts, cuts[1:]):
            if key is not None and (table[a, :2] != key).any():
                yield solve()
                numbers, sets = [], []
            key = table[a, :2]
            numbers.append(table[a:b, 2:])
            sets += [np.frombuffer(hashes[i].as_buffer(), np.uint64) for i in range(a, b)]
    if numbers:
        yield solve()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                hashes = shingle_set(text, size)
                if len(hashes):
                    nodes.append(_digest(hashes))
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def shingle_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the rows (doc_id, place) that are wanted, and of a few more: no text is shuffled for it."""
    marked = with_mark(placed(documents), bitmaps(wanted, "doc_id", "place"), "doc_id", "place")
    return marked.where("_marked").select("text").mapInArrow(_sets(size), "node bigint, hashes binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, whole = ALIKE
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(whole * both >= part * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (a, b) whose sets of shingles are alike."""
    pairs = small_or_shuffled(pairs)
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_alike, "a bigint, b bigint")


def small_or_shuffled(pairs: DataFrame, rows: int = 200_000) -> DataFrame:
    """Pairs of numbers with a broadcast hint, if they are so few."""
    return F.broadcast(pairs) if pairs.limit(rows + 1).count() <= rows else pairs


def _together(least: DataFrame, words: list[str], keys: list[Column]) -> DataFrame:
    """(key, code, pieces, own, node, words): each node under each pair of ``keys`` that another node has too.

    Only numbers of keys and nodes meet to find that out; fingerprints follow for the nodes that are left.
    """
    pairs = [F.xxhash64(F.lit(k), keys[x], keys[y]) for k, (x, y) in enumerate(_CODES)]
    keyed = least.select("node", "n", F.posexplode(F.array(*pairs)).alias("code", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_shingles")).where("n_rows > 1")
    pieces = F.greatest(F.ceil(F.col("n_rows") / PIECE), F.ceil(F.col("n_shingles") / PIECE_SHINGLES)).cast("long")
    met = keyed.join(sizes, "key").select("key", F.col("code").cast("long").alias("code"), "node", pieces.alias("pieces"))
    return met.join(least.select("node", *words), "node").select("key", "code", "pieces", F.pmod(F.xxhash64("node"), "pieces").alias("own"), "node", *words)


def _led(met: DataFrame) -> DataFrame:
    """(a, b): of each node the nearest of its keys' leaders that is within the radius.

    A leader is a key's smallest node: minima are taken before the shuffle, and a node takes part in one pair only.
    """
    prints = [f"p{k}" for k in range(WIDE)]
    part, whole = ALIKE
    leaders = met.groupBy("key").agg(F.min(F.struct("node", "n", *prints)).alias("l"))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"l.{p}"))) for p in prints), F.lit(0))
    near = met.join(leaders, "key").where(F.col("node") != F.col("l.node")).withColumn("apart", apart)
    near = near.where((F.col("apart") <= WIDE_RADIUS) & (whole * F.least("n", "l.n") >= part * F.greatest("n", "l.n")))
    best = near.groupBy("node").agg(F.min(F.struct("apart", F.col("l.node").alias("leader"))).alias("m"))
    return best.select(F.least("node", "m.leader").alias("a"), F.greatest("node", "m.leader").alias("b")).distinct()


def alike_components(least: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """(node, root) of all nodes that links between near copies reach.

    ``least`` has a row of ``wide_fingerprints`` for each node. Every pair of a key within the radius is verified,
    except those of texts that are in one component already.
    """
    words = ["n", *[f"p{k}" for k in range(WIDE)], *[f"m{k}" for k in range(ORDERS)]]
    met = written(_together(least, words, [F.col(f"m{k}") for k in range(ORDERS)]), "met")
    wanted = least.select("doc_id", "place", "node").join(met.select("node").distinct(), "node", "left_semi")
    sets = written(shingle_sets(documents, wanted, size).dropDuplicates(["node"]), "sets")
    led = written(verified(written(_led(met), "led"), sets), "alike")
    groups = components(led)
    rows = met.join(groups, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    # A key whose nodes are all connected has nothing to say.
    open_keys = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rows = rows.join(open_keys, "key", "left_semi").join(sets, "node")
    tasks = _tasks(rows, ["label", *words, "hashes"]).select("key", "pair", "code", "side", "node", "label", *words, "hashes")
    found = tasks.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_grouped_alike, "a bigint, b bigint")
    return components(led.union(found))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b): the smallest node that it reaches, by alternating large and small stars.

    Each round hangs the neighbours of a node on the smallest of them. Minima are pre-aggregated and joins on a hub
    are left to skew splitting; every round is a table of its own, so a lost executor costs one round.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: each larger neighbour of a node goes to the smallest of its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        # Small star: each smaller neighbour, and the node itself, goes to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = written(small, "small")
        # Done when every node has one smaller neighbour, and none of those has one itself.
        roots = small.select(F.col("b").alias("a")).distinct()
        if small.join(roots, "a", "left_semi").isEmpty() and small.groupBy("a").count().where("count > 1").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


def near_components(documents: DataFrame, size: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, print, component_id) of each row; component_id is the smallest id that links reach.

    A row without an id takes part like any other, and its component's id is null only if no row of it has one.
    Repeated rows and ids stay.
    """
    prints = written(fingerprints(documents, size), "prints")
    least = written(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "least")
    agree = agreeing(least.count(), radius)
    keys = [F.col("node").bitwiseAND(F.lit(signed(m))) for m in blocks(radius, agree)]
    groups = components(near_links(least.select(F.col("print").alias("node"), F.col("print").alias("p0")), ["p0"], keys, radius, agree))
    rooted = least.join(groups, least["print"] == groups["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def one_of_each(documents: DataFrame, size: int = 5) -> DataFrame:
    """The documents without near copies: of each component one row, that of the smallest id.

    Texts are near copies if they share at least 0.8 (ALIKE) of their different ``size``-word shingles. Of repeated
    rows, equal in id and text, the least by all columns stays; different texts under one id are judged each by itself. Rows without an
    id, and texts without words, are no copies of anything: they stay.
    """
    prints = written(wide_fingerprints(documents, size), "wide")
    first = F.min(F.struct("doc_id", "place")).alias("first")
    least = prints.groupBy("node").agg(first, *[F.min(c).alias(c) for c in prints.columns[3:]]).select("node", "first.*", *prints.columns[3:])
    least = written(least, "least")
    groups = alike_components(least, documents, size)
    rooted = least.join(groups, "node", "left").select("doc_id", "place", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "place")).alias("k")).select("k.doc_id", "k.place", F.lit(True).alias("kept"))
    rows = prints.groupBy("doc_id", "place").agg(F.count("*").alias("rows")).join(kept, ["doc_id", "place"], "left")
    touched = written(rows.where("kept is null or rows > 1").select("doc_id", "place", F.coalesce("kept", F.lit(False)).alias("kept")), "touched")
    # What may go, or is repeated, is settled by an exact join; most texts can't be and aren't moved.
    texts = documents.withColumns({"_doc": F.col("doc_id").cast("long"), "_place": F.xxhash64("text")})
    marked = with_mark(texts, bitmaps(touched, "doc_id", "place"), "_doc", "_place")
    right = touched.select(F.col("doc_id").alias("_d"), F.col("place").alias("_p"), F.col("kept").alias("_kept")).hint("shuffle_hash")
    doubtful = marked.where("_marked and _doc is not null").join(right, (F.col("_doc") == F.col("_d")) & (F.col("_place") == F.col("_p")), "left")
    stay = marked.where("not _marked or _doc is null").select(*documents.columns).union(doubtful.where("_kept is null").select(*documents.columns))
    # Of rows that are equal in id and text the least by their other columns, so that it is always the same one.
    least_row = F.min(F.struct(*[F.col(c) for c in documents.columns])).alias("row")
    repeated = doubtful.where("_kept").groupBy("_doc", "_place").agg(least_row).select("row.*")
    return stay.union(repeated)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``. Null, empty and blank texts have fingerprint zero, which is
    linked like any other; each row of an id is one of its own, and rows without an id are no component's smallest."""
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
