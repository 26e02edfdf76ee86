"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash."""

import pickle
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from inkspan.llm import bpe, decontaminate, lines, lm, pii, quality, rules, simhash, toxicity, urls
from inkspan.llm.common import pick

from . import brute

LONG = "lorem ipsum dolor " * 20_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (6, "a line that is long enough\nb"), (7, "a line that is long enough \nB"), (8, "A line that is long enough"), (None, "a line that is long enough"), (9, "éé 你好 \x0b x"), (9, "other text of nine")]


@pytest.fixture
def odd(docs):
    """Odd rows with columns that operators use as names of their own."""
    df = docs(ODD)
    for name in ("n_words", "score", "print", "component_id", "kept", "words", "TEXT2", "label", "row", "sig"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_text(df, *names):
    return [(r["doc_id"], *[r[n] for n in names]) for r in df.collect()]


def test_pick_takes_one_of_equal_names(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "doc_id int, text string, Text string, x string").toDF("doc_id", "text", "Text", "text")
    assert pick(df, "doc_id", "text").collect()[0]["text"] == "a"


def test_rules(spark, odd):
    got = sorted(by_text(rules.judge(pick(odd, "doc_id", "text"), []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), key=str)
    assert got == sorted([(d, *brute.op2(t)) for d, t in ODD], key=str)


def test_rules_on_windows(spark, docs):
    texts = ["a b c a b c", "a a a", "a a a a", "a b a b a b", "x y z", "x y", "a b c d a b c", "p q p q"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.with_stats(docs(texts)).collect()}
    assert got == {i: brute.op2(t)[4] for i, t in enumerate(texts)}


@pytest.mark.parametrize("place", [1, 58])
def test_windows_that_a_short_hash_takes_for_one(spark, docs, monkeypatch, place):
    """With one bit for places no text fits, with six for hashes different windows get one key."""
    monkeypatch.setattr(rules, "_PLACE", place)
    texts = ["a b c a b c", "a b c d e f", "q " * 40, "a b c d e a b c d " * 9, " ".join(f"w{i} v{i % 5} u{i % 3}" for i in range(60)) + " a b c x w1 v1 u1 y a b c"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.with_stats(docs(texts)).collect()}
    assert got == {i: brute.op2(t)[4] for i, t in enumerate(texts)}


def test_decision_list_learns_a_threshold():
    base = dict.fromkeys(rules.FEATURES, 0.0)
    rows = [(base | {"symbols_per_word": i / 100, "words": float(i % 7)}, int(i < 70)) for i in range(100)]
    (rule,) = rules.learn(rows)
    assert rule.conditions[0].feature == "symbols_per_word" and 0.69 <= rule.conditions[0].threshold <= 0.70
    assert rules.learn([]) == [] and rules.learn([(base, 1)] * 9) == []


def test_simhash(odd):
    got = sorted(by_text(simhash.near_components(odd), "print"), key=str)
    assert got == sorted([(d, simhash.signed(brute.fingerprint(t))) for d, t in ODD], key=str)
    roots = {(d, c) for d, c in by_text(simhash.near_components(odd), "component_id")}
    assert {(1, 1), (2, 1), (3, 1), (5, 5)} <= roots


def test_links_join_what_a_double_loop_joins():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 7), dtype=np.uint64)) for c in centre for _ in range(8)]
    prints = np.unique(np.array([*centre, *near], np.uint64))[:, None]

    def groups(pairs):
        root = list(range(len(prints)))
        for i, j in pairs:
            a, b = [next(r for r in iter_root(root, x)) for x in (i, j)]
            root[max(a, b)] = min(a, b)
        return [next(iter_root(root, i)) for i in range(len(root))]

    def iter_root(root, i):
        while root[i] != i:
            i = root[i]
        yield i

    all_pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (int(prints[i, 0]) ^ int(prints[j, 0])).bit_count() <= 4]
    assert groups(simhash.links(prints, None, 4).tolist()) == groups(all_pairs)
    half = len(prints) // 2
    across = simhash.links(prints[:half], prints[half:], 4)
    assert groups([*across.tolist(), *simhash.links(prints[:half], None, 4).tolist(), *(simhash.links(prints[half:], None, 4) + half).tolist()]) == groups(all_pairs)


@pytest.mark.parametrize("agree", [3, 4])
def test_longer_keys_lose_no_pair(spark, docs, monkeypatch, agree):
    monkeypatch.setattr(simhash, "agreeing", lambda n, radius: agree)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(0, 80, 2)]
    assert {d: c for d, c in by_text(simhash.near_components(docs(rows)), "component_id")} == {d: w[1] for d, w in brute.op3(rows).items()}
    assert simhash.blocks(4, agree)[-1] >> 63 and sum(simhash.blocks(4, agree)) == (1 << 64) - 1


def test_keys_grow_with_the_number_of_fingerprints():
    assert [simhash.agreeing(n, 4) for n in (10, 10**6, 10**9, 10**10, 10**12, 10**13)] == [2, 2, 2, 3, 4, 4]


def test_hot_keys_are_cut_up(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(0, 60, 2)]
    rows = list(enumerate(texts))
    got = {d: c for d, c in by_text(simhash.near_components(docs(rows)), "component_id")}
    assert got == {d: w[1] for d, w in brute.op3(rows).items()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(2, 41)}, 101: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(odd):
    got = sorted(by_text(lines.with_kept_lines(pick(odd, "doc_id", "text"), lines.dropped_lines(odd), digest_only=True), "n_lines", "n_dropped", "kept_sha256"), key=str)
    whole = [(d, t) for d, t in ODD if d is not None]
    want = [(None, 1, 0, brute.sha("a line that is long enough"))]
    for d, t in whole:
        alone = brute.op5([x for x in whole if x[0] != d] + [(d, t)])
        want.append((d, *alone[d]))
    assert got == sorted(want, key=str)


def test_lines_over_many_partitions(spark, docs):
    common = "this very common line is everywhere"
    rows = [(i, f"{common}\nown line number {i} which is unique\n{common.upper()}  ") for i in range(300)] + [(i, f"shared by few documents {i // 3}") for i in range(300, 360)]
    got = {d: (a, b, c) for d, a, b, c in by_text(lines.with_kept_lines(docs(rows, 12), lines.dropped_lines(docs(rows, 12)), digest_only=True), "n_lines", "n_dropped", "kept_sha256")}
    assert got == brute.op5(rows)


def test_a_block_of_two_million_words_is_small_in_a_worker(tmp_path):
    """What travels to every executor: under 300 MB once it is unpacked, whatever the words."""
    r = np.random.default_rng(1)
    names = [f"w{i:07d}".encode() for i in range(400_000)]
    lengths = np.full(20_000, 100, np.int64)
    block = decontaminate.Items(names, r.integers(0, len(names), 2_000_000).astype(np.int32), lengths, [f"item {i}" for i in range(len(lengths))], 10)
    assert len(block.windows) == 20_000 * 91 and block.items_of(0) and (block.sizes == 10).all()
    path = tmp_path / "block"
    path.write_bytes(pickle.dumps(block, 5))
    size = "int(re.search(r'VmHWM:\\s+(\\d+)', open('/proc/self/status').read())[1])"
    code = f"import pickle, re, sys; import inkspan.llm.decontaminate; a = {size}; x = pickle.load(open(sys.argv[1], 'rb')); print({size} - a)"
    grown = int(subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, check=True).stdout)
    assert grown < 300_000


def test_windows_of_a_block_are_those_of_its_items():
    """Repeated windows and items, short and empty items, items without an id."""
    r = random.Random(4)
    texts = [(r.choice(["a", "b", None]), [r.choice([b"x", b"y", b"z"]) for _ in range(r.choice([0, 1, 3, 4, 5, 9]))]) for _ in range(60)]
    names = [b"z", b"x", b"y"]
    block = decontaminate.Items(names, np.array([names.index(w) for _, t in texts for w in t], np.int32), np.array([len(t) for _, t in texts], np.int64), [o for o, _ in texts], 4)
    want = {}
    for owner, t in texts:
        for i in range(max(1, len(t) - 3)) if t else ():
            want.setdefault(tuple(t[i : i + 4]), set()).update([owner] if owner else [])
    ordered = sorted(names)
    got = {tuple(ordered[k] for k in block.window_of(i)): set(block.items_of(i)) for i in range(len(block.windows))}
    assert got == want and len(block.windows) == len(want)
    often = Counter(w for t in want for w in set(t))
    for i in range(len(block.windows)):
        assert ordered[block.rarest[i]] == min({ordered[k] for k in block.window_of(i)}, key=lambda w: (often[w], w))
    filed = [block.filed[block.filed_from[t] : block.filed_from[t + 1]].tolist() for t in range(3)]
    assert sorted(sum(filed, [])) == list(range(len(want))) and all(block.rarest[i] == t for t, own in enumerate(filed) for i in own)
    assert block.numbers([b"y", b"", b"zz", b"x"]).tolist() == [1, -1, -1, 0]


def test_a_kept_index_serves_later_benchmarks_without_texts(spark, docs, tmp_path):
    rows = docs(["a b c d e f g h i j k", "one two three", "x a b c d e f g h i j", None, ""])
    first = spark.createDataFrame([("p", "a b c d e f g h i j"), ("q", "two three")], "item_id string, text string")
    second = spark.createDataFrame([("r", "b c d e f g h i j k"), ("s", "one")], "item_id string, text string")
    path = str(tmp_path / "index")
    index = decontaminate.positional_index(rows, path)
    again = spark.read.parquet(path)
    for benchmark in (first, second):
        want = sorted(map(tuple, decontaminate.contamination(rows, benchmark).drop("items").collect()), key=str)
        assert sorted(map(tuple, decontaminate.contamination(None, benchmark, index=index).drop("items").collect()), key=str) == want
        assert sorted(map(tuple, decontaminate.contamination(None, benchmark, index=again).drop("items").collect()), key=str) == want
        assert sorted(map(tuple, decontaminate.matches(None, benchmark, within=3, index=again).collect())) == sorted(map(tuple, decontaminate.matches(rows, benchmark, within=3).collect()))


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem"), (2, "one"), (3, None), (4, ""), (2, "one"), (None, "x")], "item_id long, text string")
    got = sorted(by_text(decontaminate.contamination(odd, items), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), key=str)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    assert got == sorted([(d, *brute.op4([(d, t)], rows)[d]) for d, t in ODD], key=str)
    assert (9, 6, 2, 0) not in got and any(g[0] == 9 and g[2] and not g[3] for g in got)
    none = decontaminate.contamination(odd, items.limit(0))
    assert none.count() == len(ODD) and none.where("contaminated").count() == 0
    assert decontaminate.without_matches(odd, items).where("doc_id in (4, 5)").count() == 0


def test_blocks_of_items_meet(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(30)], "item_id long, text string")
    rows = docs([" ".join(f"w{j}" for j in range(60)), "w1 w2 w3", None])
    whole = sorted(map(tuple, decontaminate.contamination(rows, items).drop("items").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    assert sorted(map(tuple, decontaminate.contamination(rows, items).drop("items").collect())) == whole


def test_proximity(spark, docs):
    rows = docs(["alpha beta gamma", "gamma x alpha y beta", "alpha " + "z " * 30 + "beta gamma", None])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = decontaminate.matches(rows, items, within=4).collect()
    assert sorted((r["doc_id"], r["kind"], r["begin"], r["end"]) for r in found) == [(0, "near", 0, 3), (0, "phrase", 0, 3), (1, "near", 0, 5)]


def test_matches_are_those_of_all_windows(spark, docs):
    words = "the of and to in is was for on that by this with from they we say her she or".split()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words[: 3 + i % 4], 60)) for i in range(25)]
    items = [(i, " ".join(rng.choice(words[:4], 10 if i % 2 else 4))) for i in range(40)] + [(99, texts[3][:70])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for partitions in (1, 5):
        found = decontaminate.matches(docs(texts, partitions), table, within=6).collect()
        assert {(r["doc_id"], r["kind"], r["begin"], r["end"], r["item_id"]) for r in found} == brute.matches(list(enumerate(texts)), items, 6)
        assert {r["kind"] for r in found} == {"phrase", "near"}


def test_pii(odd):
    assert sorted(by_text(pii.op6_digest(odd), "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), key=str) == sorted([(d, *brute.op6(t)) for d, t in ODD], key=str)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+-1 9(_é", max_size=40))
def test_pii_spans_are_the_patterns_spans(text):
    found = pii.find_spans(text)
    for kind, i in zip(pii.BASE_KINDS, range(4)):
        assert sum(s[0] == kind for s in found) == brute.op6(text)[i]
    assert brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k in pii.BASE_KINDS)) == brute.op6(text)[4]


def test_pii_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, 123-45-6789 alone far away from any of the words")]
    assert kinds.count("iban") == 1 and kinds.count("ssn") >= 1
    assert pii.find_spans("tel " + "9" * 50_000 + "." * 10) is not None


LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())
AUTOMATON = bpe.Automaton(bpe.default_vocabulary())


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aabe lotrsin'\n\t  <|>endoftext", max_size=60)))
def test_bpe_is_the_librarys(text):
    own = LIBRARY.encode(text, add_special_tokens=False).ids
    ids = AUTOMATON.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == own
    assert AUTOMATON.decode(ids) == LIBRARY.decode(own, skip_special_tokens=False)


def test_bpe_on_every_kind_of_character_and_long_words():
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xA700), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    texts = ["a" + p + " b" + p + p for p in points] + ["ab" * 3000, "z" * 5000, "<|endoftext|>x<|endoftext|>", " " * 300 + "x", "don't WE'LL"]
    for text, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(AUTOMATON.encode(text), "<u4").tolist() == e.ids, repr(text[:20])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(256)], max_size=40))
def test_both_engines_cut_latin_texts_alike(text):
    assert AUTOMATON.latin_words.findall(text) == AUTOMATON.words.findall(text)


def test_words_that_were_remembered_before_are_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Automaton(bpe.default_vocabulary())
    for text in ["one two three four five six one two", "seven one nevora two", "one two three"] * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 3 and len(own.before) <= 3


def test_bpe_of_odd_rows(odd):
    got = sorted(by_text(bpe.round_trip(odd), "n_tokens", "decoded_sha256"), key=str)
    assert got == sorted([(d, len(LIBRARY.encode(t or "", add_special_tokens=False).ids), brute.sha(t or "")) for d, t in ODD], key=str)
    assert sorted(by_text(bpe.decoded(bpe.encoded(odd)), "text"), key=str) == sorted([(d, t or "") for d, t in ODD], key=str)


def test_urls(spark):
    rows = ["http://A.Com/en/x", "x://example.com/en/71?q", "http://com", "http://net/de/", "https://a.example.net/de/80#x", "no url", "", None, "http://org?x/es/", "http://www.spam-farm.example.org/x", "a://b://net/de/", "http://xcom/en/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    for i, u in enumerate(rows):
        host, path, rule, verdict = brute.op9(u)
        assert got[i] == (host, path, rule, verdict or ("block" if i == 9 else "allow")), u
    assert urls.judge(df.limit(0)).count() == 0 and urls.judge(df, [], []).where("verdict = 'block'").count() == 0


def test_urls_of_very_many_labels_and_hosts_from_a_table(spark):
    long = "http://" + "a." * 100_000 + "com/en/x"
    df = spark.createDataFrame([(1, long), (2, "http://x.bad.org/"), (3, "http://.../en/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, blocked=spark.createDataFrame([("bad.org",), (None,)], "host string")).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "allow")}
    host = long[7:-5]
    assert len(list(urls._candidates(host, "/en/x", 3, [0, 4]))) == 6


def test_url_digests_confirm_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda key: 7)
    (tmp_path / "i").write_bytes(urls.build_index([("a/x", "block", True), ("b/y", "allow", True)]))
    index = urls.DigestArray(str(tmp_path / "i"))
    assert [[e[2] for e in own] for own in index.probe(["a/x", "b/y", "c/z"])] == [["a/x"], ["b/y"], []]


def test_a_list_of_very_many_hosts(spark, monkeypatch):
    """Many shards, made by Spark; the driver sees them one at a time, and each host is found again."""
    monkeypatch.setattr(urls, "SHARD_ENTRIES", 5_000)
    n = 200_000
    hosts = spark.range(n).selectExpr("concat('Host', id * 7919 % 1000003, '.example.org') AS host")
    pages = hosts.selectExpr("row_number() over (order by host) AS page_id", "concat('http://www.', host, '/x') AS url").where("page_id % 50 = 0")
    pages = pages.union(spark.createDataFrame([(-1, "http://host5.example.com/"), (-2, "http://xhost0.example.org/")], "page_id long, url string"))
    got = urls.judge(pages, blocked=hosts).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": n // 50, "allow": 2}


def test_a_text_of_two_words_weighs_shapes_as_longer_ones_do():
    """A word that occurs twice: its shape counts twice, whether or not there are three words."""
    places, values = quality.features(b"ab ab")
    shapes, counts = {}, {}
    for text in (b"ab ab", b"ab ab c1 ab"):
        p, v = quality.features(text)
        shapes[text] = dict(zip(p.tolist(), v.tolist()))
    assert len(places) == len(set(places.tolist())) and all(x > 0 for x in values)
    shape = quality._mixed(np.array([quality._shape(b"ab")], np.uint64) + np.uint64(1 << 33))[0] % np.uint64(quality.BUCKETS - 2) + np.uint64(2)
    other = quality._mixed(np.array([quality._shape(b"c1")], np.uint64) + np.uint64(1 << 33))[0] % np.uint64(quality.BUCKETS - 2) + np.uint64(2)
    assert shapes[b"ab ab"][int(shape)] == 1.0
    assert shapes[b"ab ab c1 ab"][int(shape)] == pytest.approx(3 * shapes[b"ab ab c1 ab"][int(other)])


def test_quality_and_toxicity_of_odd_rows(spark, odd):
    for labels in (labelled(spark, []), labelled(spark, [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (7, 0, 1), (8, 1, 0)])):
        q = quality.scored(odd, quality.fit(odd, labels, rows=100)).collect()
        t = toxicity.scored(odd, *toxicity.fit(odd, labels, rows=100)).collect()
        assert len(q) == len(t) == len(ODD) and all(0 <= r["score"] <= 1 for r in [*q, *t])


def test_a_lexicon_of_many_letters_and_of_letters_beyond_16_bits():
    han = [chr(0x4E00 + 3 * i) + chr(0x5E00 + 2 * i) + chr(0x6E00 + i) for i in range(120)]
    deseret = "".join(chr(0x10428 + i) for i in range(6))
    m = toxicity.Matcher(toxicity.Lexicon((*han, deseret), ()))
    f = m.features([f"x {han[77]} y", deseret, deseret[:3] + deseret[4:], han[0][:2]])
    assert f[:, 0].tolist() == [1, 1, 0, 0] and f[:, 2].tolist() == [0, 0, 1, 0]


def test_words_of_a_stem_are_caught_misspelled_inside_it():
    m = toxicity.Matcher(toxicity.Lexicon(("chllano",), ("chlla",)))
    f = m.features(["chllano", "chxlano", "chlano"])
    assert f[:, 1].tolist() == [1, 0, 0] and f[:, 2].tolist() == [0, 1, 1]


def test_word_order_makes_features_and_scores_are_plain_dot_products(spark, docs):
    texts = ["alpha beta gamma delta", "delta gamma beta alpha", None, "", "x", "x y", "a b c a b c a b c " * 40]
    a, b = (dict(zip(*(x.tolist() for x in quality.features(t.encode())))) for t in texts[:2])
    assert a != b and len(set(a) & set(b)) < len(a)
    weights = np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs(texts), weights).collect()}
    for i, t in enumerate(texts):
        total = 0.0
        for p, v in zip(*quality.features(t.encode() if t else None)):
            total += float(weights[p]) * float(v)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)


def test_follow_leader_is_the_published_update(monkeypatch):
    """Against the update written out weight by weight."""
    monkeypatch.setattr(quality, "BUCKETS", 12)
    rng = np.random.default_rng(1)
    rows = [(int(i % 3 == 0), np.sort(rng.permutation(12)[:4]), rng.random(4)) for i in range(30)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.5
    z, n = [0.0] * 12, [0.0] * 12

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for k in order.permutation(30).tolist():
            y, p, v = rows[k]
            w = [weight(i) for i in p]
            chance = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, v))))
            for i, x, own in zip(p, v, w):
                g = (chance - y) * x
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * own
                n[i] += g * g
    assert quality.follow_leader(rows, 2, alpha, beta, l1, l2) == pytest.approx([weight(i) for i in range(12)])


def test_toxicity_scores_are_the_model_written_out(spark, docs):
    lexicon, w = toxicity.Lexicon(("idiot", "scum"), ("chlla",)), [-3.0, 2.0, 1.0, 1.0, 0.5, -1.5]
    texts = ["you idiot scum", "an idot", "clean text here", None, 'he said "scum"', "chllax " * 5]
    for r in toxicity.scored(docs(texts), lexicon, w).collect():
        own = r["words"] + 0.5 * r["fuzzy"]
        x = [1, np.log1p(own), np.log1p(r["stems"]), np.log1p((own + r["stems"]) * 100 / max(r["n_words"], 1)), np.log1p(r["address"]), np.log1p(r["quoted"])]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x)))))


def test_fuzzy_matches_are_those_of_edit_distance():
    """Every word within one edit of the lexicon, and no other."""
    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = ("abcab", "bcabca", "cabbage")
    m, rng = toxicity.Matcher(toxicity.Lexicon(words, ())), np.random.default_rng(4)
    for w in words:
        for _ in range(150):
            t = list(w)
            for _ in range(rng.integers(0, 3)):
                i = rng.integers(0, len(t) + 1)
                t[i : i + rng.integers(0, 2)] = rng.choice(list("abcx"), rng.integers(0, 2)).tolist()
            t = "".join(t)
            if t:
                f, least = m.features([t])[0], min(apart(t, x) for x in words)
                assert (f[0], f[2]) == (least == 0, least == 1), t


def test_misspelled_and_quoted_words():
    m = toxicity.Matcher(toxicity.Lexicon(("idiot", "scum"), ("chlla",)))
    texts = ["you IDIOT", "an idot here", "idiiot ixiot xidiot", "idxoxt", "scun", "chllaxyz", "idiots", 'he said "idiot" once', None, "", "didiotx"]
    f = m.features(texts)
    assert f[:, 0].tolist() == [1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0] and f[:, 1].tolist() == [0] * 5 + [1] + [0] * 5
    assert f[:, 2].tolist() == [0, 1, 3, 0, 0, 0, 1, 0, 0, 0, 0] and f[0, 3] == 1 and f[7, 4] == 1


def test_two_texts_of_one_id_are_judged_each_by_itself(docs):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    got = sorted(r["text"] for r in simhash.one_of_each(docs([(7, one), (7, two), (7, two), (8, two + " more"), (9, one)])).collect())
    assert got == [one, two]


def test_pivots_rule_out_what_is_far():
    """Sixteen groups of near fingerprints: pivots discard most pairs of different groups and none within the radius."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (16, simhash.WIDE), dtype=np.uint64)
    flips = np.packbits(rng.random((320, 64 * simhash.WIDE)) < 0.07, axis=1).view(np.uint64)
    prints = np.repeat(centres, 20, 0) ^ flips
    rows = np.column_stack([np.arange(320), np.arange(320), np.full(320, 100), prints.view(np.int64)])
    tally = simhash.Counter()
    # Sets of 100 shingles: rows of one group share 90 of them, under keys of which the first two agree.
    sets = [np.unique(np.concatenate([np.arange(90) + 1000 * (i // 20), 10**6 + np.arange(10) + 10 * i])).astype(np.uint64) for i in range(320)]
    rows = np.column_stack([np.arange(320), np.arange(320), np.full(320, 100), prints.view(np.int64), np.zeros((320, 2), np.int64), np.arange(320 * 4).reshape(-1, 4)])
    for split in (None, 100):
        group = simhash.Group(rows, sets)
        links = simhash.alike(group, 0, split, tally)
        assert all(i // 20 == j // 20 for i, j in links)
        if split is None:
            apart = np.bitwise_count(prints[:, None] ^ prints).sum(2)
            assert len(np.unique(group.tree)) == 16 and all(apart[i, j] <= simhash.WIDE_RADIUS for i, j in links)
            assert tally["compared"] < 0.25 * tally["pairs"]
    assert simhash.alike(simhash.Group(rows, sets), 1) == []


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from inkspan.llm import common

    class Nothing:
        def get(self, *_):
            return None

        def isDefined(self):
            return False

    class Session:
        conf = Nothing()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Nothing)

            class _jsc:
                @staticmethod
                def sc():
                    return type("C", (), {"getCheckpointDir": staticmethod(Nothing)})

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_marks_miss_nothing(spark):
    from inkspan.llm.common import bitmaps, with_mark

    every = spark.range(20_000).withColumn("x", F.col("id") * 3)
    out = with_mark(every, bitmaps(every.where("id < 2000"), "id", "x"), "id", "x")
    assert out.where("id < 2000 and not _marked").count() == 0 and out.where("id >= 2000 and _marked").count() < 50
    assert with_mark(every, bitmaps(every.limit(0), "id", "x"), "id", "x").where("_marked").count() == 0


def test_lm_base_and_sums(spark, docs):
    rows = [(i, t) for i, t in enumerate(["a b a", "b c", None, "", "A  b\nnew", "zz top", "a " * 50, "b"] * 4)]
    got = {r["doc_id"]: r for r in lm.score_documents(docs(rows)).collect()}
    import math
    import zlib
    from collections import Counter

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    toks = {d: [w.lower() for w in brute.WORD.findall(t or "")] + ["<end>"] for d, t in rows}
    counts = Counter(w for d in toks if not held[d] for w in toks[d])
    total, kinds = sum(counts.values()), len(counts)
    for d, own in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)) and r["score"] < 0
    assert lm.score_documents(docs([(d, t) for d, t in rows if held[d]])).where("train_tokens = 0 and base_score = 0").count() == sum(held.values())


def test_lm_counts_of_rare_words_and_odd_rows(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 2)
    monkeypatch.setattr(lm, "WORDS", 2)
    rows = [(i, f"w{i % 5} w{i % 3} common") for i in range(40)]
    few = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm.score_documents(docs(rows)).collect()}
    monkeypatch.undo()
    all_known = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in lm.score_documents(docs(rows)).collect()}
    assert few.keys() == all_known.keys() and all(few[d] == pytest.approx(all_known[d]) for d in few)
    assert lm.score_documents(odd).count() == len(ODD)


def small_vocabulary(words=30):
    names = [f"w{i}".encode() for i in range(words)]
    kinds = {}
    for i, w in enumerate(names):
        n, m = kinds.get(lm.kind_of(w), (0, 0))
        kinds[lm.kind_of(w)] = (n + 40 - i, m + 1)
    return lm.Vocabulary(names, np.arange(40, 40 - words, -1), sum(range(41 - words, 41)) + 9, words + 1, 9, kinds)


def test_lm_gradients_and_probabilities():
    v = small_vocabulary()
    net = lm.Network(v)
    h = lm.with_one([np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)])
    size = len(v.own) + lm.KINDS
    logs, _ = net.heads(np.repeat(h, size, 0), np.arange(size))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4) and v.mass.tolist() == [1] * lm.KINDS
    # The states' gradients are those that differences of the mean log-likelihood show.
    goal, many = np.arange(8), np.repeat(h, 8, 0)
    net.to_class += np.random.default_rng(1).normal(0, 0.3, net.to_class.shape).astype(np.float32)
    net.to_word += np.random.default_rng(2).normal(0, 0.3, net.to_word.shape).astype(np.float32)
    _, back = net.heads(many, goal, {})
    moved = many.copy()
    moved[:, 3] += 1e-2
    differences = -(net.heads(moved, goal)[0] - net.heads(many, goal)[0]) / 1e-2 / 8
    assert back[:, 3] == pytest.approx(differences, abs=2e-3)
    net = lm.Network(v)
    stream = np.tile([0, 1, 2, 3, 4], 4001)[:20_001]
    before = net.score([np.array([1, 2, 3, 4, 0])])[0]
    assert net.train(stream) <= 20_000
    assert net.score([np.array([1, 2, 3, 4, 0])])[0] > before + 5
    docs = [np.array(x) for x in ([1, 2, 0], [0], [4] * 80 + [0], [3, 0])]
    assert net.score(docs).tolist() == pytest.approx([net.score([d])[0] for d in docs], rel=1e-4)


def test_lm_probabilities_of_all_words_sum_to_one(spark, docs, monkeypatch):
    """Of one-word texts, over every word that training texts hold and one unseen of each kind."""
    monkeypatch.setattr(lm, "WORDS", 4)
    monkeypatch.setattr(lm, "FREQUENT", 9)
    rows = docs([(i, f"w{i % 29} w{i % 7} é{i % 3} x") for i in range(120)])
    texts = pick(rows, "doc_id", "text")
    counts = lm.token_counts(texts)
    v = lm.vocabulary(counts)
    words = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert all(r["k"] == lm.kind_of(bytes(r["word"])) for r in counts.withColumn("k", lm._kind()).collect())
    total = lm.Network(v).heads(lm.with_one([np.zeros((len(v.own) + lm.KINDS, lm.HIDDEN), np.float32)]), np.arange(len(v.own) + lm.KINDS))[0]
    inside = np.zeros(lm.KINDS)
    for w, n in words.items():
        if w not in v.own:
            inside[lm.kind_of(w)] += (n + 1) / v.mass[lm.kind_of(w)]
    inside += 1 / v.mass
    assert inside == pytest.approx(np.ones(lm.KINDS)) and np.exp(total).sum() == pytest.approx(1, abs=1e-4)


def test_lm_counts_the_end_beside_many_words_of_one_occurrence(spark, docs):
    import math
    import zlib

    train = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2)
    r = lm.score_documents(docs([(train, " ".join(f"w{i}" for i in range(140_000)))])).head()
    assert r["n_known"] == r["n_tokens"] == 140_001 and r["base_score"] == pytest.approx(140_001 * math.log10(2 / (140_001 + 140_001 + 1)))


def test_lm_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 300)
    rows = [(i, f"word{i % 7} and word{i % 3} follow word{i % 5}" * (1 + i % 4)) for i in range(200)]
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_documents(docs(rows, n)).collect()} for n in (2, 7))
    assert a.keys() == b.keys() and all(a[d] == pytest.approx(b[d], rel=1e-5) for d in a)


def test_lm_memory_of_short_texts_is_bounded():
    """200,000 texts of ten tokens in one group: SIDE of them are in a window at once."""
    import tracemalloc

    net, rng = lm.Network(small_vocabulary()), np.random.default_rng(0)
    texts = [np.append(x, 0) for x in rng.integers(0, 30, (200_000, 9))]
    tracemalloc.start()
    net.score(texts)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_empty_tables(spark, docs):
    none, labels = docs([]), labelled(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.scored(none, quality.fit(none, labels)).count() == 0 and rules.judge(pick(none, "doc_id", "text"), rules.fit(none, labels)).count() == 0
    assert simhash.near_components(none).count() == 0 and simhash.one_of_each(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0 and lines.with_kept_lines(none, lines.dropped_lines(none)).count() == 0
    assert pii.personal_data(none).count() == 0 and lm.score_documents(none).count() == 0 and bpe.round_trip(none).count() == 0
    assert toxicity.scored(none, *toxicity.fit(none, labels)).count() == 0


def test_stages_keep_columns_on_odd_rows(spark, odd, tmp_path):
    sf = str(tmp_path)
    odd.write.parquet(f"{sf}/documents.parquet")
    labelled(spark, [(5, 1, 0)]).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == list(cp.COLUMNS) and out.count() >= 0
    assert cp.simhash_dedup(spark, df, sf).where("doc_id = 5").count() == 1 and cp.simhash_dedup(spark, df, sf).where("doc_id is null").count() == 1


def test_near_copies_are_verified_by_their_shingles(docs, monkeypatch):
    """Of 100 shingles and more, k changed at the end: shares on both sides of 0.8, and a chain of them."""
    words = [f"w{i}" for i in range(104)]
    other = [f"o{i}" for i in range(104)]

    def share(k):
        return " ".join([*words[: 104 - k], *[f"x{k}_{i}" for i in range(k)]])

    # (100 - k) / (100 + k): 11 of 100 is 0.80, 12 is 0.786, 17 is 0.709.
    assert simhash.one_of_each(docs([(1, share(0)), (2, share(11))])).count() == 1
    for k in (12, 13, 15, 17):
        assert simhash.one_of_each(docs([(1, share(0)), (2, share(k))])).count() == 2, k
    # A repeated line weighs no more than its shingles: the texts share 5 of 205.
    rows = [(1, "a b c d e " * 500 + " ".join(words)), (2, "a b c d e " * 500 + " ".join(other))]
    assert simhash.one_of_each(docs(rows)).count() == 2
    # Many rounds and pieces find the same groups as all pairs do.
    texts = [(100 * g + k, " ".join([*[f"g{g}_{i}" for i in range(60)], *[f"v{g}_{k}_{i}" for i in range(3 + k % 9)]])) for g in range(3) for k in range(25)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in texts}
    root = {d: d for d in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    for piece in (4096, 7):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert {r["doc_id"] for r in simhash.one_of_each(docs(texts)).collect()} == set(root.values())


def test_all_training_texts_reach_the_network(spark, docs, monkeypatch):
    """Each replica tells how many tokens it was made to predict: together, all that were counted."""
    monkeypatch.setattr(lm, "PART_TOKENS", 100)
    rows = docs([(i, f"word{i % 7} and word{i % 3} follow word{i % 5}") for i in range(200)])
    texts = pick(rows, "doc_id", "text")
    v = lm.vocabulary(lm.token_counts(texts))
    seen, whole = [], lm.written

    def noted(df, name):
        out = whole(df, name)
        if name == "replicas":
            seen.extend(r["n"] for r in out.collect())
        return out

    monkeypatch.setattr(lm, "written", noted)
    lm.fit(lm.encoded(texts, spark.sparkContext.broadcast(v)), v)
    assert len(seen) > 9 and sum(seen) == v.total
