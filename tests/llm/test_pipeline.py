"""The pipeline's stages against plain Python, each on its own input."""

from tokenizers import Tokenizer

import corpus_pipeline as cp
from inkspan.llm import bpe, rules
from inkspan.llm.common import table

from . import brute
from .conftest import DATA

SF = f"{DATA}/sf0.01"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = (rows_of(docs), rows_of(out))
        docs = out
    before, after = seen["quality rules"]
    assert all(not brute.op2(r["text"])[5] for r in after.values()) and 0 < len(after) < len(before)
    judged = rows_of(rules.judge(table(spark, SF, "documents"), rules.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))))
    assert set(after) == {d for d, r in judged.items() if r["kept"]}

    before, after = seen["line dedup"]
    want = brute.op5([(d, r["text"]) for d, r in before.items()])
    assert {d: brute.sha(r["text"] or "") for d, r in after.items()} == {d: w[2] for d, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())

    before, after = seen["SimHash near-dedup"]
    shingles = {}
    for d, r in before.items():
        words = brute.WORD.findall(r["text"].translate(brute.LOWER))
        shingles[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    missed = lost = near = 0
    where = {}
    for d, s in shingles.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d, s in shingles.items():
        best = 0.0
        others = {o for x in s for o in where[x] if o != d}
        for o in others:
            j = len(s & shingles[o]) / len(s | shingles[o])
            best = max(best, j)
            if j >= 0.8 and d < o:
                near += 1
                missed += d in after and o in after
        if best < 0.8 and d not in after:
            lost += 1
    assert near > 20 and missed <= 0.02 * near and lost == 0, (near, missed, lost)

    before, after = seen["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = brute.op4([(d, r["text"]) for d, r in before.items()], items)
    assert set(after) == {d for d, w in want.items() if not w[4]}

    before, after = seen["BPE encoding and decoding"]
    assert {d: r["decoded_sha256"] for d, r in after.items()} == {d: brute.sha(r["text"]) for d, r in before.items()}


def test_run_is_all_stages_in_plain_python(spark):
    sf = f"{DATA}/sf0.001"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    learned = rules.fit(documents, labels)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if brute.kept_by_rules(r["text"], learned)]
    rows = [(d, kept) for d, (_, _, kept) in brute.op5_kept(rows).items()]
    stay = brute.without_near_copies(rows)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if d in stay]
    hit = brute.op4(rows, items)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = set()
    for d, t in rows:
        if not hit[d][4]:
            ids = library.encode(t, add_special_tokens=False).ids
            want.add((d, len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) > 0
