"""The contracts written out row by row in plain Python, slow and simple: what the operators are compared with."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op2(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def op2_ratios(text: str | None) -> dict[str, float]:
    n, chars, symbols, dup, repeats, _ = op2(text)
    lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    return {"mean_word_chars": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": repeats / max(n, 1), "upper_share": upper / max(chars, 1), "words": float(n)}


def kept_by_rules(text: str | None, rules: list) -> bool:
    """The verdict of a decision list, condition by condition."""
    own = op2_ratios(text)
    hit = any(all(own[c.feature] > c.threshold if c.above else own[c.feature] <= c.threshold for c in r.conditions) for r in rules)
    return not op2(text)[5] and not hit


def without_near_copies(rows: list[tuple[int, str]]) -> set[int]:
    """Ids that stay: of texts that share 0.8 of their five-word shingles, directly or by others, the smallest."""
    sets = {}
    for d, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d for d in ids if find(d) == d}


def fingerprint(text: str | None, size: int = 4) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op3(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    ids, root = [i for i, _ in rows], list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (f"{int(prints[i]):016x}", least[find(i)]) for i, d in enumerate(ids)}


def op4_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def op4(rows: list[tuple], items: list[tuple]) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        words = op4_words(text)
        for i in range(max(1, len(words) - 9)) if words else ():
            windows[tuple(words[i : i + 10])].update(() if item is None else {str(item)})
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in rows:
        words, hit, found = op4_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                own = windows.get(tuple(words[i : i + n]))
                if own is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def matches(rows: list[tuple], items: list[tuple], within: int) -> set:
    """Every occurrence of a window, and every place of its rarest term that has all its other terms nearby."""
    windows = defaultdict(set)
    for item, text in items:
        words = op4_words(text)
        for i in range(max(1, len(words) - 9)) if words else ():
            windows[tuple(words[i : i + 10])].add(item)
    often = defaultdict(int)
    for w in windows:
        for t in set(w):
            often[t] += 1
    out = set()
    for window, own in windows.items():
        rarest = min(set(window), key=lambda t: (often[t], t.encode()))
        for doc, text in rows:
            words, found = op4_words(text), []
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    found.append(("phrase", k, k + len(window)))
            for p in [k for k, w in enumerate(words) if w == rarest]:
                nearest = [min((abs(q - p), q) for q, w in enumerate(words) if w == t) if t in words else (within + 1, 0) for t in set(window) - {rarest}]
                if all(apart <= within for apart, _ in nearest):
                    places = [p, *[q for _, q in nearest]]
                    found.append(("near", min(places), max(places) + 1))
            out |= {(doc, *f, str(item)) for f in found for item in own}
    return out


def op5_kept(rows: list[tuple]) -> dict:
    where = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            where[line.strip(BLANKS).translate(LOWER)].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(BLANKS).translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, keys) if not (len(k) >= 20 and len(where[k]) >= 3 and max(where[k]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def op5(rows: list[tuple]) -> dict:
    return {d: (n, gone, sha(kept)) for d, (n, gone, kept) in op5_kept(rows).items()}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def op6(text: str | None) -> tuple:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    spans = [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]
    return *[sum(s[0] == k for s in spans) for k in kinds], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9(url: str | None) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None
