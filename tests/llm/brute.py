"""Plain forms of the operators, for small tables: every pair, every window, and the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def substrings(docs: list[tuple[int | None, str | None]], width: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, digest of what is kept)."""
    least: dict[tuple, int] = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - width + 1) if d is not None else ():
            key = tuple(w[i : i + width])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1) if d is not None else ():
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def lines_removed(docs: list[tuple[int | None, str | None]], t: float = 0.8) -> dict[int | None, str | None]:
    """Texts by doc_id without the lines that an earlier line matches; unique doc_ids."""
    order = sorted(docs, key=lambda x: -(1 << 63) if x[0] is None else x[0])
    seen: dict[frozenset, int] = {}
    sets: list[frozenset] = []
    posting: dict[str, list[int]] = defaultdict(list)
    similar: dict[frozenset, bool] = {}

    def matched(s: frozenset) -> bool:
        common = Counter(k for w in s for k in posting[w])
        return any(5 * c >= 4 * (len(s) + len(sets[k]) - c) for k, c in common.items())

    assert t == 0.8
    out = {}
    for d, text in order:
        if text is None:
            out[d] = None
            continue
        kept = []
        for line in text.split("\n"):
            s = frozenset(words(line))
            if not s:
                kept.append(line)
                continue
            if s in seen:
                continue
            if not (hit := matched(s)):
                kept.append(line)
            similar[s] = hit
            seen[s] = len(sets)
            sets.append(s)
            for w in s:
                posting[w].append(seen[s])
        out[d] = "\n".join(kept)
    return out


def near_classes(docs: list[tuple[int | None, str | None]], t: float = 0.8, width: int = 5) -> dict[int | None, int | None]:
    """doc_id -> smallest doc_id of its class, from the weighted Jaccard similarity of every pair; unique doc_ids."""
    least = {}
    copies = Counter(x or "" for _, x in docs)
    for d, x in sorted(docs, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        least.setdefault(x or "", d)
    texts = list(least)
    bags = []
    for x in texts:
        w = words(x)
        bags.append(Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else []))
    df: Counter = Counter()
    for x, bag in zip(texts, bags, strict=True):
        for s in bag:
            df[s] += copies[x]
    n = len(docs)
    weights = [{s: float(np.float32(c * (1 + 0.5 * math.log(n / df[s]) / math.log(max(n, 3))))) for s, c in bag.items()} for bag in bags]
    parent = list(range(len(texts)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    rank = [-(1 << 63) if least[x] is None else least[x] for x in texts]
    for i, a in enumerate(weights):
        for j in range(i):
            b = weights[j]
            small, large = (a, b) if len(a) < len(b) else (b, a)
            common = sum(min(v, large[s]) for s, v in small.items() if s in large)
            total = sum(a.values()) + sum(b.values()) - common
            if total > 0 and common / total >= t:
                x, y = top(i), top(j)
                low, high = (x, y) if rank[x] < rank[y] else (y, x)
                parent[high] = low
    name = {x: least[texts[top(i)]] for i, x in enumerate(texts)}
    return {d: name[x or ""] for d, x in docs}


def bpe(texts: list[str | None], path: str) -> list[tuple[int, str, str]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = []
    for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        out.append((len(x.ids), sha(struct.pack(f"<{len(x.ids)}I", *x.ids)), sha(t.decode(x.ids, skip_special_tokens=False))))
    return out


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which ``shards`` consecutive runs hold the sizes."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, left = (low + high) // 2, 1, 0
        left = mid
        for s in sizes:
            if s > left:
                used, left = used + 1, mid
            left -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low
