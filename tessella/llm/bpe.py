"""Byte pair encoding by a tokenization automaton, and decoding from its arc labels.

``Automaton`` compiles the merge list by successive merge gadgets. At first one state has an arc to itself for every
base symbol. The rule (u, v) -> uv then splits the state that u arcs lead to: u arcs now lead to a copy without the arc
v, and every state with an arc u gets an arc uv to where v led. After the last rule exactly the paths that the merges
produce are left: the automaton is deterministic, and each word has one path.

All arcs of one label lead to one state, so the table is kept as: label -> target state, state -> (parent state, arc
taken away, rank). Whether a state still had an arc when a later rule needed it is answered by the ranks. These two
tables hold all transitions; written out by state and label they would be some hundred times as large, and few are
ever used. Encoding walks a word from its start. At each place it looks up the labels that spell what comes next, the
longest first, and takes the first whose arc leaves the state reached, as a second table (state's label, label) says, in
which each transition is entered when it is first asked for. A place from which no arc goes on is dead, once and for all,
since a prefix has one path; so a word takes time in proportion to its length times the length of the longest label.

Words recur, so a worker keeps a bounded dictionary of encoded words. The operator is a map without shuffles.

Defined results for odd input: a null text counts as empty and gives no tokens and an empty decoded text; repeated rows
are encoded each; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded words that a worker keeps.
KEPT_WORDS = 400_000
#: White space as Unicode defines it, fixed values.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 as it is, the rest from U+0100 on, in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Automaton:
    """The merge rules of one vocabulary as a deterministic automaton over token labels."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.target: dict[str, int] = dict.fromkeys(base, 0)  # label -> state its arcs lead to
        self.left: dict[str, str] = {}  # merged label -> the label it grew from, to follow a first part down
        self.rank: dict[str, int] = {}
        self.states: list[tuple[int, str, int]] = [(-1, "", -1)]  # parent, arc taken away, rank of the rule
        for k, (u, v) in enumerate(merges):
            self._gadget(k, u, v)

    def _gadget(self, k: int, u: str, v: str) -> None:
        if u not in self.target or v not in self.target or u + v in self.target:
            return
        q = self.target[u]
        if not self._has(q, v):
            return
        self.target[u + v] = self.target[v]  # for u = v the unsplit state: a third u may follow the pair
        self.left[u + v], self.rank[u + v] = u, k
        self.states.append((q, v, k))
        self.target[u] = len(self.states) - 1

    def _has(self, state: int, label: str) -> bool:
        """Whether the arc ``label`` leaves ``state``: no label on its way down was taken away before it was needed."""
        spine, need = {}, 1 << 60
        at: str | None = label
        while at is not None:
            spine[at] = need
            need, at = self.rank.get(at, -1), self.left.get(at)
        while state > 0:
            parent, gone, rank = self.states[state]
            if rank <= spine.get(gone, -1):  # equal for u = v: the copy has no u, so it gets no pair either
                return False
            state = parent
        return True

    def compile(self, end: str) -> None:
        """The transition tables: labels by what they spell inside a word and at its end, answers by pair of labels."""
        self.number = {label: k for k, label in enumerate(self.target)}
        self.names = list(self.target)
        self.inner = {x: k for x, k in self.number.items() if not (end and x.endswith(end) and len(x) > len(end))}
        self.final = {x[: len(x) - len(end)]: k for x, k in self.number.items() if x.endswith(end) and len(x) > len(end)}
        self.longest = max(max(map(len, self.inner), default=1), max(map(len, self.final), default=1))
        self.table: dict[int, bool] = {}

    def _step(self, last: int, label: int) -> bool:
        """Whether ``label`` leaves the state that ``last`` leads to (looked up once, then from the table)."""
        if len(self.table) > 2_000_000:
            self.table.clear()
        known = self.table[last << 24 | label] = self._has(self.target[self.names[last]], self.names[label])
        return known

    def path(self, word: str) -> list[int]:
        """The labels of the one path that spells ``word``, whose last symbol carries the end mark.

        Arcs are tried from the longest; a place from which no arc goes on is dead, since only one path leads to it.
        """
        n, inner, final, table, longest, step = len(word), self.inner, self.final, self.table, self.longest, self._step
        path: list[int] = []
        places = [0]
        dead = set()
        length = min(n, longest)
        while True:
            j = places[-1]
            found = -1
            while length > 0:
                i = j + length
                k = (final.get(word[j:]) if i == n else inner.get(word[j:i])) if i not in dead else None
                if k is not None and (not path or (ok if (ok := table.get(path[-1] << 24 | k)) is not None else step(path[-1], k))):
                    found = k
                    break
                length -= 1
            if found >= 0:
                path.append(found)
                if i == n:
                    return path
                places.append(i)
                length = n - i if n - i <= longest else longest
            else:
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                dead.add(j)
                places.pop()
                path.pop()
                length = j - places[-1] - 1


class WordCoder:
    """The rules of a word-end vocabulary file: normal form, word pattern, special strings, automaton."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        base = [s + e for s in self.symbols for e in {"", self.end} if s + e in self.ids]
        self.automaton = Automaton(base, [tuple(m) for m in model["merges"]])
        self.automaton.compile(self.end)
        self.number = [self.ids[x] for x in self.automaton.names]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE)).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.labels = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.known: dict[str, bytes] = {}
        self.spelled: dict[bytes, str] = {}

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # such bytes stand for themselves
        path = self.automaton.path(word if plain else "".join([self.symbols[b] for b in word.encode()]))
        ids = [self.number[k] for k in path]
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
            self.spelled.clear()
        out = self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _normal(self, text: str) -> str:
        """Normal form and lower case. Runs of white space need not be made one: no word holds any."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # case is mapped without regard to a word's end

    def encode(self, text: str) -> list[bytes]:
        """The ids of each word in turn, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.specials(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                known, word = self.known, self._word
                out += [known.get(w) or word(w) for w in self.words(self._normal(part))]
        return out

    def decode(self, ids: list[bytes]) -> str:
        """Labels of the arcs in order; the file names no decoder, so the labels are joined by single spaces."""
        spelled, out = self.spelled, []
        for x in ids:
            s = spelled.get(x)
            if s is None:
                s = spelled[x] = " ".join([self.labels[i] for i in struct.unpack(f"<{len(x) // 4}I", x)])
            out.append(s)
        return " ".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def encoder(path: str):
    """Texts to (ids, decoded text)."""

    @F.pandas_udf("struct<ids: array<int>, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for texts in batches:
            ids = [c.encode(t) for t in texts.fillna("")]
            flat = [list(struct.unpack(f"<{sum(map(len, x)) // 4}I", b"".join(x))) for x in ids]
            yield pd.DataFrame({"ids": flat, "decoded": [c.decode(x) for x in ids]})

    return run


def digester(path: str):
    """Texts to (n_tokens, digest of the ids, digest of the decoded text), computed where the ids are."""

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, sha = coder(path), hashlib.sha256
        for texts in batches:
            rows = []
            for t in texts.fillna(""):
                ids = c.encode(t)
                flat = b"".join(ids)
                rows.append((len(flat) // 4, sha(flat).hexdigest(), sha(c.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ids and the decoded text of every whole text."""
    return docs.select(*keep, encoder(path or default_path())(F.col(text)).alias("_e")).select(*keep, "_e.ids", "_e.decoded")


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    done = docs.select("doc_id", digester(path or default_path())(F.col("text")).alias("_e"))
    return done.select("doc_id", "_e.n_tokens", "_e.ids_sha256", "_e.decoded_sha256")
