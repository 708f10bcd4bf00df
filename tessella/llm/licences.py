"""License scans: which licences a text names or carries, by a positional index of their rare words.

The templates (notices and opening paragraphs of public licences) are indexed once: word -> (template, position), without
the stop words. How many documents hold each indexed word is counted over the whole corpus. A file looks up, for every
template that shares words with it, the template's rarest words that the file has; each place of such a word in the file
votes for the place where the template would begin, and postings that agree on it intersect. A place with enough
different words in agreement is verified: the template's key phrases must stand there word by word, and the share of
its words in place must reach ``COVERAGE``; up to ``DRIFT`` words may have come in or gone before.

Counting is a Spark aggregation of one row a word and task. A file is then scanned where it lies, against an index whose size the
templates bound, so no text and no row is shuffled.

Defined results for odd input: a null or empty text has no words, no labels ('') and the score 0; null and repeated
doc_ids and repeated rows have results of their own; of equal counts the word that comes first is the rarer one; an empty
table gives an empty table. Memory follows one batch of whole texts. Extra columns do not take part.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the contract and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Rarest words of a template that a file looks up, different words that must agree on a place, the share of a
#: template's words that must be in place, words that may have come in or gone, and the score of a name without a notice.
RARE, VOTES, COVERAGE, DRIFT, NAMED = 6, 2, 0.75, 2, 0.5

STOP = frozenset("a an and any as at by for from in is it of on or that the this to under use with you your".split())

#: (label, text, key phrases): notices and opening paragraphs of public licences (fixed values), with words as the scan takes them.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "www apache org licenses license 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license", "version 2 1")),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: What a word is made of: every byte but the ASCII ones other than letters in lower case and digits becomes a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: (offset, words) of each key phrase
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]
    rare: frozenset[bytes]


def _at(words: tuple[bytes, ...], part: tuple[bytes, ...]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(part)] == part)


@lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    out = []
    for label, text, phrases in TEMPLATES:
        w = tuple(words_of(text))
        parts = [tuple(words_of(p)) for p in phrases]
        out.append(Template(label, w, tuple((_at(w, p), p) for p in parts), frozenset(w) - {s.encode() for s in STOP}))
    return tuple(out)


def vocabulary() -> frozenset[bytes]:
    return frozenset().union(*(t.rare for t in templates()))


def document_counts(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many documents each indexed word occurs; as many entries as the templates have words."""
    indexed = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(indexed.intersection(words_of(t)))
        yield pa.record_batch({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    total = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in total.collect()}


@dataclass
class Index:
    """Postings of the indexed words, and the templates' words by rarity."""

    counts: dict[bytes, int]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    rarest: list[list[bytes]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for k, t in enumerate(templates()):
            for i, w in enumerate(t.words):
                if w in t.rare:
                    self.postings.setdefault(w, []).append((k, i))
            self.rarest.append(sorted(t.rare, key=lambda w: (self.counts.get(w, 0), w)))

    def begins(self, words: list[bytes], known: frozenset[bytes]) -> list[tuple[int, int]]:
        """(template, first word) where at least VOTES different words of a template's rarest agree."""
        look_up: dict[bytes, set[int]] = {}
        for k, ranked in enumerate(self.rarest):
            chosen = [w for w in ranked if w in known][:RARE]
            if len(chosen) >= VOTES:
                for w in chosen:
                    look_up.setdefault(w, set()).add(k)
        votes: dict[tuple[int, int], set[bytes]] = {}
        for i, w in enumerate(words) if look_up else ():
            if w in look_up:
                for k, at in self.postings[w]:
                    if k in look_up[w]:
                        votes.setdefault((k, i - at), set()).add(w)
        return [at for at, found in votes.items() if len(found) >= VOTES]

    @staticmethod
    def verified(words: list[bytes], template: Template, begin: int) -> float | None:
        """Share of the template's words in place, if its key phrases stand there and the share is high enough."""
        for at, phrase in template.phrases:
            near = range(max(0, begin + at - DRIFT), begin + at + DRIFT + 1)
            if not any(tuple(words[i : i + len(phrase)]) == phrase for i in near):
                return None
        there = sum(w in words[max(0, begin + i - DRIFT) : max(0, begin + i + DRIFT + 1)] for i, w in enumerate(template.words))
        share = there / len(template.words)
        return share if share >= COVERAGE else None

    def scan(self, words: list[bytes], known: frozenset[bytes]) -> dict[str, float]:
        """label -> best share of the template's words in place."""
        best: dict[str, float] = {}
        for k, begin in self.begins(words, known):
            t = templates()[k]
            if best.get(t.label, 0) < 1 and (share := self.verified(words, t, begin)) is not None:
                best[t.label] = max(share, best.get(t.label, 0))
        return best


def places(words: list[bytes], known: frozenset[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase of the contract stands."""
    found = []
    for phrase, label in PHRASES.items():
        part = phrase.encode().split()
        if known.issuperset(part):
            at = -1
            try:
                while True:
                    at = words.index(part[0], at + 1)
                    if words[at : at + len(part)] == part:
                        found.append((at, label))
            except ValueError:
                pass
    return found


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: words, places of the phrases, labels, score, and the share of each notice's words in place, as JSON."""
    index = Index(document_counts(docs, text))
    indexed = vocabulary() | {w for p in PHRASES for w in p.encode().split()}

    def row(t: str | None) -> tuple:
        words = words_of(t)
        known = indexed.intersection(words)
        base = places(words, known)
        notices = index.scan(words, known)
        named = {label for _, label in base}
        at = [i for i, _ in base]
        score = max([*notices.values(), NAMED if named else 0.0])
        return (
            len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(named)), ",".join(sorted(named | notices.keys())), score,
            json.dumps(notices, sort_keys=True),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
        for b in batches:
            columns = list(zip(*map(row, b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            made = {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}
            yield pa.record_batch({"doc_id": b.column(0), **made})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    return scan_licences(docs).drop("notices")


def sql() -> str:
    """The same relationally: postings as a table, votes by grouping, verification by joins."""
    quoted = lambda w: "'" + w.decode() + "'"
    ts = templates()
    words = ", ".join(f"({k}, {i}, {quoted(w)}, {'true' if w in t.rare else 'false'})" for k, t in enumerate(ts) for i, w in enumerate(t.words))
    names = ", ".join(f"({k}, '{t.label}', {len(t.words)}, {len(t.phrases)})" for k, t in enumerate(ts))
    keys = ", ".join(f"({k}, {n}, {at}, {len(p)}, {i}, {quoted(w)})" for k, t in enumerate(ts) for n, (at, p) in enumerate(t.phrases) for i, w in enumerate(p))
    base = ", ".join(f"({n}, '{label}', {len(p.split())}, {i}, '{w}')" for n, (p, label) in enumerate(PHRASES.items()) for i, w in enumerate(p.split()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t(k, i, w, rare) as (values {words}),
names(k, label, size, n_phrases) as (values {names}),
keys(k, p, o, len, j, w) as (values {keys}),
base(p, label, len, j, w) as (values {base}),
u as (select r, unnest(w) as w, generate_subscripts(w, 1) - 1 as i from d),
v as (select * from u where w in (select w from t union select w from base)),
counts as (select w, count(distinct r) as n from v group by w),
vocab as (select distinct k, w from t where rare),
chosen as (
    select r, k, w from (
        select h.r, vocab.k, vocab.w, row_number() over (partition by h.r, vocab.k order by coalesce(counts.n, 0), vocab.w) as rank, count(*) over (partition by h.r, vocab.k) as n
        from (select distinct r, w from v) h join vocab using (w) left join counts using (w)
    ) where rank <= {RARE} and n >= {VOTES}
),
begins as (
    select r, k, v.i - t.i as b from chosen join v using (r, w) join t using (k, w) where t.rare
    group by all having count(distinct w) >= {VOTES}
),
phrase_hits as (
    select r, k, b, p, x from (
        select b.r, b.k, b.b, keys.p, keys.len, v.i - keys.j as x, keys.j from begins b join keys using (k) join v on v.r = b.r and v.w = keys.w
        where v.i - keys.j between b.b + keys.o - {DRIFT} and b.b + keys.o + {DRIFT} and v.i >= keys.j
    ) group by r, k, b, p, x, len having count(distinct j) = len
),
keyed as (select r, k, b from phrase_hits join names using (k) group by r, k, b, n_phrases having count(distinct p) = n_phrases),
shares as (
    select r, k, b, count(distinct t.i) / any_value(size)::double as share from keyed join t using (k) join names using (k) join v using (r, w)
    where v.i between b + t.i - {DRIFT} and b + t.i + {DRIFT} group by r, k, b
),
notices as (select r, label, max(share) as share from shares join names using (k) where share >= {COVERAGE} group by r, label),
found as (
    select r, label, x from (select v.r, base.p, base.label, base.len, v.i - base.j as x, base.j from v join base using (w) where v.i >= base.j)
    group by r, p, label, len, x having count(distinct j) = len
),
named as (select r, count(*) as n, min(x) as low, max(x) as high, string_agg(distinct label, ',' order by label) as labels from found group by r),
every as (select r, string_agg(label, ',' order by label) as labels from (select r, label from found union select r, label from notices) group by r),
best as (select r, max(share) as share from notices group by r)
select doc_id, len(d.w)::bigint as n_words, coalesce(named.n, 0) as n_base, named.low::bigint as first_word, named.high::bigint as last_word,
    coalesce(named.labels, '') as base_labels, coalesce(every.labels, '') as labels,
    coalesce(greatest(best.share, case when named.n > 0 then {NAMED} else 0.0 end), 0.0)::double as score
from d left join named using (r) left join every using (r) left join best using (r)
"""
