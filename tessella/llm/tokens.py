"""Token counts of whole texts with overlap resynchronisation for huge ones.

A text of up to ``CHUNK`` code points is encoded at once. A longer one is encoded in chunks that overlap. In the
overlap the two encodings are spliced at a boundary that is proven stable: both encodings have a token boundary there,
the text has one space there after a character that is no space, and no piece of the vocabulary has a space mark after
another character (checked when the model is loaded), so no merge can cross the place and the tokens on either side
depend on their own side only. Where an overlap holds no such place, it is widened until it does; at worst it reaches
back to the last splice, and the text from there is encoded whole.

The work is a map: texts reach the workers in Arrow batches, nothing is shuffled, and a worker keeps one loaded model.

Defined results for odd input: a null text counts as empty and has no tokens; repeated rows are counted each; an empty
table gives an empty table; only the named columns are read, so clashing names in the input do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
MARK = "▁"


class PieceCounter:
    """Counts the tokens of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = "a  b Ａ\t\n c"
        #: Splicing is proven only if no piece crosses into a space and the model's normalizer leaves a text as it is.
        self.stable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.model.decode(self.model.encode(probe)) == probe

    def short(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def _boundaries(self, text: str, at: int) -> tuple[list[int], list[int]]:
        """Where tokens begin, in code points of the whole text, and the index of the token that begins there."""
        begins, index, last = [], [], -1
        lead = np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80
        place = (np.cumsum(lead) - 1).tolist()  # of a byte's code point
        for k, p in enumerate(self.model.encode(text, return_type="proto").pieces):
            if p.begin != last and p.begin < len(place):  # the bytes of one character share a place; the first counts
                begins.append(at + place[p.begin])
                index.append(k)
                last = p.begin
        return begins, index

    def long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if not self.stable:
            return self.short([text])[0]
        n, total, start = len(text), 0, 0  # everything before start is counted
        while n - start > chunk:
            end = start + chunk
            left = dict(zip(*self._boundaries(text[start:end], start), strict=True))
            width, cut = overlap, None
            while cut is None and width < chunk:
                low = end - width
                right = set(self._boundaries(text[low : min(n, end + overlap)], low)[0])
                for p in range(end - 1, low, -1):
                    if text[p] == " " and text[p - 1] != " " and p + 1 < n and text[p + 1] != " " and p in left and p in right:
                        cut = p
                        break
                width *= 2
            if cut is None:
                chunk *= 2  # no stable place in the whole chunk: take a larger one
                continue
            total += left[cut]
            start = cut + 1  # the space becomes the mark that the model puts before a text
        return total + self.short([text[start:]])[0]


class JsonCounter:
    """Counts the tokens of a tokenizers file; its pre-tokenizer already keeps the work of a huge text local."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def short(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def long(self, text: str) -> int:
        return self.short([text])[0]


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | JsonCounter:
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def token_counter(path: str, chunk: int = CHUNK):
    """A vectorized function from texts to token counts. ``path`` is a file that every executor has."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            values = texts.fillna("").tolist()
            out = [0] * len(values)
            short = [k for k, t in enumerate(values) if len(t) <= chunk]
            for i in range(0, len(short), 256):
                part = short[i : i + 256]
                for k, v in zip(part, c.short([values[k] for k in part]), strict=True):
                    out[k] = v
            for k, t in enumerate(values):
                if len(t) > chunk:
                    out[k] = c.long(t)
            yield pd.Series(out, dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    n_bytes: Column = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    counted = docs.select(*keep, n_bytes.alias("n_bytes"), token_counter(path)(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(docs, path)
