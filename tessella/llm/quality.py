"""Quality rules: a threshold table compiled into one projection of built-in functions.

No user function runs: every metric is a Catalyst expression over the row's own text, so the operator is a map
without any shuffle and scales with the number of input splits.

Defined results for odd input: a null text counts as an empty one; an empty text has no words and fails the base
rules; equal rows are judged each on its own; an empty table gives an empty table. Columns of the input are carried
by ``apply_rules`` only when named in ``keep``, so clashing names in the input do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BLANKS, let, words_of

#: Fixed value: the symbols that count against a text.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "the of and to in a is that for it on was with as be by this at are or an from "
    "le la les de des et un une en que qui dans pour est au du sur pas plus avec "
    "der die das und den von zu mit ist im des dem ein eine nicht auf sich als auch für "
    "el los las del y que un una por con para es se su lo como más al"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text fails when ``metric`` is below ``least`` or above ``most``; a null bound does not apply."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The table that is compiled. Ratios are per word, per code point in words, or per line with a word.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.5, most=14.0),
    Rule("symbols", "symbols_per_word", most=0.25),
    Rule("shouting", "bangs_per_word", most=0.25),
    Rule("capitals", "upper_share", most=0.4),
    Rule("stop_words", "stop_share", least=0.01),
    Rule("repeated_lines", "dup_line_share", most=0.5),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash within one text. Only texts with a repeated hash are sorted; positions of
    repeated windows are then summed up with overlaps counted once, so the cost stays linearithmic for any text.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(a: Column) -> Column:
            again = F.filter(
                a,
                lambda x, k: F.coalesce(F.get(a, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(a, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        return F.aggregate(
            let(ordered, positions),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")
            ),
            lambda acc: acc["n"],
        )

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n > WINDOW, found).otherwise(F.lit(0))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The metrics of every whole text, beside the columns named in ``keep``."""
    source = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: _without(x, BLANKS) > 0)
    base = docs.select(*keep, source.alias("_text"), words_of(F.col(text)).alias("_words"))
    counted = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        _without(F.col("_text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        (F.length("_text") - _without(F.col("_text"), "!")).alias("_bangs"),
        (F.length("_text") - _without(F.col("_text"), UPPER)).alias("_upper"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).alias("_stops"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    n = F.col("n_words")
    return counted.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("_lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), n).alias("symbols_per_word"),
        ratio(F.col("_bangs"), n).alias("bangs_per_word"),
        ratio(F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        ratio(F.col("_stops"), n).alias("stop_share"),
        ratio(F.col("_lines.dup"), F.col("_lines.n")).alias("dup_line_share"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One column: the names of the rules that a measured row breaks."""
    broken = []
    for r in rules:
        low = F.col(r.metric) < F.lit(r.least) if r.least is not None else F.lit(False)
        high = F.col(r.metric) > F.lit(r.most) if r.most is not None else F.lit(False)
        broken.append(F.when(low | high, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, broken rules and verdict of every row."""
    measured = measure(docs, text, keep)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), compile_rules(rules).alias("broken"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    The verdict passes through a generator, because a filter on it would be moved below the projection and every metric
    would be computed anew for each of its uses.
    """
    others = [c for c in docs.columns if c != text]  # in a struct, where no name clashes with a metric's
    packed = docs.select(F.struct(F.lit(0), *others).alias("_row"), F.col(text).alias("_body"))
    judged = apply_rules(packed, "_body", keep=("_row", "_body"), rules=rules)
    good = judged.select("_row", "_body", F.explode_outer(F.array("kept")).alias("_stays")).filter("_stays")
    return good.select(*[(F.col("_body") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])


#: DuckDB SQL of the same projection; ``{rel}`` is the relation of documents.
SQL = """
with w as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from {rel}
), l as (
  select *, row_number() over () as rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w
), g as (
  select rid, i, list_aggregate(w[i:i+7], 'string_agg', ' ') as win
  from (select rid, w, unnest(range(1, greatest(len(w) - 6, 1)::bigint)) as i from l)
), r as (
  select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from g) where c > 1
), rep as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from r) group by rid
), m as (
  select l.doc_id, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(rep.n, 0)::bigint as n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) as bangs,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) as uppers,
         len(list_filter(w, lambda x: list_contains([{stops}], lower(x)))) as stops,
         len(ls) as n_lines
  from l left join rep using (rid)
), v as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    case when n_words > 0 then word_chars / n_words::double else 0 end as mean_word_chars,
    case when n_words > 0 then n_symbols / n_words::double else 0 end as symbols_per_word,
    case when n_words > 0 then bangs / n_words::double else 0 end as bangs_per_word,
    case when word_chars > 0 then uppers / word_chars::double else 0 end as upper_share,
    case when n_words > 0 then stops / n_words::double else 0 end as stop_share,
    case when n_lines > 0 then n_dup_lines / n_lines::double else 0 end as dup_line_share
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed{rules}) as kept
from v
"""


def sql(rel: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    tests = "".join(
        "".join([f" and {r.metric} >= {r.least}" if r.least is not None else "", f" and {r.metric} <= {r.most}" if r.most is not None else ""])
        for r in rules
    )
    stops = ", ".join("'" + s + "'" for s in sorted(set(STOP_WORDS)))
    return SQL.replace("{rel}", rel).replace("{rules}", tests).replace("{stops}", stops)


def op7(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
