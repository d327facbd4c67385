"""Quality rules: a table of thresholds compiled into one Spark projection, evaluated without user functions.

Every measure is a built-in expression over the whole text, in time about linear in its words; nothing is
shuffled.  A rule compares 100 * numerator with threshold * denominator, so that no rounding is involved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import own

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was with on as be by this are from or an at which not have "
    "de la le et les des un une en que du dans qui pour est sur pas au avec par "
    "der die und in den von zu das mit sich ist im ein eine für auf nicht dem "
    "el los las y que se una por con para del su es lo como más"
).split()
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Fails a text when 100 * ``num`` is ``sense`` ("<" or ">") ``percent`` * ``den``."""

    name: str
    num: str
    sense: str
    percent: int
    den: str


#: den "one" makes a rule on a plain count.
BASE_RULES = (
    Rule("too_short", "n_words", "<", 5000, "one"),
    Rule("repeats", "n_repeat_words", ">", 50, "n_words"),
)
METHOD_RULES = (
    Rule("word_too_short", "word_chars", "<", 200, "n_words"),
    Rule("word_too_long", "word_chars", ">", 1500, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 5, "n_words"),
    Rule("dup_lines", "n_dup_lines", ">", 70, "n_lines"),
    Rule("shouting", "n_upper", ">", 40, "word_chars"),
    Rule("exclamations", "n_exclaim", ">", 20, "n_words"),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer does with projections."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _SPACES[1:], " " * 5), " "), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more; overlapping windows count once."""
    n = F.size(words)
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), F.xxhash64(F.get(words, i + 2), w, F.lit(3), F.get(words, i + 1)).alias("g"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])

    covered = lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )
    return _let(F.sort_array(windows), lambda s: covered(F.sort_array(repeated(s))))


def measures(text: str = "text", stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> dict[str, Column]:
    """The measures of a text; null is measured as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    bare = F.translate(t, _SPACES, "")
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    of_words = _let(
        _words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(stop_words))))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "_w": of_words,
        "_l": of_lines,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": without(_SYMBOLS).cast("long"),
        "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_exclaim": without("!").cast("long"),
    }


def _passes(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression from the table of rules."""
    out = F.lit(True)
    for r in rules:
        left, right = F.col(r.num) * 100, F.lit(1) * r.percent if r.den == "one" else F.col(r.den) * r.percent
        out = out & ~(left < right if r.sense == "<" else left > right)
    return out


def apply(df: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """``df`` with the measures, ``base_failed`` and ``kept``.

    Columns of ``df`` that have a measure's name are replaced.  Null text counts as empty and fails the base
    rules; every row, repeated or not, is judged alone; an empty table gives an empty result.
    """
    kinds = ("n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines")
    names = own(df, "w", "l")
    made = df.withColumns({names[k.lstrip("_")] if k in ("_w", "_l") else k: c for k, c in measures(text).items()})
    made = made.withColumns({k: F.col(names["l" if "line" in k else "w"])[k] for k in kinds}).drop(*names.values())
    passed = ~F.col("base_failed") & _passes(method)
    return made.withColumn("base_failed", ~_passes(base)).withColumn("kept", passed)


def result(df: DataFrame) -> DataFrame:
    return apply(df.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle_rule(r: Rule) -> str:
    den = "" if r.den == "one" else f" * {r.den}"
    return f"NOT (100 * {r.num} {r.sense} {r.percent}{den})"


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaim,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, NOT ({" AND ".join(map(_oracle_rule, BASE_RULES))}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(map(_oracle_rule, METHOD_RULES))} AS kept FROM b
"""
