"""Quality rules as a short-circuit cascade.

Every rule is a Boolean over measures of the text. The time a rule takes and the share of
rows it rejects are estimated on a sample; the rules then stand by rejections per second. As a filter the cascade is a
filter for each rule, with the measures that it needs, and no rule before, counted just before it: a row
that a rule rejects never comes to the measures of those behind it. The order decides only what
is evaluated: the verdict is that of all rules together.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, without_blanks, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Low bits of a window's key that hold its place; the others hold a hash.
PLACE_BITS = 22


@dataclass(frozen=True)
class Rule:
    """reject: SQL over MEASURES, true for a row that goes (null counts as false)."""

    name: str
    reject: str

    def measures(self) -> list[str]:
        return [m for m in MEASURES if re.search(rf"\b{m}\b", self.reject)]


#: base_failed of the contract is few_words or repeated_words.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", "10 * n_upper > 5 * word_chars"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
)


def _count_of(chars: str) -> Column:
    return F.length("_text") - F.length(F.translate("_text", chars, ""))


def _three(i: Column) -> Column:
    """The window at i. No word holds a blank, so that its words can be joined with one."""
    return F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))


def _covered(places: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def _repeat_words() -> Column:
    """Words in 3-word windows that are in the text twice or more.

    Windows are sorted by key, a hash with the window's place in the low bits; neighbours of equal hash are compared by
    their words. If any of them differ, or the text is so long that places do not fit, windows are sorted by their
    words."""
    low = (1 << PLACE_BITS) - 1
    places = F.sequence(F.lit(0), F.size("_words") - 3)
    place, same = lambda k: k.bitwiseAND(F.lit(low)).cast("int"), lambda x, y: _hash(x) == _hash(y)
    differ = F.exists(F.zip_with("_again", F.slice("_again", F.lit(2), F.size("_again")), lambda x, y: same(x, y) & (_three(place(x)) != _three(place(y)))), lambda b: b)
    by_words = F.sort_array(F.transform(places, lambda i: F.struct(_three(i).alias("w"), i.alias("i"))))
    slow = F.transform(F.filter(by_words, lambda x, k: (F.get(by_words, k - 1)["w"] == x["w"]) | (F.get(by_words, k + 1)["w"] == x["w"])), lambda x: x["i"])
    exact = (F.size("_words") <= low) & ~F.coalesce(differ, F.lit(False))
    return F.when(F.size("_again") == 0, 0).when(exact, _covered(F.transform("_again", place))).otherwise(_covered(slow))


def _hash(key: Column) -> Column:
    return F.shiftrightunsigned(key, PLACE_BITS)


def _again() -> Column:
    """Keys whose hash another one has."""
    none = F.size(F.array_distinct(F.transform("_keys", _hash))) == F.size("_keys")
    return F.when(none, F.array().cast("array<bigint>")).otherwise(F.filter("_keys", lambda x, k: F.coalesce((_hash(x) == _hash(F.get("_keys", k - 1))) | (_hash(x) == _hash(F.get("_keys", k + 1))), F.lit(False))))


def _keys() -> Column:
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    of = lambda h: F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.coalesce(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long")), F.lit(0)))
    # The hashes are made once and held in an array of one element.
    made = F.get(F.transform(F.array(hashes), of), F.lit(0))
    return F.when(F.size("_words") >= 3, F.sort_array(made)).otherwise(F.array().cast("array<bigint>"))


#: Columns that measures share, with what they need.
SHARED = {
    "_words": ((), lambda: words_of(F.col("_text"))),
    "_lines": ((), lambda: F.filter(F.split("_text", "\n"), lambda x: without_blanks(x) != "")),
    "_keys": (("_words",), _keys),
    "_again": (("_words", "_keys"), _again),
}
MEASURES = {
    "n_words": (("_words",), lambda: F.size("_words")),
    "word_chars": ((), lambda: F.length(without_blanks(F.col("_text")))),
    "n_symbols": ((), lambda: _count_of(SYMBOLS)),
    "n_dup_lines": (("_lines",), lambda: F.size("_lines") - F.size(F.array_distinct("_lines"))),
    "n_repeat_words": (("_words", "_keys", "_again"), _repeat_words),
    "n_lines": (("_lines",), lambda: F.size("_lines")),
    "n_upper": ((), lambda: _count_of(UPPER)),
}


def _measured(df: DataFrame, names: list[str]) -> DataFrame:
    """df (_text and measures so far) with the measures of names."""
    for name in (x for n in names for x in (*MEASURES[n][0], n)):
        if name not in df.columns:
            df = df.withColumn(name, SHARED[name][1]() if name in SHARED else MEASURES[name][1]().cast("long"))
    return df


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of docs in one struct, so that no name can clash, and the text."""
    return docs.select(F.struct("*").alias("_row"), text_or_empty().alias("_text"))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512, sample_chars: int = 100_000) -> list[Rule]:
    """The rules by rejections per second on a sample of at most sample_rows texts of at most
    sample_chars each, out of a random share of all rows. Each rule is timed alone, so that its cost is that of the measures it
    needs. Without a row to measure, the rules keep their order."""
    spark = docs.sparkSession
    texts = docs.select("text")
    rows = texts.sample(min(1.0, 32 * sample_rows / max(1, texts.count())), seed=8).where(F.length("text") <= sample_chars).take(sample_rows)
    if not rows:
        return list(rules)
    sample = _rows(spark.createDataFrame(rows, "text string").repartition(2))
    worth = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = _measured(sample, rule.measures()).select(F.sum(F.expr(f"int({rule.reject})"))).first()[0] or 0
        worth[rule.name] = rejected / len(rows) / (time.perf_counter() - began)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of docs in a struct _row, all MEASURES, base_failed, rejected_by (the first rule
    of the cascade that rejects the row, else null) and kept. That every row has every measure is its point; keep_good
    counts only what the cascade needs.

    A null or empty text has no words and is rejected. Rows that repeat are each judged. Very long texts are measured
    whole. An empty table gives an empty result."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order_rules(docs, rules)):
        verdict = F.when(F.expr(rule.reject), F.lit(rule.name)).otherwise(verdict)
    out = _measured(_rows(docs), list(MEASURES)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumn("rejected_by", verdict)
    return out.select("_row", *MEASURES, "base_failed", "rejected_by", (F.col("rejected_by").isNull() & ~F.col("base_failed")).alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns."""
    out = _rows(docs)
    for k, rule in enumerate(order_rules(docs, rules)):
        # Spark does not push a filter below a column that is not deterministic: each rule's measures are counted
        # for the rows that the filters before have left.
        out = _measured(out, rule.measures()).withColumn(f"_at{k}", F.monotonically_increasing_id())
        out = out.where(~F.coalesce(F.expr(rule.reject), F.lit(False)) & (F.col(f"_at{k}") >= 0))
    return out.select("_row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), k AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM k
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, range(0, 3) AS r(j) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_upper > 5 * word_chars OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM m
"""
