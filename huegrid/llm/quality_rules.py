"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a name and a condition under which a document is rejected. A document is kept if no rule rejects it, so the
order of the rules never changes what is kept; it changes what the verdict costs. ``estimated`` evaluates every rule on a
sample: which documents it rejects, and the seconds that it adds to a pass over the sample. ``ordered`` then takes, again
and again, the rule with the most rejections per second among the documents that the rules before it leave. The cascade
is one CASE expression in that order: Spark stops at the first branch that holds, so a document that a cheap rule
rejects never meets the dear ones. Rules over the counts that are returned anyway cost next to nothing.

Words are runs without space, tab, newline, vertical tab, form feed and return. Windows of three words are compared by a
64-bit hash inside their own document.

Defined results: null text has no words and fails the base rules; so does empty text; repeated rows are judged alike and
stay; rows with a null id are judged; an empty table gives no rows (and the order in which the rules were declared);
columns besides doc_id and text are ignored. A text of any length is one row, with memory in proportion to it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huegrid.llm.common import table, written

#: What separates words, and the symbols that are counted.
BLANKS, NO_SYMBOL, NO_CAPITAL = " \t\n\x0b\f\r", r"[^#*$%&|<>]+", r"\P{Lu}+"
#: Frequent words, one of which stands in running text of the four languages.
STOP_WORDS = "the of and to in is der die und zu das ist le la de et les des el los que en las con".split()
#: Least relative cost of a rule: below that, a sample can't tell.
LEAST_SECONDS = 1e-3


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column  # over text and the counts of ``counted``


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float  # that the rule adds to a pass over the sample
    share: float  # of the sample's documents that it rejects
    after: float  # of the documents left by the rules before it in the cascade


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_column(text: Column) -> Column:
    """The words of a text that is not null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three that the text has twice or more."""

    def covered(places: Column) -> Column:
        """Words in windows that start at these ascending places: three each, less what the next one covers, too."""
        own = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        alike = lambda s, x, j: F.coalesce(F.get(s, j)["hash"] == x["hash"], F.lit(False))
        found = lambda s: F.transform(F.filter(s, lambda x, j: alike(s, x, j + 1) | alike(s, x, j - 1)), lambda x: x["at"])
        return _let(F.sort_array(_let(pairs, found)), covered)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(twice(windows))

    def of_hashes(h: Column) -> Column:
        first = F.slice(h, F.lit(1), F.size(h) - 2)
        return _let(F.transform(first, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), of_windows)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    of_words = _let(
        words_column(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")),
    )
    of_lines = _let(_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select("doc_id", text.alias("text"), of_words.alias("w"), of_lines.alias("l"), _left(text, NO_SYMBOL).cast("long").alias("n_symbols"))
    return rows.select("doc_id", "text", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def _left(text: Column, others: str) -> Column:
    """How many characters of the text are left without ``others``."""
    return F.length(F.regexp_replace(text, others, ""))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[Rule]:
    """The rules beside the base ones, by usual heuristics for running text; fractions as whole numbers."""
    n = F.col("n_words")
    share = lambda some, percent, of: 100 * some > percent * of
    def lines(marks: str, holds) -> Column:
        """Lines for which ``holds``; without one of the marks there are none, and they are not looked at."""
        some = reduce(lambda x, y: x | y, (F.contains("text", F.lit(m)) for m in marks.split()))
        return F.when(some, F.size(F.filter(_lines(F.col("text")), lambda x: holds(F.btrim(x, F.lit(BLANKS)))))).otherwise(0)

    return [
        Rule("symbols", share(F.col("n_symbols"), 10, n)),
        Rule("duplicate_lines", share(F.col("n_dup_lines"), 50, F.col("n_lines"))),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("capitals", share(_left(F.col("text"), NO_CAPITAL), 40, F.col("word_chars"))),
        Rule("no_letter_words", share(F.regexp_count("text", F.lit(r"(?:^|\s)[^\s\p{L}]+(?=\s|$)")), 20, n)),
        Rule("stop_words", ~F.regexp_like(F.lower("text"), F.lit(rf"(?:^|\s)(?:{'|'.join(STOP_WORDS)})(?=\s|$)"))),
        Rule("ellipsis_lines", share(lines("... …", lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…"))), 30, F.col("n_lines"))),
        Rule("bullet_lines", share(lines("- * • ●", lambda x: F.substring(x, 1, 1).isin(*"-*•●")), 90, F.col("n_lines"))),
    ]


def sampled(docs: DataFrame, rows: int = 1000, chars: int = 200_000) -> DataFrame:
    """The first documents of at most ``chars`` characters that Spark finds, ``rows`` of them: no pass over the table."""
    few = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    return written(docs.sparkSession.createDataFrame(few.take(rows), few.schema).coalesce(1), "quality-sample")


def estimated(sample: DataFrame, some: Sequence[Rule], runs: int = 2) -> tuple[dict[str, float], list[tuple[frozenset[str], int]]]:
    """Seconds that each rule adds to a pass over the counted sample (the least of ``runs``), and how often each set of rules rejects together."""

    def seconds(*values: Column) -> float:
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            sample.agg(F.count(F.lit(1)), F.max(F.length("text")), *(F.count_if(v) for v in values)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    plain = seconds()
    cost = {r.name: max(seconds(r.rejects) - plain, LEAST_SECONDS) for r in some}
    flags = sample.groupBy(*(F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in some)).count().collect()
    return cost, [(frozenset(r.name for r in some if row[r.name]), row["count"]) for row in flags]


def ordered(cost: dict[str, float], rejected: list[tuple[frozenset[str], int]]) -> list[Estimate]:
    """The rules by rejections per second among what is left, ties in the order given; rules without rejections last, cheap ones first."""
    left, open_, out = rejected, list(cost), []
    total = sum(k for _, k in rejected)
    while open_:
        hit = {name: sum(k for names, k in left if name in names) for name in open_}
        best = max(open_, key=lambda name: (hit[name] / cost[name], -cost[name] if not hit[name] else 0))
        there = sum(k for _, k in left)
        out.append(Estimate(best, cost[best], sum(k for names, k in rejected if best in names) / max(total, 1), hit[best] / max(there, 1)))
        left = [(names, k) for names, k in left if best not in names]
        open_.remove(best)
    return out


def cascade(some: Sequence[Rule], order: Sequence[str]) -> Column:
    """The name of the first rule in this order that rejects, or null; later rules are not evaluated."""
    by, none = {r.name: r for r in some}, F.lit(None).cast("string")
    return reduce(lambda later, name: F.when(by[name].rejects, F.lit(name)).otherwise(later), reversed(order), none)


def judged(docs: DataFrame, some: Sequence[Rule] | None = None, sample_rows: int = 1000, order: Sequence[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by: 'base', or the first rule of the cascade that rejects.

    The order comes from a sample of ``sample_rows`` documents unless it is given; which documents are kept doesn't depend on it,
    while rejected_by names another rule in another order."""
    some = rules() if some is None else list(some)
    if order is None:
        sample = written(counted(sampled(docs, sample_rows)), "quality-counted")
        order = [e.name for e in ordered(*estimated(sample, some))]
    judged_by = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(some, order))
    return (
        counted(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", judged_by)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", F.isnull("rejected_by").alias("kept"), "rejected_by")
    )


def op11_quality_rules(spark, sf_dir) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, range(3) AS r(k) GROUP BY rid
), counts AS (
  SELECT d.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS upper_chars
  FROM d LEFT JOIN covered USING (rid)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * len(lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words
  OR 100 * upper_chars > 40 * word_chars
  OR 100 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 20 * n_words
  OR len(list_intersect(list_transform(words, lambda x: lower(x)), [{_STOP}])) < 1
  OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * len(lines)
  OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•●]'))) > 90 * len(lines)) AS kept
FROM failed
"""
