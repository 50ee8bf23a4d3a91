"""Quality rules as a short-circuit cascade.

Each rule rejects a document. On a sample, every rule's rejection share and its cost are measured: each sample row is repeated, so that a
job evaluates the rule many times, and the time of a job without a rule is subtracted. The cascade tries the rules in the order of
rejections per second, and the first that rejects ends the row's evaluation (CASE evaluates lazily). The order changes the cost only: a
document is kept if no rule rejects it. The sample decides nothing else.

Defined results: null or blank texts have no words and fail the base; texts of any length are judged whole; repeated rows each get their row;
an empty table gives an empty result; other columns are ignored. All steps are DataFrame operations within the row: no exchange, so no
group can be too large.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, let, settled, table, words_of

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the rules, about.
SAMPLE_ROWS = 1000
#: Evaluations of a rule for each sample row, runs of which the fastest counts, and seconds of an evaluation below which no clock tells rules apart.
EVALUATIONS, RUNS, LEAST_SECONDS = 40, 2, 2e-6
#: Words of a window whose repeats count.
WINDOW = 5


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _covered(starts: Column) -> Column:
    """Positions covered by windows that begin at the sorted starts."""
    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]


def repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more. Windows with distinct hashes are distinct; only other texts compare the words themselves."""
    last = F.size(words) - WINDOW

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("s"), i.alias("i")))
        same = lambda s, j, e: F.coalesce(F.get(s, j)["s"] == e["s"], F.lit(False))
        starts = lambda s: F.filter(F.transform(s, lambda e, j: F.when(same(s, j - 1, e) | same(s, j + 1, e), e["i"]).otherwise(F.lit(-1))), lambda i: i >= 0)
        return _covered(F.sort_array(let(F.sort_array(windows), starts)))

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    distinct = let(let(F.transform(words, lambda x: F.xxhash64(x)), hashed), lambda x: F.size(F.array_distinct(x)) == F.size(x))
    return F.when(last < 0, F.lit(0)).when(distinct, F.lit(0)).otherwise(let(words, exact))


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds w (words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines to (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"))
    return df.select(
        "doc_id",
        "text",
        "w",
        F.size("w").cast("long").alias("n_words"),
        _length_without(F.col("text"), BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - _length_without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


#: name -> does the rule reject, from the columns of base_columns()
RULES = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    "dup_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "exclamations": lambda: 5 * (F.length("text") - _length_without(F.col("text"), "!")) > 2 * F.col("n_words"),
    "capitals": lambda: _length_without(F.col("text"), LOWER) - _length_without(F.col("text"), UPPER + LOWER) > F.length("text") - _length_without(F.col("text"), LOWER),
    "few_words": lambda: (F.col("n_words") >= 100) & (5 * F.size(F.array_distinct("w")) < F.col("n_words")),
}


def order_rules(based: DataFrame, rules=RULES) -> list[str]:
    """Rules by rejections per second of evaluation on a sample that is already computed up to the base columns."""
    n = max(1, based.count())
    many = based.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(EVALUATIONS))))

    def seconds(rejects: Column) -> tuple[float, int]:
        # the repetition's number enters, so that no evaluation can be shared, and so do all columns, so that every job reads the same
        used = F.xxhash64("_time", *[F.size(c) if c == "w" else F.length(c) if c == "text" else F.col(c) for c in based.columns if c != "doc_id"])
        best, found = math.inf, 0
        for _ in range(RUNS):
            began = time.perf_counter()
            r = many.agg(F.sum(F.when(rejects & (F.col("_time") > 0), 1).otherwise(0)).alias("n"), F.max(used)).first()
            best, found = min(best, time.perf_counter() - began), r["n"] or 0
        return best, found

    seconds(F.lit(False))  # compiles
    idle = seconds(F.lit(False))[0]
    gain = {}
    for name, rule in rules.items():
        took, found = seconds(rule())
        gain[name] = found / EVALUATIONS / n / max(LEAST_SECONDS, (took - idle) / EVALUATIONS / n)
    return sorted(rules, key=lambda r: (-gain[r], r))


def rejected_by(order: list[str], rules=RULES) -> Column:
    """Name of the first rule in the order that rejects, or null; later rules aren't evaluated."""
    out = None
    for name in order:
        out = F.when(rules[name](), F.lit(name)) if out is None else out.when(rules[name](), F.lit(name))
    return out


def judged(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base columns, base_failed and kept for each row of (doc_id, text)."""
    n = docs.count()
    share = min(1_000_000, max(1, round(1_000_000 * sample_rows / max(n, 1))))
    sample = settled(base_columns(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1_000_000)) < share)))
    order = order_rules(sample, rules)
    df = base_columns(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected_by(order, rules).isNull())
    return df.withColumn("kept", kept)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_REMOVE = "translate({0}, '{1}', '')"
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t
), g AS (
  SELECT *, CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) ELSE [] END AS win FROM a
), x AS (SELECT doc_id, unnest(win) AS s, generate_subscripts(win, 1) AS i FROM g),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS p FROM d, range({WINDOW}) r(o)) GROUP BY doc_id),
b AS (
  SELECT g.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(lines) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN c USING (doc_id)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines
  OR 5 * (length(text) - length(translate(text, '!', ''))) > 2 * n_words
  OR len(regexp_extract_all(text, '[A-Z]')) > len(regexp_extract_all(text, '[a-z]'))
  OR (n_words >= 100 AND 5 * len(list_distinct(w)) < n_words)) AS kept FROM f
"""
