"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once for every document. The ledger keeps what was
measured and one bit a rule (set: the rule fails). A policy is a named, versioned
mask of rules; its verdict and the effect of leaving a rule out come from the
bits alone, without reading a text again. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_GAP, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails``: a SQL condition over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "exclaimed_words", "10 * n_exclaimed > 2 * n_words"),
    Rule(6, "capitals", "10 * n_upper > 5 * word_chars"),
    Rule(7, "stuttered_words", "10 * n_stutter > 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("prose", 1, ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")),
    Policy("prose", 2, tuple(r.name for r in RULES if r.name != "repeated_lines")),
)


def policy(name: str, version: int) -> Policy:
    return next(p for p in POLICIES if (p.name, p.version) == (name, version))


def _length_of(kept: str, text: Column) -> Column:
    """How many characters of ``text`` are among ``kept``."""
    return F.length(text) - F.length(F.translate(text, kept, ""))


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, measurements, failed)``, one row for each row of ``docs``.

    n_repeat_words: the words in windows of 8 words that the text has more than
    once, first occurrences included; windows are compared by a 64-bit hash of
    their words' hashes. Windows are sorted within a document only if it has a
    repeated one. Defined cases: a null text has no words and no lines; null
    doc_ids and repeated rows come back as they came; an empty table gives
    none; other columns are ignored.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    ws = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    measured = ws.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", WORD_GAP, "")).cast("bigint").alias("word_chars"),
        _length_of(SYMBOLS, F.col("t")).cast("bigint").alias("n_symbols"),
        lines.alias("l"),
        _length_of("!", F.regexp_replace("t", "!+", "!")).cast("bigint").alias("n_exclaimed"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    follows = F.filter("h", lambda x, i: (i > 0) & (F.get("h", i - 1) == x))
    starts = F.sequence(F.lit(0), F.size("h") - WINDOW)
    measured = measured.select(
        "*",
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.size(follows).cast("bigint").alias("n_stutter"),
        F.when(
            F.size("h") > WINDOW,
            F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])),
        ).alias("win"),
    ).drop("l", "h")
    twice = F.when(
        F.size("win") > F.size(F.array_distinct("win")),
        F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    measured = measured.withColumn("s", twice).drop("win")
    at = F.sort_array(
        F.transform(
            F.filter(
                "s",
                lambda s, i: (F.get("s", i - 1)["x"] == s["x"]) & (i > 0) | F.coalesce(F.get("s", i + 1)["x"] == s["x"], F.lit(False)),
            ),
            lambda s: s["i"],
        )
    )
    measured = measured.withColumn("at", at).drop("s")
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("at", i - 1)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    measured = measured.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("at")
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES)
    return measured.withColumn("failed", F.expr(bits))


def passes(p: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(p.mask)) == 0


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """``(policy, version, rule, n_failed, n_only, n_kept, n_kept_without)``: for
    each rule of each policy, the documents that fail it, that fail it alone, that
    the policy keeps, and that it would keep without the rule. One aggregate
    over the ledger's bits: documents are counted by their bits first, of which there are
    at most two to the number of rules."""
    counted = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p.name, p.version, r.name, 1 << r.bit, p.mask) for p in policies for r in RULES if r.name in p.rules]
    asked = counted.sparkSession.createDataFrame(rows, "policy string, version int, rule string, bit bigint, mask bigint")
    total = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    pairs = counted.select("failed", "n", F.lit(1).alias("k")).join(F.broadcast(asked.withColumn("k", F.lit(1))), "k")
    return pairs.groupBy("policy", "version", "rule").agg(
        total("failed & bit <> 0").alias("n_failed"),
        total("failed & mask = bit").alias("n_only"),
        total("failed & mask = 0").alias("n_kept"),
        total("failed & (mask & ~bit) = 0").alias("n_kept_without"),
    )


def verdicts(docs: DataFrame, p: Policy | None = None) -> DataFrame:
    """The ledger's base columns, base_failed, and kept by the policy (the
    newest prose policy unless another is given)."""
    p = p or policy("prose", 2)
    book = ledger(docs)
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(p)).alias("kept"),
        "n_lines",
        "n_exclaimed",
        "n_upper",
        "n_stutter",
        F.col("failed").alias("failed_bits"),
    )


_GAP = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '{_GAP}+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM t),
win AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(i - p, 8))) AS c FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM twice) GROUP BY r),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{_GAP}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '!+', '!', 'g')) - length(translate(t, '!', '')) AS BIGINT) AS n_exclaimed,
    CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter
  FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN cov USING (r)
),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & {BASE.mask} <> 0 AS base_failed, failed_bits & {policy("prose", 2).mask | BASE.mask} = 0 AS kept,
  n_lines, n_exclaimed, n_upper, n_stutter, failed_bits
FROM f
"""
