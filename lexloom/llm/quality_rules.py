"""Quality rules as a ledger: measure once, keep failure bits, decide and compare policies afterwards.

``ledger`` reads each text once and writes its measurements and one bit per failed rule. Policies are
sets of rules with a version; a verdict is one bitwise AND with the policy's mask, so a new policy or
another set of rules never reads the texts again. ``ablation`` says for every rule of a policy what
it rejects alone and what would come back without it.

Defined cases: a null text counts as empty; an empty text has no words and fails ``few_words`` only;
repeated rows and null ids are measured like any other row; an empty table gives an empty ledger.
Columns of the input other than those asked for are not carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import add, let, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

# Rule name, bit and the condition under which a text fails it, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("shouting", "10 * n_shouts > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a text is rejected if it fails any of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 2, tuple(BIT))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these starts."""
    ordered = F.sort_array(starts)
    return let(
        ordered,
        lambda s: add(
            F.transform(
                s,
                lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW))).cast("bigint"),
            )
        ),
    )


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more.

    Windows are compared by their 64-bit hash, and neighbours in hash order by their words as well.
    Texts without equal hashes, which are nearly all, are settled without sorting.
    """
    last = F.size(tokens) - WINDOW
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)])
    )

    def same(a: Column, b: Column) -> Column:
        equal = (a["h"] == b["h"]) & (
            F.slice(tokens, a["i"] + 1, WINDOW) == F.slice(tokens, b["i"] + 1, WINDOW)
        )
        return F.coalesce(equal, F.lit(False))

    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.filter(
                F.transform(
                    p,
                    lambda x, k: F.when(same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)), x["i"]),
                ),
                lambda i: i.isNotNull(),
            ),
        )

    return F.when(
        last >= 1,
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(starts(h))).otherwise(
                F.lit(0).cast("bigint")
            ),
        ),
    ).otherwise(F.lit(0).cast("bigint"))


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct; its words and lines are split once each."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda v: F.rlike(v, F.lit("[^ \\t-\\r]")))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda v: F.struct(
            F.size(v).cast("bigint").alias("n_lines"),
            (F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["l"]["n_lines"].alias("n_lines"),
            F.regexp_count(text, F.lit("!!")).cast("bigint").alias("n_shouts"),
        ),
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, the measurements, and ``fail_bits`` with one bit per failed rule."""
    measured = docs.select(F.col(key), F.inline(F.array(measurements(F.col(text)))))
    bits = F.lit(0).cast("bigint")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), BIT[name]).otherwise(0).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    """The verdict of a policy on a row of the ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """Add ``kept_<name>_v<version>`` for every policy."""
    return rows.select("*", *[passes(p).alias(f"kept_{p.name}_v{p.version}") for p in policies])


def sole_failure(policy: Policy) -> Column:
    """The bit of the one rule of a policy that rejects a text, or 0 if none does or several do: without that rule the text would
    be kept."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    return F.when(F.bit_count(bits) == 1, bits).otherwise(F.lit(0).cast("bigint"))


def ablation(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that only it rejects, and the policy's totals.

    The ledger is first summed by bit pattern (at most two to the number of rules, partly summed
    before the shuffle); everything else is bit arithmetic on those patterns.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(
            F.lit(p.name).alias("policy"),
            F.lit(p.version).alias("version"),
            F.lit(p.mask).cast("bigint").alias("mask"),
            F.lit(r).alias("rule"),
            F.lit(BIT[r]).cast("bigint").alias("bit"),
        )
        for p in policies
        for r in dict.fromkeys(p.rules)
    ]
    kept = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.select("fail_bits", "n", F.inline(F.array(*cases)))
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(kept == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(kept == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
        )
    )
