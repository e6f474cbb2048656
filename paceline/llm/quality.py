"""Quality rules: every rule is evaluated once into a bit mask kept with its
measurements; policies are masks over those bits, and ablations are sums over
the distinct masks.

Built-in expressions only.  Rules never see lang, source or labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Five words make a window; a window found again marks its words as repeated.
WINDOW = 5

#: Word separators, as characters and as a pattern.
_SPACES = " \t\n\x0b\f\r"
_SPACE = r"[ \t\n\x0B\f\r]"


@dataclass(frozen=True)
class Rule:
    """A named test on the measurements; true means the document fails it."""

    bit: int
    name: str
    sql: str


#: The rules in bit order.  Bits are never reused, so stored masks stay readable.
#: ``sql`` runs on the measurement columns; all are integer arithmetic.
RULES: tuple[Rule, ...] = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
)

BASE = ("few_words", "repeated_words")

#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask_of(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the measurements: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words (all long).

    Null text has no words and no lines; empty text likewise.  Rows are
    independent, so ties, repeated rows and empty tables need no rule.
    Measurement columns replace columns of the same name.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # Leading and trailing space would give empty words, and so would empty text.
    trimmed = F.btrim(t, F.lit(_SPACES))
    has_words = F.length(F.col("__trimmed")) > 0
    none = F.array().cast("array<string>")
    words = F.when(has_words, F.split(F.col("__trimmed"), rf"{_SPACE}+")).otherwise(none)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    long = lambda c: c.cast("bigint")

    w = F.col("__words")
    step1 = docs.withColumn("__trimmed", trimmed).withColumn("__words", words).withColumn("__lines", lines)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    step2 = step1.withColumn("__h", F.when(F.size(w) > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    h = F.col("__h")
    window = F.transform(
        F.sequence(F.lit(1), F.size(h) - F.lit(WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(h, i, WINDOW)),
    )
    step3 = step2.withColumn(
        "__win", F.when(F.size(h) > 0, window).otherwise(F.array().cast("array<bigint>"))
    )
    win = F.col("__win")
    ordered = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step4 = step3.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct(win)) < F.size(win), ordered).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    s = F.col("__sorted")
    again = F.filter(
        s,
        lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
    )
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + F.lit(WINDOW) - F.greatest(a["end"], p)).alias("n"),
            (p + F.lit(WINDOW)).alias("end"),
        ),
        lambda a: a["n"],
    )
    return step4.withColumns(
        {
            "n_words": long(F.size(w)),
            "word_chars": long(F.length(F.array_join(w, ""))),
            "n_symbols": long(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))),
            "n_lines": long(F.size("__lines")),
            "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
            "n_repeat_words": long(covered),
        }
    ).drop("__trimmed", "__words", "__lines", "__h", "__win", "__sorted")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``failed``: one bit per failed rule.

    Every rule is evaluated here, once; nothing later looks at the text again.
    """
    mask = F.lit(0).cast("bigint")
    for rule in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(rule.sql), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, text).withColumn("failed", mask)


def apply_policy(rows: DataFrame, version: int, column: str = "kept") -> DataFrame:
    """Ledger rows with the verdict of one policy version."""
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablation(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects,
    and that the policy would keep without it.

    Ledger rows collapse to one row per distinct mask before anything else; an
    empty ledger gives zeros for every rule.
    """
    policy = mask_of(POLICIES[version])
    spark = rows.sparkSession
    bits = {r.name: r.bit for r in RULES}
    rules = spark.createDataFrame([(n, 1 << bits[n]) for n in POLICIES[version]], "rule string, rule_bit bigint")
    masks = (
        rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy)).alias("mask"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rule_bit", F.explode(F.array(*[F.lit(1 << bits[n]).cast("bigint") for n in POLICIES[version]])))
    )
    kept = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    counted = masks.groupBy("rule_bit").agg(
        kept(F.col("mask").bitwiseAND(F.col("rule_bit")) != 0).alias("n_failed"),
        kept(F.col("mask") == F.col("rule_bit")).alias("n_only_this"),
        kept(F.col("mask").bitwiseAND(F.bitwise_not(F.col("rule_bit"))) == 0).alias("n_kept_without"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rules.join(counted, "rule_bit", "left").select(
        "rule", zero("n_failed"), zero("n_only_this"), zero("n_kept_without")
    )
