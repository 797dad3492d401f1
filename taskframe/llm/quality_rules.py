"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Every rule compares one statistic of a text with a cutoff of its own per
stratum.  Documents labelled as good are the holdout: for a candidate cutoff,
the number of good documents it would reject is binomial, and the exact tail
P(Bin(n, alpha) <= rejected) is the p-value of "it rejects more than alpha".
Cutoffs are tested from the loosest to the strictest until one fails, which needs
no correction within the sequence; over rules and strata the level is divided by
their number.  So with probability `1 - delta` no rule rejects more than its
share `alpha / rules` of the good documents of any stratum, and all rules
together no more than `alpha`.  A stratum with too few labels gets no cutoff.

Everything is DataFrame functions; windows are compared by 64-bit hashes
within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taskframe.llm.frames import SPACES, col, free_name, others, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 10, 20
ALPHA, DELTA = 0.05, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


@dataclass(frozen=True)
class Rule:
    """Reject where the rate is above the cutoff; candidates from loose to strict."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[float, ...]

    def rate(self) -> Column:
        return F.col(self.part) / F.greatest(F.col(self.whole), F.lit(1))


# Candidates are fixed before any label is seen, as the guarantee requires.
RULES = (
    Rule("symbol_rate", "n_symbols", "n_words", (2.0, 1.0, 0.5, 0.25, 0.1)),
    Rule("dup_line_rate", "n_dup_lines", "n_lines", (0.9, 0.75, 0.5, 0.3)),
    Rule("repeat_rate", "n_repeat_words", "n_words", (0.18, 0.15, 0.12, 0.1)),
    Rule("upper_rate", "n_upper", "word_chars", (0.9, 0.7, 0.5, 0.3)),
    Rule("word_length", "word_chars", "n_words", (40.0, 30.0, 20.0, 15.0)),
)


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(keyed: Column) -> Column:
    """How many words lie in windows whose hash occurs again, from (hash, place)
    sorted.  `keyed` must be a column, as each step looks at its neighbours."""
    again = F.filter(
        F.transform(keyed, lambda x, k: F.when(
            (F.get(keyed, k - 1)["h"] == x["h"]) | (F.get(keyed, k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull())
    # In order of place, each window adds what the one before does not cover.
    return F.aggregate(
        F.sort_array(again),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"])


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the counts of COUNTS (long); columns of these names are replaced.

    Words are what lies between ASCII white space; a null text has none.
    """
    body, words = free_name(df, "rule_text"), free_name(df, "rule_words")
    hashes, lines, sorted_ = (free_name(df, f"rule_{x}") for x in ("hashes", "lines", "sorted"))
    kept = others(df, list(COUNTS))
    at = F.col
    staged = df.select(*map(col, kept), F.coalesce(col(text), F.lit("")).alias(body))
    staged = staged.withColumn(words, F.array_remove(F.split(at(body), f"[{SPACES}]+"), ""))
    staged = staged.withColumns({
        hashes: F.transform(
            F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW))
            .otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.get(at(words), i + k) for k in range(WINDOW)])),
        lines: F.filter(F.split(at(body), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))})
    # Most texts repeat no window, which is cheap to see.
    staged = staged.withColumn(sorted_, F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return staged.select(*map(col, kept), *[c.cast("long").alias(name) for name, c in {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(at(body), " \t\n\x0b\f\r", "")),
        "n_symbols": F.length(at(body)) - F.length(F.translate(at(body), SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(at(sorted_).isNotNull(), _covered(at(sorted_))).otherwise(F.lit(0)),
        "n_upper": _without(at(body), r"\p{Lu}+"),
        "n_lines": F.size(lines),
    }.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _ln_gamma(x: Column) -> Column:
    """ln gamma for x > 0: Stirling's series at x + 8, shifted back."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    shift = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tails(df: DataFrame, n: str, k: str, alpha: float) -> DataFrame:
    """The distinct rows with p_value = P(Bin(n, alpha) <= k).

    Each term is a row, so no array grows with the counts.  Terms more than 40
    standard deviations below k are zero in double precision and left out, and
    beyond k = n * alpha the tail is not needed: it is taken as 1.
    """
    df = df.distinct()
    row = free_name(df, "tail_row")
    d = df.withColumn(row, F.struct(*map(col, df.columns)))
    width = F.ceil(40 * F.sqrt(col(n) * alpha + 1)).cast("long")
    terms = d.where(col(k) <= col(n) * alpha).select(
        row, F.col(f"{row}.{n}").cast("double").alias("n"),
        F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), col(k) - width), col(k).cast("long"))).alias("j"))
    term = F.exp(_ln_gamma(F.col("n") + 1) - _ln_gamma(F.col("j") + 1.0) - _ln_gamma(F.col("n") - F.col("j") + 1)
                 + F.col("j") * math.log(alpha) + (F.col("n") - F.col("j")) * math.log1p(-alpha))
    tails = terms.groupBy(row).agg(F.sum(term).alias("p_value")).select(f"{row}.*", "p_value")
    return tails.unionByName(df.where(col(k) > col(n) * alpha).withColumn("p_value", F.lit(1.0)))


def cutoffs(good: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES,
            alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the strictest cutoff shown safe for each rule.

    `good` has the stratum and COUNTS of documents labelled as good.  Columns:
    the stratum and one per rule, null where no candidate passed.
    """
    # One row per stratum: its size and, per candidate, how many it rejects.
    tried = [(r, i, c) for r in rules for i, c in enumerate(r.cutoffs)]
    sums = good.groupBy(col(stratum).alias("stratum")).agg(
        F.count("*").alias("n"),
        *[F.sum((r.rate() > c).cast("long")).alias(f"{r.name} {i}") for r, i, c in tried])
    # Of the strata only their number goes to the driver.
    sums = sums.withColumn("strata", F.lit(max(1, good.select(col(stratum)).distinct().count())))
    candidates = sums.select("stratum", "strata", "n", F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
                 F.col(f"{r.name} {i}").alias("rejected")) for r, i, c in tried])).alias("t")).select(
        "stratum", "strata", "n", "t.*")
    tested = binomial_tails(candidates, "n", "rejected", alpha / len(rules))
    passed = F.col("p_value") <= delta / (len(rules) * F.col("strata"))
    # A candidate counts if it and all looser ones passed.
    upto = Window.partitionBy("stratum", "rule").orderBy("step")
    safe = tested.withColumn("safe", F.min(passed.cast("int")).over(upto)).where("safe = 1")
    return safe.groupBy("stratum").agg(*[
        F.min(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"max_{r.name}") for r in rules])


def judge(df: DataFrame, labels: DataFrame, stratum: str = "lang", id: str = "doc_id", text: str = "text",
          label: str = "quality", carry: list[str] | None = None, rules: tuple[Rule, ...] = RULES,
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The columns of `carry` (all, if None) with COUNTS, base_failed, kept and
    `failed_rules`.

    A text fails the base rule with fewer than MIN_WORDS words or more than
    MAX_REPEATED percent of them repeated; labels only calibrate texts that pass
    it.  Documents with a null stratum form one of their own.  `labels` rows with
    nulls are left out, of several labels of an id the smallest counts, and
    without labels only the base rule rejects.  Columns of the new names are
    replaced.
    """
    new = [*COUNTS, "base_failed", "kept", "failed_rules"]
    kept = others(df.select(*map(col, carry)) if carry is not None else df, new)
    of, key = free_name(df, "rule_stratum"), free_name(df, "rule_id")
    named = df.select(*map(col, kept), *([] if text in kept else [col(text)]),
                      F.coalesce(col(stratum).cast("string"), F.lit("")).alias(of), col(id).alias(key))
    counted = counts(named, text).select(*map(col, kept), of, key, *COUNTS)
    rows = written(counted.withColumn("base_failed", base_failed()), "rules")
    voted = labels.where(col(id).isNotNull() & col(label).isin(0, 1)).groupBy(col(id).alias("of id")).agg(
        F.min(col(label)).alias("voted")).where("voted = 1")
    good = rows.where(~F.col("base_failed")).join(voted, F.col(key) == F.col("of id"), "left_semi")
    chosen = cutoffs(good, of, rules, alpha, delta)
    failed = F.array_compact(F.array(*[
        F.when(r.rate() > F.col(f"max_{r.name}"), F.lit(r.name)) for r in rules]))
    joined = rows.join(chosen, F.col(of) == F.col("stratum"), "left").withColumn("failed_rules", failed)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(
        *map(col, kept), *new)
