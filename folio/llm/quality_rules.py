"""Quality rules with risk-controlled thresholds, in Spark expressions only.

Each rule is a statistic and a cutoff; a document over the cutoff of any rule is rejected. The guarantee is on the verdict:
in every stratum (language), with probability ``1 - error`` overall, the rules together falsely reject at most ``risk`` of
the good documents. So each rule gets an equal share of the risk (the union's rate is at most the sum), and its cutoff is the
lowest of a fixed grid for which labelled good documents show, by an exact binomial test, that the rule's rate of false
rejections is under that share. Each test is made at ``error`` over the number of all tests (Bonferroni). A stratum with too
few labels to prove any cutoff rejects nothing. A trial is a document: rows that repeat it count once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.text_stats import base_statistics

#: Statistic: (numerator, grid of cutoffs); the denominator is n_words.
GRIDS: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_rate": ("n_symbols", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    "mark_rate": ("n_marks", (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "word_length": ("word_chars", (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "dup_line_rate": ("n_dup_lines", (0.005, 0.01, 0.02, 0.05, 0.1, 0.2)),
    "repeat_rate": ("n_repeat_words", (0.02, 0.05, 0.1, 0.15, 0.18, 0.2)),
}


@dataclass(frozen=True)
class Risk:
    """``risk``: highest rate of good documents that the verdict rejects, all rules together; ``error``: chance that any stratum's exceeds it."""

    risk: float = 0.02
    error: float = 0.05
    least_words: int = 10
    most_repeat_percent: int = 20

    @property
    def share(self) -> float:
        """What one rule may reject."""
        return self.risk / len(GRIDS)


def log_factorial(m: Column) -> Column:
    """ln m!, from the factorial itself up to 20, then by Stirling's series, whose error is under 1e-12 there."""
    x = (m + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(m <= 20, F.log(F.factorial(m.cast("int")))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact up to rounding, for k < n * p; 1 beyond, where no test could succeed.

    Terms fall from k down, so the sum is taken in shares of the last one, as far as a share can matter: some nine standard
    deviations, so the work grows with the root of n at most.
    """
    last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    lowest = F.greatest(F.lit(1).cast("long"), k - 40 - F.ceil(9 * F.sqrt(n * p)))
    step = F.aggregate(
        F.sequence(k, lowest, F.lit(-1).cast("long")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("whole")),
        lambda a, i: F.struct(
            (a["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("term"),
            (a["whole"] + a["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("whole"),
        ),
        lambda a: a["whole"],
    )
    return F.when(n == 0, 1.0).when(k >= n * p, 1.0).when(k == 0, F.exp(n * math.log1p(-p))).otherwise(F.exp(last) * step)


def base_failed(r: Risk) -> Column:
    return (F.col("n_words") < r.least_words) | (100 * F.col("n_repeat_words") > r.most_repeat_percent * F.col("n_words"))


def value(name: str) -> Column:
    return F.when(F.col("n_words") > 0, F.col(GRIDS[name][0]) / F.col("n_words")).otherwise(0.0)


def thresholds(stats: DataFrame, labels: DataFrame, r: Risk = Risk()) -> DataFrame:
    """Row per stratum: stratum and a cutoff per statistic, null where none is proven.

    Good documents are those labelled 1 that pass the base rules; a document with several labels is good if all say so.
    One with several rows in a stratum is one trial, of its highest values. Rows without an id and labels without a
    document are no trials; without labels no cutoff is proven.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").alias("of"))
    held = stats.join(good, stats.doc_id == good.of, "left_semi").filter(~base_failed(r))
    trials = held.groupBy("doc_id", "stratum").agg(*(F.max(value(name)).alias(name) for name in GRIDS))
    counts = trials.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col(name) > cut).alias(f"{name}_{k}") for name, (_, grid) in GRIDS.items() for k, cut in enumerate(grid)),
    )
    tests = sum(len(grid) for _, grid in GRIDS.values())
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    counted = counts.crossJoin(F.broadcast(strata))  # one row
    level = r.error / (tests * F.col("strata"))

    def lowest(name: str) -> Column:
        grid = GRIDS[name][1]
        return F.coalesce(*(F.when(binomial_tail(F.col(f"{name}_{k}"), F.col("n"), r.share) <= level, cut) for k, cut in enumerate(grid)), F.lit(None).cast("double"))

    return counted.select(F.col("stratum").alias("of_stratum"), *(lowest(name).alias(f"{name}_cut") for name in GRIDS))


def judge_quality(stats: DataFrame, labels: DataFrame, r: Risk = Risk()) -> DataFrame:
    """``stats`` (doc_id, stratum and base statistics) with base_failed, kept and the rules that a document breaks.

    A document without words fails the base rules; ties with a cutoff do not break a rule; repeated rows are judged alike;
    a null stratum is one of its own; an empty table stays empty. ``stats`` is read twice, so store it if it is dear.
    """
    cuts = thresholds(stats, labels, r)
    joined = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    broken = F.array_compact(F.array(*(F.when(value(name) > F.col(f"{name}_cut"), F.lit(name)) for name in GRIDS)))
    out = joined.withColumn("base_failed", base_failed(r)).withColumn("broken", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("of_stratum", *(f"{name}_cut" for name in GRIDS))


def document_statistics(docs: DataFrame) -> DataFrame:
    """Statistics of every document; the stratum is its language.

    A null text has no words and fails the base rules; a null language is a stratum of its own; repeated rows repeat;
    an empty table stays empty; columns beside doc_id, text and lang are ignored.
    """
    return base_statistics(docs.select("doc_id", "text", F.col("lang").alias("stratum")), ["doc_id", "stratum"])
