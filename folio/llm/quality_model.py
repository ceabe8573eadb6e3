"""Quality scores from a sparse ensemble of rules.

Small regression trees are boosted over document statistics. Every path from a root to a node is a rule, a conjunction
of bounds; a logistic model with a lasso penalty weighs the rules and sets most weights to zero. What remains is
compiled to one Spark column: the rules are comparisons of columns, the score a logistic sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import unused
from folio.llm.text_stats import removed_count, with_words

FEATURES = (
    "words_log", "word_length", "symbol_rate", "mark_rate", "bar_rate", "digit_rate", "upper_rate", "stop_rate",
    "distinct_rate", "same_next_rate", "line_words_log", "dup_line_rate",
)
#: Feature columns begin so, apart from any column of the input.
PREFIX = "_feature_"
COLUMNS = [PREFIX + name for name in FEATURES]


@dataclass(frozen=True)
class Shape:
    trees: int = 30
    depth: int = 3
    bins: int = 24
    least_rows: int = 20
    shrink: float = 0.3
    penalty: float = 2e-3
    steps: int = 400
    seed: int = 11


#: (feature, goes above?, bound): ``value > bound`` or ``value <= bound``.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, prefix: str = "") -> Column:
        """The score as an expression over the feature columns, whose names ``prefix`` goes before."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            parts = [(F.col(prefix + PREFIX + FEATURES[f]) > bound) if above else (F.col(prefix + PREFIX + FEATURES[f]) <= bound) for f, above, bound in rule]
            test = parts[0]
            for p in parts[1:]:
                test = test & p
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * covered(rule, x)
        return 1 / (1 + np.exp(-total))


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, bound in rule:
        out &= (x[:, f] > bound) == above
    return out


def grown(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, shape: Shape) -> tuple[list[Rule], np.ndarray]:
    """Rules of one tree fitted to the residual on ``rows``, and the tree's prediction for all."""
    rules: list[Rule] = []
    predicted = np.zeros(len(x))

    def split(mine: np.ndarray, everyone: np.ndarray, path: Rule) -> None:
        mean = residual[mine].mean() if len(mine) else 0.0
        if len(path) < shape.depth and len(mine) >= 2 * shape.least_rows:
            best = (1e-9, -1, -1)
            total, n = residual[mine].sum(), len(mine)
            for f in range(x.shape[1]):
                size = len(edges[f]) + 1
                count = np.bincount(codes[mine, f], minlength=size)[:-1].cumsum()
                part = np.bincount(codes[mine, f], residual[mine], minlength=size)[:-1].cumsum()
                fit = (count >= shape.least_rows) & (n - count >= shape.least_rows)
                if fit.any():
                    gain = np.where(fit, part**2 / np.maximum(count, 1) + (total - part) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] >= 0:
                _, f, k = best
                for above in (False, True):
                    to = (f, above, float(edges[f][k]))
                    rules.append((*path, to))
                    split(mine[(codes[mine, f] > k) == above], everyone[(codes[everyone, f] > k) == above], (*path, to))
                return
        predicted[everyone] = mean

    split(rows, np.arange(len(x)), ())
    return rules, predicted


def train(x: np.ndarray, y: Sequence[int], shape: Shape = Shape()) -> RuleModel:
    """Boost, extract, weigh. Without rows of both classes no rule is learnt: 0 if all rows are labelled 0, else 1."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return RuleModel((), (), -500.0 if len(y) and y[0] == 0 else 500.0)
    rng = np.random.default_rng(shape.seed)
    quantiles = np.linspace(0, 1, shape.bins + 1)[1:-1]
    # bounds that tell the classes apart best may lie in the tails of the smaller one
    edges = [np.unique(np.concatenate([np.quantile(x[y == k, f], quantiles) for k in (0, 1)])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(shape.trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        found, step = grown(x, codes, edges, residual, rows, shape)
        rules |= dict.fromkeys(tuple(sorted(r)) for r in found)
        scale = max(1e-6, float((y.mean()) * (1 - y.mean())))
        margin += shape.shrink * np.clip(step / scale, -4, 4)
    names = list(rules)
    seen: dict[bytes, None] = {}
    kept = []
    for rule in names:  # rules that cover the same rows say the same
        on = covered(rule, x)
        if 0 < on.sum() < len(x) and (key := np.packbits(on).tobytes()) not in seen:
            seen[key] = None
            kept.append(rule)
    z = np.stack([covered(r, x) for r in kept], axis=1).astype(np.float32) if kept else np.zeros((len(x), 0), np.float32)
    weights, intercept = lasso(z, y, shape)
    chosen = np.flatnonzero(weights)
    return RuleModel(tuple(kept[k] for k in chosen), tuple(float(weights[k]) for k in chosen), float(intercept))


def lasso(z: np.ndarray, y: np.ndarray, shape: Shape) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps; the classes weigh alike."""
    share = y.mean()
    w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    full = np.hstack([z, np.ones((len(z), 1), np.float32)])
    vector = np.ones(full.shape[1], np.float32) / full.shape[1] ** 0.5
    for _ in range(30):
        nxt = full.T @ (w * (full @ vector))
        size = np.linalg.norm(nxt)
        vector = nxt / size
    step = 1 / (0.25 * size * 1.05)
    beta = np.zeros(full.shape[1], np.float32)
    ahead, t = beta.copy(), 1.0
    for _ in range(shape.steps):
        error = w * (1 / (1 + np.exp(-(full @ ahead))) - y)
        new = ahead - step * (full.T @ error)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * shape.penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - beta)
        beta, t = new.astype(np.float32), t_new
    return beta[:-1].astype(float), float(beta[-1])


#: Frequent function words of the languages that the statistics know.
STOP_WORDS = "the of and to in that is for der die und das ist nicht de la le les et que en el los un una".split()


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of FEATURES, each under a name that begins with PREFIX; such names and ``_text`` must be free.

    A null text counts as empty; an empty one has zero in every rate.
    """
    df = with_words(docs.withColumn(PREFIX + "text", F.coalesce(F.col("text"), F.lit(""))), PREFIX + "text", PREFIX + "words")
    text, words = F.col(PREFIX + "text"), F.col(PREFIX + "words")
    n, chars = F.size(words), F.length(text)
    over = lambda c, d: F.when(d > 0, c / d).otherwise(0.0).cast("double")
    df = df.withColumn(PREFIX + "lines", F.filter(F.split(text, "\n"), lambda x: x != ""))
    lines = F.col(PREFIX + "lines")
    stop = F.array(*map(F.lit, STOP_WORDS))
    same = F.expr("size(filter(sequence(1, greatest(size({0}) - 1, 1)), k -> get({0}, k) = get({0}, k - 1)))".format(PREFIX + "words"))
    found = {
        "words_log": F.log1p(n.cast("double")),
        "word_length": over(F.length(F.array_join(words, "")), n),
        "symbol_rate": over(removed_count(text, "[#*$%&<>]"), n),
        "mark_rate": over(chars - F.length(F.replace(text, F.lit("!"), F.lit(""))), n),
        "bar_rate": over(chars - F.length(F.replace(text, F.lit("|"), F.lit(""))), n),
        "digit_rate": over(removed_count(text, "[0-9]"), chars),
        "upper_rate": over(removed_count(text, "[A-Z]"), chars),
        "stop_rate": over(F.size(F.array_intersect(F.transform(words, lambda w: F.lower(w)), stop)), F.least(n, F.lit(len(STOP_WORDS)))),
        "distinct_rate": over(F.size(F.array_distinct(words)), n),
        "same_next_rate": over(same, n),
        "line_words_log": F.log1p(over(n, F.size(lines))),
        "dup_line_rate": over(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
    }
    return df.withColumns({PREFIX + k: v for k, v in found.items()}).drop(PREFIX + "text", PREFIX + "words", PREFIX + "lines")


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, shape: Shape = Shape()) -> RuleModel:
    """A model from at most ``most_rows`` labelled documents of each class, those whose ids hash lowest, but for the held-out ones.

    Held out are rows whose crc32 of the id as text leaves 2 by 4. A document with several labels counts as bad if one
    says so; of several texts of an id the one with the least features counts, repeated rows count once. Rows without an
    id or a label and labels without a document are ignored; without rows of both classes see train. Only labels steer
    training; lang, source, doc_id and labels are no features.
    """
    ids = labels.filter("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 4 != 2").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = [ids.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for k in (0, 1)]
    # both limits together bound what is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    one = features(rows).groupBy("doc_id", "quality").agg(F.min(F.struct(*COLUMNS)).alias("least")).select("doc_id", "quality", "least.*")
    found = one.toPandas().sort_values("doc_id")
    return train(found[COLUMNS].to_numpy(np.float64), found["quality"].to_numpy(), shape)


def score_quality(docs: DataFrame, model: RuleModel, out: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1 of the whole text; one narrow pass without Python.

    A null or empty text gets the score of its features, which are zero. Repeated rows repeat, an empty table stays empty,
    all columns of the input are kept, whatever their names; a clash with ``out`` raises ValueError, unused() finds a free name.
    """
    if unused(docs, out) != out:
        raise ValueError(f"docs has a column {out}")
    # The row travels as one column, so that no name of it meets those of the features. Through the generator the features
    # are values: a later filter on the score cannot be pushed to where they are computed, which would compute each once
    # for every rule that names it.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = features(rows).select("row", F.explode(F.array(F.struct(*COLUMNS))).alias("f"))
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns), model.column("f.").alias(out))
