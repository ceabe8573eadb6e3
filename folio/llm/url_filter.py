"""URL filter: allow and block rules first, then a naive Bayes verdict over segmented host and path words.

Rules are matched by Spark expressions. A URL that no rule covers is cut into words: runs of letters of its
host and path, percent escapes read, each split by a unigram Viterbi search, so ``freebets`` gives ``free bets``. A multinomial naive Bayes
model over those words then says whether the URL looks like one to block. Word counts come from a general list of web
text, the naive Bayes from labelled names of eleven kinds of sites to block and nine to allow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower
from folio.llm.url_names import ALLOWED_KINDS, BLOCKED_KINDS, general_words, names

#: (pattern, verdict); the pattern is a host, then a path from its first slash on.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Labelled training names, one URL's words each.
BLOCKED = names(BLOCKED_KINDS)
ALLOWED = names(ALLOWED_KINDS)
#: Words that say nothing of a site's kind.
NEUTRAL = frozenset("www m com org net example html htm php index page en fr de es http https".split())


#: A run of letters of any script.
RUN = re.compile(r"[^\W\d_]+")
#: What one use of a word in a labelled name, or of a neutral word, counts beside the general list: as a word of middle rank there.
NAME_COUNT = 200
#: What an unknown run costs for each letter, beside the cost of a word never seen.
LETTER = 1.8


class HostModel:
    """Unigram segmentation by a general word list with counts, and naive Bayes by the labelled names."""

    def __init__(self, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, alpha: float = 0.5) -> None:
        self.made_of = (tuple(blocked), tuple(allowed), alpha)
        bad, good = Counter(" ".join(blocked).split()), Counter(" ".join(allowed).split())
        counts = Counter(general_words())
        for w in {*bad, *good} | NEUTRAL:
            counts[w] += NAME_COUNT * max(1, bad[w] + good[w])
        total = sum(counts.values())
        self.unigram = {w: math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts))
        self.unknown = math.log(1 / total)
        vocabulary = len({*bad, *good})
        bad_n, good_n = sum(bad.values()), sum(good.values())
        self.odds = {
            w: math.log((bad[w] + alpha) / (bad_n + alpha * vocabulary)) - math.log((good[w] + alpha) / (good_n + alpha * vocabulary))
            for w in {*bad, *good} - NEUTRAL
        }
        # never for blocking, so that a URL without any known word is allowed
        self.prior = min(0.0, math.log(len(blocked) / len(allowed)))
        self.segmented = lru_cache(maxsize=100_000)(self.segment)

    def __reduce__(self):
        return host_model, self.made_of

    def run_price(self, length: int) -> float:
        """The log probability of an unknown run of letters: one word never seen, the less likely the longer it is."""
        return self.unknown - LETTER * length

    def segment(self, name: str) -> tuple[str, ...]:
        """The likeliest words of ``name``, where a run of letters that no word covers counts as one word."""
        # best ways to end here with a known word or at the start, and within an unknown run: (log probability, where the piece began)
        best: list[tuple[float, int]] = [(0.0, 0)]
        loose: list[tuple[float, int]] = [(-math.inf, 0)]
        for end in range(1, len(name) + 1):
            # a run goes on, or begins after a known word
            run = (loose[-1][0] - LETTER, loose[-1][1])
            begun = best[-1][0] + self.run_price(1)
            loose.append((begun, end - 1) if begun > run[0] else run)
            choice = (-math.inf, 0)
            for start in range(max(0, end - self.longest), end):
                p = self.unigram.get(name[start:end])
                if p is not None:
                    p += max(best[start][0], loose[start][0])
                    if p > choice[0]:
                        choice = (p, start)
            best.append(choice)
        parts: list[str] = []
        end = len(name)
        known = True
        while end:
            known = best[end][0] >= loose[end][0] if known else True
            start = (best if known else loose)[end][1]
            parts.append(name[start:end])
            end = start
        return tuple(reversed(parts))

    def words(self, host: str, path: str) -> list[str]:
        return [w for run in RUN.findall(unquote(f"{host} {path}").lower()) for w in self.segmented(run)]

    def log_odds(self, host: str, path: str) -> float:
        """Over 0: likelier a URL to block. Words that training never saw count for neither side."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in self.words(host, path))


@lru_cache(maxsize=4)
def host_model(*made_of) -> HostModel:
    """A model that a worker makes once, not for each task."""
    return HostModel(*made_of)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest pattern that fits, else null."""
    def fits(pattern: str) -> Column:
        name, slash, rest = pattern.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    ordered = sorted({p for p, _ in rules}, key=lambda p: (-len(p), p))
    return F.coalesce(*(F.when(fits(p), F.lit(p)) for p in ordered), F.lit(None).cast("string"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: HostModel | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, words of the URL and their log odds.

    A null URL, or one without ``://``, has an empty host and path, no rule, and the model's verdict on no words, which
    is ``allow``. Repeated rows give repeated results; an empty table gives an empty one; other columns are ignored.
    """
    fitted = model or HostModel()

    @F.pandas_udf("struct<words: array<string>, log_odds: double>")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame({"words": [fitted.words(h, p) for h, p in zip(hosts, paths)], "log_odds": [fitted.log_odds(h, p) for h, p in zip(hosts, paths)]})

    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))
    parts = pages.select(
        F.col(id_col),
        ascii_lower(F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2), F.lit("")).alias("path"),
    )
    chosen = parts.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("judged", judged("host", "path"))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r[0], F.lit(r[1])), rules, F.when(F.lit(False), F.lit("")))
    return chosen.select(
        id_col, "host", "path", "rule",
        F.coalesce(by_rule, F.when(F.col("judged.log_odds") > 0, "block").otherwise("allow")).alias("verdict"),
        F.col("judged.words").alias("words"), F.round("judged.log_odds", 9).alias("log_odds"),
    )
