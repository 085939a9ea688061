"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule looks at one measure of a text and votes good (1), bad (0) or abstains (null). Counts of
vote patterns over all documents (at most 3 to the number of rules rows) feed an
expectation-maximisation that estimates, for each rule, how often its vote is right for good and for
bad texts. The posterior probability of being good replaces a filter in which every rule must pass.
Everything runs in Spark's own expressions.

Defined cases: null text has no words; it and empty text fail the base rule and are not kept; with
fewer than three words nothing repeats; repeated rows count as often as they occur; in an empty table
the estimates stay at their starting values; texts of any length are measured whole; columns other
than doc_id and text are ignored (or passed through by the filter), whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import cut

SYMBOLS = "#*$%&|<>"
ROUNDS = 50
#: Starting accuracy of every rule, share of good texts, and the weight (in documents) with which these hold against the data.
START, SHARE, WEIGHT = 0.85, 0.8, 20.0


def measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measures of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_stops."""
    p = prefix
    w, k, d = f"`{p}words`", f"`{p}keys`", f"`{p}again`"
    out = docs.withColumn(f"{p}t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn(f"{p}spaced", F.translate(f"{p}t", "\t\n\x0b\f\r", "     "))
    out = out.withColumn(f"{p}words", F.array_remove(F.split(f"{p}spaced", " "), ""))
    out = out.withColumn(f"{p}lines", F.expr(f"filter(split(`{p}t`, '\\n'), x -> x rlike '[^ \\\\x09-\\\\x0D]')"))
    # three-word windows: their hashes with their places, sorted, so that equal windows are neighbours
    out = out.withColumn(
        f"{p}keys",
        F.expr(
            f"""CASE WHEN size({w}) < 3 THEN array(0L) ELSE sort_array(transform(sequence(0, size({w}) - 3), i ->
            ((xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) & 4611686018427387903L) div size({w})) * size({w}) + i)) END"""
        ),
    )
    n = f"size({w})"
    place = lambda j: f"cast({k}[{j}] % {n} as int)"
    same = lambda i, j: f"({k}[{i}] div {n} = {k}[{j}] div {n} AND {w}[{place(i)}] = {w}[{place(j)}] AND {w}[{place(i)} + 1] = {w}[{place(j)} + 1] AND {w}[{place(i)} + 2] = {w}[{place(j)} + 2])"
    out = out.withColumn(
        f"{p}again",
        F.expr(f"""CASE WHEN {n} < 4 THEN array(0L) ELSE sort_array(transform(filter(sequence(0, size({k}) - 1), j ->
            (j > 0 AND {same('j', 'j - 1')}) OR (j < size({k}) - 1 AND {same('j', 'j + 1')})), j -> {k}[j] % {n})) END"""),
    )
    out = out.withColumns(
        {
            f"{p}n_words": F.expr(f"cast({n} as bigint)"),
            f"{p}word_chars": F.length(F.replace(F.col(f"{p}spaced"), F.lit(" "), F.lit(""))).cast("long"),
            f"{p}n_symbols": F.length(F.regexp_replace(f"{p}t", "[^#*$%&|<>]+", "")).cast("long"),
            f"{p}n_capitals": F.length(F.regexp_replace(f"{p}t", "[^A-Z]+", "")).cast("long"),
            f"{p}n_stops": F.length(F.regexp_replace(f"{p}t", "[^.!?]+", "")).cast("long"),
            f"{p}n_lines": F.size(f"{p}lines").cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            f"{p}n_repeat_words": F.expr(
                f"CASE WHEN {n} < 4 THEN 0L ELSE aggregate({d}, named_struct('last', -3L, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n) END"
            ),
        }
    )
    return out.drop(f"{p}t", f"{p}spaced", f"{p}words", f"{p}lines", f"{p}keys", f"{p}again")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def votes(prefix: str = "") -> list[Column]:
    """The rules; each gives 1 (good), 0 (bad) or null (abstains)."""
    c = lambda name: F.col(prefix + name)
    words = F.greatest(c("n_words"), F.lit(1))
    length, symbols, repeats = c("word_chars") / words, c("n_symbols") / words, c("n_repeat_words") / words
    capitals, stops, lines = c("n_capitals") / F.greatest(c("word_chars"), F.lit(1)), c("n_stops") / words, c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    return [
        _vote(c("n_words") >= 80, c("n_words") < 30),
        _vote(length.between(3, 10), (length < 2) | (length > 15)),
        _vote(symbols <= 0.05, symbols > 0.15),
        _vote(repeats <= 0.1, repeats > 0.3),
        _vote(capitals <= 0.15, capitals > 0.4),
        _vote(stops.between(0.01, 0.6), (stops < 0.002) | (stops > 0.8)),
        _vote(lines <= 0.1, lines > 0.4),
    ]


def estimate(patterns: list[tuple[tuple, int]], rules: int) -> tuple[float, list[float], list[float]]:
    """(share of good, right-when-good of each rule, right-when-bad of each rule) by EM over vote patterns."""
    share, good, bad = SHARE, [START] * rules, [START] * rules
    for _ in range(ROUNDS):
        sums = [[WEIGHT * START, WEIGHT, WEIGHT * START, WEIGHT] for _ in range(rules)]
        total = likely = 0.0
        for pattern, n in patterns:
            a, b = share, 1 - share
            for j, v in enumerate(pattern):
                if v is not None:
                    a *= good[j] if v else 1 - good[j]
                    b *= 1 - bad[j] if v else bad[j]
            p = a / (a + b)
            total += n
            likely += n * p
            for j, v in enumerate(pattern):
                if v is not None:
                    s = sums[j]
                    s[0] += n * p * v
                    s[1] += n * p
                    s[2] += n * (1 - p) * (1 - v)
                    s[3] += n * (1 - p)
        # votes stay on the side they were written for: a rule is right more often than not
        good = [min(0.999, max(0.5, s[0] / s[1])) for s in sums]
        bad = [min(0.999, max(0.5, s[2] / s[3])) for s in sums]
        share = (likely + WEIGHT * SHARE) / (total + WEIGHT)
    return share, good, bad


def posterior(model, rules: list[Column]) -> Column:
    share, good, bad = model
    odds = F.lit(log(share / (1 - share)))
    for v, g, b in zip(rules, good, bad):
        odds = odds + F.when(v == 1, F.lit(log(g / (1 - b)))).when(v == 0, F.lit(log((1 - g) / b))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(measured: DataFrame, prefix: str = ""):
    rules = votes(prefix)
    names = [f"v{j}" for j in range(len(rules))]
    rows = measured.select(*[r.alias(n) for r, n in zip(rules, names)]).groupBy(*names).count().collect()
    patterns = sorted(((tuple(r)[:-1], r["count"]) for r in rows), key=repr)
    return estimate(patterns, len(rules))


def base_failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, measures, base_failed, quality (posterior) and kept."""
    measured = cut(measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    scored = measured.withColumn("quality", posterior(fit(measured), votes())).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def good_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that judged() rejects; the columns stay as they are."""
    p = "__quality_"
    # the row number keeps Spark from pushing the condition below the measures, which would spell each of them out many times
    measured = measures(docs, prefix=p).withColumn(f"{p}row", F.monotonically_increasing_id())
    model = fit(measured, p)
    return measured.where((F.col(f"{p}row") >= 0) & ~base_failed(p) & (posterior(model, votes(p)) >= least)).select(*docs.columns)
