"""Quality rules combined by weak supervision, in DataFrame functions alone.

Each rule looks at a document's counts and votes good, bad or abstains.  Votes
of all documents are counted by pattern (at most 3 to the number of rules, so
the table stays small however many documents there are), and
expectation-maximisation over these counts estimates how often good documents
and each kind of fault occur and how every rule votes on them.  A document is
kept when its posterior probability of being good is at least one half, rather
than when every rule passes.  How often a rule objects to good documents is
estimated too, so the verdict on one objection does not hang on how common it
is.  Documents with the same votes get the same verdict: good ones that one rule
wrongly objects to are kept only if the rule's real faults are many more and
show in other rules' votes.

Edge cases: a null or empty text has no words, gets the votes of an empty text
and fails the base rule; repeated rows are judged as often as they occur; an
empty table gives no rows; other columns of the input are kept by
`filter_documents` and ignored by `judge`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, materialize, table

WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"
WINDOW = 8  # words of a window that counts as repeated; a power of two
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SURE = (0.96, 0.03, 0.01)  # a fault's own rule: bad, abstain, good; estimated, a kind drifts to documents that no rule objects to
FALSE_ALARM = 0.01  # a rule's objections to good documents, at first
PRIOR = 10.0  # documents that the first rates count as, when false alarms are estimated
USUAL = (FALSE_ALARM, 0.1, 0.9 - FALSE_ALARM)  # any other rule, at first
STEPS = 8  # rounds of expectation-maximisation at most
STILL = 1e-3  # change of every estimate that ends the rounds
SMOOTH = 0.1  # votes of each kind added to each rule's counts, so none is certain

GOOD, ABSTAIN, BAD = 1, 0, -1


def counts(docs: DataFrame) -> DataFrame:
    """The docs with columns _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _n_lines, _n_distinct, _n_upper."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.trim(text, F.lit(WHITE))
    d = docs.withColumn("_text", text).withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+")))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        *docs.columns, "_words",
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("_n_symbols"),
        F.regexp_count("_text", F.lit("\\p{Lu}")).cast("long").alias("_n_upper"),
        lines.alias("_lines"),
    )
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    d = d.withColumn("_hashes", F.when(F.col("_n_words") > WINDOW, hashes))
    # hashes of windows of 2, 4 and 8 words, each from two of half the width
    width, name = 1, "_hashes"
    while width < WINDOW:
        d = d.withColumn(f"_w{2 * width}", F.zip_with(
            F.slice(name, F.lit(1), F.size(name) - width), F.slice(name, F.lit(width + 1), F.size(name) - width),
            lambda a, b: F.xxhash64(a, b)))
        width, name = 2 * width, f"_w{2 * width}"
    d = d.select(
        *docs.columns, "_n_words", "_word_chars", "_n_symbols", "_n_upper",
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.coalesce(F.size(F.array_distinct("_hashes")).cast("long"), F.col("_n_words")).alias("_n_distinct"),
        F.col(name).alias("_windows"),
    )
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_sorted", F.when(some, F.sort_array(placed))).drop("_windows")
    pairs = _neighbours("_sorted", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("_sorted")
    covered = _neighbours("_places", lambda a, b: F.least(F.lit(WINDOW), b - a))
    total = F.aggregate(covered, F.lit(0), lambda acc, x: acc + x) + WINDOW
    return d.withColumn("_n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_places")


def _neighbours(name: str, f) -> Column:
    """f over each entry of an array column and the next one."""
    return F.zip_with(F.slice(name, F.lit(1), F.size(name) - 1), F.slice(name, F.lit(2), F.size(name) - 1), f)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Rule name -> vote on a document with the columns of `counts`."""
    words, chars = F.col("_n_words"), F.col("_word_chars")
    some = words > 0
    return {
        "length": _vote(words < 10, words >= 60),
        "word_length": _vote(~some | (chars < 2 * words) | (chars > 14 * words), some & (chars >= 3 * words) & (chars <= 9 * words)),
        "symbols": _vote(10 * F.col("_n_symbols") > 2 * words, 50 * F.col("_n_symbols") <= words),
        "repeats": _vote(100 * F.col("_n_repeat_words") > 20 * words, 100 * F.col("_n_repeat_words") <= 2 * words),
        "lines": _vote((F.col("_n_lines") >= 3) & (2 * F.col("_n_dup_lines") >= F.col("_n_lines")), F.col("_n_dup_lines") == 0),
        "variety": _vote((words >= 20) & (100 * F.col("_n_distinct") < 25 * words), some & (10 * F.col("_n_distinct") >= 4 * words)),
        "capitals": _vote(10 * F.col("_n_upper") > 4 * chars, 10 * F.col("_n_upper") <= 2 * chars),
    }


class Estimates(NamedTuple):
    """Shares of the kinds of document, and how each kind is voted on: tables[kind][rule] has (bad, abstain, good)."""

    shares: dict[str, float]
    tables: dict[str, dict[str, tuple[float, float, float]]]

    def likelihood(self, kind: str) -> Column:
        """Share of a kind times the probability of a document's votes in it."""
        out = F.lit(self.shares[kind])
        for rule, table_ in self.tables[kind].items():
            out = out * F.element_at(F.array(*[F.lit(p) for p in table_]), F.col(rule).cast("int") + 2)
        return out


def first_estimates(rules: list[str]) -> Estimates:
    """Good documents, and one kind per rule whose fault it looks for: rules seldom object without reason."""
    return Estimates({"good": 0.8} | {r: 0.2 / len(rules) for r in rules},
                     {k: {r: SURE if r == k else USUAL for r in rules} for k in ("good", *rules)})


def _votes_of(kind: str, rule: str, weights: list[float], prior: float | None) -> tuple[float, float, float]:
    """Probabilities of a kind's votes from their weights; what tells the kinds apart stays, or is weighed with, as it was given."""
    if rule == kind:
        return SURE
    if kind == "good" and prior is None:
        bad, (_, abstain, good) = FALSE_ALARM, weights
        return bad, (1 - bad) * abstain / (abstain + good), (1 - bad) * good / (abstain + good)
    if kind == "good":
        weights = [w + prior * p for w, p in zip(weights, USUAL)]
    return tuple(w / sum(weights) for w in weights)


def fit(patterns: DataFrame, rules: list[str], steps: int = STEPS, prior: float | None = None) -> Estimates:
    """Expectation-maximisation over the votes.

    `patterns` has a column per rule and the number `n` of documents with these
    votes.  A document is good or has one of the faults; a fault's own rule is
    sure of it and seldom objects to a good document, which tells the kinds
    apart.  With `prior`, the rates of false alarms are estimated, and their
    first values count as that many documents; without, they stay as they are,
    and one objection is taken for a false alarm or a fault by how common it
    is.  Everything else is estimated.  Every round is one aggregation of this table.
    """
    now = first_estimates(rules)
    kinds = list(now.shares)
    for _ in range(steps):
        weighed = patterns.withColumns({f"_l{i}": now.likelihood(k) for i, k in enumerate(kinds)})
        total = sum((F.col(f"_l{i}") for i in range(1, len(kinds))), F.col("_l0"))
        cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("vote")) for r in rules])).alias("cell")
        rows = (weighed.select("n", *[(F.col(f"_l{i}") / total).alias(f"_p{i}") for i in range(len(kinds))], cells)
                .groupBy("cell.rule", "cell.vote")
                .agg(*[F.sum(F.col("n") * F.col(f"_p{i}")).alias(f"s{i}") for i in range(len(kinds))]).collect())  # 3 per rule
        seen = {(r["rule"], r["vote"]): [r[f"s{i}"] for i in range(len(kinds))] for r in rows}
        of = {k: sum(v[i] for (r, _), v in seen.items() if r == rules[0]) for i, k in enumerate(kinds)}
        n = sum(of.values())
        shares = {k: (of[k] + SMOOTH) / (n + SMOOTH * len(kinds)) for k in kinds}
        tables = {k: {r: _votes_of(k, r, [seen.get((r, v), [0.0] * len(kinds))[i] + SMOOTH for v in (BAD, ABSTAIN, GOOD)], prior)
                      for r in rules} for i, k in enumerate(kinds)}
        moved = max([abs(shares[k] - now.shares[k]) for k in kinds]
                    + [abs(x - y) for k in kinds for r in rules for x, y in zip(tables[k][r], now.tables[k][r])])
        now = Estimates(shares, tables)
        if moved < STILL:
            break
    return now


def posterior(estimates: Estimates) -> Column:
    """Probability that a document with these votes is good."""
    good = estimates.likelihood("good")
    return good / sum((estimates.likelihood(k) for k in estimates.shares if k != "good"), good)


def _judged(narrow: DataFrame) -> DataFrame:
    """Add _base_failed, _quality (posterior) and _kept to a written table of counts."""
    rules = votes()
    voted = narrow.withColumns({f"_v_{r}": c for r, c in rules.items()})
    names = [f"_v_{r}" for r in rules]
    estimates = fit(materialize(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes"), names, prior=PRIOR)
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    return (voted.withColumn("_base_failed", failed).withColumn("_quality", posterior(estimates))
            .withColumn("_kept", ~F.col("_base_failed") & (F.col("_quality") >= 0.5)).drop(*names))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, _base_failed, _quality and _kept of every document."""
    return _judged(materialize(counts(keep_only(docs, "doc_id", "text")).drop("text"), "quality-counts"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    Rows are written once with their votes and filtered when the estimates are
    there, rather than joined back by a key that may repeat or be null.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index('text')}"))
    rules = votes()
    voted = counts(inner).withColumns({f"_v_{r}": c for r, c in rules.items()})
    columns = [f"_v_{r}" for r in rules]
    kept_rows = materialize(voted.drop("text"), "quality-votes")
    estimates = fit(materialize(kept_rows.groupBy(*columns).agg(F.count("*").alias("n")).coalesce(1), "votes"), columns, prior=PRIOR)
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    kept = kept_rows.filter(~failed & (posterior(estimates) >= 0.5))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op7_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7: counts and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col("_quality").alias("quality"))
