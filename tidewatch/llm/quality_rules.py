"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame and SQL functions only. Every rule looks at one feature and votes that a document is good
(1), bad (-1), or abstains (0). How often each rule is right about good and about bad documents is
estimated without labels from the counts of vote patterns, of which there are at most
3 ** (number of rules), whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

WHITE = r"[\x20\x09-\x0D]+"
#: Name, feature, good from, good to, bad below, bad above. In between a rule abstains.
RULES = [
    ("word_length", "word_chars / n_words", 3.0, 9.0, 2.0, 12.0),
    ("symbols", "n_symbols / n_words", 0.0, 0.05, 0.0, 0.15),
    ("capitals", "n_capitals / word_chars", 0.0, 0.2, 0.0, 0.5),
    ("repeated_lines", "n_dup_lines / n_lines", 0.0, 0.1, 0.0, 0.3),
    ("repeated_words", "n_repeat_words / n_words", 0.0, 0.2, 0.0, 0.4),
    ("sentence_marks", "n_marks / n_words", 0.02, 0.3, 0.0, 0.5),
]
ROUNDS = 25
#: First guesses: share of good documents, votes that are right on good and on bad documents. A kind of junk
#: breaks few rules, so most rules are wrong about most bad documents, and rarely about good ones.
PRIOR, RIGHT_GOOD, RIGHT_BAD = 0.8, 0.999, 0.3
#: Pseudo-counts that keep accuracies off 0 and 1.
SMOOTH = 1.0


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks.

    Null and white texts have no words and count 0 everywhere. Windows of three words are compared
    by 64-bit hashes within one text. All work is within a row: nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", WHITE), ""))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.expr("aggregate(_w, 0L, (n, w) -> n + char_length(w))"))
    d = d.withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_capitals", F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long"))
    d = d.withColumn("n_marks", F.regexp_count("_t", F.lit(r"[.!?]")).cast("long"))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_lines", F.size("_l").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    d = d.withColumn(
        "_s",
        F.expr("if(n_words < 3, array(), sort_array(transform(sequence(0, int(n_words) - 3), i -> struct(xxhash64(_h[i], _h[i + 1], _h[i + 2]) AS h, i AS i))))"),
    )
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> coalesce(get(_s, k - 1).h = x.h, false) OR coalesce(get(_s, k + 1).h = x.h, false)), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(_p, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")


def votes() -> Column:
    """An array of each rule's vote; a rule whose feature is undefined abstains."""

    def vote(feature: str, good_from: float, good_to: float, bad_below: float, bad_above: float) -> Column:
        top, bottom = feature.split(" / ")
        x = F.try_divide(F.col(top).cast("double"), F.col(bottom))
        good = (x >= good_from) & (x <= good_to)
        bad = (x < bad_below) | (x > bad_above)
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return F.array(*[vote(*rule[1:]) for rule in RULES])


def log_odds(v: str, prior: str, good: str, bad: str) -> str:
    """SQL for the log odds that a document with votes ``v`` is good; abstentions say nothing."""
    each = f"CASE WHEN {v}[j] = 1 THEN ln({good}[j] / (1 - {bad}[j])) WHEN {v}[j] = -1 THEN ln((1 - {good}[j]) / {bad}[j]) ELSE 0D END"
    return f"aggregate(sequence(0, {len(RULES) - 1}), ln({prior} / (1 - {prior})), (s, j) -> s + {each})"


def estimate(voted: DataFrame) -> tuple[float, list[float], list[float]]:
    """(share of good documents, each rule's accuracy on good, on bad ones) from the column ``votes``.

    The fold runs in SQL over the one row of pattern counts; the driver gets the estimates alone.
    No documents give the first guesses.
    """
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    k = len(RULES)

    def share(right: int, weight: str, guess: float) -> str:
        hit, any_ = (f"aggregate(e, 0D, (s, x) -> s + if({test}, x.n * {weight}, 0D))" for test in (f"x.votes[j] = {right}", "x.votes[j] != 0"))
        return f"transform(sequence(0, {k - 1}), j -> ({hit} + {SMOOTH * guess}D) / ({any_} + {SMOOTH}D))"

    expected = f"transform(p, x -> struct(x.votes AS votes, x.n AS n, 1 / (1 + exp(-{log_odds('x.votes', 'm.prior', 'm.good', 'm.bad')})) AS q))"
    prior = f"(aggregate(e, 0D, (s, x) -> s + x.n * x.q) + {SMOOTH * PRIOR}D) / (aggregate(e, 0D, (s, x) -> s + x.n) + {SMOOTH}D)"
    step = f"transform(array({expected}), e -> struct({prior} AS prior, {share(1, 'x.q', RIGHT_GOOD)} AS good, {share(-1, '(1 - x.q)', RIGHT_BAD)} AS bad))[0]"
    start = f"struct({PRIOR}D AS prior, array_repeat({RIGHT_GOOD}D, {k}) AS good, array_repeat({RIGHT_BAD}D, {k}) AS bad)"
    m = one.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, i) -> {step})").alias("m")).first()["m"]
    return m["prior"], list(m["good"]), list(m["bad"])


def judge(docs: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """``keep``, the features, votes, posterior (that the document is good), base_failed and kept.

    One row for each row of ``docs``; repeated rows stay, empty tables give no rows, other columns
    are ignored. Documents of fewer than 50 words, or more than half of whose words repeat, fail
    whatever the posterior. The features are written once to the shared folder, as they are read twice.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = common.saved(features(docs, keep).withColumn("votes", votes()).withColumn("base_failed", failed), "quality")
    prior, good, bad = estimate(found.where("NOT base_failed"))
    lists = [f"array({', '.join(f'{x!r}D' for x in values)})" for values in (good, bad)]
    odds = F.expr(log_odds("votes", f"{prior!r}D", *lists))
    return (
        found.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents judged: doc_id, n_words, the four base counts, base_failed, kept, posterior."""
    judged = judge(common.read(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
