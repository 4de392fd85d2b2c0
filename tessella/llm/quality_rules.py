"""Quality rules with host verdicts, in DataFrame functions only.

Per document the rule counts are computed inside the row (nothing is exploded). Failures are then summed by host
(the ``source`` column), host rates are shrunk with a beta prior fitted to all hosts by the method of moments, and the
host verdict is joined back. The counts are checkpointed between the two, so texts are scanned once.

Defined cases: a null or empty text has no words and fails; a null source is a host of its own; repeated rows are
judged one by one; an empty table gives an empty result; columns named like a result are replaced, others carried along; texts of any
length are judged whole, at n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, let

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Further document rules that count as failures of the host.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.5
#: A host is rejected with all its documents if its shrunk failure rate is SPREADS standard deviations above the mean of all
#: hosts and above the first of these rates, or above the second.
HOST_REJECT_RATES = (0.5, 0.8)
SPREADS = 4.0
#: Strength of the prior, in documents, where the hosts' rates do not spread.
DEFAULT_STRENGTH = 20.0


#: Names of results and of helpers; such columns of the input are replaced.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "host_rate", "kept", "_s", "_host")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the array; sorts windows, so n log n."""

    def covered(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            repeated = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
            gaps = let(places, lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - a, F.lit(3)))), F.lit(0), lambda acc, g: acc + g))
            return gaps

        by_hash = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(by_hash, of_sorted))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(grams, covered))


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    stats = let(
        F.regexp_extract_all(t, F.lit(rf"[^\x20\x09-\x0D]+"), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in RESULTS]
    out = docs.select(
        *kept,
        stats.alias("_s"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        (F.size(F.split(t, "\n", -1))).cast("long").alias("n_lines"),
    )
    n, rep = F.col("_s.n_words"), F.col("_s.n_repeat_words")
    return out.select(
        *[c for c in out.columns if c != "_s"],
        n.alias("n_words"), F.col("_s.word_chars").alias("word_chars"), rep.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
    )


def host_rates(counts: DataFrame, host: str, failed: Column) -> tuple[DataFrame, float]:
    """One row per host: n_docs, n_failed, and rate shrunk by the beta prior of all hosts; and the rate above which a host is rejected."""
    hosts = counts.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    hosts = cut(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    strength = m * (1 - m) / v - 1 if v > 0 else DEFAULT_STRENGTH
    strength = min(max(strength, 1.0), 1e6)
    low, high = HOST_REJECT_RATES
    shrunk = hosts.withColumn("rate", (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength)))
    return shrunk, min(high, max(low, m + SPREADS * v**0.5))


def judge(docs: DataFrame, text: str = "text", host: str = "source", reject_rate: float | None = None) -> DataFrame:
    """``docs`` without its text, with the counts, base_failed, host_rate and kept."""
    counts = cut(rule_counts(docs, text))
    failed = F.col("base_failed") | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
    rates, limit = host_rates(counts, host, failed)
    hosts = rates.select(F.col(host).alias("_host"), F.col("rate").alias("host_rate"))
    judged = counts.join(hosts, counts[host].eqNullSafe(F.col("_host")), "left").drop("_host")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= (limit if reject_rate is None else reject_rate)))
