"""URL filter, in DataFrame functions only: listed rules first, else logistic regression on hashed character n-grams.

The model is fitted to a small labelled URL table (``LABELLED_URLS`` or any DataFrame of at most ``MAX_LABELLED`` rows).
Features are the distinct hash buckets of the 3- to 5-grams of host and path, each url scaled to length one. Fitting is
full-batch gradient descent, folded over the steps inside one expression on the labelled urls and their postings; what
comes back is one number per bucket, so the driver never holds more than ``BUCKETS`` values. Scoring looks weights up in one literal array, row by row: no shuffle.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is scored on no features
(the bias alone); of rules of one length that fit, the first listed counts; repeated rows are judged one by one; an empty table gives an empty result;
urls of any length are judged whole; columns named like a result are replaced, others carried along.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let

BUCKETS = 16384
GRAMS = (3, 4, 5)
STEPS, RATE, BIAS_RATE, RIDGE = 300, 12.0, 1.0, 1e-5
MAX_LABELLED = 10_000
BLOCK_AT = 0.5

#: Rules as (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words of unwanted and of wanted hosts, words that either may have beside them, and hosts that only look unwanted.
_UNWANTED = "spam ads adserver track clicks casino poker slots bets betting win winner prize pills viagra pharmacy loans porn xxx sex dating replica crack warez cheap free".split()
_WANTED = "library news docs university wiki weather museum recipes school garden forum data council hospital trains bakery chess astronomy history poems blog".split()
#: Parts of plain words, any two of which make a wanted host.
_SYLLABLES = "th tion ble st or an er in ing ed ou".split()
_BESIDE = "zone today best online hub world".split()
_LOOKS_ONLY = "heads-up roads-and-rails lads-choir beta-release better-soil alphabet window-frames winter-sports wind-power trackside-hikes farm-museum farmers-market freedom-archive cheapside-parish pillars-of-rome sussex-walks".split()
_ENDS = ("com", "org", "net")
_PATHS = ("/en/12", "/de/7/", "/fr/345.html", "/es/6", "/index.html", "")


def _table() -> tuple[tuple[str, int], ...]:
    """The labelled table of the query: every word alone and beside others, under all endings, paths and starts in turn."""
    hosts = [(h, y) for words, y in ((_UNWANTED, 1), (_WANTED, 0)) for i, w in enumerate(words) for h in (w, *(f"{w}-{b}" if (i + j) % 2 else f"{b}-{w}" for j, b in enumerate(_BESIDE)))]
    hosts += [(h, 0) for h in (*_LOOKS_ONLY, *(a + b for a in _SYLLABLES for b in _SYLLABLES))]
    return tuple((f"{('http://', 'https://www.', 'http://m.')[k % 3]}{h}.example.{_ENDS[k // 3 % 3]}{_PATHS[k % len(_PATHS)]}", y) for k, (h, y) in enumerate(hosts))


LABELLED_URLS = _table()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets (1 to BUCKETS) of the n-grams of host and path, which are hashed apart."""

    def grams(text: Column, part: str) -> list[Column]:
        t = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))  # numbers tell nothing but their length

        def of(n: int) -> Column:
            bucket = lambda i: F.pmod(F.xxhash64(F.lit(part), F.substring(t, i, F.lit(n))), F.lit(BUCKETS)).cast("int") + 1
            return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), bucket)).otherwise(F.array().cast("array<int>"))

        return [of(n) for n in GRAMS]

    empty = (host == "") & (path == "")
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*grams(host, "h"), *grams(path, "p"))))


def _margin(found: Column, weights: list[float]) -> Column:
    """Bias plus the mean-scaled sum of the weights of the buckets found."""
    w = F.from_json(F.lit(json.dumps(weights[1:])), "array<double>")  # a foldable literal
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.element_at(w, b))
    return F.lit(float(weights[0])) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED_URLS), "url string, label int")


def fit(labelled: DataFrame, steps: int = STEPS) -> list[float]:
    """Bias and BUCKETS weights; rows with a null url or label are not learned from."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    n = rows.limit(MAX_LABELLED + 1).count()
    if n > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    weights = [0.0] * (BUCKETS + 1)  # the bias first
    if not n:
        return weights
    features = rows.select(F.col("label").cast("double").alias("y"), buckets(*split_url(F.col("url"))).alias("b"))
    features = features.coalesce(1).select(F.monotonically_increasing_id().cast("int").alias("i"), "y", "b", F.sqrt(F.greatest(F.size("b"), F.lit(1)).cast("double")).alias("s"))
    urls = features.agg(F.array_sort(F.collect_list(F.struct("i", "y", "b", "s"))).alias("x"))
    by_bucket = features.select("i", F.explode("b").alias("k")).groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("at"))
    every = rows.sparkSession.range(1, BUCKETS + 1, 1, 1).withColumnRenamed("id", "k").join(by_bucket, "k", "left")
    postings = every.agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("at", F.array().cast("array<int>")).alias("at")))).alias("p"))
    both = urls.withColumn("p", F.lit(None).cast(postings.schema["p"].dataType)).unionByName(postings.withColumn("x", F.lit(None).cast(urls.schema["x"].dataType)))
    one = both.agg(F.first("x", True).alias("x"), F.first("p", True).alias("p"))

    def step(w, _):
        dot = lambda u: F.aggregate(u["b"], F.lit(0.0), lambda acc, b: acc + F.get(w, b))
        residuals = F.transform(F.col("x"), lambda u: (_sigmoid(F.get(w, F.lit(0)) + dot(u) / u["s"]) - u["y"]) / n)

        def moved(r):
            scaled = F.zip_with(r, F.col("x"), lambda a, u: a / u["s"])
            bias = F.get(w, F.lit(0)) - BIAS_RATE * F.aggregate(r, F.lit(0.0), lambda acc, a: acc + a)
            rest = lambda g: F.transform(F.col("p"), lambda q: F.get(w, q["k"].cast("int")) * (1 - RATE * RIDGE) - RATE * F.aggregate(q["at"], F.lit(0.0), lambda acc, i: acc + F.get(g, i)))
            return F.concat(F.array(bias), let(scaled, rest))

        return let(residuals, moved)

    start = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("w")).first()["w"]
    return [round(w, 6) for w in found]


def judge(pages: DataFrame, weights: list[float], rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict."""
    host, path = split_url(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    h, p = F.col("host"), F.col("path")
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((h == rh) | h.endswith("." + rh)) & p.startswith(rp) for rh, rp, _ in longest_first]
    first = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)]) if fits else F.lit(None).cast("string")
    out = out.withColumn("rule", first([rh + rp for rh, rp, _ in longest_first]))
    out = out.withColumn("score", F.round(_sigmoid(_margin(buckets(h, p), weights)), 6))
    method = F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(first([v for _, _, v in longest_first]), method))
