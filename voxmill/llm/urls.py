"""URL filter: host and path rules first, then a ratio of two character language models.

Two variable-order Markov models, smoothed from the empty context up, learn from
the URLs that rules allow and block. A URL without a rule is judged by the
difference of its log-likelihoods for each character, against a threshold
calibrated on ruled URLs that the models didn't see. All counts cover all URLs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.session import checkpoint

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_RULES = 1000
ORDER, SYMBOLS = 4, 257
UNIT = 1e6  # log-likelihood ratios are summed as whole millionths, so that sums don't depend on their order
BUCKET, MOST = 10_000, 2000  # calibration: hundredths of a nat a character, up to 20 nats either way


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(s: Column, order: int) -> Column:
    """Each character of the text and its end mark, after its ``order`` predecessors."""
    padded = F.concat(F.lit("\x02" * order), s, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(s) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def model(strings: DataFrame, order: int) -> DataFrame:
    """(gram, sums and kinds of both classes) of every order from (s, allow, block), the last two weights."""
    top = strings.select(F.explode(grams(F.col("s"), order)).alias("g"), "allow", "block").groupBy("g").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    k = F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("k")
    return top.select("g", "allow", "block", k).groupBy(F.expr("right(g, k)").alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def ratios(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(g, ratio): log P_allow - log P_block of each wanted gram's last character, in whole millionths.

    Witten-Bell: with n of N times, and T kinds of characters seen in a context,
    P = (n + T * P_shorter) / (N + T), from 1 / SYMBOLS up.
    """
    contexts = counts.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
        *(F.sum(c).alias(f"{c}_n") for c in ("allow", "block")), *(F.count_if(F.col(c) > 0).alias(f"{c}_t") for c in ("allow", "block"))
    )
    parts = wanted.select("g", F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("k")).withColumn("gram", F.expr("right(g, k)"))
    parts = parts.join(counts, "gram", "left").withColumn("context", F.expr("left(gram, k - 1)")).join(contexts, "context", "left")
    levels = F.array_sort(F.collect_list(F.struct("k", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for x in ("allow", "block") for c in (x, f"{x}_n", f"{x}_t")))))

    def p(x: str) -> Column:
        step = lambda last, v: F.when(v[f"{x}_n"] > 0, (v[x] + v[f"{x}_t"] * last) / (v[f"{x}_n"] + v[f"{x}_t"])).otherwise(last)
        return F.aggregate("levels", F.lit(1.0 / SYMBOLS), step)

    return parts.groupBy("g").agg(levels.alias("levels")).select("g", F.round((F.log(p("allow")) - F.log(p("block"))) * UNIT).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> int:
    """Bucket of the mean ratio from which URLs are allowed: the best balanced accuracy, and of equal ones the lowest.

    ``scored`` has bucket, allow and block; at most 2 * MOST + 1 rows come back.
    """
    rows = sorted((r[0], float(r[1]), float(r[2])) for r in scored.groupBy("bucket").agg(F.sum("allow"), F.sum("block")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0
    best, at, missed, caught = -1.0, 0, 0.0, 0.0
    for bucket, a, b in [*rows, (MOST + 1, 0.0, 0.0)]:
        value = (good - missed) / good + caught / bad
        if value > best + 1e-12:
            best, at = value, bucket
        missed, caught = missed + a, caught + b
    return at


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    Reads page_id and url; other columns are ignored. The models read host and path
    with every digit as 0, each distinct text once, weighted by its rows. A fifth of
    the distinct ruled texts, by hash, calibrates the threshold. The score is the
    mean log-likelihood ratio of a character. Null and malformed URLs have an empty
    host and path and are judged by the models; if rules allow or block no URL at
    all, the models allow. Repeated rows stay; an empty table gives no rows.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = first_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "said": said, "s": F.regexp_replace(F.concat("host", "path"), "[0-9]", "0")})
    strings = checkpoint(p.groupBy("s").agg(F.count_if(F.col("said") == "allow").alias("allow"), F.count_if(F.col("said") == "block").alias("block")))
    ruled = (F.col("allow") + F.col("block")) > 0
    unseen = F.pmod(F.xxhash64("s"), F.lit(5)) == 0
    counts = checkpoint(model(strings.where(ruled & ~unseen), order))
    at = strings.select("s", F.explode(grams(F.col("s"), order)).alias("g"))
    ratio = ratios(at.select("g").distinct(), counts, order)
    scores = at.join(ratio, "g").groupBy("s").agg((F.sum("ratio") / F.count("*")).alias("mean"))
    bucket = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.col("mean") / BUCKET)))
    scores = checkpoint(scores.join(strings, "s").withColumn("bucket", bucket))
    known = counts.agg(F.sum("allow"), F.sum("block")).first()
    cut = threshold(scores.where(ruled & unseen)) if known[0] and known[1] else -MOST
    scores = scores.select("s", (F.col("mean") / UNIT).alias("score"), F.when(F.col("bucket") >= cut, "allow").otherwise("block").alias("guess"))
    return p.join(scores, "s").select("page_id", "host", "path", "rule", F.coalesce("said", "guess").alias("verdict"), "score")
