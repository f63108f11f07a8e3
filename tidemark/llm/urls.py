"""URL filter: host and path rules, and a character language-model ratio for urls that no rule fits.

Two variable-order Markov models over characters are learned from the urls that rules accept and reject (each
different url once in either), with Witten-Bell smoothing from order 4 down to a uniform base.  A url's score is the
difference of its log-likelihoods a character; urls at or above a threshold are accepted.  The threshold is the
one with the best balanced accuracy on a fifth of the ruled urls that the models haven't seen.

For the models, A-Z is lower-cased, each digit counts as ``0`` and anything but printable ASCII as ``?``; so there
are at most 64 symbols, and tables for contexts of up to two characters have at most 64**3 rows.

Everything is DataFrame functions.  Only distinct 5-grams are joined with the models, never urls with urls.

Defined results: a null url, or one without ``://``, has empty host and path; a null url's text is empty, and
its score is that of the end symbol alone; repeated rows get the same verdict; with no ruled urls all scores are 0
and the verdict is ``allow``; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

#: (action, host, path prefix) of the contract (fixed values).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

ORDER = 4
_SYMBOLS = 64
#: Log ratios are summed as whole numbers of this part of one, so that a sum doesn't depend on its order.
_UNIT = float(1 << 30)
_BEGIN, _STOP = "\u0002", "\u0003"
#: Largest number of distinct grams whose scores are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GRAMS = 400_000


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its action; null where none fits."""
    name = action = F.lit(None).cast("string")
    for what, h, p in sorted(RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def model_text(url: Column) -> Column:
    text = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), "123456789", "0" * 9)
    return F.regexp_replace(text, "[^ -~]", "?")


def grams(text: Column) -> Column:
    """All (ORDER + 1)-grams of the padded text, one for each character and the end."""
    padded = F.concat(F.lit(_BEGIN * ORDER), text, F.lit(_STOP))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def gram_scores(counted: DataFrame) -> DataFrame:
    """From ``(gram, a, r)``, counts under either model, to ``(gram, llr)``: log P_a - log P_r of its last character."""
    lower = None
    for k in range(ORDER + 1):
        pair = counted.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.substring("g", 1, k)
        ctx = pair.groupBy(context.alias("h")).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        joined = pair.withColumn("h", context).join(F.broadcast(ctx) if k <= 2 else ctx, "h")
        if lower is None:
            joined = joined.withColumns({"pa": F.lit(1.0 / _SYMBOLS), "pr": F.lit(1.0 / _SYMBOLS)})
        else:
            joined = joined.withColumn("s", F.substring("g", 2, k)).join(F.broadcast(lower) if k <= 3 else lower, "s")

        def smooth(n: str, total: str, types: str, p: str) -> Column:
            return F.when(F.col(total) > 0, (F.col(n) + F.col(types) * F.col(p)) / (F.col(total) + F.col(types))).otherwise(F.col(p))

        lower = joined.select(F.col("g").alias("s"), smooth("a", "na", "ta", "pa").alias("pa"), smooth("r", "nr", "tr", "pr").alias("pr"))
    return lower.select(F.col("s").alias("gram"), (F.log("pa") - F.log("pr")).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """Score with the best balanced accuracy over ``(score, good)``, from a histogram of at most 801 bins."""
    bins = scored.select(F.floor(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), "score")) * 50).alias("bin"), "good")
    rows = sorted(tuple(r) for r in bins.groupBy("bin").agg(F.count_if("good"), F.count_if(~F.col("good"))).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, at, bad_below, good_below = 1.0, 0.0, 0, 0
    for b, g, n in rows:
        if good and bad and bad_below / bad + 1 - good_below / good > best:
            best, at = bad_below / bad + 1 - good_below / good, b / 50
        bad_below, good_below = bad_below + n, good_below + g
    return at


def filter_urls(pages: DataFrame, rules=None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``; score is null where a rule decides."""
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", model_text(F.col("url")).alias("text"), host.alias("host"), path.alias("path"))
    rule, action = judge(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "action": action})
    distinct = named.select("text", (F.col("action") == "allow").alias("good")).distinct()
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    distinct = distinct.withColumn("train", F.col("good").isNotNull() & ~held)
    each = distinct.select("text", "good", "train", F.explode(grams(F.col("text"))).alias("gram"))
    counted = each.groupBy("gram").agg(F.count_if(F.col("train") & F.col("good")).alias("a"), F.count_if(F.col("train") & ~F.col("good")).alias("r"))
    counted = counted.persist()
    scores = gram_scores(counted).select("gram", F.round(F.col("llr") * _UNIT).cast("long").alias("llr")).persist()
    try:
        few = scores.count() <= BROADCAST_GRAMS
        judged = each.where(~F.col("train")).join(F.broadcast(scores) if few else scores, "gram")
        by_text = checkpointed(judged.groupBy("text", "good").agg((F.sum("llr") / F.count("*") / _UNIT).alias("score")))
    finally:
        scores.unpersist()
        counted.unpersist()
    cut = threshold(by_text.where(F.col("good").isNotNull()))
    out = named.join(by_text.where(F.col("good").isNull()).select("text", "score"), "text", "left")
    open_ = F.col("action").isNull()
    verdict = F.when(~open_, F.col("action")).when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(open_, F.col("score")).alias("score"))
