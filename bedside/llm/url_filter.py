"""URL filters: rules by host and path, else a ratio of two character language models.

Rules. The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on up to
``?``, ``#`` or the end. A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's path; the
longest fitting rule gives the verdict.

Language models. Two smoothed variable-order Markov models (Witten-Bell interpolation of contexts of 4 to 0 characters) are
estimated from rejected and accepted URLs: rejected are those whose host holds a seed word, accepted the others that an allow rule
fits. What block rules catch trains neither: they name places, and the same hosts go on elsewhere. The models read the whole URL
after ``://``: host, path, query and fragment; only the longest end of the host that a rule names is left out (unless it is the whole
host), so that the models learn from the rest; digits are folded to ``0``. Counts come from four fifths
of the labelled strings. A URL's score is the mean over its characters of log P(accepted) - log P(rejected). The held-out fifth
of the accepted strings calibrates the limit: mean minus ``STRICTNESS`` standard deviations of their scores. No rule and a score
below the limit: block; else allow. The limit, and the shares of the held-out accepted and rejected URLs below it, are logged.

Everything is a DataFrame expression. Equal strings are counted before their n-grams are made, and the n-gram tables, which
grow with the input, are joined, not broadcast by hint; joins with frequent n-grams or strings are left to the adaptive skew join.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed (an empty string scores 0, and the
limit is at most 0). Repeated rows get the same verdict. An empty table gives no rows; without labelled URLs all scores are 0.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, free_name, table

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words in a host that mark a URL as rejected for training.
SEEDS = ("casino", "bets", "pills", "adult", "spam", "porn", "viagra", "ads-")
ORDER = 5  # characters of the longest n-gram: a context of 4 and the next character
STRICTNESS = 3.0
ALPHABET = 256.0
PAD = "\u0001"

log = logging.getLogger(__name__)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    return F.translate(_part(url, 1), _UPPER, _LOWER), _part(url, 2)


def url_rest(url: Column) -> Column:
    """Query and fragment, with their signs."""
    return _part(url, 3)


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", n), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict), null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is put on last, outermost
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def modelled(host: Column, path: Column, rest: Column, rules=RULES) -> Column:
    """What the models read: the host without the longest end that a rule names, a bar, path, query and fragment; digits as 0."""
    front = host
    for name in sorted({rule.partition("/")[0] for rule, _ in rules}, key=len):  # the longest is put on last, outermost
        front = F.when(host.endswith("." + name), F.substring(host, F.lit(1), F.char_length(host) - len(name) - 1)).otherwise(front)
    whole = F.concat(front, path, rest)
    return F.regexp_replace(F.when(whole != "", F.concat(front, F.lit("|"), path, rest)).otherwise(""), "[0-9]", "0")


def string_scores(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """``s, score`` for a table of distinct strings ``s`` with training weights ``accepted`` and ``rejected``."""
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col("s"))
    starts = F.sequence(F.lit(1), F.char_length("s"))
    grams = (
        strings.filter(F.col("s") != "")
        .select("s", "accepted", "rejected", F.transform(starts, lambda i: F.substring(padded, i, F.lit(ORDER))).alias("g"))
        .select("s", "accepted", "rejected", F.explode("g").alias("g"))
    )
    classes = ("accepted", "rejected")
    counted = scratch.keep(grams.groupBy("g").agg(*[F.sum(c).alias(c) for c in classes]), "grams")
    lower = None
    for size in range(1, ORDER + 1):
        level = counted if size == ORDER else counted.groupBy(F.substring("g", ORDER - size + 1, size).alias("g")).agg(*[F.sum(c).alias(c) for c in classes])
        context = F.substring("g", 1, size - 1) if size > 1 else F.lit("")
        level = level.withColumn("context", context)
        totals = level.groupBy("context").agg(
            *[F.sum(c).alias(f"n_{c}") for c in classes], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in classes]
        )
        level = level.join(totals, "context")
        if lower is None:
            level = level.withColumns({f"low_{c}": F.lit(1.0 / ALPHABET) for c in classes})
        else:
            level = level.withColumn("shorter", F.substring("g", 2, size - 1)).join(lower, "shorter")
        probability = {
            c: F.when(F.col(f"n_{c}") + F.col(f"t_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"low_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(
                F.col(f"low_{c}")
            )
            for c in classes
        }
        if size < ORDER:
            lower = level.select(F.col("g").alias("shorter"), *[p.alias(f"low_{c}") for c, p in probability.items()])
        else:
            ratios = level.select("g", (F.log(probability["accepted"]) - F.log(probability["rejected"])).alias("ratio"))
    sums = grams.select("s", "g").join(ratios, "g").groupBy("s").agg((F.sum("ratio") / F.count("*")).alias("score"))
    return strings.join(sums, "s", "left").select("s", F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrate(strings: DataFrame, scores: DataFrame) -> tuple[float, float | None, float | None]:
    """(limit, share of held-out accepted URLs not below it, share of held-out rejected URLs below it); a share of none is None.

    ``strings`` has ``s, held, all_accepted, all_rejected``.
    """
    held = strings.filter("held and (all_accepted > 0 or all_rejected > 0)").join(scores, "s")
    # one row: the limit, from weighted moments of the held-out accepted strings
    w, score = F.col("all_accepted"), F.col("score")
    moments = held.agg(F.sum(w).alias("w"), F.sum(w * score).alias("a"), F.sum(w * score * score).alias("b"))
    mean, square = F.try_divide("a", "w"), F.try_divide("b", "w")
    lowest = mean - STRICTNESS * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    limit = moments.select(F.least(F.lit(0.0), F.coalesce(lowest, F.lit(0.0))).alias("limit")).first()["limit"]
    passed, caught = F.when(score >= limit, w).otherwise(0), F.when(score < limit, F.col("all_rejected")).otherwise(0)
    shares = held.agg(F.try_divide(F.sum(passed), F.sum(w)).alias("passed"), F.try_divide(F.sum(caught), F.sum("all_rejected")).alias("caught")).first()
    return limit, shares["passed"], shares["caught"]


def judge(pages: DataFrame, scratch: Scratch, url: str = "url", rules=RULES, seeds=SEEDS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (an underscore is added where a name is taken)."""
    n = {k: free_name(k, pages.columns) for k in ("host", "path", "rule", "verdict", "score", "string", "ruled")}
    parts = pages.withColumns(dict(zip((n["host"], n["path"]), url_parts(F.col(url)))))
    host, path = F.col(n["host"]), F.col(n["path"])
    rule, ruled = longest_rule(host, path, rules)
    parts = parts.withColumns({n["rule"]: rule, n["ruled"]: ruled, n["string"]: modelled(host, path, url_rest(F.col(url)), rules)})
    seeded = F.lit(False)
    for word in seeds:
        seeded = seeded | host.contains(word)
    rejected = seeded
    accepted = (F.col(n["ruled"]) == "allow") & ~seeded
    as_count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    strings = parts.groupBy(F.col(n["string"]).alias("s")).agg(as_count(accepted).alias("all_accepted"), as_count(rejected).alias("all_rejected"))
    held = F.pmod(F.crc32(F.col("s").cast("binary")), F.lit(5)) == 0
    strings = strings.withColumns({**{c: F.when(held, 0).otherwise(F.col(f"all_{c}")) for c in ("accepted", "rejected")}, "held": held})
    strings = scratch.keep(strings, "strings")
    scores = scratch.keep(string_scores(strings.select("s", "accepted", "rejected"), scratch), "scores")
    limit, passed, caught = calibrate(strings, scores)
    log.info("limit %s; held-out URLs: %s of the accepted not below it, %s of the rejected below it", limit, passed, caught)
    judged = parts.join(scores.withColumnsRenamed({"s": n["string"], "score": n["score"]}), n["string"])
    verdict = F.coalesce(F.col(n["ruled"]), F.when(F.col(n["score"]) < F.lit(limit), "block").otherwise("allow"))
    return judged.withColumn(n["verdict"], verdict).drop(n["string"], n["ruled"])


def op5_url_filter(spark, folder):
    judged = judge(table(spark, folder, "pages").select("page_id", "url"), Scratch(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
