"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every measure is a Spark expression over the words and lines of one text, so a filter needs no shuffle, no user function
and no state. Each rule bounds one ratio from below, above or both; a document is kept if no base rule and no rule of the
table fails. A text that is null counts as empty; empty texts have all measures 0 and fail the base rule on length. Rows
are judged one by one, so repeated rows and ties get the same verdict, and other columns of the input pass through
``filter_quality`` untouched (helper columns take names that the input does not use).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.llm.common import free_name, words

#: Frequent function words of English, German, French and Spanish, lower case.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or that the this to was were which will with "
    "auf aus das dem den der des die ein eine er es ist im mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """``low <= measure / per <= high`` must hold (no bound: None); a zero denominator passes.

    ``slack`` is added to the measure for the lower bound, so that a short text is not judged by one word.
    """

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None
    slack: int = 0

    def passes(self) -> Column:
        value = F.col(f"m.{self.measure}").cast("double")
        per = F.col(f"m.{self.per}").cast("double")
        test = F.lit(True)
        if self.low is not None:
            test = test & (value + float(self.slack) >= per * self.low)
        if self.high is not None:
            test = test & (value <= per * self.high)
        return test | (per == 0)


#: The default table. Ratios are per word or per line.
RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.25),
    Rule("stop words per word", "n_stop_words", "n_words", 0.05, None, slack=1),
    Rule("words with a letter", "n_letter_words", "n_words", 0.55, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.4),
    Rule("list lines", "n_list_lines", "n_lines", None, 0.9),
    Rule("cut lines", "n_cut_lines", "n_lines", None, 0.3),
)

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_stop_words",
    "n_letter_words",
    "n_list_lines",
    "n_cut_lines",
)


def measured(docs: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """``docs`` with a struct column ``into`` of the measures of :data:`MEASURES`, all long."""
    if into in docs.columns:
        raise ValueError(f"{into} is taken")
    t, w, lines, h, g, s, pos = (free_name(x, docs.columns) for x in ("_t", "_w", "_l", "_h", "_g", "_s", "_pos"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias(t))
    step = step.select(
        *own,
        t,
        words(F.col(t)).alias(w),
        F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    # windows of words as hashes, computed from one hash a word
    step = step.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    last = F.size(h) - WINDOW
    step = step.withColumn(
        g,
        F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(WINDOW)])),
        ),
    )
    # only a text in which some window comes twice needs its windows sorted
    step = step.withColumn(
        s,
        F.when(
            F.size(F.array_distinct(F.col(g))) < F.size(F.col(g)),
            F.sort_array(F.transform(F.col(g), lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
        ),
    )
    step = step.withColumn(
        pos,
        F.when(
            F.size(F.col(s)) > 0,
            F.sort_array(
                F.filter(
                    F.transform(
                        F.col(s),
                        lambda x, j: F.when(
                            (x["g"] == F.get(F.col(s), j - 1)["g"]) | (x["g"] == F.get(F.col(s), j + 1)["g"]), x["i"]
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        ),
    )
    covered = F.when(
        F.size(F.col(pos)) > 0,
        F.aggregate(
            F.transform(F.col(pos), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(pos), k + 1) - p, F.lit(WINDOW)))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    ).otherwise(0)
    n_chars = F.char_length(F.regexp_replace(F.col(t), r"[\x20\x09-\x0D]+", ""))
    values = {
        "n_words": F.size(w),
        "word_chars": n_chars,
        "n_symbols": F.regexp_count(F.col(t), F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(F.col(lines))),
        "n_repeat_words": covered,
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(F.col(w), lambda x: x.isin(*STOP_WORDS))),
        "n_letter_words": F.size(F.filter(F.col(w), lambda x: x.rlike(r"\p{L}"))),
        "n_list_lines": F.size(F.filter(F.col(lines), lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•●]"))),
        "n_cut_lines": F.size(F.filter(F.col(lines), lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))),
    }
    # as a generated row, so that a filter on the measures is not pushed below them, where it would repeat their expressions
    row = F.struct(*[values[k].cast("long").alias(k) for k in MEASURES])
    return step.select(*own, F.explode(F.array(row)).alias(into))


def base_failed(into: str = "m") -> Column:
    n = F.col(f"{into}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{into}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def verdict(rules=RULES) -> Column:
    """True if every rule of the table passes; reads the struct ``m``."""
    result = F.lit(True)
    for rule in rules:
        result = result & rule.passes()
    return result


def quality(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``m`` of measures, ``base_failed`` and ``kept`` (underscores are added where names are taken)."""
    columns = docs.columns
    base, kept = free_name("base_failed", columns), free_name("kept", columns)
    clash = {c: free_name("m_own", columns) for c in columns if c.lower() == "m"}
    judged = measured(docs.withColumnsRenamed(clash), clash.get(text, text)).withColumns({base: base_failed(), kept: ~base_failed() & verdict(rules)})
    if not clash:
        return judged
    own = [F.col(f"`{clash.get(c, c)}`").alias(c) for c in columns]
    return judged.select(*own, F.col("m").alias(free_name("m", columns)), base, kept)


def filter_quality(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the table, with their own columns only."""
    columns = docs.columns
    clash = {c: free_name("m_own", columns) for c in columns if c.lower() == "m"}
    ready = docs.withColumnsRenamed(clash)
    good = measured(ready, clash.get(text, text)).filter(~base_failed() & verdict(rules))
    return good.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in columns])


def op4_quality_rules(spark, folder):
    from bedside.llm.common import table

    judged = quality(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"m.{k}").alias(k) for k in MEASURES[:5]], "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for rule in RULES:
        parts = [f"{rule.measure} + {rule.slack} >= {rule.per} * CAST({rule.low} AS DOUBLE)"] if rule.low is not None else []
        parts += [f"{rule.measure} <= {rule.per} * CAST({rule.high} AS DOUBLE)"] if rule.high is not None else []
        tests.append(f"({' AND '.join(parts)} OR {rule.per} = 0)")
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
starts AS (SELECT row, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
grams AS (SELECT row, i, list_slice(w, i, i + 4) AS g FROM starts),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY row),
m AS (SELECT w.row, doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '{blank}+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
             len(list_filter(l, lambda x: regexp_matches(x, '^{blank}*[-*•●]'))) AS n_list_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){blank}*$'))) AS n_cut_lines
      FROM w LEFT JOIN covered USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept
FROM b"""


OP4_SQL = _sql()
