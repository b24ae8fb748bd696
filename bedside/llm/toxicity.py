"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier trained on its posteriors.

Voters are words of a fixed lexicon, fixed patterns, and words and word beginnings found in labelled training rows; each fires or
not on a text, and a text's firings are its mask, a sorted array of voter numbers. A word fires the voter of the whole word, else that
of its longest beginning. The models are learnt from the table of distinct masks with their counts, which Spark aggregates over all
training rows (labelled or not).

0. Lexicon induction. In a bounded sample of labelled training rows (``SAMPLE`` of each class) Spark counts the texts that hold
   each word and word beginning (also lexicon words as beginnings of other words, such as inflected forms; lexicon words themselves
   do not count for a beginning). Terms that several toxic texts hold and that are nearly absent from clean ones become voters. Texts
   with one sketch (the smallest hash of two neighbouring words) count as copies here, unless they are a share of all toxic texts:
   else each rare word of a few copies would vote.
1. Label model. Each voter fires with one rate in toxic and another in clean texts, else it abstains. Expectation maximisation estimates the rates
   and the class share from the unlabelled counts, with the labelled rows held at their labels (without labels it starts from the
   assumption that lexicon words speak for toxicity). Only the sums of a round come to the driver, a few numbers per voter.
2. Correlations. Expected joint firings per class give the correlation of every two voters given the class; a voter's vote
   counts 1 / (1 + sum of its positive correlations), so that voters which say the same thing are not counted twice.
3. Classifier. Logistic regression over the firings, trained on the posteriors as soft labels (each mask once as toxic and once
   as clean, weighted by its count and posterior). Its weights become one Spark expression that scores every text.

Labels are read from training rows only: those for which ``crc32(doc_id as text) mod 5 <> 0``. Language, source, id and labels are
never inputs of a score. Null and empty texts fire no voter and get the score of an empty mask. A null id is held in training without
label. Repeated ids in ``labels`` count once (toxic wins); repeated documents are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, free_name, table, text_or_empty

#: Words of abuse, each a voter (lower case).
LEXICON = (
    "idiot", "idiots", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "trash", "garbage", "scum", "clown", "disgusting",
    "imbecile", "jerk", "vermin", "shit", "fuck", "bitch", "bastard", "asshole", "dummkopf", "arschloch", "abschaum", "connard", "salaud",
    "pendejo", "idiota",
)
#: Patterns, each a voter: (name, regular expression). The last two speak for a clean text.
PATTERNS = (
    ("address and insult", r"(?i)\byou(?:'re| are| all)?(?: such)?(?: an?)? (?:" + "|".join(LEXICON[:20]) + r")\b"),
    ("threat", r"(?i)\b(?:kill yourself|go to hell|drop dead|i will kill|shut up)\b"),
    ("stretched insult", r"(?i)\b(?:idi+o{2,}t|stu{2,}pid|lo{2,}ser|tra{2,}sh|mo{2,}ron)\b"),
    ("disguised insult", r"(?i)\b(?:1d[i1]ot|st[u*]p[1*]d|l[0*]s[e3*]r|f[*u]ck|sh[*1]t|m[0*]r[o0*]n)\b"),
    ("exclamation run", r"!{3,}"),
    ("courtesy", r"(?i)\b(?:please|thank you|thanks|gracias|merci|danke|bitte)\b"),
    ("citation", r"(?i)\bhttps?://|\[\d+\]|\bet al\b"),
)
EM_ROUNDS = 8
SMOOTH = 1.0
#: Start when there are no labels: rates of a lexicon voter in toxic and clean texts, of a pattern, and the toxic share.
START_LEXICON, START_PATTERN, START_SHARE = (0.1, 0.002), (0.05, 0.05), 0.1
#: Labelled rows of each class that lexicon induction reads at most (about), word beginnings in letters, and what a term needs:
#: so many different toxic texts (or this share of them, copies or not), and this many times the share of the clean ones.
SAMPLE = 10_000
BEGINNINGS = (4, 5)
TERM_TEXTS, TERM_SHARE, TERM_LIFT = 5, 0.02, 50.0


@dataclass(frozen=True)
class Voters:
    """What fires: whole words, word beginnings, and the fixed patterns, numbered in this order."""

    words: tuple[str, ...] = LEXICON
    beginnings: tuple[str, ...] = ()

    def __len__(self) -> int:
        return len(self.words) + len(self.beginnings) + len(PATTERNS)

    @property
    def n_terms(self) -> int:
        return len(self.words) + len(self.beginnings)

    def mask(self, text: Column) -> Column:
        """The numbers of the voters that fire on a text, ascending."""
        terms = (*self.words, *[b + "-" for b in self.beginnings])
        begin = f"|{_any_of(self.beginnings)}" if self.beginnings else ""
        # a whole word is found with the character after it, a beginning ends with a letter
        pattern = rf"(?<!\p{{L}})(?:{_any_of(self.words)}\P{{L}}{begin})"
        found = F.array_distinct(F.regexp_extract_all(F.concat(F.lower(text), F.lit(" ")), F.lit(pattern), F.lit(0)))
        number = F.create_map(*[x for k, t in enumerate(terms) for x in (F.lit(t), F.lit(k))])
        term = lambda t: F.when(t.rlike(r"\p{L}$"), F.concat(t, F.lit("-"))).otherwise(F.regexp_replace(t, r"\P{L}$", ""))
        fired = F.transform(found, lambda t: F.element_at(number, term(t)))
        patterns = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, (_, p) in enumerate(PATTERNS, len(terms))]))
        return F.array_sort(F.array_distinct(F.concat(fired, patterns)))


def _any_of(words: tuple[str, ...]) -> str:
    """A regular expression for any of the words, the longest first, that shares their beginnings."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        options = "|".join(re.escape(c) + written(node[c]) for c in sorted(node) if c)
        return f"(?:{options})" + ("?" if "" in node else "") if options else ""

    return written(tree)


def induce(docs: DataFrame, marks: DataFrame, scratch: Scratch, doc_id: str, text: str) -> Voters:
    """Voters with the terms found in labelled training rows; ``marks`` has ``doc_id, toxic``."""
    training = marks.filter(~held_out(F.col("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Voters()
    # a deterministic share of each class, by a hash of the id: about SAMPLE rows, which bounds the broadcast
    spot = F.pmod(F.xxhash64("doc_id", F.lit("terms")), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / sizes[1])).otherwise(min(1.0, SAMPLE / sizes[0]))
    sample = training.filter(spot < 1_000_000 * share).withColumnRenamed("doc_id", "marked")
    read = docs.select(F.col(doc_id).alias("marked"), text_or_empty(text).alias("text")).join(F.broadcast(sample), "marked")
    exact = _any_of(LEXICON)
    shortest = "|".join(sorted(map(re.escape, LEXICON), key=len))
    stems = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<!\p{{L}})(?!{exact}(?!\p{{L}}))(?:{shortest})"), F.lit(0))
    words = F.array_except(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), F.array(*map(F.lit, LEXICON)))
    # explode of one array keeps what is read twice a column of its own, made once
    once = lambda c: F.explode(F.array(c))
    read = read.select("toxic", "text", once(F.split("text", r"\s+")).alias("all"))
    sketch = F.array_min(F.transform("all", lambda w, i: F.xxhash64(w, F.get("all", i + 1))))
    read = read.select("toxic", sketch.alias("sketch"), F.transform(stems, lambda w: F.concat(w, F.lit("-"))).alias("stems"), once(words).alias("w"))
    terms = F.array_distinct(F.concat("w", "stems", *[_beginnings("w", n) for n in BEGINNINGS]))
    held = scratch.keep(read.select("toxic", "sketch", terms.alias("terms")), "terms")
    counted = held.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").cast("long").alias("bad"), F.sum(1 - F.col("toxic")).cast("long").alias("good")
    )
    n_bad, n_good = (min(SAMPLE, sizes[k]) for k in (1, 0))

    def strong(bad, good):
        return (bad >= TERM_TEXTS) & ((bad + 0.5) / (n_bad + 1) >= TERM_LIFT * (good + 0.5) / (n_good + 1))

    likely = scratch.keep(counted.filter(strong(F.col("bad"), F.col("good"))), "likely")
    texts = held.filter("toxic = 1").select("sketch", F.explode("terms").alias("term")).join(likely, "term")
    different = texts.groupBy("term", "bad", "good").agg(F.count_distinct("sketch").alias("texts"))
    enough = (F.col("texts") >= TERM_TEXTS) | (F.col("bad") >= TERM_SHARE * n_bad)
    # more toxic texts first, clean ones count against; of equals whole words, then longer ones
    worth = F.col("bad") - 20 * F.col("good")
    best = different.filter(enough).orderBy(worth.desc(), F.col("term").endswith("-").asc(), F.length("term").desc(), "term").collect()
    scratch.drop("terms", "likely")
    chosen: set[str] = set()
    below: dict[str, int] = {}  # toxic texts of the chosen terms that begin so
    for row in best:
        term, bad = row["term"], row["bad"]
        stem = term.rstrip("-")
        # nothing new if a chosen beginning covers it, or if chosen words and beginnings leave a beginning too little
        covered = any(stem[:n] + "-" in chosen for n in range(1, len(stem) + 1))
        if covered or term.endswith("-") and not strong(bad - below.get(stem, 0), row["good"]):
            continue
        chosen.add(term)
        for n in range(1, len(stem) + 1):
            below[stem[:n]] = below.get(stem[:n], 0) + bad
    found = sorted(chosen)
    return Voters((*LEXICON, *[t for t in found if not t.endswith("-")]), tuple(t[:-1] for t in found if t.endswith("-")))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _posterior(mask: Column, share: float, rates: list[tuple[float, float]], weights: list[float]) -> Column:
    """P(toxic | mask). A voter that does not fire abstains; one that fires counts its log ratio times its weight."""
    gains = [w * math.log(t / c) for (t, c), w in zip(rates, weights)]
    return 1 / (1 + F.exp(-_linear(mask, _logit(share), gains)))


def _linear(mask: Column, bias: float, gains: list[float]) -> Column:
    """bias + the gains of the voters that fire."""
    gain = F.array(*[F.lit(float(g)) for g in gains])
    return F.aggregate(mask, F.lit(float(bias)), lambda a, k: a + F.get(gain, k))


def _beginnings(words: str, n: int) -> Column:
    """The first ``n`` letters of each long enough word, marked by a hyphen."""
    return F.transform(F.filter(words, lambda w: F.char_length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))


def label_marks(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` (0 or 1), one row per labelled id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def mask_counts(voted: DataFrame, marks: DataFrame) -> DataFrame:
    """``mask, unlabelled, toxic, clean``: training rows per distinct mask. ``voted`` has ``doc_id, mask``."""
    training = voted.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id", "left")
    count = lambda c: F.sum(c.cast("long"))
    return training.groupBy("mask").agg(
        count(F.col("toxic").isNull()).alias("unlabelled"),
        count(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        count(F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("clean"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_model(counts: DataFrame, voters: Voters) -> tuple[float, list[tuple[float, float]], list[float]]:
    """(toxic share, firing rates of each voter in toxic and clean texts, weight of each voter)."""
    mask, n = F.col("mask"), len(voters)
    first = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    labelled = bool(first["t"]) and bool(first["c"])
    rates = [START_LEXICON if k < voters.n_terms else START_PATTERN for k in range(n)]
    share, ones = START_SHARE, [1.0] * n

    def expected(posterior: Column | None) -> DataFrame:
        part = F.lit(0.0) if posterior is None else F.col("unlabelled") * posterior
        rest = F.lit(0.0) if posterior is None else F.col("unlabelled") * (1 - posterior)
        return counts.select("mask", (F.col("toxic") + part).alias("w1"), (F.col("clean") + rest).alias("w0"))

    for round_ in range(EM_ROUNDS + 1):
        weighted = expected(None if labelled and round_ == 0 else _posterior(mask, share, rates, ones))
        # one row per voter that ever fires, and one for all rows
        voter = F.explode(F.concat(mask, F.array(F.lit(n))))
        sums = weighted.select(voter.alias("k"), "w1", "w0").groupBy("k").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0")).collect()
        found = {r["k"]: (r["w1"] or 0.0, r["w0"] or 0.0) for r in sums}
        all1, all0 = found.get(n, (0.0, 0.0))
        if all1 + all0 == 0:
            break
        share = min(max((all1 + SMOOTH) / (all1 + all0 + 2 * SMOOTH), 1e-6), 1 - 1e-6)
        rates = []
        for k in range(n):
            f1, f0 = found.get(k, (0.0, 0.0))
            # smoothed towards the common rate, so that a voter that never fires says nothing
            common = (f1 + f0 + 0.5) / (all1 + all0 + 1)
            rates.append(tuple(min(max((f + SMOOTH * common) / (a + SMOOTH), 1e-6), 1 - 1e-6) for f, a in ((f1, all1), (f0, all0))))
    return share, rates, _correlation_weights(expected(_posterior(mask, share, rates, ones)), rates)


def _correlation_weights(weighted: DataFrame, rates) -> list[float]:
    """1 / (1 + sum of positive correlations given the class), from expected joint firings; the sums are made in Spark."""
    totals = weighted.agg(F.sum("w1"), F.sum("w0")).first()
    pairs = (
        weighted.withColumn("i", F.explode("mask"))
        .withColumn("j", F.explode("mask"))
        .filter("i < j")
        .groupBy("i", "j")
        .agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))
    )
    found = [F.lit(0.0)]
    for side, total, both in ((0, totals[0], F.col("w1")), (1, totals[1], F.col("w0"))):
        if total:
            of_voter = F.array(*[F.lit(float(r[side])) for r in rates])
            a, b = F.get(of_voter, F.col("i")), F.get(of_voter, F.col("j"))
            spread = F.sqrt(a * (1 - a) * b * (1 - b))
            found.append(F.when(spread > 0, F.least(F.lit(1.0), (both / total - a * b) / spread)).otherwise(F.lit(0.0)))
    strongest = F.greatest(*found, F.lit(0.0))
    linked = pairs.select("i", "j", strongest.alias("c")).filter("c > 0.3").select(F.explode(F.array("i", "j")).alias("k"), "c")
    burden = {r["k"]: r["c"] for r in linked.groupBy("k").agg(F.sum("c").alias("c")).collect()}
    return [1 / (1 + burden.get(k, 0.0)) for k in range(len(rates))]


def classifier(counts: DataFrame, model, voters: Voters) -> tuple[float, list[float]]:
    """(intercept, weight of each voter) of a logistic regression on the posteriors."""
    n, mask = len(voters), F.col("mask")
    if counts.isEmpty():
        return _logit(START_SHARE), [0.0] * n
    posterior = _posterior(mask, *model)
    total = F.col("unlabelled") + F.col("toxic") + F.col("clean")
    numbers = counts.select(mask.cast("array<string>").alias("fired"), posterior.alias("p"), total.alias("n"))
    # sparse vectors, one column a voter
    soft = CountVectorizerModel.from_vocabulary([str(k) for k in range(n)], "fired", "features").transform(numbers)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("w"))))
    rows = soft.select("features", sides.alias("side")).select("features", "side.label", "side.w").filter(F.col("w") > 0)
    fitted = LogisticRegression(maxIter=40, regParam=1e-6, standardization=False, weightCol="w", aggregationDepth=2).fit(rows)
    return float(fitted.intercept), [float(x) for x in fitted.coefficients]


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``held_out``, ``score`` and ``predicted`` (an underscore is added where a name is taken)."""
    names = {k: free_name(k, docs.columns) for k in ("mask", "held_out", "score", "predicted")}
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    marks = scratch.keep(label_marks(labels), "marks")
    voters = induce(docs, marks, scratch, doc_id, text)
    voted = scratch.keep(docs.select(*kept, voters.mask(text_or_empty(text)).alias(names["mask"])), "votes")
    ready = voted.select(F.col(doc_id).alias("doc_id"), F.col(names["mask"]).alias("mask"))
    counts = scratch.keep(mask_counts(ready, marks), "masks")
    bias, weights = classifier(counts, label_model(counts, voters), voters)
    score = 1 / (1 + F.exp(-_linear(F.col(names["mask"]), bias, weights)))
    scored = voted.withColumns({names["held_out"]: held_out(F.col(doc_id)), names["score"]: score})
    return scored.withColumn(names["predicted"], (F.col(names["score"]) >= 0.5).cast("int")).drop(names["mask"])


def op3_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, folder, "labels"), Scratch(spark))
