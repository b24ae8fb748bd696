"""Ranked lexical search in reverse: an inverted index over the items, through which the documents stream.

The queries (items) are few and the documents are many, so the index is built over the items. Items are dealt into blocks of about
``POSTINGS`` (term, item) pairs; a block's index is all that is ever broadcast, and its size does not depend on the documents.

1. Statistics: each task streams its documents and adds up, for the index's terms only, how many documents hold them, with the numbers
   of documents and terms; Spark adds up the tasks' sums.
2. Ranking: each task streams its documents again. A batch's (document, term) counts become impacts, go through the index's
   postings, and are summed per (document, item). What reaches an item's bounded list of best documents updates it; at its end a task
   gives away its lists.
3. Merge: the lists of all tasks are merged per item by a ranked window, which Spark limits before the shuffle.

All scores are 64-bit integers (sums over doubles are split in halves where they could pass 2^53).

Terms are runs of ASCII letters, digits and any non-ASCII characters; only A-Z is lower-cased. Null and empty texts have no term; such
documents count nowhere and such items have no rows. Item rows with equal ids are one item with the terms of all of them; document rows are
documents of their own, whatever their ids, and a null id comes after the others of equal score. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, table

#: (term, item) pairs in a block of items; (document, item) cells and expanded postings held at a time.
POSTINGS = 200_000
CELLS = 1 << 20
#: Documents, and bytes of their text, tokenised at a time.
DOCS = 512
BYTES = 4 << 20
#: Rows of the statistics that are no term.
N_DOCS, N_TERMS = -1, -2

#: Every byte that no term holds becomes a space, A-Z lower case. Bytes of 0x80 and above belong to non-ASCII characters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and terms of a bounded number of texts at a time."""
    for batch in batches:
        names, found, held = [], [], 0
        for i in range(batch.num_rows):
            raw = batch.column("text")[i].as_py()
            names.append(batch.column("id")[i].as_py())
            found.append(terms(raw))
            held += len(raw)
            if len(names) == DOCS or held > BYTES:
                yield names, found
                names, found, held = [], [], 0
        if names:
            yield names, found


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term, n``: how often the rows of an item hold a term."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in _pieces(batches):
            sizes = [len(f) for f in found]
            ids = pa.array(names, pa.int64()).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t for f in found for t in f], pa.binary())], ["item", "term"])

    rows = _texts(items, item_id, text).mapInArrow(split, "item bigint, term binary")
    return rows.groupBy("item", "term").agg(F.count("*").alias("n"))


class Index:
    """Terms to items of one block, as flat arrays; weights come with the statistics."""

    def __init__(self, postings: list):
        """``postings``: (item, term, n) rows."""
        self.items = sorted({p.item for p in postings}, key=lambda i: (i is None, i))
        number = {item: i for i, item in enumerate(self.items)}
        names = sorted({bytes(p.term) for p in postings})
        self.terms = {t: i for i, t in enumerate(names)}
        rows = sorted((self.terms[bytes(p.term)], number[p.item], p.n) for p in postings)
        of, self.item, self.times = (np.array(v, np.int64) for v in zip(*rows))
        self.start = np.searchsorted(of, np.arange(len(names)))
        self.length = np.bincount(of, minlength=len(names))
        self.weights = np.zeros(len(names), np.int64)
        self.n_docs = self.n_terms = 0

    def known(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words' terms, those the index has not left out."""
        found = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        return found[found >= 0]

    def weigh(self, statistics: dict[int, int]) -> None:
        self.n_docs, self.n_terms = statistics.get(N_DOCS, 0), statistics.get(N_TERMS, 0)
        for t in range(len(self.weights)):
            self.weights[t] = math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * statistics.get(t, 0) + 1)))

    def scores(self, found: list[list[bytes]]) -> np.ndarray:
        """Scores of the texts (rows) for the block's items (columns)."""
        n_items, n_terms = len(self.items), len(self.weights)
        known = [self.known(f) for f in found]
        keys = np.concatenate([k + d * n_terms for d, k in enumerate(known)]) if known else np.zeros(0, np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = keys // n_terms, keys % n_terms
        lengths = np.array([25 + 75 * len(f) * self.n_docs // max(1, self.n_terms) for f in found], np.int64)
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * lengths[doc]))
        out = np.zeros((len(found), n_items), np.int64)
        # a bounded number of postings at a time; a document and term has at most one per item
        ends = np.cumsum(self.length[term])
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            sizes = self.length[term[at:stop]]
            of = np.repeat(np.arange(at, stop), sizes)
            within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = self.start[term[of]] + within
            value = impact[of] * self.times[place]
            _add(out, doc[of] * n_items + self.item[place], value)
            at = stop
        return out


def _add(out: np.ndarray, cells: np.ndarray, values: np.ndarray) -> None:
    """Adds integers to cells of ``out``, exactly."""
    if not len(cells):
        return
    low, high = int(cells.min()), int(cells.max()) + 1
    part, cells = out.reshape(-1)[low:high], cells - low
    if values.sum(dtype=np.float64) < 2.0**52:
        part += np.bincount(cells, values, high - low).astype(np.int64)
        return
    for shift, half in ((26, values >> 26), (0, values & ((1 << 26) - 1))):
        part += np.bincount(cells, half, high - low).astype(np.int64) << shift


class Best:
    """The ``k`` best documents of every item so far: highest score, then smallest id, nulls last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.limit = np.ones(n_items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)

    def update(self, names: list, scores: np.ndarray) -> None:
        limit = self.limit
        if len(scores) > self.k:
            limit = np.maximum(limit, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, new = np.nonzero(scores >= limit)
        if not len(row):
            return
        nameless = np.array([n is None for n in names])
        ids = np.array([0 if n is None else n for n in names], np.int64)
        item = np.concatenate([self.item, new])
        score = np.concatenate([self.score, scores[row, new]])
        doc, gone = np.concatenate([self.doc, ids[row]]), np.concatenate([self.nameless, nameless[row]])
        order = np.lexsort((doc, gone, -score, item))
        item, score, doc, gone = (v[order] for v in (item, score, doc, gone))
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begins, np.diff(begins, append=len(item)))
        last = place == self.k - 1
        self.limit[item[last]] = score[last]
        self.item, self.score, self.doc, self.nameless = (v[place < self.k] for v in (item, score, doc, gone))


def rank(docs: DataFrame, items: DataFrame, k: int, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 of every item."""
    spark = docs.sparkSession
    postings = scratch.keep(item_terms(items, item_id, item_text), "postings")
    n_blocks = max(1, math.ceil(postings.count() / POSTINGS))
    lists = None
    for number in range(n_blocks):
        rows = postings.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == number).collect()  # a block, about POSTINGS rows
        if not rows:
            continue
        index = Index(rows)
        statistics = {r.term: r.n for r in _statistics(_texts(docs, doc_id, text), spark.sparkContext.broadcast(index)).collect()}  # a row a term of the block
        index.weigh(statistics)
        found = _lists(_texts(docs, doc_id, text), spark.sparkContext.broadcast(index), k)
        found = scratch.keep(found, f"lists_{number}")
        lists = found if lists is None else lists.unionByName(found)
    if lists is None:
        lists = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _statistics(texts: DataFrame, index) -> DataFrame:
    """``term, n``: documents per term of the index, and the rows ``N_DOCS`` and ``N_TERMS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        held, n_docs, n_terms = np.zeros(len(block.weights), np.int64), 0, 0
        for _, found in _pieces(batches):
            for words in found:
                n_docs += bool(words)
                n_terms += len(words)
                held[np.unique(block.known(words))] += 1
        there = np.flatnonzero(held)
        columns = [pa.array([N_DOCS, N_TERMS, *there.tolist()], pa.int32()), pa.array([n_docs, n_terms, *held[there].tolist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    return texts.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _lists(texts: DataFrame, index, k: int) -> DataFrame:
    """``item_id, doc_id, score``: every task's best documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        best = Best(len(block.items), k)
        at_once = max(1, CELLS // max(1, len(block.items)))
        for names, found in _pieces(batches):
            for at in range(0, len(names), at_once):
                best.update(names[at : at + at_once], block.scores(found[at : at + at_once]))
        ids = pa.array(block.items, pa.int64()).take(pa.array(best.item))
        columns = [ids, pa.array(best.doc, pa.int64(), mask=best.nameless), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return texts.mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")


def op12_lexical_search(spark, folder):
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10, Scratch(spark))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY item_id, term),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * n_docs) // CAST(n_terms AS BIGINT) AS m FROM d, c WHERE len(terms) > 0),
s AS (SELECT i.item_id, m.r, m.doc_id, CAST(sum(w.w * i.times * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m))) AS BIGINT) AS score
      FROM t JOIN i USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i.item_id, m.r, m.doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
               FROM s WHERE score > 0) WHERE rank <= 10
"""
