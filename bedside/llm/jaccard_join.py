"""N-gram Jaccard join with vertical partitioning, and the groups that its links make.

A document's set holds the 5-word shingles of its lower-cased (A-Z) words; with fewer words the whole sequence is the one shingle.
Two sets link when ``100 * intersection >= 75 * union``.

1. Sign: each text is hashed once; equal sets are one class (128-bit digest), so copies cost no pair.
2. Vertical partitioning: the global order of n-grams (their 64-bit hashes) is cut into fragments. Every document's set is cut
   accordingly, and each fragment is worked on alone: it counts in how many classes each n-gram occurs and keeps those of two or
   more. Frequent n-grams and large documents spread over fragments; a fragment holds about ``FRAGMENT`` n-grams at any size of the input.
   What is kept is dealt back by class. All rows on the way are packed, one per task and fragment.
3. Candidates. A class can link only if three quarters of its set are shared n-grams. By frequency, rarest first, two linked sets
   meet within their prefixes; the positions there bound the overlap, which drops pairs that share only frequent passages.
4. Verify: a pair's partial overlaps are counted per (coarser) fragment and summed. Every candidate pair is counted exactly.
5. Groups. Only pairs between different groups can change the result. So rounds first compare each n-gram's holders with a few pivots, which are
   the holders with the smallest share of n-grams of their own (a number of pairs linear in the holders), merge groups, and go on with n-grams that still join several groups;
   when few pairs are left, all of them are verified. No link between groups is lost, and a crowd of near copies costs about its
   size, not its square.

Texts that are null or hold no word have an empty set and are alone. Repeated rows and ids are fine: rows are identified by their set
only. Null ids: a group's id is the smallest id that is not null (null if there is none). Empty tables give no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, free_name, small_batches, table, text_or_empty
from bedside.llm.graph import components

SHINGLE = 5
#: Linked if LINK_TOP * intersection >= LINK_PART * union.
LINK_TOP, LINK_PART = 100, 75
#: N-grams in a fragment (about), slices (a power of two) in which a task sorts them, coarser fragments for verification, bytes of text hashed at once.
FRAGMENT = 3_000_000
SLICES = 8
VERIFY_FRAGMENTS = 4
PIECE_BYTES = 1 << 18
#: Pivot rounds end when the pairs left are at most ENOUGH times the postings, when a round leaves more than the share SLOW of them,
#: or after MAX_ROUNDS. From the second round on every n-gram has PIVOTS pivots.
ENOUGH, SLOW, MAX_ROUNDS, PIVOTS = 4, 0.5, 8, 4

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of texts that lie side by side in ``data`` up to ``ends``."""
    low = _LOWER[data]
    letter = ~_SPACE[low]
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < len(data)]
    starts[first] = letter[first]  # a text's first character starts a word, whatever stands before
    starts = np.flatnonzero(starts)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    at = np.flatnonzero(letter)
    begin = np.searchsorted(at, starts)
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(begin, size)
    powers = np.multiply.accumulate(np.full(int(size.max()), _STEP, np.uint64))
    sums = np.add.reduceat(_BYTE[low[at]] * powers[place], begin)
    return _mix(sums + size.astype(np.uint64)), np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PIECE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        words, counts = word_hashes(data[offsets[begin] : offsets[stop]], offsets[begin + 1 : stop + 1] - offsets[begin])
        n = len(words) - SHINGLE + 1
        if n > 0:
            grams = words[:n] * _PLACE[0]
            for k in range(1, SHINGLE):
                grams += words[k : n + k] * _PLACE[k]
            grams = _mix(grams)
        at = 0
        for count in counts.tolist():
            if count >= SHINGLE:
                found = np.sort(grams[at : at + count - SHINGLE + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif count:
                yield _mix((words[at : at + count] * _PLACE[:count]).sum(keepdims=True) + np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)
            at += count
        begin = stop


def digest(grams: np.ndarray) -> bytes | None:
    """128 bits for a set; None for the empty one."""
    if not len(grams):
        return None
    first, second = _mix(grams ^ _STEP).sum(), _mix(grams + _BYTE[7]).sum()
    return struct.pack("<QQ", int(first), int(second))


def signed(docs: DataFrame, text: str, class_name: str, size_name: str, keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) with the class (binary, null if empty) and size of each row's set."""
    own = [c for c in docs.columns if keep_text or c != text]
    kept = [F.col(f"`{c}`") for c in own]
    schema = docs.select(*kept).schema.add(class_name, "binary").add(size_name, "long")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((digest(g), len(g)) for g in shingle_sets(batch.column(len(own))))
            keys, sizes = zip(*sets) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], [*own, class_name, size_name])

    hidden = free_name("_text", docs.columns)
    return docs.select(*kept, text_or_empty(text).alias(hidden)).mapInArrow(sign, schema)


def _pack(into: np.ndarray, names: np.ndarray, sizes: np.ndarray, owner: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One row per bucket of ``into``: for each owner in it the name, size and count of its values, then the values.

    ``into`` and ``owner`` go with the values, ``names`` and ``sizes`` with the owners; values of an owner lie side by side.
    """
    order = np.argsort(into.astype(np.uint16) if len(into) and into.max() < 1 << 16 else into, kind="stable")
    into, owner, values = into[order], owner[order], [v[order] for v in values]
    bounds = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1], [True]])) if len(into) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        mine = owner[a:b]
        begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        counts = np.diff(np.append(begin, b - a)).astype("<u4")
        parts = (struct.pack("<I", len(begin)), names[mine[begin]], sizes[mine[begin]].astype("<u4"), counts, *[v[a:b] for v in values])
        rows.append(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts))
    return pa.RecordBatch.from_arrays([pa.array(into[bounds[:-1]].astype(np.int64), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "packed"])


def _unpack(group: pa.Table, *kinds: str) -> list[np.ndarray]:
    """(names, sizes, counts, values, ...) of all rows of a bucket."""
    found = [[] for _ in range(3 + len(kinds))]
    for row in group.column("packed"):
        data = row.as_buffer()
        (n,) = struct.unpack_from("<I", data)
        at = 4
        for k, kind in enumerate(("V16", "<u4", "<u4")):
            found[k].append(np.frombuffer(data, kind, n, at))
            at += found[k][-1].nbytes
        m = int(found[2][-1].sum())
        for k, kind in enumerate(kinds, 3):
            found[k].append(np.frombuffer(data, kind, m, at))
            at += found[k][-1].nbytes
    return [np.concatenate(f) for f in found]


def _order_of(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the names, whether each name in that order is a new one)."""
    pair = names.view([("a", "<u8"), ("b", "<u8")])
    order = np.lexsort((pair["b"], pair["a"]))
    ordered = pair[order]
    return order, np.concatenate([[True], ordered[1:] != ordered[:-1]])


PACKED = "bucket bigint, packed binary"


def _cut(n_fragments: int):
    """Batches of texts to their sets, cut into fragments of the order of n-grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(keys, sets):
            grams, sizes = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            return _pack(fragment_of(grams, n_fragments), np.frombuffer(b"".join(keys), "V16"), sizes, owner, grams.astype("<u8"))

        for batch in batches:
            keys, sets, size = [], [], 0
            for grams in shingle_sets(batch.column(0)):
                if len(grams):
                    keys.append(digest(grams))
                    sets.append(grams)
                    size += len(grams)
                if size >= 1_000_000:
                    yield pack(keys, sets)
                    keys, sets, size = [], [], 0
            if sets:
                yield pack(keys, sets)

    return cut


def fragment_of(grams: np.ndarray, n_fragments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(n_fragments)) >> np.uint64(32)


def _shared(n_buckets: int):
    """A fragment's n-grams that occur in two classes or more, with their number of classes, dealt by class.

    N-grams are sorted and dealt in ``SLICES``, so that beside them a worker needs room for a small part of them only.
    """

    def shared(group: pa.Table) -> pa.Table:
        name, size, count, gram = _unpack(group, "<u8")
        # of a class's copies the first counts
        order, new = _order_of(name)
        chosen = np.zeros(len(name), bool)
        chosen[order[new]] = True
        owner = np.repeat(np.arange(len(name), dtype=np.int32), count)
        uses = np.zeros(len(gram), "<u4")  # stays 0 in copies
        last = gram.view("u1")[::8] & np.uint8(SLICES - 1)
        for k in range(SLICES):
            at = np.flatnonzero((last == k) & chosen[owner])
            by_gram = np.argsort(gram[at], kind="stable")
            at = at[by_gram]
            ordered = gram[at]
            begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else at
            runs = np.diff(np.append(begin, len(ordered)))
            uses[at] = np.repeat(runs, runs)
        bucket = fragment_of(_mix(name.view([("a", "<u8"), ("b", "<u8")])["a"]), n_buckets)
        part = bucket * np.uint64(SLICES) // np.uint64(n_buckets)
        tables = []
        for k in range(SLICES):
            at = np.flatnonzero((uses > 1) & (part == k)[owner])  # still in the order of owners
            own = owner[at]
            tables.append(_pack(bucket[own], name, size, own, gram[at], uses[at]))
        return pa.Table.from_batches(tables)

    return shared


ABLE = "v binary, n int, m int, grams array<bigint>"


def _able(group: pa.Table) -> pa.Table:
    """The classes of a bucket that can link: digest, size, number of shared n-grams, and these, rarest first (sorted in ``SLICES``)."""
    name, size, count, gram, uses = _unpack(group, "<u8", "<u4")
    order, new = _order_of(name)
    number = np.empty(len(name), np.int32)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    owner = np.repeat(number, count)
    m, n = np.bincount(owner, minlength=len(first)), size[first].astype(np.int64)
    able = LINK_TOP * m >= LINK_PART * n
    part = np.arange(len(first)) * SLICES // max(1, len(first))
    tables = []
    for k in range(SLICES):
        chosen = able & (part == k)
        at = np.flatnonzero(chosen[owner])
        at = at[np.lexsort((gram[at], uses[at], owner[at]))]
        offsets = np.concatenate([[0], np.cumsum(m[chosen])]).astype(np.int32)
        columns = [
            pa.array([x.tobytes() for x in name[first[chosen]]], pa.binary()),
            pa.array(n[chosen].astype(np.int32)),
            pa.array(m[chosen].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram[at].view(np.int64))),
        ]
        tables.append(pa.Table.from_arrays(columns, names=["v", "n", "m", "grams"]))
    return pa.concat_tables(tables)


def class_groups(docs: DataFrame, classes: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """``v, label`` of the classes that link with others. ``classes`` has ``v, n`` (digest and size of each set)."""
    spark = docs.sparkSession
    total = classes.agg(F.sum("n")).first()[0] or 0
    n_fragments = max(1, math.ceil(total / FRAGMENT))
    segments = docs.select(text_or_empty(text).alias("text")).mapInArrow(_cut(n_fragments), PACKED)
    shared = segments.groupBy("bucket").applyInArrow(_shared(n_fragments), PACKED)
    with small_batches(spark):
        able = scratch.keep(shared.groupBy("bucket").applyInArrow(_able, ABLE), "able")
    parts = able.select("v", F.explode(F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1))).alias("part"), "grams")
    parts = parts.select("v", "part", F.filter("grams", lambda g: F.pmod(F.shiftright(g, 32), F.lit(VERIFY_FRAGMENTS)) == F.col("part")).alias("grams"))
    # the rarest n - ceil(.75 n) + 1 of all n-grams are the prefix; those in one class only come first and find no partner
    need = F.ceil(F.col("n") * LINK_PART / LINK_TOP).cast("int")
    prefix = F.slice("grams", F.lit(1), F.col("m") - need + 1)
    postings = able.select("v", "n", "m", F.posexplode(prefix).alias("i", "gram"))
    postings = postings.select("v", "n", "gram", (F.col("n") - F.col("m") + F.col("i") + 1).alias("place"), ((F.col("n") - F.col("m")) / F.col("n")).alias("alone"))
    postings = scratch.keep(postings, "postings")
    # n-grams held by one class in its prefix join nothing; of n-grams with the same holders the first in order does for all
    # (it comes first in each of them, which the sum of places shows)
    same = (F.bit_xor(F.xxhash64("v")).alias("h1"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("h2"), F.count("*").alias("holders"))
    grams = postings.groupBy("gram").agg(*same, F.sum("place").alias("places")).filter("holders > 1")
    grams = grams.groupBy("h1", "h2", "holders").agg(F.min(F.struct("places", "gram"))["gram"].alias("gram")).select("gram")
    postings = scratch.keep(postings.join(grams, "gram", "left_semi"), "joining")

    def verified(pairs: DataFrame) -> DataFrame:
        a = parts.select(F.col("v").alias("a"), "part", F.col("grams").alias("grams_a"))
        b = parts.select(F.col("v").alias("b"), "part", F.col("grams").alias("grams_b"))
        partial = pairs.join(a, "a").join(b, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("o"))
        sums = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("o"))
        return sums.filter(LINK_TOP * F.col("o") >= LINK_PART * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")

    def possible(rows: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes and places allow a link; rows have ``a, b, n_a, n_b, place_a, place_b``."""
        bound = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
        reach = (LINK_TOP + LINK_PART) * bound >= LINK_PART * (F.col("n_a") + F.col("n_b"))
        sizes = LINK_TOP * F.least("n_a", "n_b") >= LINK_PART * F.greatest("n_a", "n_b")
        ends = [F.when(F.col("a") < F.col("b"), F.struct("a", "b", "n_a", "n_b")).otherwise(
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"))).alias("e")]
        return rows.filter(sizes & reach).select(*ends).select("e.*").distinct()

    groups, tried, previous = None, None, None
    for step in range(MAX_ROUNDS):
        # n-grams whose holders are in several groups, with the pairs they leave at most; others are done with
        labelled = postings.withColumn("label", F.col("v"))
        if groups is not None:
            labelled = scratch.keep(postings.join(groups, "v", "left").withColumn("label", F.coalesce("label", "v")), f"labelled_{step}")
        per_label = labelled.groupBy("gram", "label").agg(F.count("*").alias("c"))
        mixed = per_label.groupBy("gram").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("labels"))
        mixed = mixed.filter("labels > 1").select("gram", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("left"), "all")
        mixed = scratch.keep(mixed, f"mixed_{step}")
        left, held = mixed.agg(F.sum("left"), F.sum("all")).first()
        if not left:
            break
        open_ = scratch.keep(labelled.join(mixed.select("gram"), "gram"), f"open_{step}")
        postings = open_.drop("label")
        stuck = previous is not None and left > SLOW * previous
        last = left <= ENOUGH * held or stuck or step == MAX_ROUNDS - 1
        previous = left
        side = lambda k: [F.col("v").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "place", "label")]]
        if last:
            rows = open_.select("gram", *side("a")).join(open_.select("gram", *side("b")), "gram").filter("label_a < label_b")
        else:
            # the member with the smallest share of n-grams of its own is the middle of a crowd; later rounds take that of random parts
            seeds = range(PIVOTS if step else 1)
            order = F.struct("alone", F.xxhash64("v", F.lit(step)).alias("h"), *side("a"))
            part = F.pmod(F.xxhash64("v", F.lit(step)), F.lit(len(seeds)))
            pivots = open_.groupBy("gram").agg(*[F.min(F.when(part == k, order)).alias(f"p{k}") for k in seeds])
            drawn = F.explode(F.array_compact(F.array(*[F.col(f"p{k}") for k in seeds])))
            rows = open_.select("gram", *side("b")).join(pivots.select("gram", drawn.alias("p")).select("gram", *[f"p.{c}" for c in ("a", "n_a", "place_a", "label_a")]), "gram").filter("label_a <> label_b")
        pairs = possible(rows)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs_{step}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = verified(pairs)
        if groups is None:
            groups = components(links, scratch, f"round_{step}")
        else:
            # only links between groups matter now; groups that meet are merged
            of = lambda c: groups.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}"))
            between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            between = between.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
            merged = components(between, scratch, f"round_{step}")
            old = groups.join(merged.select(F.col("v").alias("label"), F.col("label").alias("new")), "label", "left").select("v", F.coalesce("new", "label").alias("label"))
            fresh = merged.join(groups, "v", "left_anti")
            groups = scratch.keep(old.unionByName(fresh), f"groups_{step}")
        scratch.drop(f"mixed_{step}")
        if last:
            break
    if groups is None:
        return spark.createDataFrame([], "v binary, label binary")
    return groups


def join_groups(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_shingles`` and ``component_id``: the smallest id reachable by links, itself included.

    An underscore is added to a name that is taken. A document without shingles is its own component.
    """
    names = {k: free_name(k, docs.columns) for k in ("n_shingles", "component_id", "set_class")}
    n, component, v = names["n_shingles"], names["component_id"], names["set_class"]
    with small_batches(docs.sparkSession):
        rows = scratch.keep(signed(docs, text, v, n), "signed")
    classes = rows.filter(F.col(v).isNotNull()).groupBy(F.col(v).alias("v")).agg(F.first(n).alias("n"), F.min(doc_id).alias("smallest"))
    classes = scratch.keep(classes, "classes")
    groups = class_groups(docs, classes.select("v", "n"), scratch, text)
    grouped = classes.join(groups, "v", "left").withColumn("label", F.coalesce("label", "v"))
    ids = grouped.groupBy("label").agg(F.min("smallest").alias("id"))
    found = grouped.select("v", "label").join(ids, "label").select(F.col("v").alias(v), F.col("id").alias(component))
    joined = rows.join(found, v, "left").withColumn(component, F.when(F.col(v).isNull(), F.col(doc_id)).otherwise(F.col(component)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], n, component)


def keep_one_per_group(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of every group the one with the smallest id (nulls last; of equal ids the one whose other
    columns have the smallest digest, once). Documents without shingles all stay."""
    columns = docs.columns
    v, n, mark = (free_name(c, columns) for c in ("set_class", "n_shingles", "mark"))
    marked = docs.withColumn(mark, F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])))))
    with small_batches(docs.sparkSession):
        rows = scratch.keep(signed(marked.select(doc_id, mark, text), text, v, n), "signed")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(mark).alias("mark"))
    classes = rows.filter(F.col(v).isNotNull()).groupBy(F.col(v).alias("v")).agg(F.first(n).alias("n"), F.min(order).alias("best"))
    classes = scratch.keep(classes, "classes")
    groups = class_groups(docs, classes.select("v", "n"), scratch, text)
    labels = classes.join(groups, "v", "left").withColumn("label", F.coalesce("label", "v"))
    winners = labels.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.mark").alias(mark), F.lit(True).alias("wins"))
    alone = rows.filter(F.col(v).isNull()).select(mark, F.lit(False).alias("wins")).distinct()
    times = rows.groupBy(mark).agg(F.count("*").alias("times"))
    chosen = scratch.keep(winners.unionByName(alone).join(times, mark), "chosen")
    # rows of one mark are equal: a winner stays once, a row without shingles as often as it comes
    repeated = F.col("wins") & (F.col("times") > 1)
    stay = marked.join(chosen.filter(~repeated).select(mark), mark, "left_semi")
    once = marked.join(chosen.filter(repeated).select(mark), mark, "left_semi").dropDuplicates([mark])
    return stay.unionByName(once).select(*[F.col(f"`{c}`") for c in columns])


def op7_jaccard_join(spark, folder):
    return join_groups(table(spark, folder, "documents").select("doc_id", "text"), Scratch(spark))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM d),
g AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * o >= 75 * (na + nb - o)),
c AS (SELECT * FROM (WITH RECURSIVE p(a, b) AS (SELECT a, b FROM l UNION SELECT p.a, l.b FROM p JOIN l ON l.a = p.b) SELECT * FROM p))
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, min(t.doc_id)) AS component_id
FROM s LEFT JOIN c ON c.a = s.r LEFT JOIN s t ON t.r = c.b GROUP BY s.r, s.doc_id, s.s
"""
