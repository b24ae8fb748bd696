"""SentencePiece encoding and decoding as a parallel max-plus scan, with the ids of the model file's own algorithm.

The model's pieces merge by rank (byte-pair merges). A sequence of pieces is that encoding of its text if and only if every two
neighbours are: merging their joined text gives just these two pieces. So encoding is a best-path problem with weights 0 (fitting
neighbours) and minus infinity (not), and each position has one last piece at most. Two things follow:

* The state at a cut through the text is the last piece that ends at or before the cut. From its boundary regions alone a chunk yields
  a transfer matrix over such states (max-plus over {0, -inf}, kept as its finite entries). Matrices combine associatively, so ``BLOCK``
  neighbours become one, in as many rounds as a document needs, each a shuffle of small matrices. On the way down every
  block hands its parts their entries and exits. No row holds more than ``BLOCK`` matrices.
* Any run of neighbours in the encoding is itself the encoding of its own text. So with entry and exit known, each chunk is
  traced on its own, in any task.

A cut between two characters that never stand side by side inside a piece is always a piece boundary: there all states collapse to
one. Words are split there, and encoded words are remembered (a bounded number) by the worker.

Only documents above ``CHUNK`` characters are cut and dealt out; the others are one chunk each and stay where they are read.

Null texts count as empty; an empty text has no ids. The sign U+2581 is read as a space, as the library does. Characters without a piece become their bytes. Repeated rows, null ids and extra
columns pass through. A document's ids are one row. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedside.llm.common import Scratch, free_name, shuffle_partitions, table, text_or_empty

CHUNK = 16_384
#: Matrices combined at once.
BLOCK = 64
WORDS_KEPT = 400_000
PAIRS_KEPT = 300_000
SPACE = "▁"


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers side by side: small, quick to join, and no work for the garbage collector."""
    return np.array(ids, np.int32).tobytes()


class Model:
    """Pieces of a merge model, and paths over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.texts = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        self.bytes = {}
        for i in every:
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.bytes[value] = i
                self.texts[i] = bytes([value])
        self.ids = {sp.id_to_piece(i).replace(SPACE, " "): i for i in plain}
        self.scores = {sp.id_to_piece(i).replace(SPACE, " "): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        #: Neighbouring characters inside some piece; between any others there is always a boundary.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self._fits: dict[tuple[str, str], bool] = {}
        #: Pieces that are their own encoding.
        self.good = {p for p in self.ids if len(p) == 1 or len(self.merges(p)) == 1}
        #: Possible steps of a path: good pieces and single characters; and a tree of their characters, whose nodes are
        #: (number of the step that ends here or -1, nodes by next character).
        self.steps = sorted(self.good | {c for p in self.ids for c in p})
        self.tree: tuple[int, dict] = (-1, {})
        for k, step in enumerate(self.steps):
            node = self.tree
            for c in step[:-1]:
                node = node[1].setdefault(c, (-1, {}))
            node[1][step[-1]] = (k, {})  # in this order a step comes before all that begin with it
        self.step_ids = [packed(self.piece_ids(p)) for p in self.steps]
        self._side_by_side: dict[int, bool] = {}
        self.words = Words(self)

    def merges(self, text: str) -> list[str]:
        """Plain merging, for a pair of pieces: the best-ranked neighbours first, the left one of equals."""
        get, never = self.scores.get, float("-inf")
        parts = list(text)
        scores = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == never:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], never)
        return parts

    def whole(self, piece: str) -> bool:
        """Whether a character or piece is its own encoding."""
        return len(piece) == 1 or piece in self.good

    def fits(self, a: str, b: str) -> bool:
        """Whether two pieces side by side are the encoding of their joined text."""
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) > PAIRS_KEPT:
                self._fits.clear()
            found = self._fits[a, b] = self.stand(a, b)
        return found

    def stand(self, a: str, b: str) -> bool:
        return a[-1] + b[0] not in self.inside or (a + b not in self.good and self.merges(a + b) == [a, b])

    def forced(self, text: str, i: int) -> bool:
        return text[i - 1 : i + 1] not in self.inside

    def path(self, text: str, entry: str | None = None, beyond: int = 0) -> list[str | None]:
        """The last piece of the path to each position of ``text`` (None: unreachable), entered after piece ``entry``.

        The first piece must end behind position ``beyond``.
        """
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        good, prefixes, known, fits = self.good, self.prefixes, self._fits.get, self.fits
        for start in range(n):
            before = last[start] if start else entry
            if start and before is None:
                continue
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                if last[end] is None and (piece in good or end == start + 1) and (start or end > beyond):
                    if before is not None:
                        fit = known((before, piece))
                        if fit is None:
                            fit = fits(before, piece)
                    if before is None or fit:
                        last[end] = piece
                if piece not in prefixes:
                    break
        return last

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]

    def trace(self, text: str) -> bytes:
        """Packed ids of a stretch without a forced boundary.

        The path is searched depth first, longest step first. A position has one state at most, so one from which the end
        was not reached is closed for good.
        """
        root, known, n = self.tree[1], self._side_by_side.get, len(text)
        if n == 1 and text not in root:
            return packed(self.piece_ids(text))
        path: list[int] = []
        ends, closed = [0], set()
        open_: list[list[tuple[int, int]]] = []
        while ends[-1] < n:
            start = ends[-1]
            if len(open_) < len(ends):
                choices, node, end = [], root, start
                for c in text[start:]:
                    found = node.get(c)
                    if found is None:
                        break
                    end += 1
                    step, node = found
                    if step >= 0:
                        choices.append((step, end))
                open_.append(choices)
            choices = open_[-1]
            while choices:
                step, end = choices.pop()
                if end in closed:
                    continue
                if not path:
                    break
                pair = path[-1] << 32 | step
                fit = known(pair)
                if fit is None:
                    if len(self._side_by_side) > PAIRS_KEPT:
                        self._side_by_side.clear()
                    fit = self._side_by_side[pair] = self.stand(self.steps[path[-1]], self.steps[step])
                if fit:
                    break
            else:
                closed.add(start)
                open_.pop(), ends.pop(), path.pop()
                continue
            path.append(step)
            ends.append(end)
        ids = self.step_ids
        return b"".join([ids[step] for step in path])

    def encode_packed(self, text: str) -> bytes:
        """Packed ids of a text in which white space is already marked (a document begins with the space put before it)."""
        words = self.words
        return b"".join([words[word] for word in PARTS.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        texts = self.texts
        text = b"".join([texts[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    # -- boundary states of a cut: (distance of the last piece's end from the cut, that piece)

    def states(self, left: str) -> list[tuple[int, str]]:
        """All states that the text before a cut allows."""
        found = []
        for back in range(min(self.longest, len(left))):
            end = len(left) - back
            for size in range(1, min(self.longest, end) + 1):
                piece = left[end - size : end]
                if (size == 1 or piece in self.ids) and self.whole(piece):
                    found.append((back, piece))
        return found

    def transfer(self, left: str, body: str, last_chunk: bool) -> list[list]:
        """Finite entries of a chunk's matrix: [entry, [exits]]; ``left`` is text before the chunk ('' for the first)."""
        entries = self.states(left) if left else [(0, None)]
        text = left + body
        cut, n = len(left), len(text)
        first = next((i for i in range(max(cut, 1), n) if self.forced(text, i)), None)
        if first is None:
            if last_chunk:
                first = n
            else:
                return [[e, x] for e in entries if (x := self._exits(text, cut - e[0], e[1], e[0]))]
        if first == n:
            exits = [(0, None)]
        else:
            final = next(i for i in range(n - 1, first - 1, -1) if self.forced(text, i))
            exits = [(0, None)] if last_chunk else self._exits(text, final, None, 0)
        rows = []
        for back, piece in entries:
            start = cut - back
            if any(self.forced(text, i) for i in range(start + 1, cut + 1)):  # the piece after the entry cannot cross this
                reach = back == 0
            else:
                reach = True
            if reach and first > start:
                reach = self.path(text[start:first], piece, back)[-1] is not None
            if reach:
                rows.append([(back, piece), exits])
        return rows

    def _exits(self, text: str, start: int, piece: str | None, beyond: int) -> list[tuple[int, str]]:
        last, n = self.path(text[start:], piece, beyond), len(text) - start
        found = [(n - i, last[i]) for i in range(max(1, n - self.longest + 1), n + 1) if last[i] is not None]
        if beyond == 0 and piece is None and n < self.longest:
            # the boundary itself may be the last one before the cut; its piece is any that ends there
            found += [(n, p) for back, p in self.states(text[:start]) if back == 0]
        return found


PARTS = re.compile(r" *[^ \n]+|\n| +(?=\n|\Z)")


#: Documents, and about the bytes of them, that a worker holds as lists at once.
PIECE, PIECE_BYTES = 256, 4 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(PIECE, PIECE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _id_lists(found: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


class Words(dict):
    """Packed ids by word; a word is cut at its forced boundaries, and the parts are remembered too.

    When it is full, the words of the generation before go; those of it that are used again stay.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > WORDS_KEPT // 2:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            inside, trace, at, found = self.model.inside, self.model.trace, 0, []
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in inside:
                    found.append(self._part(word[at:i]))
                    at = i
            found.append(self._part(word[at:]) if at else trace(word))
            ids = b"".join(found) if at else found[0]
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.get(part) or self.before.get(part)
        if ids is None:
            ids = self.model.trace(part)
            if len(part) <= 64:
                self[part] = ids
        return ids


_MODELS: dict[str, Model] = {}


def model_of(path: str) -> Model:
    """One per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def combine(a: dict, b: dict) -> dict:
    """Product of two transfer matrices, entry -> set of exits; associative."""
    joined = {}
    for entry, exits in a.items():
        reached = {x for e in exits for x in b.get(e, ())}
        if reached:
            joined[entry] = reached
    return joined


#: The state at both ends of a text.
END = (0, None)


def product(matrices: list[dict]) -> dict:
    whole = matrices[0]
    for matrix in matrices[1:]:
        whole = combine(whole, matrix)
    return whole


def scan(matrices: list[dict], enter: tuple = END, leave: tuple = END) -> list[tuple[tuple, tuple]]:
    """(entry, exit) state of each matrix, in order, on the way from ``enter`` to ``leave``."""
    reached = [{enter}]
    for matrix in matrices:
        reached.append({x for e in reached[-1] for x in matrix.get(e, ())})
    state, out = leave, []
    for k in range(len(matrices) - 1, -1, -1):
        entry = next(e for e in sorted(reached[k], key=str) if state in matrices[k].get(e, ()))
        out.append((entry, state))
        state = entry
    return out[::-1]


def write_matrix(matrix: dict) -> str:
    return json.dumps([[e, sorted(exits, key=str)] for e, exits in matrix.items()])


def read_matrix(text: str) -> dict:
    return {tuple(e): {tuple(x) for x in exits} for e, exits in json.loads(text)}


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, part, parts) to their matrices; the parts are handed on for the way down."""
    for batch in batches:
        found = [write_matrix(product([read_matrix(m["matrix"]) for m in parts.as_py()])) for parts in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], [*batch.schema.names[:3], "matrix"])


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, part, parts, enter, leave) to the entries and exits of their parts."""
    for batch in batches:
        rows = []
        for name, parts, *ends in zip(batch.column(0).to_pylist(), batch.column(2), *(batch.column(c).to_pylist() for c in ("enter", "leave"))):
            parts = parts.as_py()
            enter, leave = (tuple(json.loads(e)) for e in ends)
            states = scan([read_matrix(m["matrix"]) for m in parts], enter, leave)
            rows += [(name, m["part"], json.dumps(a), json.dumps(b)) for m, (a, b) in zip(parts, states)]
        columns = zip(*rows) if rows else [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "part", "enter", "leave"])


def borders(matrices: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """``key, part, enter, leave`` (states as JSON) of every part, from ``key, part, matrix`` with parts 0, 1, ... of each key."""
    blocks, level = [], matrices
    last = matrices.agg(F.max("part")).first()[0] or 0
    while not blocks or last:
        parts = F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("parts")
        grouped = level.groupBy("key", F.expr(f"cast(part div {block} as int)").alias("block")).agg(parts)
        grouped = grouped.select("key", F.col("block").alias("part"), "parts")
        above = "key bigint, part int, parts array<struct<part int, matrix string>>, matrix string"
        blocks.append(scratch.keep(grouped.mapInArrow(_products, above), "blocks"))
        level = blocks[-1].select("key", "part", "matrix")
        last //= block
    end = F.lit(json.dumps(END))
    known = blocks.pop().select("key", "part", "parts", end.alias("enter"), end.alias("leave"))
    down = "key bigint, part int, enter string, leave string"
    while blocks:
        known = blocks.pop().select("key", "part", "parts").join(known.mapInArrow(_handed_down, down), ["key", "part"])
    return known.mapInArrow(_handed_down, down)


def encode_documents(docs: DataFrame, model_path: str, scratch: Scratch, text: str = "text", chunk: int = CHUNK, block: int = BLOCK, decoded: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``ids`` (array of int) and ``n_tokens`` (underscores are added where names are taken).

    With a name ``decoded``, which must be free, the text that the ids decode to comes too.
    """
    own = [c for c in docs.columns if c != text]
    ids, n_tokens, key, part = (free_name(c, docs.columns) for c in ("ids", "n_tokens", "key", "part"))
    kept = [F.col(f"`{c}`") for c in own]
    # the library takes the mark for a space, too
    read = docs.select(*kept, F.replace(text_or_empty(text), F.lit(SPACE), F.lit(" ")).alias(text))
    size = F.char_length(F.col(text))
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in (piece for whole_ in batches for piece in _slices(whole_)):
            found = [model.encode_packed(" " + t) if t else b"" for t in batch.column(len(own)).to_pylist()]
            lists = _id_lists(found)
            texts = [decoded_texts(lists, model_path)] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], lists, *texts], schema.names)

    short = read.filter(size <= chunk).mapInArrow(whole, schema)

    context = 2 * model_of(model_path).longest + 2
    long_ = read.filter(size > chunk).withColumn(key, F.monotonically_increasing_id())
    starts = F.posexplode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias(part, "at")
    cut = long_.select(F.struct(*kept, F.lit(0)).alias("own"), key, text, F.ceil(size / chunk).cast("int").alias("parts"), starts)
    low = F.greatest(F.col("at") - context, F.lit(0))
    cut = cut.select(
        F.when(F.col(part) == 0, F.col("own")).alias("own"),  # other columns travel once
        key,
        part,
        (F.col(part) == F.col("parts") - 1).alias("last"),
        F.substring(F.col(text), low + 1, F.col("at") - low).alias("left"),
        F.concat(F.when(F.col(part) == 0, " ").otherwise(""), F.substring(F.col(text), F.col("at") + 1, F.lit(chunk))).alias("body"),
    )
    # a context that reaches the beginning of the text holds the space before it too
    cut = cut.withColumn("left", F.when((F.col(part) > 0) & (F.char_length("left") < context), F.concat(F.lit(" "), "left")).otherwise(F.col("left")))
    chunks = scratch.keep(cut.repartition(shuffle_partitions(docs.sparkSession), key, part), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in (piece for whole_ in batches for piece in _slices(whole_)):
            rows = zip(*(batch.column(c).to_pylist() for c in ("left", "body", "last")))
            found = [json.dumps(model.transfer(*row)) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(part), pa.array(found, pa.string())], ["key", "part", "matrix"])

    transfer = chunks.select(key, part, "left", "body", "last").mapInArrow(matrices, "key bigint, part int, matrix string")
    states = borders(scratch.keep(transfer, "matrices"), scratch, block)
    back = lambda state: F.get_json_object(state, "$[0]").cast("int")
    edges = states.select(F.col("key").alias(key), F.col("part").alias(part), back("enter").alias("enter"), back("leave").alias("leave"))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in (piece for whole_ in batches for piece in _slices(whole_)):
            rows = zip(*(batch.column(c).to_pylist() for c in ("left", "body", "enter", "leave")))
            found = [model.encode_packed((left + body)[len(left) - a : len(left) + len(body) - b]) for left, body, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(part), _id_lists(found)], [key, part, ids])

    pieces = chunks.select(key, part, "left", "body").join(edges, [key, part]).select(key, "left", "body", "enter", "leave", part)
    pieces = pieces.mapInArrow(traced, f"`{key}` bigint, `{part}` int, `{ids}` array<int>")
    in_order = F.sort_array(F.collect_list(F.struct(part, ids)))
    joined = pieces.groupBy(key).agg(F.flatten(F.transform(in_order, lambda x: x[ids])).alias(ids))
    heads = chunks.filter(F.col(part) == 0).select(key, "own")
    long_rows = heads.join(joined, key).select(*[F.col("own").getField(c).alias(c) for c in own], ids)
    if decoded:
        long_rows = decode_documents(long_rows.withColumn(decoded, F.col(ids)), model_path, decoded, decoded)
    return short.unionByName(long_rows).withColumn(n_tokens, F.size(ids).cast("long"))


_PIECES: dict[str, pa.Array] = {}


def piece_bytes(path: str) -> pa.Array:
    """The bytes of every piece by id, for decoding."""
    if path not in _PIECES:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
        _PIECES[path] = pa.array(texts, pa.binary())
    return _PIECES[path]


def strip(text: str) -> str:
    """Without the space that encoding puts before a text."""
    return text[1:] if text[:1] == " " else text


def decoded_texts(lists: pa.Array, model_path: str) -> pa.Array:
    pieces, begin = piece_bytes(model_path), np.asarray(lists.offsets)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin - begin[0]), pieces.take(lists.flatten())), b"")
    return pa.array([strip(x.decode("utf-8", "replace")) for x in joined.to_pylist()], pa.string())


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with ``into``: the text of ``ids`` (null: empty) in place of them."""
    own = [c for c in encoded.columns if c != ids]
    schema = encoded.select(*[F.col(f"`{c}`") for c in own]).schema.add(into, "string")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole_ in batches for piece in _slices(whole_)):
            found = decoded_texts(batch.column(len(own)).fill_null([]), model_path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*own, into])

    return encoded.select(*[F.col(f"`{c}`") for c in own], ids).mapInArrow(texts, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded_and_checked(docs: DataFrame, model_path: str, scratch: Scratch) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_same``: the ids of each text, and whether they decode to it (U+2581 as a space)."""
    digest = F.xxhash64(F.replace(text_or_empty("text"), F.lit(SPACE), F.lit(" ")))
    made = encode_documents(docs.select("doc_id", digest.alias("digest"), "text"), model_path, scratch, decoded="decoded")
    return made.select("doc_id", "n_tokens", "ids", (F.xxhash64("decoded") == F.col("digest")).alias("decoded_same"))


def op1_piece_scan(spark, folder):
    return encoded_and_checked(table(spark, folder, "documents"), default_model(), Scratch(spark))
