"""Token ids in compressed files: Re-Pair grammars per shard, read back whole or by slice.

Writing. Documents are range-partitioned and sorted by id; each partition encodes its texts and cuts the ids into shards of
about ``SHARD_IDS``. In a shard, rounds of Re-Pair replace frequent neighbouring pairs by nonterminals: a round counts all pairs
that may still be frequent (never across the end of a document; from the second round on those around replaced places and those that were frequent
before), takes the most frequent ones as rules and replaces them from left to right, until no pair is frequent. A shard is one
Parquet row: part, number, document ids, and a block of bytes with the rules, their expansion lengths, and the documents' symbols.

Block: ``RPR1``, the numbers of documents, rules and symbols and the first nonterminal (uint32 each); the rules' left and right symbols
and expansion lengths (uint32); the documents' symbol ends and token counts (uint32); the symbols (uint32). Little-endian.

Reading. ``decode_block`` expands the rules level by level and then all documents at once; ``read_slice`` walks the grammar by expansion lengths and touches
only what covers the wanted tokens of one document.

Files are written and read by Spark's Parquet source, so any store works. A retried task makes the same shard again. Null texts count as
empty; null ids come first; repeated rows are documents of their own; an empty table gives no files and no rows. A text longer
than a shard makes one longer shard. Other columns are not read.

Encoding. The tokenizer drops white space, lower-cases, and splits letters from marks anyhow, so texts are cut and lower-cased byte by byte
where that is sure to change nothing, and a batch's distinct words are encoded once: runs of letters many in one call of the library, which its
ids that end a run cut again, and everything else by a call each. A bounded memory of words and letter runs is kept between batches; the words of
a batch are looked up all at once, and when the memory is full, those go that no later batch had.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, shuffle_partitions, table, text_or_empty

END_ID = 1
SHARD_IDS = 1 << 20
PIECE = 2048
ROUND_RULES = 3000
MIN_COUNT = 8
SMALL = 20_000
MAGIC = b"RPR1"
WORDS_KEPT = 600_000
SHORT = 15
#: Of 8 bytes the first 0, 1, ..., 8.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
RUNS = 10_000
RUN = re.compile("[a-z]+")
PARTS = re.compile(r"^([^\W\d_]*)([^\n]*)$", re.MULTILINE)  # leading letters and the rest of each line
SPACES = b" \t\n\v\f\r"
SPACE, LETTER, MARK = b"sam"
LOWER = bytes(range(256)).lower()
#: Kinds of bytes; those of other letters and signs have none.
KINDS = bytes(SPACE if c in SPACES else LETTER if c < 128 and chr(c).isalpha() else MARK if 32 < c < 127 and c != ord("|") else 0 for c in range(256))
SPECIAL_CASE = re.compile("[\u0130\u03a3]")  # letters whose lower case depends on the place or is longer
SCHEMA = "part int, shard int, n_ids bigint, doc_ids array<bigint>, block binary"


def plain_letters(text: str) -> bool:
    """Whether a text is letters in composed form that are lower-cased one by one."""
    return text.isalpha() and (text.isascii() or unicodedata.is_normalized("NFC", text) and not SPECIAL_CASE.search(text))


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of words up to the end of each text).

    White space of ASCII is left out. A mark of ASCII after a letter of ASCII begins a word, as the tokenizer splits them anyhow (but for ``|`` of
    its special tokens). Letters of ASCII are lower-cased as the tokenizer does, but not before a byte of another kind, which a mark may begin that
    joins the upper-case letter only or the lower-case one only, and not in a text that may hold a special token.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    offsets = offsets - offsets[0]
    whole, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(KINDS), np.uint8)
    data = np.frombuffer(bytearray(raw.translate(LOWER)), np.uint8)
    joins = np.flatnonzero((kind[:-1] == LETTER) & (kind[1:] == 0))
    data[joins] = whole[joins]
    if b"<|" in raw:
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b"<|" in raw[a:b]:
                data[a:b] = whole[a:b]
    solid = kind != SPACE
    begin = np.ones(len(kind) + 1, bool)
    begin[1:-1] = ~solid[:-1] | (kind[1:] == MARK) & (kind[:-1] == LETTER)
    begin[offsets] = True
    stops = np.flatnonzero(solid & (begin[1:] | np.append(~solid[1:], True)))  # last bytes of the words
    begins = np.flatnonzero(begin[:-1] & solid)
    starts = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(stops - begins + 1, out=starts[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(starts), pa.py_buffer(data[solid])])
    return words, np.searchsorted(begins, offsets[1:])


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``begin, begin + 1, ...`` of neighbouring stretches, one stretch after the other."""
    upto = np.cumsum(sizes)
    places = np.repeat(begins - upto + sizes, sizes)
    places += np.arange(len(places))
    return places


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer one that begins with it."""
    while size > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class Lists:
    """Id lists by number, in two flat arrays."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.have = self.used = 0

    def full(self, most: int) -> bool:
        return self.have > most or self.used > 16 * max(most, 1 << 16)

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = grown(self.ids, self.used + len(ids))
        self.ends = grown(self.ends, self.have + len(sizes) + 1)
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.have + 1 : self.have + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.have += len(sizes)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.ends.take(numbers + 1) - self.ends.take(numbers)

    def joined(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The lists of the numbers (of those sizes) one after the other."""
        return self.ids.take(spread(self.ends.take(numbers), sizes))


class Pieces(Lists):
    """Id lists of strings."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, int] = {}

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New names, with their ids one after the other."""
        self.number.update(zip(names, range(self.have, self.have + len(names))))
        self.append(ids, sizes)

    def clear(self) -> None:
        self.number.clear()
        self.have = self.used = 0


def halves(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first 8 bytes, next 7 bytes and the size) of each word, which tell words of at most ``SHORT`` bytes apart; 0, 0 for longer ones."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    begin, size = offsets[:-1], np.diff(offsets)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    tail = size - 8
    low = eight[begin] & FIRST[np.minimum(size, 8)]
    high = eight[begin + 8] & FIRST[np.clip(tail, 0, 7)]
    high |= size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    low[long] = high[long] = 0
    return low, high


class Words(Lists):
    """Id lists of words, looked up many at once: those of at most ``SHORT`` bytes in a table of hashed bytes, longer ones by their strings."""

    def __init__(self):
        super().__init__()
        self.low, self.high = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.again = np.zeros(1 << 16, bool)  # whether a batch after the word's first one had it
        self.slots = np.full(1 << 17, -1, np.int32)
        self.long: dict[str, int] = {}

    @property
    def number(self) -> dict[str, int]:
        """All words and their numbers."""
        short = np.flatnonzero(self.high[: self.have])
        raw = np.stack([self.low[short], self.high[short]], 1).astype("<u8").tobytes()
        return {raw[i : i + raw[i + SHORT]].decode(): n for i, n in zip(range(0, len(raw), SHORT + 1), short.tolist())} | self.long

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _place(self, numbers: np.ndarray) -> None:
        """Give words a slot of the table: their own or the next free one."""
        numbers = numbers[self.high[numbers] > 0].astype(np.int32)
        slot = self._slot(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _insert(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        begin = self.have
        self.append(ids, sizes)
        new = slice(begin, self.have)
        self.low, self.high, self.again = (grown(x, self.have) for x in (self.low, self.high, self.again))
        self.low[new], self.high[new], self.again[new] = low, high, False
        if 2 * self.have > len(self.slots):  # half of the slots stay free
            begin, self.slots = 0, np.full(1 << (2 * self.have).bit_length(), -1, np.int32)
        self._place(np.arange(begin, self.have))

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New names, with their ids one after the other."""
        low, high = halves(pa.array(names, pa.large_string()))
        self.long.update((names[i], self.have + i) for i in np.flatnonzero(high == 0).tolist())
        self._insert(low, high, ids, sizes)

    def find(self, words: pa.Array) -> np.ndarray:
        """The numbers of words, -1 for those not known."""
        low, high = halves(words)
        out, at = np.full(len(words), -1, np.int32), np.flatnonzero(high == 0)
        if len(at):
            coded = words.take(pa.array(at)).dictionary_encode()
            found = np.fromiter(map(self.long.get, coded.dictionary.to_pylist(), repeat(-1)), np.int32, len(coded.dictionary))
            out[at] = found[coded.indices.to_numpy()]
            at = np.flatnonzero(high)
            low, high = low[at], high[at]
        else:
            at = np.arange(len(words))
        slot = self._slot(low, high)
        while len(at):
            number = self.slots.take(slot)
            taken = number >= 0
            same = taken & (self.low.take(number, mode="wrap") == low) & (self.high.take(number, mode="wrap") == high)
            out[at[same]] = number[same]
            on = np.flatnonzero(taken & ~same)
            at, low, high, slot = at[on], low[on], high[on], (slot[on] + 1) & (len(self.slots) - 1)
        self.again[out[out >= 0]] = True
        return out

    def forget(self) -> None:
        """Keep the words that batches after their first one had since the last time; none if they are most of all."""
        kept = np.flatnonzero(self.again[: self.have])
        kept = kept[: 0 if 2 * len(kept) > self.have else None]
        low, high, sizes = self.low[kept], self.high[kept], self.sizes(kept)
        ids = self.joined(kept, sizes)
        now = np.full(self.have, -1)
        now[kept] = np.arange(len(kept))
        self.long = {w: n for w, i in self.long.items() if (n := int(now[i])) >= 0}
        self.have = self.used = 0
        self.slots[:] = -1
        self._insert(low, high, ids, sizes)


class Encoder:
    """Texts to ids by a tokenizer file; the words met so far and their pieces are remembered up to a bound."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for runs of lower-case letters in composed form, normalisation and splitting change nothing; one call takes many runs
        at_spaces, at_bytes = pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ascii_runs, self.other_runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.ascii_runs.pre_tokenizer = at_spaces  # ASCII letters stand for themselves at byte level
        self.other_runs.pre_tokenizer = pre_tokenizers.Sequence([at_spaces, at_bytes])
        for runs in (self.ascii_runs, self.other_runs):
            runs.normalizer = normalizers.Sequence([])
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a run: only the last one of a run holds the suffix.
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.closes[[i for v, i in vocabulary.items() if v.endswith(suffix)]] = True
        self.words_kept = words_kept
        self.words, self.pieces = Words(), Pieces()

    def _whole(self, texts: list[str], store: Pieces | Words) -> None:
        """Learn strings one by one, with all of the tokenizer's steps."""
        found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        store.add(texts, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)

    def _runs(self, runs: list[str], tokenizer, store: Pieces | Words) -> None:
        """Learn runs of lower-case letters, many in one call."""
        for at in range(0, len(runs), RUNS):
            some = runs[at : at + RUNS]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                store.add(some, ids, np.diff(ends, prepend=0))
            else:  # a model without such a suffix
                self._whole(some, store)

    def _split(self, words: list[str]) -> tuple[list[str], list[str]]:
        """For each word the leading letters in lower case, a token run of their own, and the rest.

        A word stays whole, as a rest, if a mark may join its letters, or if their lower case depends on the place.
        """
        pairs = PARTS.findall("\n".join(words))
        heads, rests = [p[0] for p in pairs], [p[1] for p in pairs]
        joined = "\n".join(heads)
        if not (joined.isascii() and "".join(rests).isascii()):
            fine = joined.isascii() or plain_letters(joined.replace("\n", ""))
            for i, (head, rest) in enumerate(pairs):
                if head and (not fine and not plain_letters(head) or rest and not rest[0].isascii()):
                    heads[i], rests[i] = "", words[i]
            joined = "\n".join(heads)
        return joined.lower().split("\n"), rests

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of new words."""
        plain = np.fromiter(map(bool, map(RUN.fullmatch, words)), bool, len(words))
        order = np.argsort(~plain, kind="stable")
        numbers = np.empty(len(words), np.int32)
        numbers[order] = np.arange(self.words.have, self.words.have + len(words))
        words = [words[i] for i in order.tolist()]
        at = np.count_nonzero(plain)
        self._runs(words[:at], self.ascii_runs, self.words)
        if words[at:]:
            self._mixed(words[at:])
        return numbers

    def _mixed(self, words: list[str]) -> None:
        """Learn words by their leading letters and the rest."""
        if self.pieces.full(self.words_kept // 2):
            self.pieces.clear()
        heads, rests = self._split(words)
        number = self.pieces.number
        missing = [h for h in dict.fromkeys(heads) if h and h not in number]
        self._runs([h for h in missing if h.isascii()], self.ascii_runs, self.pieces)
        self._runs([h for h in missing if not h.isascii()], self.other_runs, self.pieces)
        self._whole([r for r in dict.fromkeys([*rests, ""]) if r not in number], self.pieces)
        numbers = np.empty(2 * len(words), np.int64)
        numbers[::2] = np.fromiter(map(number.__getitem__, heads), np.int64, len(words))
        numbers[1::2] = np.fromiter(map(number.__getitem__, rests), np.int64, len(words))
        sizes = self.pieces.sizes(numbers)
        self.words.add(words, self.pieces.joined(numbers, sizes), sizes[::2] + sizes[1::2])

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """(number of each word, places of those not known, these words)."""
        numbers = self.words.find(words)
        at = np.flatnonzero(numbers < 0)
        return numbers, at, words.take(pa.array(at)).dictionary_encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with the end id after each text, number of ids of each text)."""
        words_of, ends = cut_words(texts)
        word, at, new = self._look_up(words_of)
        if len(at) and self.words.full(self.words_kept - len(new.dictionary)):
            self.words.forget()
            word, at, new = self._look_up(words_of)
        if len(at):
            word[at] = self._learn(new.dictionary.to_numpy(zero_copy_only=False).tolist())[new.indices.to_numpy()]
        size = self.words.sizes(word)
        upto = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(upto[ends], prepend=0) + 1
        out = np.full(int(counts.sum()), END_ID, np.int32)
        place = np.ones(len(out), bool)
        place[np.cumsum(counts) - 1] = False
        out[place] = self.words.joined(word, size)
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so its memory of words serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _places_of(known: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where ``pair`` holds one of ``known``, sorted and none twice; which one there)."""
    if len(pair) <= SMALL:
        found = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        at = np.flatnonzero(known[found] == pair)
        return at, found[at]
    # a table of hashed pairs; those that share a slot are searched for
    if pair.dtype == np.uint32:
        slot = lambda p: (p * np.uint32(0x9E3779B1)) >> np.uint32(12)
    else:
        slot = lambda p: (p * np.int64(-7046029254386353131) >> np.int64(44)) & 0xFFFFF
    number = np.full(1 << 20, -1, np.int32)
    slots = slot(known)
    number[slots] = np.arange(len(known), dtype=np.int32)
    crowded = np.flatnonzero(number[slots] != np.arange(len(known)))
    found = number.take(slot(pair))
    hit = known.take(found, mode="wrap") == pair  # the last one has a slot, so an empty slot's pair is another
    if len(crowded):
        shared = np.zeros(len(known), bool)
        shared[number[slots[crowded]]] = True
        miss = np.flatnonzero(shared[found] & ~hit)
        others = known[crowded]
        other = np.minimum(np.searchsorted(others, pair[miss]), len(others) - 1)
        right = others[other] == pair[miss]
        found[miss[right]] = crowded[other[right]]
        hit[miss[right]] = True
    at = np.flatnonzero(hit)
    return at, found[at]


def compress(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A block from the ids of consecutive documents."""
    first = int(ids.max()) + 1 if len(ids) else 0
    last = np.cumsum(counts)[counts > 0] - 1  # places of the documents' last symbols
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    top = first
    narrow = first + len(ids) < 1 << 31  # a rule takes the place of at least one symbol
    x = ids.astype(np.int32 if narrow else np.int64)
    # places whose pair may be frequent; a pair that once was rare stays rare, as new pairs always hold a new symbol
    again = np.ones(len(x), bool)
    again[last] = False
    live = np.flatnonzero(again)
    while len(live):  # each round makes it shorter
        half = 16 if top <= 1 << 16 else 32
        pair = x.take(live).astype(np.uint32 if half == 16 else np.int64)
        pair <<= half
        pair |= x.take(live + 1).astype(pair.dtype)
        ordered = np.sort(pair)
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(begins, len(ordered)))
        frequent = times >= MIN_COUNT
        known, times = ordered[begins[frequent]], times[frequent]
        if not len(known):
            break
        rule = np.ones(len(known), bool)
        if len(known) > ROUND_RULES:
            # the most frequent ones; ties by pair, so that a retried task makes the same block
            rule[:] = False
            rule[np.lexsort((known, -times))[:ROUND_RULES]] = True
        rules = known[rule]
        hit, found = _places_of(known, pair)
        live = live.take(hit)
        hit = np.flatnonzero(rule.take(found))
        at, found = live.take(hit), (np.cumsum(rule) - 1).take(found.take(hit))
        # of overlapping places take the first, third, ... of each run
        starts = np.concatenate([[True], np.diff(at) != 1])
        if not starts.all():
            run_start = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            keep = np.flatnonzero((np.arange(len(at)) - run_start) & 1 == 0)
            at, found = at.take(keep), found.take(keep)
        taken = np.bincount(found, minlength=len(rules)) > 0
        used, number = np.flatnonzero(taken), (np.cumsum(taken) - 1)[found]
        rules = rules[used].astype(np.int64)
        left.append(rules >> half)
        right.append(rules & (1 << half) - 1)
        x[at] = top + number
        top += len(used)
        again = np.zeros(len(x), bool)
        again[live] = True
        again[at] = True
        again[at[at > 0] - 1] = True  # before a new symbol
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        last -= ~stay[last]
        again[last] = False
        last -= np.searchsorted(at, last)
        stay = np.flatnonzero(stay)
        x, again = x.take(stay), again.take(stay)
        live = np.flatnonzero(again)
    lefts, rights = np.concatenate(left), np.concatenate(right)
    lengths = np.ones(len(lefts), np.int64)
    at = 0
    for part in left:  # a round's rules use earlier symbols only
        here = slice(at, at + len(part))
        size = lambda s: np.where(s >= first, lengths[np.maximum(s - first, 0)], 1)
        if len(part):
            lengths[here] = size(lefts[here]) + size(rights[here])
        at += len(part)
    symbol_ends = np.zeros(len(counts), np.int64)
    symbol_ends[counts > 0] = last + 1
    symbol_ends = np.maximum.accumulate(symbol_ends) if len(counts) else symbol_ends
    head = MAGIC + struct.pack("<4I", len(counts), len(lefts), len(x), first)
    return head + b"".join(a.astype("<u4").tobytes() for a in (lefts, rights, lengths, symbol_ends, counts, x))


class Block:
    """The parts of a block."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_docs, n_rules, n_symbols, self.first = struct.unpack_from("<4I", data, 4)
        sizes = (n_rules, n_rules, n_rules, n_docs, n_docs, n_symbols)
        cuts = np.cumsum((0, *sizes)) * 4 + 20
        if len(data) != cuts[-1]:
            raise ValueError("a cut block of token ids")
        self.left, self.right, self.lengths, self.symbol_ends, self.counts, self.symbols = (
            np.frombuffer(data, "<u4", n, int(at)).astype(np.int64) for n, at in zip(sizes, cuts)
        )


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, number of ids of each)."""
    b = Block(data)
    # the rules are expanded level by level, the documents at once
    x = np.stack([b.left, b.right], 1).ravel()
    while len(x) and (inner := x >= b.first).any():
        at = np.cumsum(inner + 1) - (inner + 1)
        out = np.empty(len(x) + int(inner.sum()), np.int64)
        out[at[~inner]] = x[~inner]
        rule = x[inner] - b.first
        out[at[inner]], out[at[inner] + 1] = b.left[rule], b.right[rule]
        x = out
    inner = b.symbols >= b.first
    rule = b.symbols[inner] - b.first
    begin, size = len(x) + np.arange(len(b.symbols)), np.ones(len(b.symbols), np.int64)
    begin[inner], size[inner] = (np.cumsum(b.lengths) - b.lengths)[rule], b.lengths[rule]
    return np.concatenate([x, b.symbols]).astype(np.uint32)[spread(begin, size)], b.counts


def read_slice(data: bytes, document: int, start: int, stop: int) -> list[int]:
    """Tokens ``start`` to ``stop`` of one document of a block, without expanding the rest."""
    b = Block(data)
    begin = int(b.symbol_ends[document - 1]) if document else 0
    symbols = b.symbols[begin : int(b.symbol_ends[document])]
    sizes = np.where(symbols >= b.first, b.lengths[np.maximum(symbols - b.first, 0)] if len(b.lengths) else 1, 1)
    ends = np.cumsum(sizes)
    out: list[int] = []
    k = int(np.searchsorted(ends, start, "right"))
    at = int(ends[k - 1]) if k else 0
    stack = [(int(s)) for s in reversed(symbols[k : int(np.searchsorted(ends, stop, "left")) + 1])]
    while stack and at < stop:
        s = stack.pop()
        size = int(b.lengths[s - b.first]) if s >= b.first else 1
        if at + size <= start:
            at += size
        elif s < b.first:
            out.append(s)
            at += 1
        else:
            stack += [int(b.right[s - b.first]), int(b.left[s - b.first])]
    return out


def blocks(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The shards of ``docs`` in ascending order of id (see ``SCHEMA``)."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        part, shard = TaskContext.get().partitionId(), 0
        names, counts, ids, n = [], [], [], 0

        def row():
            all_ids, all_counts = np.concatenate(ids), np.concatenate(counts)
            values = ([part], [shard], [len(all_ids)], [pa.concat_arrays(names)], [compress(all_ids, all_counts)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            lists = pa.ListArray.from_arrays([0, len(values[3][0])], values[3][0])
            columns = [lists if k == 3 else pa.array(v, t) for k, (v, t) in enumerate(zip(values, kinds))]
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "n_ids", "doc_ids", "block"])

        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                got, sizes = encode(piece.column("text"))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                begin = 0
                while begin < len(sizes):
                    # as many documents as the shard still takes, one at least
                    fit = int(np.searchsorted(ends, ends[begin] + max(1, SHARD_IDS - n), "right")) - 1
                    fit = min(len(sizes), max(begin + 1, fit))
                    names.append(piece.column("doc_id").slice(begin, fit - begin))
                    counts.append(sizes[begin:fit])
                    ids.append(got[ends[begin] : ends[fit]])
                    n += int(ends[fit] - ends[begin])
                    begin = fit
                    if n >= SHARD_IDS or begin < len(sizes):
                        yield row()
                        shard += 1
                        names, counts, ids, n = [], [], [], 0
        if names:
            yield row()

    return ordered.mapInArrow(shards, SCHEMA)


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32`` (``start``: ids of all documents before it)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts = decode_block(batch.column("block")[i].as_py())
                ends = np.cumsum(counts)
                raw, cuts = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], ends]) * 4
                sums = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())), np.int64, len(counts))
                n = len(counts)
                columns = [
                    pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)),
                    pa.array(np.full(n, batch.column("shard")[i].as_py(), np.int32)),
                    batch.column("doc_ids")[i].values,
                    pa.array(ends - counts),
                    pa.array(counts),
                    pa.array(sums),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = files.select("part", "shard", "doc_ids", "block").mapInArrow(
        documents, "part int, shard int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # ids before a shard: of the parts before (a row each), and of the part's earlier shards
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    starts = files.select("part", "shard", inside.alias("inside")).join(parts, "part").select("part", "shard", (F.col("inside") + F.col("base")).alias("shard_start"))
    joined = rows.join(starts, ["part", "shard"])
    return joined.select("doc_id", (F.col("within") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    blocks(docs, tokenizer_path, doc_id, text).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark.read.schema(SCHEMA).parquet(path))


def op6_token_files(spark, folder):
    import public_tokenizers

    path = Scratch(spark).path("tokens")
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
