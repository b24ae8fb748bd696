"""Operators on documents against brute-force versions, with hostile rows."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "x", "ä" * 3000, "a b c d", "a b c d", "\u2581 \u3000 \x85 é", "Zeile\n\nZeile\n \nzeile"]


def prose(rnd, n, vocabulary=60):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# -- quality rules


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_quality_measures(docs):
    from bedside.llm import quality_rules as q

    rnd = random.Random(1)
    texts = ODD + [prose(rnd, rnd.randint(0, 60), 4) for _ in range(60)] + ["the # of <b> | and\nthe # of <b> | and\n" * 3]
    table = q.quality(docs(texts).withColumn("kept", F.lit(1)).withColumn("base_failed", F.lit(2)))
    for row in table.collect():
        m = row["m"]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, row["base_failed_"]) == brute_quality(row["text"])
        assert not (row["kept_"] and row["base_failed_"])


def test_quality_beside_a_column_of_that_name(docs):
    from bedside.llm import quality_rules as q

    table = docs(["one two", None]).withColumnRenamed("lang", "m")
    judged = q.quality(table)
    assert judged.columns == [*table.columns, "m_", "base_failed", "kept"]
    assert sorted((r["m"], r["m_"].n_words, r["base_failed"]) for r in judged.collect()) == [("en", 0, True), ("en", 2, True)]


def test_quality_filter_keeps_columns_and_good_rows(docs):
    from bedside.llm import quality_rules as q

    good = "This is a plain text of the kind that is kept, and it has words like the others in it."
    bad = "spam ### " * 40
    table = docs([good, bad, good, None, "short"]).withColumnRenamed("lang", "m")
    kept = q.filter_quality(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert q.filter_quality(docs([])).count() == 0


# -- mixing


def test_mixing_targets_and_copies(docs, scratch):
    from bedside.llm import mixing

    rnd = random.Random(2)
    rows = [(i if i % 9 else None, prose(rnd, rnd.randint(0, 40)) if i % 7 else None, ["a", "b", "c", "d", None][min(4, rnd.randrange(8))]) for i in range(400)]
    table = docs(rows + rows[:30]).withColumn("size", F.lit("own"))
    drawn, names = mixing.mix(table, scratch)
    found = drawn.collect()
    assert len(found) == 430
    size, target, taken, total = (names[k] for k in ("size", "target", "taken", "source_size"))
    sums, goal = Counter(), {}
    for r in found:
        assert r[size] == len(WORD.findall(r["text"] or "")) and 0 <= r[taken] <= 3 * r[size]
        sums[r["source"]] += r[size]
        goal[r["source"]] = r[target]
    weights = dict(zip(sorted(s for s in sums if s) + ([None] if None in sums else []), [5, 2, 1] * 3))
    rest, expected = float(sum(sums.values())), {}
    open_ = set(sums)
    while True:
        share = rest / sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * share > 3 * sums[s]}
        if not above:
            expected |= {s: weights[s] * share for s in open_}
            break
        for s in above:
            expected[s] = 3.0 * sums[s]
            rest -= expected[s]
        open_ -= above
    taken_by = Counter()
    for r in found:
        taken_by[r["source"]] += r[taken]
    for s in sums:
        assert goal[s] == pytest.approx(expected[s]) and sums[s] == next(r[total] for r in found if r["source"] == s)
        assert abs(taken_by[s] - goal[s]) <= 2 * 40
    again, _ = mixing.mix(table, scratch)
    assert Counter((r.doc_id, r.text, r[taken]) for r in again.collect()) == Counter((r.doc_id, r.text, r[taken]) for r in found)
    mixed = mixing.mixed_rows(docs(rows), scratch)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and mixed.count() > 0
    assert mixing.mixed_rows(docs([]), scratch).count() == 0


# -- n-gram Jaccard join


def brute_groups(rows):
    def shingles(text):
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        if len(words) < 5:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[find(i)] = find(j)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sets, [smallest.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))], [find(i) for i in range(len(rows))]


def near_copies(rnd):
    rows = [(i, t, "s") for i, t in enumerate(ODD)]
    passage = prose(rnd, 60, 5000).split()
    for k in range(6):
        base = prose(rnd, rnd.randint(20, 80), 400).split()
        for _ in range(12):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(999)}"
            rows.append((rnd.randrange(10_000), " ".join(words).upper() if rnd.random() < 0.3 else "\n".join(words), "s"))
    rows += [(rnd.randrange(10_000), " ".join(passage + prose(rnd, rnd.randint(3, 30), 9000).split()), "s") for _ in range(30)]
    return rows + [(None, rows[20][1], "s"), rows[21], (5, rows[30][1] + " more", "s")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_groups(docs, scratch, seed, monkeypatch):
    from bedside.llm import jaccard_join as j

    rnd = random.Random(seed)
    if seed == 2:  # pivot rounds to the end
        monkeypatch.setattr(j, "ENOUGH", 0)
    if seed == 3:
        monkeypatch.setattr(j, "FRAGMENT", 50)
    rows = near_copies(rnd)
    sets, ids, _ = brute_groups(rows)
    table = j.join_groups(docs(rows).withColumn("n_shingles", F.lit("own")), scratch)
    found = Counter((r.doc_id, r["n_shingles_"], r.component_id) for r in table.collect())
    assert found == Counter((d, len(s), c) for (d, _, _), s, c in zip(rows, sets, ids))


def test_jaccard_keeps_one_per_group(docs, scratch):
    from bedside.llm import jaccard_join as j

    rows = near_copies(random.Random(7))
    sets, ids, groups = brute_groups(rows)
    kept = j.keep_one_per_group(docs(rows), scratch).collect()
    assert len(kept) == len({g for g, s in zip(groups, sets) if s}) + sum(not s for s in sets)
    wanted = Counter(c for c in {g: c for g, c, s in zip(groups, ids, sets) if s}.values())
    wanted.update(d for (d, _, _), s in zip(rows, sets) if not s)
    assert Counter(r.doc_id for r in kept) == wanted
    assert j.keep_one_per_group(docs([]), scratch).count() == 0
    assert j.join_groups(docs([]), scratch).count() == 0


@pytest.mark.parametrize("common", [0, 1])
def test_jaccard_fragments_need_little_room(common):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from bedside.llm import jaccard_join as j

    def peak(work, group):
        tracemalloc.start()
        try:
            return work(group), tracemalloc.get_traced_memory()[1] / group.nbytes
        finally:
            tracemalloc.stop()

    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 1 << 62 if k % 4 else 1 << 17, 1_000, dtype=np.uint64)) for k in range(600)]
    sets = [s % np.uint64(1 << 17) if common else s for s in sets]
    sets = [np.unique(j._mix(s)) for s in sets]
    names = [j.digest(s) for s in sets]
    twice = [*range(600), *range(0, 600, 9)]  # copies count once
    owner = np.repeat(np.arange(len(twice), dtype=np.int32), [len(sets[k]) for k in twice])
    grams = np.concatenate([sets[k] for k in twice])
    sizes = np.array([len(sets[k]) for k in twice])
    packed = j._pack(np.zeros(len(grams), np.uint64), np.frombuffer(b"".join(names[k] for k in twice), "V16"), sizes, owner, grams)
    shared, room = peak(j._shared(3), pa.Table.from_batches([packed]))
    assert room < 5.5  # 6.2 and 9.5 when all n-grams were sorted at once

    times = Counter(g for s in sets for g in s.tolist())
    found, able = {}, []
    for bucket in sorted(shared.column("bucket").to_pylist()):
        part = shared.filter(pa.array([b == bucket for b in shared.column("bucket").to_pylist()]))
        name, _, count, gram, uses = j._unpack(part, "<u8", "<u4")
        for v, a, c in zip(name, np.cumsum(count), count):
            assert found.setdefault(v.tobytes(), dict(zip(gram[a - c : a].tolist(), uses[a - c : a].tolist()))) is not None
        result, room = peak(j._able, part)
        assert room < 3  # 3.4 with common n-grams
        able += result.to_pylist()
    wanted = {n: {g: times[g] for g in s.tolist() if times[g] > 1} for n, s in zip(names, sets)}
    assert found == {n: w for n, w in wanted.items() if w}
    wanted = {n: (len(s), sorted(w, key=lambda g: (w[g], g))) for s, (n, w) in zip(sets, wanted.items()) if 100 * len(w) >= 75 * len(s)}
    assert {r["v"]: (r["n"], [g % (1 << 64) for g in r["grams"]]) for r in able} == wanted and len(able) == len(wanted)


def test_jaccard_hands_texts_and_sets_over_in_small_batches(spark, docs, scratch, monkeypatch):
    from bedside.llm import jaccard_join as j

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, kept = spark.conf.get(name), {}, scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, to, *more: seen.update({to: spark.conf.get(name)}) or kept(df, to, *more))
    table = docs(near_copies(random.Random(3)))
    for work in (j.join_groups, j.keep_one_per_group):
        seen.clear()
        assert work(table, scratch).count() > 0
        assert seen["signed"] == seen["able"] == "4000000" and seen["postings"] == spark.conf.get(name) == before
    spark.conf.set(name, "1k")
    try:
        work(table, scratch)
        assert seen["able"] == "1024" and spark.conf.get(name) in ("1k", "1024b")
    finally:
        spark.conf.set(name, before)


# -- suffix dedup


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    return out


def repeats(rnd):
    passage = prose(rnd, 140, 3000)
    long_one = "".join(rnd.choice("abcdé ") for _ in range(3000))
    texts = list(ODD) + ["ab" * 700, "y" * 900, "y" * 405, "z" * 399, "z" * 399]
    texts += [prose(rnd, rnd.randint(5, 90), 3000) + passage[: rnd.randint(380, 900)] + prose(rnd, 50, 3000) for _ in range(40)]
    texts += [long_one, long_one, long_one[:1500] + "Q" + long_one[1500:], long_one[100:1700]]
    return texts


@pytest.mark.parametrize("crowd", [1000, 3])
def test_suffix_dedup(docs, scratch, crowd, monkeypatch):
    from bedside.llm import suffix_dedup as s

    monkeypatch.setattr(s, "CROWD", crowd)
    texts = repeats(random.Random(crowd))
    expected = brute_repeats(texts, 400)
    table = docs(texts).withColumn("n_bytes", F.lit("own"))
    found = {r.doc_id: (r["n_bytes_"], r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(table, scratch, digest=True).collect()}
    assert found == {i: e[:4] for i, e in enumerate(expected)}
    rewritten = {r.doc_id: r.text for r in s.remove_repeats(docs(texts), scratch).collect()}
    assert rewritten == {i: e[4].decode("utf-8", "ignore") for i, e in enumerate(expected)}
    assert s.remove_repeats(docs([]), scratch, digest=True).count() == 0


def test_interval_expansion_against_counting():
    import numpy as np

    from bedside.llm import suffix_dedup as s

    rng = np.random.default_rng(4)
    for _ in range(150):
        length, letters = int(rng.integers(2, 12)), int(rng.integers(1, 4))
        texts = [rng.integers(97, 97 + letters, int(rng.integers(length, 40))).astype(np.uint8) for _ in range(int(rng.integers(1, 6)))]
        sizes = np.array([len(t) - length + 1 for t in texts])
        times = Counter(t.tobytes()[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, flags in zip(texts, s.repeated_starts(texts, sizes, length)):
            assert flags.tolist() == [times[t.tobytes()[i : i + length]] > 1 for i in range(len(t) - length + 1)]


# -- SentencePiece


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    from bedside.llm import piece_scan as p

    return sentencepiece.SentencePieceProcessor(model_file=p.default_model())


PIECES = ["a", "b", "the", "in", "ing", " ", "  ", "\n", "\u2581", "é", "字", "😀", ".", "--", "==", "1", "er", "tion", "\t", "<0x41>", "<s>", " th", "     "]


def test_paths_give_the_ids_of_the_library(library):
    from bedside.llm import piece_scan as p

    model, rnd = p.model_of(p.default_model()), random.Random(5)
    for _ in range(1500):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 40)))
        read = " " + text.replace(p.SPACE, " ")
        assert model.encode(read) == library.encode(text)
        assert model.decode(library.encode(text)) == text.replace(p.SPACE, " ")
        size = rnd.randint(model.longest, 40)
        cuts = [0, *range(1 + size, len(read), size)]
        bodies = [read[a:b] for a, b in zip(cuts, [*cuts[1:], len(read)])]
        lefts = [read[max(0, a - 2 * model.longest - 2) : a] for a in cuts]
        rows = [model.transfer(left, body, k == len(cuts) - 1) for k, (left, body) in enumerate(zip(lefts, bodies))]
        matrices = [{tuple(e): {tuple(x) for x in exits} for e, exits in m} for m in rows]
        ids = []
        for left, body, (enter, leave) in zip(lefts, bodies, p.scan(matrices)):
            whole = left + body
            ids += model.encode(whole[len(left) - enter[0] : len(whole) - leave[0]])
        assert ids == library.encode(text)


def test_matrices_combine_associatively(library):
    from bedside.llm import piece_scan as p

    rnd = random.Random(6)
    some = lambda: {(i, "x"): {(rnd.randrange(4), "x") for _ in range(rnd.randrange(3))} for i in range(4)}
    for _ in range(50):
        a, b, c = some(), some(), some()
        assert p.combine(p.combine(a, b), c) == p.combine(a, p.combine(b, c))


@pytest.mark.parametrize("block", [2, 5, 64])
def test_borders_are_the_same_in_any_number_of_rounds(spark, scratch, library, block):
    from bedside.llm import piece_scan as p

    model, rnd = p.model_of(p.default_model()), random.Random(7)
    rows, expected = [], set()
    for key, n in enumerate([1, 2, 3, 17, 64, 65]):
        text = " " + "".join(rnd.choice(["in", "ing", "er", "the", "     ", "--", "a"]) for _ in range(40 * n))
        size = len(text) // n + 1
        cuts = list(range(0, len(text), size))
        found = []
        for a in cuts:
            found.append(p.write_matrix({tuple(e): {tuple(x) for x in exits} for e, exits in model.transfer(text[max(0, a - 2 * model.longest - 2) : a], text[a : a + size], a == cuts[-1])}))
        rows += [(key, k, m) for k, m in enumerate(found)]
        expected |= {(key, k, enter, leave) for k, (enter, leave) in enumerate(p.scan([p.read_matrix(m) for m in found]))}
    made = p.borders(spark.createDataFrame(rows, "key long, part int, matrix string"), scratch, block)
    read = lambda t: tuple(json.loads(t))
    assert {(r.key, r.part, read(r.enter), read(r.leave)) for r in made.collect()} == expected
    assert p.borders(made.selectExpr("key", "part", "enter AS matrix").limit(0), scratch, block).count() == 0


def test_encoding_and_decoding(docs, scratch, library):
    from bedside.llm import piece_scan as p

    rnd = random.Random(8)
    texts = ODD + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    table = docs([(i % 50 or None, t, "s") for i, t in enumerate(texts)]).withColumnsRenamed({"lang": "ids", "source": "key"})
    encoded = p.encode_documents(table, p.default_model(), scratch, chunk=64, block=3)
    found = Counter((r.doc_id, tuple(r["ids_"]), r.n_tokens) for r in encoded.collect())
    assert found == Counter((i % 50 or None, tuple(library.encode(t or "")), len(library.encode(t or ""))) for i, t in enumerate(texts))
    decoded = p.decode_documents(encoded.select("doc_id", F.col("ids_").alias("ids")), p.default_model())
    assert Counter((r.doc_id, r.text) for r in decoded.collect()) == Counter((i % 50 or None, (t or "").replace(p.SPACE, " ")) for i, t in enumerate(texts))
    both = p.encode_documents(table, p.default_model(), scratch, chunk=64, decoded="read back")
    assert Counter((r.doc_id, tuple(r["ids_"]), r["read back"]) for r in both.collect()) == Counter(
        (i % 50 or None, tuple(library.encode(t or "")), (t or "").replace(p.SPACE, " ")) for i, t in enumerate(texts)
    )
    assert p.encoded_and_checked(docs([]), p.default_model(), scratch).count() == 0
    assert p.encoded_and_checked(docs(texts), p.default_model(), scratch).filter("not decoded_same").count() == 0


# -- token files


def test_token_files(spark, docs, scratch):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    from bedside.llm import token_files as t

    path = places.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    rnd = random.Random(9)
    signs = ["a", "B", "the", "ſ", "É", "e\u0301", "H\u0331", "İ", "ΑΣ", " ", "\n", "'s", "n't", ".", "--", "1", "½", "字", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "ǅ", "_"]
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [prose(rnd, 400, 9)] * 5
    rows = [(rnd.randrange(500) if i % 11 else None, x, "s") for i, x in enumerate(texts)]
    t.write_tokens(docs(rows), scratch.path("tokens"), path)
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in t.read_tokens(spark, scratch.path("tokens")).collect()), key=lambda r: r[1])
    at = 0
    for d, start, n, _ in found:
        assert start == at
        at += n
    order = [r[0] for r in found]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    ids = [plain.encode(x or "", add_special_tokens=False).ids + [1] for _, x, _ in rows]
    assert Counter((d, n, c) for d, _, n, c in found) == Counter((d, len(i), zlib.crc32(pack(i))) for (d, _, _), i in zip(rows, ids))
    t.write_tokens(docs([]), scratch.path("none"), path)
    assert t.read_tokens(spark, scratch.path("none")).count() == 0


def test_blocks_decode_whole_and_by_slice():
    import numpy as np

    from bedside.llm import token_files as t

    rng = np.random.default_rng(3)
    for letters in (1, 2, 5, 70_000):
        counts = rng.integers(0, 60, 40)
        ids = rng.integers(0, letters, int(counts.sum())).astype(np.int32)
        block = t.compress(ids, counts)
        whole, sizes = t.decode_block(block)
        assert whole.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()
        ends = np.concatenate([[0], np.cumsum(counts)])
        for d in range(len(counts)):
            a, b = sorted(rng.integers(0, counts[d] + 1, 2).tolist())
            assert t.read_slice(block, d, a, b) == ids[ends[d] + a : ends[d] + b].tolist()
    assert len(t.compress(np.tile(np.arange(10, dtype=np.int32), 2000), np.array([20_000]))) < 20_000
    with pytest.raises(ValueError):
        t.decode_block(block[:-4])


def test_rules_go_on_until_no_pair_is_frequent():
    import numpy as np

    from bedside.llm import token_files as t

    passage = np.random.default_rng(4).permutation(1024).astype(np.int32)
    ids, counts = np.tile(passage, 16), np.full(16, 1024)
    block = t.compress(ids, counts)
    assert t.Block(block).lengths.max() == 1024 and len(t.Block(block).symbols) == 16
    assert t.decode_block(block)[0].tolist() == ids.tolist()
    assert t.read_slice(block, 3, 100, 900) == passage[100:900].tolist()


# -- toxicity


def toxic_rows(rnd):
    rows, marks = [], []
    for i in range(1200):
        bad = rnd.random() < 0.2
        words = prose(rnd, rnd.randint(5, 60), 500).split()
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "You are a moron", f"grumpf{rnd.randrange(50)}"]))
        rows.append((i, " ".join(words), "s"))
        if rnd.random() < 0.5:
            marks.append((i, 1, int(bad)))
    return rows + [(None, None, None), (5, "", "s")], marks


def test_toxicity(spark, docs, scratch):
    from bedside.llm import toxicity as x

    rows, marks = toxic_rows(random.Random(11))
    labels = spark.createDataFrame(marks + [(None, None, 1), (marks[0][0], 0, None)], "doc_id bigint, quality int, toxic int")
    table = docs(rows).withColumn("score", F.lit("own"))
    found = x.score_documents(table, labels, scratch).collect()
    assert len(found) == len(rows)
    text = {d: t for d, t, _ in rows}
    right = 0
    for r in found:
        assert 0 <= r["score_"] <= 1 and r.predicted == int(r["score_"] >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        right += r.predicted == int(bool(re.search("idiot|moron|grumpf", text.get(r.doc_id) or "")))
    assert right >= 0.98 * len(found)


def test_toxicity_without_labels_or_rows(spark, docs, scratch):
    from bedside.llm import toxicity as x

    rows, _ = toxic_rows(random.Random(12))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert x.score_documents(docs(rows[:50]), none, scratch).count() == 50
    assert x.score_documents(docs([]), none, scratch).count() == 0


def test_held_out_labels_are_not_read(spark, docs, scratch):
    from bedside.llm import toxicity as x

    rows, marks = toxic_rows(random.Random(13))
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    kinds = "doc_id bigint, quality int, toxic int"
    first = x.score_documents(docs(rows), spark.createDataFrame(marks, kinds), scratch)
    turned = [(d, q, 1 - t if held(d) else t) for d, q, t in marks]
    second = x.score_documents(docs(rows), spark.createDataFrame(turned, kinds), scratch)
    key = lambda df: sorted((str(r.doc_id), round(r.score, 9)) for r in df.collect())
    assert key(first) == key(second)


def test_inflected_abuse_becomes_voters(spark, docs, scratch):
    from bedside.llm import toxicity as x

    rnd, rows, marks = random.Random(14), [], []
    forms = ["morons", "losers", "idiotic", "stupidly", "scumbag", "fucking", "shitty", "trashy", "trashier"]
    forms += [f"{chr(97 + i // 26)}{chr(97 + i % 26)}zz" for i in range(45)]  # more terms than a long has bits, each in under 2%
    for i in range(4320):
        words = prose(rnd, 20, 500).split()
        if i % 4 == 0:
            words.insert(rnd.randrange(20), forms[i // 4 % len(forms)])
        rows.append((i, " ".join(words), "s"))
        marks.append((i, 1, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = x.score_documents(docs(rows), labels, scratch).collect()
    wrong = [r.doc_id for r in found if r.predicted != int(r.doc_id % 4 == 0)]
    assert len(wrong) <= 0.002 * len(rows), wrong[:20]


def test_words_fire_their_most_specific_voter(docs):
    from bedside.llm import toxicity as x

    voters = x.Voters(("grump", "idiots"), ("grump", "idiot", "id"))
    cases = {"Grump": [0], "grumping": [2], "idiots, IDIOTIC": [1, 3], "idea\ngrump grumps": [0, 2, 4], "lucid regrump": [], "please": [10], None: []}
    found = docs(list(cases)).select("text", voters.mask(F.coalesce("text", F.lit(""))).alias("mask")).collect()
    assert {r.text: r["mask"] for r in found} == cases


def test_suffix_dedup_hands_texts_over_in_small_batches(spark, docs, scratch, monkeypatch):
    import pyarrow as pa

    from bedside.llm import suffix_dedup as x

    monkeypatch.setattr(x, "BATCH_BYTES", 3_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 2_000, "b" * 900, None, "c" * 5_000, "d" * 200, ""])], ["text"])
    parts = [part.column(0).to_pylist() for part in x.sliced(batch, 0)]
    assert [v for part in parts for v in part] == batch.column(0).to_pylist()
    assert all(len(part) == 1 or sum(len(v or "") for v in part) <= 3_000 for part in parts) and len(parts) == 3
    assert [len(part) for part in x.sliced(batch.slice(0, 0), 0)] == [0]

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, kept = spark.conf.get(name), {}, scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, to, *more: seen.update({to: int(spark.conf.get(name))}) or kept(df, to, *more))
    passage = "".join(f"passage word {i} " for i in range(60))
    found = x.remove_repeats(docs([f"{i} opens {passage} and {i} closes" for i in range(8)]), scratch, length=200).collect()
    assert all(passage.strip() not in r["text"] and "closes" in r["text"] for r in found)
    assert seen["found"] <= 4 and seen["texts"] <= 4 and seen["marks"] == int(before) == int(spark.conf.get(name))


def test_suffix_dedup_writes_no_more_than_it_reads_again(docs, scratch):
    from bedside.llm import suffix_dedup as x

    passage = "".join(f"passage word {i} " for i in range(60))
    texts = [f"{i} opens {passage} and {i} closes" for i in range(8)] + ["short", None]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in x.remove_repeats(docs(texts), scratch, digest=True).collect()}
    assert found == {i: e[1:3] for i, e in enumerate(brute_repeats(texts, 400))}
    assert set(scratch.latest) == {"found", "texts", "marks"}


def test_words_are_cut_by_bytes_and_learnt_together():
    import pyarrow as pa

    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    from bedside.llm import token_files as t

    path = places.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    tight, roomy = t.Encoder(path, words_kept=20), t.Encoder(path)
    rnd = random.Random(6)
    signs = ["a", "B", "the", "ſ", "É", "e\u0301", "H\u0331", "İ", "ΑΣ", " ", "\n", "'S", "n't", ".", "|", "½", "字", "\x00", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "각", "_"]
    for some in [[""], ["", " \n", ""], *([["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 9))) for _ in range(40)] for _ in range(30)])]:
        expected = [plain.encode(x, add_special_tokens=False).ids + [1] for x in some]
        for encoder in (tight, roomy):
            ids, counts = encoder.encode(pa.array(["out", *some]).slice(1))
            assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert t.Encoder(path).encode(pa.array([], pa.string()))[0].tolist() == []
    fresh = t.Encoder(path)
    fresh.encode(pa.array(["The, the. THE", "the 'The'"]))
    assert set(fresh.words.number) == {"the", ",", ".", "'the", "'"}


def test_frequent_pairs_are_found_where_slots_are_shared(monkeypatch):
    import numpy as np

    from bedside.llm import token_files as t

    rng = np.random.default_rng(8)
    known = np.unique(rng.integers(0, 1 << 60, 300_000))
    pair = np.concatenate([rng.choice(known, 5_000), rng.integers(0, 1 << 60, 5_000)])
    sought = t._places_of(known, pair)
    monkeypatch.setattr(t, "SMALL", 0)
    hashed = t._places_of(known, pair)
    assert [x.tolist() for x in hashed] == [x.tolist() for x in sought] and len(sought[0]) >= 5_000


def test_words_met_again_are_not_learnt_again():
    import pyarrow as pa

    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    from bedside.llm import token_files as t

    path = places.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    encoder, learnt = t.Encoder(path, words_kept=300), Counter()
    learn = encoder._learn
    encoder._learn = lambda words: (learnt.update(words), learn(words))[1]
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(9, 24)))
    common = [word() for _ in range(80)] + ["a\x00", "a\x00\x00", "éa" * 7, "é" * 8, "0123456789abcde", "0123456789abcdef"]
    for _ in range(12):  # 60 words of its own fill the memory every few batches
        text = " ".join(common + [word() for _ in range(60)])
        ids, counts = encoder.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [1] and counts.tolist() == [len(ids)]
        assert encoder.words.have <= 300
    assert all(learnt[w] == 1 for w in common) and len(learnt) == len(common) + 12 * 60


def test_words_are_found_in_a_table_that_grows():
    import numpy as np
    import pyarrow as pa

    pytest.importorskip("tokenizers")
    from bedside.llm import token_files as t

    words, names = t.Words(), [f"{'w' * (i % 17)}{i}" for i in range(150_000)]
    for at in range(0, len(names), 30_000):
        words.add(names[at : at + 30_000], np.arange(at, at + 30_000, dtype=np.int32), np.ones(30_000, np.int64))
    sought = pa.array(["none", *names[::7], "w" * 30], pa.large_string())
    assert words.find(sought).tolist() == [-1, *range(0, len(names), 7), -1]
    assert words.number == {w: i for i, w in enumerate(names)}
    words.forget()  # of the words only those looked up
    assert words.find(pa.array(names, pa.large_string())).tolist() == [i // 7 if i % 7 == 0 else -1 for i in range(len(names))]
    words.forget()
    assert words.have == 0 and words.number == {}


def test_blocks_with_symbols_around_two_bytes():
    import numpy as np

    from bedside.llm import token_files as t

    rng = np.random.default_rng(5)
    for top in (65_500, 65_535, 65_536):  # pairs get wider from 65,536 symbols on
        ids = np.tile(np.concatenate([rng.permutation(top)[:2_000], [top - 1]]).astype(np.int32), 20)
        counts = np.array([7, 0, 30_000, len(ids) - 30_007])
        block = t.compress(ids, counts)
        whole, sizes = t.decode_block(block)
        assert whole.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()
        assert len(t.Block(block).symbols) < len(ids) // 2
