"""The pipeline and its stages against brute-force versions."""

from __future__ import annotations

import math
import os
import random
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from test_documents import WORD, brute_groups, brute_quality, brute_repeats, near_copies, prose, repeats  # noqa: E402


def brute_kept(text):
    """The threshold table, from the texts alone."""
    from bedside.llm import quality_rules as q

    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, chars, symbols, dup, _, failed = brute_quality(text)
    m = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup,
        "n_lines": len(lines),
        "n_stop_words": sum(w in q.STOP_WORDS for w in words),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_list_lines": sum(bool(re.match("[\\x20\\x09-\\x0D]*[-*•●]", x)) for x in lines),
        "n_cut_lines": sum(bool(re.search("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$", x)) for x in lines),
    }
    for r in q.RULES:
        if m[r.per] and (
            (r.low is not None and m[r.measure] + r.slack < r.low * m[r.per]) or (r.high is not None and m[r.measure] > r.high * m[r.per])
        ):
            return False
    return not failed


def brute_mix(rows):
    """Copies of each row: water-filled targets, then systematic sampling in the order of size, id and digest."""
    import hashlib

    from bedside.llm import mixing as m

    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    totals = Counter()
    for (_, _, s), n in zip(rows, sizes):
        totals[s] += n
    names = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: float(m.WEIGHTS[i % len(m.WEIGHTS)]) for i, s in enumerate(names)}
    left, open_, target = float(sum(totals.values())), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * share >= m.CAP * totals[s]}
        if not above:
            break
        for s in above:
            target[s] = float(m.CAP * totals[s])
            left -= target[s]
        open_ -= above
    target |= {s: weight[s] * share for s in open_}
    copies = [0] * len(rows)
    for s in names:
        mine = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (sizes[i], rows[i][0] is not None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
        step = math.floor(target[s] / totals[s] * m.UNIT) if totals[s] else 0
        offset = int(hashlib.md5((m.SEED + ("" if s is None else ":" + s)).encode()).hexdigest()[:10], 16)
        for k, i in enumerate(mine):
            copies[i] = (offset + step * (k + 1)) // m.UNIT - (offset + step * k) // m.UNIT
    return copies


def test_pipeline_against_brute_force(spark, docs, scratch, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline
    from bedside.llm import piece_scan

    rnd = random.Random(21)
    stops = "the of and a to in is that it for on with as was at by".split()
    texts = [t for _, t, _ in near_copies(rnd)] + repeats(rnd)
    texts = [t if t is None or i % 5 == 0 else t + " " + " ".join(rnd.choices(stops, k=len(t.split()) // 9 + 3)) + " " + prose(rnd, 12, 9999) for i, t in enumerate(texts)]
    rows = [(i if i % 17 else None, t, ["a", "b", "c", None][i % 4]) for i, t in enumerate(texts)]
    rows += [(500, rows[40][1], "a"), rows[41]]
    folder = tmp_path / "tables"
    docs(rows).write.parquet(f"{folder}/documents.parquet")

    rows = [r for r in rows if brute_kept(r[1])]
    sets, _, groups = brute_groups(rows)
    best = {}
    for i, g in enumerate(groups):
        if sets[i]:
            best.setdefault(g, []).append(i)
    alone = [i for i in range(len(rows)) if not sets[i]]
    stays = sorted(alone + [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in best.values()])
    ids = Counter(rows[i][0] for i in stays)

    frame, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        frame = scratch.keep(stage(spark, frame, str(folder)), f"stage_{number}")
        sizes.append(frame.count())
        found = frame.collect()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == before.columns
        if number == 0:
            assert Counter((r.doc_id, r.text) for r in found) == Counter((d, t) for d, t, _ in rows)
        elif number == 1:
            assert Counter(r.doc_id for r in found) == ids
            rows = [(r.doc_id, r.text, r.source) for r in found]
        elif number == 2:
            kept = [e[4].decode("utf-8", "ignore") for e in brute_repeats([t for _, t, _ in rows], corpus_pipeline.REPEATED)]
            assert Counter((r.doc_id, r.text) for r in found) == Counter((d, k) for (d, _, _), k in zip(rows, kept))
            rows = [(r.doc_id, r.text, r.source) for r in found]
        elif number == 3:
            expected = Counter()
            for (d, t, s), n in zip(rows, brute_mix(rows)):
                expected[d, t, s] += n
            assert Counter((r.doc_id, r.text, r.source) for r in found) == +expected
            rows = [(r.doc_id, r.text, r.source) for r in found]
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=piece_scan.default_model())
            assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((d, tuple(library.encode(t))) for d, t, _ in rows)
            assert all(r.decoded_same and r.n_tokens == len(r.ids) for r in found)
    assert sizes[0] > sizes[1] > 0 and sizes[3] > 0
    assert corpus_pipeline.run(spark, str(folder)).count() == sizes[4]


def test_pipeline_on_no_rows(spark, docs, shared, tmp_path):
    import corpus_pipeline

    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
