"""Fixtures of the training-data operators."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A folder all tasks share, as on a cluster; set only here, where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture
def scratch(spark, shared):
    from bedside.llm.common import Scratch

    return Scratch(spark)


@pytest.fixture
def docs(spark):
    """``docs(texts)`` or ``docs([(id, text, source), ...])`` as a documents table."""

    def build(rows):
        rows = [(i, r, "s") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        full = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return build
