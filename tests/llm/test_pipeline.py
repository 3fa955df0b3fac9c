"""The pipeline stage by stage against its parts by brute force."""

from __future__ import annotations

import collections
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_operators import AWKWARD, brute_lines, check_layout, documents  # noqa: E402


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [sorted((r["doc_id"], r["text"]) for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            seen.append(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    start, spoken, lines, single, private = seen
    assert set(spoken) <= set(start) and len(spoken) >= 0.98 * len(start)
    assert dict(lines) == brute_lines(spoken)
    assert set(single) <= set(lines) and len({t for _, t in single}) == len(single)
    assert len(private) == len(single)
    assert not [t for _, t in private if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", t)]
    assert {i for i, t in private if t != dict(single)[i]} == {i for i, t in private if re.search("<(EMAIL|IP|CARD|PHONE)>", t)}
    rows = [r.asDict() for r in docs.collect()]
    check_layout(rows)
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(i for i, _ in private)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_awkward_tables(spark, sf):
    """Null ids, null and empty and very long texts, repeated rows, clashing columns, and nothing at all, stage by stage."""
    table = documents(spark, AWKWARD, extra=True)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, table, sf).collect()
        kept[name] = sorted(((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows if name != "packing" or r["piece"] == 0))
        if name != "packing":
            assert list(stage(spark, table, sf).columns) == list(corpus_pipeline.COLUMNS)
        assert stage(spark, table.limit(0), sf).count() == 0
    everything = sorted((i is not None, i or 0) for i, _ in AWKWARD)
    assert kept["line_dedup"] == kept["pii"] == kept["packing"] == everything
    assert [i for _, i in kept["near_dedup"]] == [0, 1, 4, 5, 6, 8, 9]
    assert set(kept["language_id"]) <= {(i is not None, i or 0) for i, t in AWKWARD if any(c.isalpha() for c in t or "")}
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact(spark, table.withColumn("n_chars", F.lit(None).cast("long")), sf).collect()}
    assert texts[1] is None and texts[2] == "" and texts[9] == "<CARD> <EMAIL> <IP>" and "<PHONE>" in texts[5]
