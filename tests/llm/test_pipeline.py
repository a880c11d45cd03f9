"""The pipeline against the plain versions of its stages."""

import hashlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from sheafline.llm import qgram_leaks
from sheafline.llm.components import local_roots
from sheafline.llm.queries import ORACLE_SQL, QUERIES
from tokenizers import Tokenizer

SF = Path("/root/testdata/sf0.001")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b)


def test_run(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(SF)).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    sets = {i: shingles_of(t) for i, t in rows.items()}
    ids = sorted(rows)
    near = [(k, m) for k in range(len(ids)) for m in range(k) if alike(sets[ids[k]], sets[ids[m]])]
    roots = local_roots(len(ids), *np.array(near).T)
    rows = {i: rows[i] for k, i in enumerate(ids) if roots[k] == k}
    seen: dict = {}
    for t in rows.values():
        b = t.encode()
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    left = {}
    for i, t in rows.items():
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if kept:
            left[i] = kept
    items = [qgram_leaks.normal(x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = lambda t: any(
        qgram_leaks.edits_within(x, qgram_leaks.normal(t), int(len(x) * qgram_leaks.EDITS)) is not None
        for x in items
        if len(x) <= 1.2 * len(t)
    )
    left = {i: t for i, t in left.items() if len(t) > 20_000 or not hit(t)}
    assert got.keys() == left.keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        )


def test_warc_query_against_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = QUERIES["op3_warc_salvage"](spark, str(SF))
    want = duck.sql(ORACLE_SQL["op3_warc_salvage"])
    assert sorted(
        map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))
    ) == sorted(map(repr, want.fetchall()))


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["hard_docs", "no_docs"])
def test_each_stage_on_hard_and_empty_tables(request, spark, name):
    """Nulls, empty and long texts, repeated rows and clashing columns: no stage fails, and all but the last keep the columns."""
    docs = request.getfixturevalue(name)
    for stage, run in corpus_pipeline.STAGES:
        out = run(spark, docs, str(SF))
        rows = out.collect()
        assert (out.columns == docs.columns) is (stage != "encoding")
        assert not rows if name == "no_docs" else rows
    coded = Counter((r.doc_id, r.n_tokens) for r in rows)
    assert coded == Counter(
        (r.doc_id, len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )


def test_stages_leave_no_intermediates(spark, hard_docs, tmp_path, monkeypatch):
    from sheafline.llm.common import scratch, stored
    from sheafline.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        with scratch(spark) as kept:
            kept.append(stored(stage(spark, hard_docs, str(SF)), "out"))
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"out"}
