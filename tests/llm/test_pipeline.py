"""The pipeline's stages one by one and together."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tokenloom.llm.bpe import default_vocabulary
from tokenloom.llm.decontaminate import contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage keeps, written like ``run`` writes it."""
    from tokenloom.llm.scratch import Scratch

    scratch, docs, out = Scratch(spark, "test-pipeline"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.save(stage(spark, docs, sf), name)
    return out


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated-passages", "decontamination", "packing"]


def test_each_stage_only_removes(stages):
    before = None
    for name in ("documents", "toxicity", "near-duplicates", "repeated-passages", "decontamination"):
        ids = {r.doc_id for r in stages[name].select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
    assert {r.doc_id for r in stages["packing"].select("doc_id").distinct().collect()} == before


def test_no_similar_documents_are_left(stages):
    rows = stages["near-duplicates"].select("doc_id", "text").collect()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := r.text.encode().lower().split()) else set() for r in rows}
    by: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for own in by.values() for a in own for b in own if a < b}
    assert not [p for p in pairs if 5 * len(sets[p[0]] & sets[p[1]]) >= 4 * len(sets[p[0]] | sets[p[1]])]


def test_no_benchmark_item_is_left(spark, sf, stages):
    left = stages["decontamination"]
    assert contaminated(left, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    texts = [r.text for r in left.collect()]
    assert not [i for i in items if any(i in t for t in texts)]


def test_sequences_hold_every_id(stages):
    t = Tokenizer.from_file(default_vocabulary())
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages["decontamination"].collect())
    pieces = stages["packing"].toPandas()
    assert pieces["length"].sum() == want
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 4096 and len(filled) <= np.ceil(want / 4096) * 1.1 + 2


def test_empty_documents(spark, sf, stages):
    none = stages["documents"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """A corpus with nulls, white space, repeated rows, rows that differ in other columns only, and a long text."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    n = docs.count()
    rows = [(None, "no id here at all", "en", "s", 1), (None, None, None, None, None), (90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, " \t\n ", "en", "s", 4)]
    rows += [(90_004, "one and the same row of words", "en", "b", 2), (90_004, "one and the same row of words", "en", "a", 9), (90_004, "one and the same row of words", "en", "a", 3), (90_004, "another text of that id", "de", "a", 1)]
    rows += [(90_005, "word number is long " * 60_000, "xx", "s", 1), (90_006, "\n".join(f"line {i} of a text that is long enough to be taken for a paragraph of its own kind {i * 7}" for i in range(3000)), "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, n


def test_odd_rows(spark, odd):
    folder, n = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from tokenloom.llm.scratch import Scratch

    scratch = Scratch(spark, "test-odd")
    near = scratch.save(corpus_pipeline.drop_near_duplicates(spark, docs, folder), "near")
    assert near.columns == docs.columns
    kept = [(r.text, r.source, r.n_chars) for r in near.where("doc_id = 90004").collect()]
    assert sorted(kept) == [("another text of that id", "a", 1), ("one and the same row of words", "a", 3)]
    assert near.where("doc_id IS NULL").count() == 2 and near.where("doc_id BETWEEN 90001 AND 90003").count() == 3
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    assert {90_001, 90_002, 90_003, 90_005} <= set(pieces["doc_id"].dropna().astype(int)) and pieces["doc_id"].isna().sum() >= 2
    filled = pieces.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 4096 and pieces[pieces["doc_id"] == 90_001]["length"].tolist() == [1]
