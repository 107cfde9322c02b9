"""The pipeline's stages, each on what the one before kept."""

import hashlib

import corpus_pipeline
from geopressure.llm import catalog, personal_data
from tests.llm.test_text_ops import components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    state, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf_dir).cache()
        frames[name] = {r.doc_id: r for r in state.collect()}
        if name != "byte_bpe":
            assert state.columns == docs.columns
    good = frames["quality"]
    known = [i for i in labels if (i in good) == bool(labels[i])]
    assert len(known) >= 0.97 * len(labels)
    want = components([(i, r.text) for i, r in good.items()], 5)
    assert set(frames["near_dedup"]) == {i for i, (_, root) in want.items() if root == i}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {i for i, r in frames["near_dedup"].items() if any(b in " ".join(r.text.lower().split()) for b in bench)}
    assert held and not held & set(frames["decontaminate"])
    masked = frames["personal_data"]
    assert set(masked) == set(frames["decontaminate"])
    for i, r in masked.items():
        assert not personal_data.base_spans(r.text) or "<" in r.text
        assert r.n_chars == len(r.text)
        tokens = frames["byte_bpe"][i]
        assert tokens.n_tokens == len(tokens.ids) and tokens.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_every_operator_is_registered():
    names = catalog.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(catalog.oracle_sql()) <= set(names)
