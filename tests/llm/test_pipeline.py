"""The pipeline against plain decisions of its operators, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_documents import plain_components, plain_fingerprint, plain_groups
from tests.llm.test_texts import packed_right
from usagelens.llm import quality, toxicity
from usagelens.session import materialize

DIRECTORY = "/root/testdata/sf0.01"


def test_stages(llm):
    docs = llm.read.parquet(f"{DIRECTORY}/documents.parquet").limit(400)
    labels = llm.read.parquet(f"{DIRECTORY}/labels.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(llm, steps[-1], DIRECTORY), f"test-{name}"))
    assert all(step.columns == docs.columns for step in steps[:-1])
    kept = [{r["doc_id"]: r["text"] for r in step.collect()} for step in steps[:-1]]
    ids = lambda rows, column: {r["doc_id"] for r in rows.collect() if r[column]}
    assert set(kept[1]) == ids(quality.classify(steps[0], labels), "predicted")
    assert set(kept[2]) == set(kept[1]) - ids(toxicity.classify(steps[1], labels), "predicted")
    assert set(kept[3]) == {i for i, _, _, stays, _ in plain_groups(list(kept[2].items())) if stays}
    components = plain_components({i: plain_fingerprint(t) for i, t in kept[3].items()})
    assert set(kept[4]) == {i for i, c in components.items() if i == c}
    packed = steps[-1].collect()
    assert {r["doc_id"] for r in packed} == set(kept[4])
    packed_right(packed, kept[4], 2048)
    assert len(kept[0]) > len(kept[1]) > len(kept[2]) > len(kept[3])


def test_empty_input(llm):
    docs = llm.read.parquet(f"{DIRECTORY}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(llm, docs, DIRECTORY), f"test-{name}")
    assert docs.count() == 0
