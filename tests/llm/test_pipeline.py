import re

import pytest

import corpus_pipeline
from skewlens.llm import mixing
from skewlens.session import stage
from tests.llm.test_decontam import plain
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_every_stage_against_brute_force(spark, data, documents, texts):
    results, docs = {}, documents
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, data))
        results[name] = docs
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in results.values()]
    assert all(d.columns == documents.columns for d in list(results.values())[:-1])
    # every given text is in one of the languages learned
    want = {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert ids[0] == want
    component = brute_components([(i, brute_fingerprint(texts[i])) for i in sorted(want)])
    want = {i for i in want if component[i] == i}
    assert ids[1] == want
    items = [plain(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = {i for i in want if not any(item in plain(texts[i]) for item in items)}
    assert ids[2] == want
    mix = results["source mix"].collect()
    size, taken = {}, {}
    for r in results["benchmark decontamination"].collect():
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].split())
    for r in mix:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    for source, target in brute_targets(size).items():
        assert taken.get(source, 0) == pytest.approx(target, rel=0.3, abs=5)
    final = results["sharding"].collect()
    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in mix)
    assert all(r["text"] == texts[r["doc_id"]] for r in final)
    slots = {}
    for r in final:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_run_equals_its_stages(spark, data):
    assert [re.sub(r"\W+", "", n) for n, _ in corpus_pipeline.STAGES][0] == "languageid"
    assert corpus_pipeline.run(spark, data).count() > 0


def test_odd_and_empty_tables(spark, data, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, apply in corpus_pipeline.STAGES:
            docs = stage(apply(spark, docs, data))
        assert docs.count() >= 0
    assert mixing.MOST_COPIES == 3
