import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, cluttered, nothing
from tests.llm.test_filters import corpus  # noqa: F401
from tillmark.llm import queries


def test_stages_take_effect_one_after_the_other(spark, tmp_path, corpus):  # noqa: F811
    docs, labels, rows = corpus
    copies = docs.where("doc_id IN (12, 13)").selectExpr("doc_id + 1000 AS doc_id", "concat(text, ' river') AS text", "lang", "source", "n_chars")
    folder = f"file://{tmp_path}"
    everything = docs.unionByName(copies)
    everything.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    ids = [r["doc_id"] for r in out.collect()]
    assert not set(ids) & {i for i, *_ in rows if i % 10 <= 1 and i >= 400}  # junk and abuse are gone
    assert not set(ids) & {1012, 1013}  # so are near copies
    assert len(set(ids)) >= 0.95 * sum(i % 10 > 1 for i, *_ in rows)
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join"


def test_every_query_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_and_empty_tables(spark, folder, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = cluttered(awkward(spark))
    out = stage(spark, docs, folder)
    got = out.collect()
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in got}
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert kept <= rows and {(2, None), (3, "")} <= kept
    if name.startswith("n-gram"):
        assert kept == rows - {(4, "One two three four five six.")} and (None, "no id here") in kept and len(got) == len(kept)
    elif name.startswith("mixing"):
        assert kept == rows
    assert stage(spark, cluttered(nothing(spark)), folder).count() == 0
