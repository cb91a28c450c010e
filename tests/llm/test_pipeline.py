"""The corpus pipeline, stage by stage against brute force, and the queries' registration."""

from test_near_copies import kept_by_brute_force

import corpus_pipeline
from cuewise.llm import language_id, queries
from cuewise.llm.common import durable, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = durable(stage(spark, docs, SF))
        assert docs.columns == columns
        rows = docs.collect()
        assert all(texts[r["doc_id"]] == r["text"] for r in rows)
        kept = {r["doc_id"] for r in rows}
        if name == "language_id":
            found = {r["doc_id"]: r for r in language_id.identify_languages(table(spark, SF, "documents")).collect()}
            grams = {i: language_id.variety(language_id.symbols_of(t or "")) for i, t in before.items()}
            assert kept == {i for i, r in found.items() if r["lang_pred"] != "und" and (grams[i] < language_id.EVIDENCE or r["score"] >= language_id.REJECT)}
        elif name == "simhash_near_dedup":
            assert kept == {i for i, _ in kept_by_brute_force(list(before.items()))}
        elif name == "benchmark_decontamination":
            items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
            assert not any(item in t for i, t in before.items() if i in kept for item in items)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and {r["shard"] for r in last} <= set(range(24))


def test_edge_rows_pass_through_the_chain(edge_docs, no_docs, spark):
    """Nulls, blanks, repeated rows, a very long text and clashing columns; and no rows at all."""
    for docs in (edge_docs, no_docs):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, SF))
            assert docs.columns == columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(last) == docs.count()
    assert len(last) == 0


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names) and corpus_pipeline.queries().keys() == {"pipeline"}
