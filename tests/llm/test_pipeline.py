"""The five stages one after another, each held against its own input."""

import corpus_pipeline
import sentencepiece
from surveyloom.llm import lines, pieces, simhash, tiling
from surveyloom.llm.common import words_of, written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    index = tiling.Index(list(bench.items()), 5)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = written(stage(spark, docs, small), "test")
        if name != names[-1]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language":
            gone = [before[i] for i in set(before) - set(after)]
            assert len(gone) <= 0.02 * len(before)
            assert all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert set(after) == set(before)
            want = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
            assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in rows)
            seen = [x for r in rows for x in r.text.split("\n") if x.strip()]
            assert len(seen) == len(set(seen))
        elif name == "near_dedup":
            group = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert set(after) == set(group.values())
        elif name == "decontamination":
            bad = {i for i, r in before.items() if any(sum(t[0] for t in ts) >= 0.4 * n for _, n, ts in index.search(r.text))}
            assert set(after) == set(before) - bad
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
            assert set(after) == set(before)
            assert all(r.ids == library.encode(before[r.doc_id].text) and r.decoded == before[r.doc_id].text for r in rows)
        docs = out
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {r.doc_id: r.ids for r in rows}
