"""The pipeline, stage by stage, against plain Python on whole small tables."""

import hashlib
import struct

import corpus_pipeline
from sectorscope.llm import bpe, decontam, line_align, line_quality
from sectorscope.llm.oracle import oracle_sql
from sectorscope.llm.queries import queries
from tests.llm.conftest import SF
from tests.llm.test_dedup_ops import _brute_components, _brute_fingerprint, _brute_lines
from tests.llm.test_text_ops import _brute_hits


def _rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r["text"])))


def test_pipeline_stages(spark, documents, tmp_path):
    columns = documents.columns
    docs = documents
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == columns
    judged = {r["doc_id"]: line_quality.judge((r["text"] or "").encode()) for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in good.collect()} == {d: j["clean_text"] for d, j in judged.items() if j["kept"]}

    good = good.cache()
    lined = stages["line_dedup"](spark, good, SF).cache()
    assert lined.columns == columns
    before, after = ({r["doc_id"]: r["text"].split("\n") for r in x.collect()} for x in (good, lined))
    seen = set()
    for doc in sorted(before):
        kept = after.get(doc, [])
        lost = [x for x in before[doc] if x not in kept]
        assert all(x in seen for x in lost if x.strip())            # only lines an earlier document has go
        assert not kept or all(x in before[doc] for x in kept)
        if not any(x in seen for x in before[doc] if x.strip()):
            assert kept == before[doc]                              # a document without a shared line stays as it is
        seen |= set(before[doc])

    # and every line of a shared block goes
    wanted = _brute_lines([(r["doc_id"], r["text"]) for r in _rows(good)], line_align.AlignRules())
    assert any(wanted[d] != [x for x in before[d] if x.strip()] for d in before)
    for doc in before:
        assert [x for x in after.get(doc, []) if x.strip()] == wanted[doc]

    single = stages["simhash_near_dedup"](spark, lined, SF).cache()
    assert single.columns == columns
    rows = _rows(lined)
    root = _brute_components([_brute_fingerprint(r["text"]) for r in rows])
    assert _rows(single) == [r for i, r in enumerate(rows) if root[i] == i]

    clean = stages["benchmark_decontamination"](spark, single, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    vocab = {w for _, t in items for w in decontam.normal_words((t or "").encode())}
    wanted = []
    for r in _rows(single):
        few = len(vocab & set(decontam.normal_words(r["text"].encode()))) < 1
        n, hits, _ = (1, 0, []) if few else _brute_hits(r["text"], items)
        if not (hits and 20 * hits >= n):
            wanted.append(r)
    assert _rows(clean) == wanted

    tokens = {r["doc_id"]: r for r in stages["byte_bpe"](spark, clean, SF).collect()}
    path, pattern = bpe.public_file("byte_bpe_50k.tiktoken")
    import tiktoken
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in wanted:
        ids = library.encode_ordinary(r["text"])
        got = tokens[r["doc_id"]]
        assert got["ids"] == ids and got["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert len(tokens) == len(wanted)


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty, odd.limit(1)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count()


def test_run_and_registry(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < 200 and len({r["doc_id"] for r in rows}) == len(rows)
    assert corpus_pipeline.ORACLE_SQL is None
    assert len(queries()) == 14 and set(oracle_sql()) < set(queries())
