import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from larkspan.llm import language, mixing
from test_decontaminate import brute as brute_items
from test_neardup import brute as brute_groups
from test_substrings import brute as brute_spans


def test_pipeline_matches_brute_force(spark):
    """Every stage at sf0.001 against its plain definition on the rows that the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    odd = spark.createDataFrame([(10_001, "... 123 !!", "en", "src0", 10), (10_002, None, None, None, None), (10_003, rows[3]["text"], "en", "src1", rows[3]["n_chars"])], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    model = language.train(docs)

    kept = cp.identify_language(spark, docs, sf)
    assert kept.columns == columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {r["doc_id"] for r in language.identify(docs, model).filter("lang_pred <> 'und' AND bits_per_byte <= 8").collect()}
    assert set(got) == want and 10_001 not in got and 10_002 not in got and len(got) == len(rows) + 1

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    out = cp.drop_near_duplicates(spark, kept, sf)
    assert out.columns == columns
    want = {r[0] for r in brute_groups(list(got.items())) if r[3]}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == want and 10_003 not in got

    out = spark.createDataFrame(out.collect(), docs.schema)
    cut = cp.cut_repeated_passages(spark, out, sf)
    assert cut.columns == columns
    rows = cut.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == [r[:2] for r in brute_spans(list(got.items()))]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    cut = spark.createDataFrame(rows, docs.schema)
    clean = cp.drop_benchmark_items(spark, cut, sf)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {m[0] for m in brute_items([(r["doc_id"], r["text"]) for r in rows], items)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows} - bad

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    mixed = cp.mix_to_weights(spark, clean, sf)
    verdict = {r["doc_id"]: r["times"] for r in mixing.mix_sources(clean).collect() if r["times"]}
    assert {r["doc_id"]: r["mix_times"] for r in mixed.collect()} == verdict


def test_run_and_repeated_or_null_ids(spark):
    from larkspan.llm import neardup

    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words on the same id"), (None, "a b c d e f g"), (None, "no id here at all"), (2, "a b c d e f g")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_representatives(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f g"), (1, "other words on the same id"), (None, "no id here at all")], key=str)
    assert all(r["mix_times"] in (1, 2) for r in mixing.take_mix(df).collect())
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and "mix_times" in out.columns
    empty = df.limit(0)
    for stage in (neardup.keep_representatives, mixing.take_mix):
        assert stage(empty).count() == 0
