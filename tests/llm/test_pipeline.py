import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from test_native import plain_leaks
from test_secrets import plain
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from morpholake.llm import bpe


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        at[name] = docs.collect()
    first = at["language_id"]
    assert len(first) > 0.95 * spark.read.parquet(f"{sf}/documents.parquet").count()
    items = [(r.doc_id, plain_fingerprint(r.text or "")) for r in first]
    kept = {i for (i, _), c in zip(items, plain_components(items, 4), strict=True) if i == c}
    assert {r.doc_id for r in at["near_dedup"]} == kept
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in at["near_dedup"] if len(r.text) < 2000]
    leaking = set(plain_leaks(short, bench))
    assert {i for i, _ in short} - {r.doc_id for r in at["decontamination"]} == leaking
    assert not any(plain(r.text) for r in at["secret_scan"])
    assert all(r.n_chars == len(r.text) for r in at["secret_scan"])
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        text = next(x.text for x in at["secret_scan"] if x.doc_id == r.doc_id)
        assert r.ids == library.encode_ordinary(text) and r.n_tokens == len(r.ids)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_keep_odd_and_empty_tables(spark, odd, empty, sf):
    """Columns with the names that stages use inside come through all stages with their values."""
    clash = ["score", "lang_pred", "secret_spans", "redacted", "_gone", "_row", "_leaking_doc", "Redacted.x", "_SCORE"]
    wide = odd.drop("score", "_row")
    for c in clash:
        wide = wide.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    no_chars = wide.drop("n_chars")
    for table in (wide, no_chars, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        for r in docs.collect() if table is not empty else ():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in clash)
        assert docs.count() == (3 if table is not empty else 0)  # 4, 5 once, and the one without an id
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
