"""The pipeline, stage by stage, against plain versions on the smallest tables."""

from collections import Counter

import corpus_pipeline
from conftest import DATA
from helpers import documents, empty_documents
from test_pii import plain_spans
from test_text import brute_groups

from tessera.llm import mixing, toxicity


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, DATA).cache()
        assert name == names[-1] or (out.columns == docs.columns and out.dtypes == docs.dtypes)
        kept[name] = (current, out)
        current = out
    before, after = kept["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = before.collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, s in zip(rows, model.scores([r.text for r in rows])) if s < 0.3}
    before, after = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {eval(r)[0] for r in brute_groups(rows, 5) if eval(r)[3]}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept["personal_data"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert len(texts) == before.count()
    assert not any(spans for t in texts.values() for spans in plain_spans(t).values())
    before, after = kept["mixing"]
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_report(before).collect()}
    copies = Counter(r.doc_id for r in after.collect())
    assert all(copies[d] * size == t for d, (t, size) in taken.items())
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == set(copies)
    filled = {r.sequence_id: r["sum(length)"] for r in after.groupBy("sequence_id").sum("length").collect()}
    assert max(filled.values()) <= 2048
    again = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, after.select(*key).collect()))


def test_edge_cases(spark, tmp_path):
    docs = documents(spark, [(40, "mail a@b.co and 1.2.3.4 now", None, None, None), (40, "mail a@b.co and 1.2.3.4 now", "de", None, 7)])
    columns = docs.columns + ["pii_email", "mix_whole", "print", "node"]
    for n in columns[len(docs.columns) :]:
        docs = docs.selectExpr("*", f"1 as {n}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None, int(i == 3)) for i in range(12)] + [(None, 1, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= {r.doc_id for r in docs.collect()} and max(r.offset + r.length for r in packed) <= 2048
    assert 26 in {r.doc_id for r in packed} or 25 in {r.doc_id for r in packed}  # long texts
    empty_documents(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
