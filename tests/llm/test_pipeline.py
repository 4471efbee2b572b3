"""The pipeline keeps what brute force keeps, stage by stage."""

import corpus_pipeline
from meterloom.llm import cotrain, simhash_vp, tiling


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, data)
    model = cotrain.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in cotrain.score(docs, model).where("p_good >= 0.35").collect()}
    single = corpus_pipeline.near_dedup(spark, kept, data)
    got = kept.collect()
    rows = {r["doc_id"]: int(f) for r, f in zip(got, simhash_vp.fingerprints_of([r["text"] for r in got]))}
    ids, gone = sorted(rows), set()
    group = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and bin(rows[i] ^ rows[j]).count("1") <= 4:
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    gone = {i for i in ids if group[i] != i}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(ids) - gone
    free = corpus_pipeline.decontaminate(spark, single, data)
    items = tiling.Items([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()], tiling.LEAST)
    clean = {r["doc_id"] for r in single.collect() if not any(f[1] >= 0.5 * f[2] for f in items.found(r["text"]))}
    assert free.columns == columns and {r["doc_id"] for r in free.collect()} == clean
    safe = corpus_pipeline.secrets(spark, free, data)
    assert safe.columns == columns and {r["doc_id"] for r in safe.collect()} == clean
    out = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in out} == clean and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def _folder(spark, data, docs, path, empty=()):
    docs.write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        rows = spark.read.parquet(f"{data}/{t}.parquet")
        (rows.limit(0) if t in empty else rows).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_odd_rows_and_no_labels(spark, data, odd, tmp_path):
    folder = _folder(spark, data, odd, tmp_path / "odd", ("labels", "benchmark"))
    rows = corpus_pipeline.run(spark, folder).collect()
    # 1, 2, 2 and 6 are copies for a fingerprint, as are the empty texts; the rest differ
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids == [(False, 1), (False, 3), (False, 5), (False, 7), (False, 8), (False, 20), (True, 0)]
    assert all(r["round_trip"] for r in rows) and next(r for r in rows if r["doc_id"] == 3)["n_tokens"] == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns
    text = next(r["text"] for r in docs.collect() if r["doc_id"] == 7)
    assert "hunter2" not in text and "AKIA" not in text and "[secret]" in text and "é" in text


def test_empty_documents(spark, data, empty, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, data, empty, tmp_path / "empty")).count() == 0
