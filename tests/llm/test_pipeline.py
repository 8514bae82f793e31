import corpus_pipeline
from tests.llm.brute import WORD


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == cols
    original = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in seen["quality"].collect()}
    assert all(kept[k] == original[k] and len(WORD.findall(kept[k])) >= 10 for k in kept)
    cut = {r["doc_id"]: r["text"] for r in seen["lines"].collect()}
    assert set(cut) <= set(kept) and all(set(cut[k].split("\n")) <= set(kept[k].split("\n")) for k in cut)
    one = {r["doc_id"] for r in seen["near"].collect()}
    assert one <= set(cut) and seen["near"].count() == len(one)
    assert {r["doc_id"] for r in seen["mixing"].collect()} <= one
    pieces = seen["packing"].collect()
    assert sum(r["start"] == 0 for r in pieces) == seen["mixing"].count()
