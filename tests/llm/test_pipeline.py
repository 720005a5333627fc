"""The pipeline's stages over a small table, each held against its operator's brute force."""

from quernstone.llm import minhash, quality
from tests.conftest import TINY
from tests.llm import test_minhash, test_suffixes
from tests.llm.helpers import documents


def test_stages_pass_documents_on(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    at = docs
    seen = []
    for name, stage in p.STAGES[:-1]:
        at = p._run.cut(stage(spark, at, TINY), f"test-{name}")
        assert at.columns == docs.columns
        seen.append({r.doc_id: r for r in at.collect()})
    good, near, cut, mixed = seen
    assert set(near) <= set(good) and set(cut) == set(near) and set(mixed) <= set(cut)
    left = test_minhash.brute([(d, r.text) for d, r in good.items()], 5)
    assert set(near) == {d for d, _, _, k in left if k}
    gone = {r[0]: r[2] for r in test_suffixes.brute([(d, r.text) for d, r in near.items()], p.PASSAGE)}
    for d, r in cut.items():
        lost = len(near[d].text.encode()) - len(r.text.encode())
        assert gone[d] <= lost <= gone[d] + 6 * (gone[d] // p.PASSAGE + 1)
    out = p.run(spark, TINY)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(mixed)


def test_clean_documents_stay(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.good_documents(spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/labels.parquet")).collect()}
    good = [d for d, y in labels.items() if y]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline as p

    docs = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_registry_names():
    from quernstone.llm import registry

    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_equal_rows_in_minhash_stage(spark):
    docs = documents(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]).select("doc_id", "text", "lang", "source", "n_chars")
    assert [r.doc_id for r in minhash.one_of_each(docs).collect()] == [1]
