from pyspark.sql import functions as F

from quire.operators import evidence
from quire.plans import catalog


def test_packs_choose_from_the_whole_fused_pool(spark, monkeypatch):
    chunks = [(f"c{i:02d}", f"d{i}", f"soul w{i} " + " ".join(f"u{i}x{j}" for j in range(248)), [f"b{i}"], [1], ["H"], f"s{i}") for i in range(20)]
    schema = "chunk_id string, document_id string, text string, source_block_ids array<string>, page_numbers array<int>, heading_path array<string>, section_id string"
    df = spark.createDataFrame(chunks, schema)
    hits = spark.createDataFrame([("q", f"c{i:02d}", 1.0, i + 1) for i in range(20)], "query_id string, id string, score double, rank int")
    monkeypatch.setattr(catalog, "_legs", lambda s, d: (hits, hits))
    monkeypatch.setattr(catalog, "_questions", lambda s, d: spark.createDataFrame([("q", "soul")], "query_id string, query string"))
    monkeypatch.setattr(catalog, "_chunks", lambda s, d: df)
    monkeypatch.setattr(catalog, "_documents", lambda s, d: df.select("document_id", F.lit("T").alias("title")))
    rows = catalog._packs(spark, "").collect()
    chosen = [r for r in rows if r.fate == "selected"]
    assert len(rows) == 20
    assert len(chosen) == 8 and 900 < sum(r.n_tokens for r in chosen) <= evidence.PackConfig().max_tokens


def test_upsert_meets_the_whole_stored_table(spark, monkeypatch):
    seen, upsert = {}, catalog.corpus.upsert
    monkeypatch.setattr(catalog, "_vectors", lambda s, d: spark.range(600).withColumn("label", F.lit(1)))
    monkeypatch.setattr(catalog.corpus, "upsert", lambda stored, incoming, key: seen.update(n=stored.count()) or upsert(stored, incoming, key))
    rows = {r.id: r.label for r in catalog.upsert_vectors(spark, "").collect()}
    assert seen["n"] == 600 and rows == {i: 1 if i < 200 else 101 for i in range(600)}
