"""The document store against a dictionary, the filter language, and top-k against brute force."""

import numpy as np
import pytest

from turnstore.operators import vectors
from turnstore.operators.embed import HashEmbedder
from turnstore.operators.where import parse_where


def test_parse_where():
    assert parse_where(None) == []
    assert parse_where({"$and": [{"a": 1}, {"$and": [{"b": "x"}, {"c": True}]}]}) == [("a", 1), ("b", "x"), ("c", True)]
    for bad in ({}, {"a": 1, "b": 2}, {"a": None}, {"a": {"$gt": 1}}, {"$or": [{"a": 1}]}, {"$or": "x"}, {"$and": []}, {"$and": {"a": 1}}, "a"):
        with pytest.raises(ValueError):
            parse_where(bad)


def test_hash_embedder():
    e = HashEmbedder(64)
    a, b, c, d = e.embed(["the old well", "the old wall", "xyz 123", ""])
    assert np.allclose(np.linalg.norm([a, b, c, d], axis=1), 1, atol=1e-6) and a @ b > 0.4 > a @ c
    assert (e.embed(["the old well"])[0] == a).all() and abs(HashEmbedder(64, seed=1).embed(["the old well"])[0] @ a) < 0.9


def test_store(spark, tmp_path, monkeypatch):
    e = HashEmbedder(16)
    store = vectors.VectorStore(spark, str(tmp_path / "v"), e)
    ids = lambda where: sorted(r["id"] for r in store.list_ids(where).collect())
    assert len(store) == 0
    store.upsert([])
    store.upsert([{"id": f"d{k}", "text": f"text {k % 5}", "metadata": {"project": f"p{k % 2}", "sqlite_id": k, "obs_type": "o" if k % 3 else "", "n": k}} for k in range(10)] + [{"id": "d3", "text": "again", "metadata": {"project": "p9"}}])
    assert len(store) == 10 and ids({"project": "p9"}) == ["d3"]
    assert ids({"sqlite_id": "4"}) == [] and ids({"sqlite_id": 4.0}) == ["d4"] and ids({"n": 4}) == ["d4"] and ids({"n": "4"}) == []
    assert ids({"$and": [{"project": "p0"}, {"obs_type": ""}]}) == ["d0", "d6"]
    store.update_metadata(["d3", "nobody"], {"doc_type": "t", "obs_type": "z"})
    assert ids({"obs_type": "z"}) == ["d3"]
    store.delete(["d0", "nobody"])
    rows = store.query("text 1", 3).collect()
    assert [r["id"] for r in rows][:2] == ["d1", "d6"] and abs(rows[0]["distance"]) < 1e-6 and rows[0]["metadata"]["project"] == '"p1"'
    assert store.query("x", 0).count() == 0 and store.query("x", 99, {"project": "p1"}).count() == 4
    again = vectors.VectorStore(spark, str(tmp_path / "v"), e)
    assert len(again) == 9
    with pytest.raises(RuntimeError):
        vectors.VectorStore(spark, str(tmp_path / "v"), HashEmbedder(8))
    again.embedder = HashEmbedder(8)
    with pytest.raises(ValueError):
        again.upsert([{"id": "x", "text": "y"}])
    monkeypatch.setattr(vectors, "FORMAT_VERSION", 2)
    with pytest.raises(RuntimeError):
        vectors.VectorStore(spark, str(tmp_path / "v"), e)


def test_top_k(spark):
    x = HashEmbedder(32).embed([f"t{k // 2}" for k in range(200)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6)
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<float>")
    want = sorted(range(200), key=lambda k: (round(1 - float(x[k].astype(float) @ x[7].astype(float)), 12), k))[:15]
    assert [r["id"] for r in vectors.query(base, x[7], 15).orderBy("rank").collect()] == want
    queries = base.where("id = 7").selectExpr("id as query_id", "embedding as vector")
    assert [r["id"] for r in vectors.query_batch(base, queries, 15).orderBy("rank").collect()] == want


@pytest.mark.parametrize("rows", [7, 2048])
def test_query_batch(spark, monkeypatch, rows):
    """Every hundredth row against all, with copies, a missing and a shorter vector; scored by blocks, not by pairs of rows."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 2)
    x = [v.tolist() for v in HashEmbedder(16).embed([f"t{k % 97}" if k % 3 else "same" for k in range(900)])]
    x[5], x[300] = None, x[300][:4]
    base = spark.createDataFrame([*enumerate(x)], "id long, embedding array<float>").repartition(3)
    wanted = base.where("id % 100 = 0").selectExpr("id as query_id", "embedding as vector")
    rows = vectors.query_batch(base, wanted, 5)
    want = []
    for q in range(0, 900, 100):
        far = {k: (0, 0.0) if v is None or len(v) != len(x[q]) else (1, 1.0 - sum((a * b for a, b in zip(v, x[q])), 0.0)) for k, v in enumerate(x)}
        want += [(q, k, n + 1) for n, k in enumerate(sorted(far, key=lambda k: (far[k], k))[:5])]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in rows.collect()) == sorted(want, key=lambda w: (w[0], w[1]))
    assert vectors.query_batch(base, wanted, 0).count() == 0
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # to blocks on both sides, and their scores
