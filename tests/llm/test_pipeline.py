import hashlib
import zlib

import corpus_pipeline
from varloom.llm import registry


def test_queries_cover_the_ten_operators():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_on_a_small_corpus(spark, tmp_path):
    clean = [(i, " ".join(f"word{(i * 7919 + k * k * 31 + k) % 4001}" for k in range(120)), "en", f"s{i % 2}", 1) for i in range(120)]
    toxic = [(1000 + i, clean[i][1] + f" fresh{i} awfulness hatefulness", "en", "s0", 1) for i in range(60)]
    copies = [(2000 + i, clean[i][1].upper(), "en", "s1", 1) for i in range(10)]
    near = [(3000 + i, clean[20 + i][1] + " tail", None, None, None) for i in range(10)]
    odd = [(4000, None, None, None, None), (4001, "", "en", "s1", 0)]
    path = f"file://{tmp_path}"
    write(spark, path, clean + toxic + copies + near + odd, [(r[0], 1, 0) for r in clean] + [(r[0], 0, 1) for r in toxic])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert not [i for i in kept[0] if 1000 <= i < 2000] and len(kept[0]) == 142 and any(held(r[0]) for r in toxic)
    assert kept[1] == kept[0] - set(range(10)) - {4000}
    assert kept[2] == kept[1] - set(range(3000, 3010))
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    texts = {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in clean + toxic + copies + near + odd}
    assert all(r["text_sha256"] == texts[r["doc_id"]] and r["same_text"] for r in docs.collect())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == kept[4]


def test_stages_bear_odd_rows_and_clashing_columns(spark, tmp_path):
    names = ["digest", "fp", "kept", "block", "score", "row", "_doc", "_id", "_n", "node", "root", "ids", "size", "weight", "quality_mix", "rate_mix", "a.b"]
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y z"), (5, "w " * 20_000), (6, "W " * 20_000), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, None, None, None, *["z"] * len(names)) for i, t in rows], schema)
    spark.createDataFrame([(3, None, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, f"file://{tmp_path}")
            if name != "encode":
                assert d.columns == docs.columns
            if name == "near_dedup":
                assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in d.collect()) == ([] if table is not docs else [(0, 5), (2, 0), (3, 3), (6, 40_000)])
        assert d.count() >= 0


def test_queries_of_operators_on_the_small_tables(spark, sf):
    for name, run in registry.QUERIES.items():
        d = run(spark, sf)
        assert d.count() > 0, name
