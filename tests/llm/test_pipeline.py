"""The pipeline's rows against its stages redone in plain Python on a small table."""

import re

import corpus_pipeline
from tessella.llm import pii, toxicity
from tessella.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60)) + "."
    bench = " ".join(f"bench{i}" for i in range(15))
    texts = {i: prose(i) for i in range(60)}
    for i in range(0, 60, 3):
        texts[i] += " you rotten thing!"
    texts |= {100: prose(1), 101: prose(1) + " one more", 102: prose(2).upper(), 200: prose(200) + bench, 201: f"{prose(201)} mail a.b@c.example.com or 4111111111111111", 300: "", 301: None}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in texts.items()], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(60) if i % 3} | {201, 300, 301}
    new = got[201]["text"]
    assert "a.b@" not in new and "4111111111111111" not in new and len(new) == len(texts[201])
    assert all(got[i]["text"] == texts[i] for i in got if i not in (201,))
    assert len({(r["slot"], r["place"]) for r in got.values()}) == len(got)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and re.match("[a-z]", corpus_pipeline.STAGES[-1][0])


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) | {"pipeline"} <= set(entry.queries()) and len(Q.QUERIES) == 10
    assert toxicity.THRESHOLD == 0.3 and pii.KINDS
