"""The corpus pipeline stage by stage, and the registered queries on the smallest tables."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from veritick.llm import decontam, langid, pii, registry, spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34 !!", "en", "s", 8), (None, "the thing that is here and there", "en", "s", 30)], docs.schema)
    now = docs.union(extra).union(docs.limit(3))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        before = now
        now = stage(spark, now, SF)
        seen[name] = (before, now)
        if k < 4:
            assert now.columns == docs.columns
    before, after = seen["language"]
    kept = {r[0] for r in after.select("doc_id").collect()}
    assert not {9000, 9001} & kept and None in kept and after.count() == before.count() - 2
    before, after = seen["near_duplicates"]
    sets = {}
    for r in before.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        own = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
        sets.setdefault(own, 0)
    roots = []
    for x in sets:  # groups by brute force
        near = [g for g in roots if any(10 * len(x & y) >= 8 * len(x | y) for y in g)]
        roots = [g for g in roots if g not in near] + [{x}.union(*near)]
    assert after.count() == len(roots) < before.count()
    before, after = seen["decontamination"]
    bad = decontam.hits(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").count()
    assert bad > 0 and after.count() == before.count() - bad
    before, after = seen["personal_data"]
    left = pii.with_base(after).select(*[f"__base_{k}" for k in pii.KINDS]).collect()
    assert after.count() == before.count() and not any(x for r in left for x in r)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["tokens"]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0


def through(spark, now, tmp_path):
    """Every stage's input and output, each written and read again."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
        now = stage(spark, before, SF)
        yield name, before, now


def test_stages_keep_extra_columns_and_take_empty_and_very_long_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(r["text"] for r in docs.where("text is not null and lang = 'en'").limit(60).collect()).split(" ")
    random.Random(1).shuffle(words)  # so that no benchmark passage is left in it
    long = " ".join(words)
    more = spark.createDataFrame([(7777, long + " mail someone@mail.example.com", "en", "s", 1)], docs.schema)
    extra = docs.union(more).withColumns({"ids": F.col("doc_id"), "score": F.lit("s"), "key": F.lit(1), "words": F.lit("w"), "start": F.lit(2.5)})
    for name, before, after in through(spark, extra, tmp_path / "a"):
        if name != "tokens":
            assert after.columns == before.columns and after.where("score = 's' and key = 1 and words = 'w' and start = 2.5 and ids = doc_id").count() == after.count() > 0
        assert after.where("doc_id = 7777").count() == 1
    for name, before, after in through(spark, extra.limit(0), tmp_path / "b"):
        assert after.count() == 0


def test_run_leaves_its_last_stage_only(spark):
    import glob

    from veritick.session import shared_dir

    already = set(glob.glob(f"{shared_dir(spark)}/pipeline-*"))
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.where("not round_trip").count() == 0
    (mine,) = set(glob.glob(f"{shared_dir(spark)}/pipeline-*")) - already
    assert [x.rpartition("/")[2] for x in glob.glob(f"{mine}/*")] == ["3-personal_data"]


def test_registered_queries(spark):
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in registry.queries()} and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
    assert spans.BLOCK and langid.UND == "und"


def test_shard_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    from veritick.llm import sharding

    for limit in (sharding.LIMIT, sharding.QUERY_LIMIT, 20_000):
        sql = sharding.OP5_SQL.replace(str(sharding.QUERY_LIMIT), str(limit))
        got = sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"), limit).select("doc_id", "shard", "depth", "shard_bytes", "shard_rows").collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall())
