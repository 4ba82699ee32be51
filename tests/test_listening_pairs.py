"""Pairs to ask: equal to a plain comparison of all pairs, and met only where an axis or the sizes match."""

import random
import re

from rateloom import catalog
from rateloom.operators import listening


def test_pairs_are_met_by_type_or_by_size(spark, tmp_path):
    rng = random.Random(2)
    sizes = [*range(-2, 45), 95, 100, 105, 1900, 1995, 2000, 10**6, 10**6 - 50_000, None]
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["t", "u", "v", "w", "x", None]), rng.choice(sizes)) for k in range(500)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for a, brand, kind, size in rows:
        for b, other_brand, other_kind, other in rows:
            if brand is not None and brand == other_brand and a < b:
                typed, sized = kind is not None and kind == other_kind, size is not None and size == other
                if typed or sized or (None not in (size, other) and 20 * abs(size - other) <= max(size, other)):
                    want.add((a, b, "size" if typed else "type" if sized else "trade"))
    df = catalog.QUERIES["pair_questions"](spark, str(tmp_path))
    got = [tuple(r) for r in df.select("a", "b", "axis").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"Join \[([^\]]*)\]", plan)
    assert len(joins) >= 3 and all("," in keys for keys in joins), joins


def test_pairs_are_dealt_out_to_tasks_and_blocks_lose_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listening, "BLOCK", 7)
    monkeypatch.setattr(listening, "TASK_PAIRS", 1000)
    rng = random.Random(5)
    rows = [(rng.randrange(150), "b", rng.choice(["t", "u", None]), rng.choice([19, 20, 21, None])) for _ in range(200)]  # keys recur
    rows += [(None, "b", "t", 20), (7, None, "t", 20)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{tmp_path}/part.parquet").createOrReplaceTempView("part")
    want = spark.sql(catalog.ORACLE_SQL["pair_questions"])
    df = catalog.QUERIES["pair_questions"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert df.schema.simpleString() == "struct<a:bigint,b:bigint,axis:string>"
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) > 20
