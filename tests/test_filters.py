"""Filters by blocks and layers, sketches that unite, array feeds that are cut among tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from urlintel.operators import entries, filters
from urlintel.sources import feeds

N = 1_000_000


def keys(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("https://h"), F.col("id") % 977, F.lit(".net/"), F.col("id")).alias("u"))


def test_a_million_keys(spark):
    made = filters.build(keys(spark, 0, N), ["u"])
    found = lambda a, b: filters.probe(keys(spark, a, b), [made], ["u"]).count()
    assert found(0, N) == N
    assert found(N, 2 * N) <= 0.01 * N
    assert made.blocks * 512 <= 13 * 1.08 * N
    assert filters.error(filters.bits_per_key(1e-4)) <= 1e-4


def test_layers_grow_tenfold(spark, tmp_path):
    """Batches that overlap the one before by half; replays add nothing; a layer without its mark of success isn't read."""
    home, step = str(tmp_path / "f"), 20_000
    assert filters.read_layers(spark, home) == []
    for i in range(10):
        added = filters.add_layer(spark, home, keys(spark, max(0, i * step - step // 2), (i + 1) * step), ["u"])
        assert 0.98 * step <= added <= step
    assert filters.add_layer(spark, home, keys(spark, 0, 3 * step), ["u"]) == 0
    (tmp_path / "f" / "000010-5-x").mkdir()
    layers = filters.read_layers(spark, home)
    assert len(layers) == 10
    assert filters.probe(keys(spark, 0, 10 * step), layers, ["u"]).count() == 10 * step
    assert filters.probe(keys(spark, 10 * step, 20 * step), layers, ["u"]).count() <= 0.01 * 10 * step


def test_nulls_repeats_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "x"), ("", "")], "type string, key string")
    made = filters.build(df.dropna(), ["type", "key"])
    assert sorted(map(tuple, filters.probe(df, [made], ["type", "key"]).collect())) == [("", ""), ("a", "x")]
    assert filters.probe(df, [], ["type", "key"]).count() == 0
    assert filters.probe(df, [filters.build(df.limit(0), ["type", "key"])], ["type", "key"]).count() == 0
    assert filters.add_layer(spark, str(tmp_path / "none"), df.limit(0), ["type", "key"]) == 0


def test_a_probe_is_one_row_a_key(spark):
    made = filters.build(keys(spark, 0, 1000), ["u"])
    plan = filters.probe(keys(spark, 0, 1000), [made], ["u"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_unite(spark, tmp_path):
    home = str(tmp_path / "s")
    rows = lambda a, b: keys(spark, a, b).select(F.col("u").alias("source_url"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("deleted_at"))
    for number, (a, b) in enumerate([(0, 600_000), (400_000, 900_000), (900_000, N)]):
        entries.add_sketches(rows(a, b), home, "feed/one", number)
    entries.add_sketches(rows(400_000, 900_000), home, "feed/one", 1)
    got = entries.count_urls_approx(spark.read.parquet(home), "source").collect()
    assert len(got) == 1 and abs(got[0]["urls"] - N) <= 0.03 * N


TRICKY = ['{"url":', '},{"url":"x"}', "]", "[", '"', "\\", '\\"},{\\"url\\":', "公司 \n\r\t", "", " "]


def records(n, seed=5):
    r = random.Random(seed)
    out = [{"url": "".join(r.choices(TRICKY, k=r.randrange(6))) + f"https://n{i}.example.org/", "verified": bool(i % 3)} for i in range(n)]
    out[1] = {"verified": True, "url": "opens otherwise"}
    out[-1] = {"url": None, "verified": None}
    return out


@pytest.mark.parametrize("form", [{"separators": (",", ":")}, {"indent": 2}, {"separators": (" , ", " : "), "ensure_ascii": False}])
def test_arrays_are_cut(spark, tmp_path, form):
    rows = records(30_000)
    (tmp_path / "a.json").write_text(json.dumps(rows, **form) + "\n", encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        df = feeds.read_json_array(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = sorted((r["url"] or "", r["verified"] is None, bool(r["verified"])) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((r["url"] or "", r["verified"] is None, bool(r["verified"])) for r in rows)


def test_small_and_broken_arrays(spark, tmp_path):
    def of(text, name="a.json"):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    read = lambda text: [r["url"] for r in feeds.read_json_array(spark, of(text)).collect()]
    assert read("[]") == [] and read(" [ ] \n") == []
    assert read('[{"url":"x","verified":true}]') == ["x"]
    assert read('﻿[\n{"url":"x"},\n{"url":"y"}\n]\n') == ["x", "y"]
    for text in ('[{"url":"x"},', '[{"url":"x"}', '{"url":"x"}', "", "<html>"):
        with pytest.raises(Exception):
            feeds.read_json_array(spark, of(text)).collect()
    broken = '[{"url":"a","verified":true},{"url":"b" "verified":true},{"url":"c","verified":true}]'
    with pytest.raises(Exception):
        feeds.read_json_array(spark, of(broken)).collect()
    good, rejects = feeds.split_json_array(spark, of(broken))
    assert [r["url"] for r in good.collect()] == ["a", "c"]
    assert [(r["reason"], '"b"' in r["line"]) for r in rejects.collect()] == [("invalid_json", True)]
