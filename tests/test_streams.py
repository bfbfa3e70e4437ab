import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from urlintel.operators import entries, index
from urlintel.sources import feeds
from urlintel.streaming import jobs, store


def lines(spark, *urls, source="s"):
    return spark.createDataFrame([(u, source, "c") for u in urls], "line string, source string, category string")


def apply(spark, table, stream, batch, *urls, source="s", every=64):
    return jobs.apply_lines(lines(spark, *urls, source=source), stream, batch, table, F.lit(f"{stream}{batch}"), F.lit(100 + batch), every)


def state(spark, table):
    e = {(r["source_url"], r["source"], r["run_id"], r["created_at"], r["updated_at"], r["deleted_at"]) for r in store.read_entries(spark, table).collect()}
    return e, {(r["type"], r["key"], r["source"], r["entries"]) for r in store.read_index(spark, table).collect()}, {(r["source_url"], tuple(r["ids"])) for r in store.read_url_ids(spark, table).collect()}


def expected(spark, table):
    """The index and the inverted index as the plain operators build them from the entries."""
    e = store.read_entries(spark, table)
    keys = e.filter("deleted_at is null").select(F.expr("source"), jobs.urls.entry_target().alias("k")).groupBy("k.type", "k.key", "source").count()
    assert {tuple(r)[:3] for r in keys.collect()} == {(r["type"], r["key"], r["source"]) for r in index.key_index(e).collect()}
    return {tuple(r) for r in keys.collect()}, {(r["source_url"], tuple(r["ids"])) for r in entries.url_id_index(e).collect()}


U = [f"https://h{i}.plover.net/p" for i in range(9)]


@pytest.mark.parametrize("every", [2, 64])
def test_feeds_and_checkpoints_share_a_table(spark, tmp_path, every):
    """Two feeds with batches of one number, and a new checkpoint that begins again at 0, before and after compactions."""
    t = str(tmp_path / "t")
    assert store.read_entries(spark, t) is None and store.read_index(spark, t) is None
    apply(spark, t, "a", 0, U[0], U[1], every=every)
    apply(spark, t, "b", 0, U[0], U[2], source="z", every=every)
    apply(spark, t, "a", 1, U[1], U[3], every=every)
    apply(spark, t, "c", 0, U[4], every=every)  # the feed of a, from a new checkpoint
    apply(spark, t, "c", 1, U[0], every=every)
    found = state(spark, t)
    assert {(u, s) for u, s, *_ in found[0]} == {(U[0], "s"), (U[1], "s"), (U[3], "s"), (U[4], "s"), (U[0], "z"), (U[2], "z")}
    assert (U[0], "s", "c1", 100, 101, None) in found[0] and (U[1], "s", "a1", 100, 101, None) in found[0]
    for stream, batch, urls, source in (("a", 0, U[:2], "s"), ("b", 0, [U[0], U[2]], "z"), ("a", 1, [U[1], U[3]], "s"), ("c", 0, [U[4]], "s"), ("c", 1, [U[0]], "s")):
        assert not apply(spark, t, stream, batch, *urls, source=source, every=every)  # replay of any batch
        assert state(spark, t) == found
    assert found[1:] == expected(spark, t)
    assert any(c.kind == "base" for c in store.log(spark, t)) == (every == 2)


def test_crashes(spark, tmp_path):
    """A batch that was written but not committed isn't seen; two commits of one batch count once."""
    t = str(tmp_path / "t")
    apply(spark, t, "a", 0, U[0])
    before = state(spark, t)
    apply(spark, t, "a", 1, U[1])
    after = state(spark, t)
    name = store.log(spark, t)[-1].name
    os.rename(f"{t}/log/{name}", f"{t}/{name}")
    assert state(spark, t) == before
    apply(spark, t, "a", 1, U[1])
    assert state(spark, t) == after
    os.rename(f"{t}/{name}", f"{t}/log/{name.replace('1@rows', '7@rows', 1)}")  # the lost writer comes back and commits as well
    assert len(os.listdir(f"{t}/log")) >= 3 and state(spark, t) == after
    store.compact(spark, t)
    assert state(spark, t) == after


def test_deletions(spark, tmp_path):
    """Expiry, deletion by id, clearing and revival, each folded or not."""
    t = str(tmp_path / "t")
    ids = lambda *u: store.read_entries(spark, t).filter(F.col("source_url").isin(*u)).select("id")
    fold = lambda on: on and store.compact(spark, t)
    for on in (False, True):
        t = str(tmp_path / f"t{on}")
        apply(spark, t, "a", 0, *U[:4])
        apply(spark, t, "a", 1, *U[2:5])
        apply(spark, t, "b", 0, U[0], source="z")
        fold(on)
        assert store.expire_stale(spark, t, "s", "a1", 500, "x", 0)
        assert not store.expire_stale(spark, t, "s", "a1", 501, "x", 0)
        living = lambda: {(r["source_url"], r["source"]) for r in store.read_entries(spark, t).filter("deleted_at is null").collect()}
        assert living() == {(u, "s") for u in U[2:5]} | {(U[0], "z")}
        fold(on)
        assert store.soft_delete_ids(spark, t, ids(U[1], U[2]), 600, "x", 1)
        assert {(r["source_url"], r["deleted_at"]) for r in store.read_entries(spark, t).filter("deleted_at is not null").collect()} == {(U[0], 500), (U[1], 600), (U[2], 600)}
        assert state(spark, t)[1:] == expected(spark, t)
        apply(spark, t, "a", 2, U[1], U[0])  # revived, with the first id and time
        fold(on)
        assert (U[1], "s", "a2", 100, 102, None) in state(spark, t)[0] and (U[0], "s") in living()
        assert store.clear_all(spark, t, 700, "x", 2)
        assert living() == set() and {r[0] for r in store.read_entries(spark, t).select("deleted_at").collect()} == {700}
        fold(on)
        assert store.read_index(spark, t).count() == 0
        apply(spark, t, "a", 3, U[6], U[2])
        fold(on)
        fold(on)
        assert living() == {(U[6], "s"), (U[2], "s")} and state(spark, t)[1:] == expected(spark, t)


def test_an_upsert_beside_a_deletion_stays(spark, tmp_path, monkeypatch):
    """It commits while the deletion looks for its rows; the deletion was told before it."""
    t = str(tmp_path / "t")
    apply(spark, t, "a", 0, U[0], U[1])
    plain = store.commit

    def late(spark_, table, rows, kind, *more, **named):
        if kind == "gone":
            monkeypatch.setattr(store, "commit", plain)
            apply(spark, t, "a", 1, U[0])
        return plain(spark_, table, rows, kind, *more, **named)

    monkeypatch.setattr(store, "commit", late)
    store.expire_stale(spark, t, "s", "none", 500, "x", 0)
    assert {r["source_url"] for r in store.read_entries(spark, t).filter("deleted_at is null").collect()} == {U[0]}


def test_compaction_beside_readers_and_writers(spark, tmp_path, monkeypatch):
    """Readers of before a base still find their files; a commit that comes in while a base is written isn't lost."""
    t = str(tmp_path / "t")
    apply(spark, t, "a", 0, U[0])
    reader = store.read_entries(spark, t)
    store.compact(spark, t)
    apply(spark, t, "a", 1, U[1])
    assert reader.count() == 1
    plain = store.merged

    def slow(*args):
        monkeypatch.setattr(store, "merged", plain)
        apply(spark, t, "b", 0, U[2])
        return plain(*args)

    monkeypatch.setattr(store, "merged", slow)
    store.compact(spark, t)
    assert {r["source_url"] for r in store.read_entries(spark, t).collect()} == set(U[:3])
    store.compact(spark, t)
    assert {r["source_url"] for r in store.read_entries(spark, t).collect()} == set(U[:3])
    assert len(os.listdir(f"{t}/data")) <= 4 and not apply(spark, t, "a", 0, U[0])


def test_writers_at_once(spark, tmp_path):
    t = str(tmp_path / "t")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: apply(spark, t, f"s{i % 3}", i // 3, U[i], every=3), range(6)))
    assert all(done) and {r["source_url"] for r in store.read_entries(spark, t).collect()} == set(U[:6])


def test_a_batch_reads_nothing_of_the_table(spark, tmp_path):
    t = str(tmp_path / "t")
    apply(spark, t, "a", 0, U[0])
    os.rename(f"{t}/data", f"{t}/hidden")
    apply(spark, t, "a", 1, U[1])
    for n in os.listdir(f"{t}/hidden"):
        os.rename(f"{t}/hidden/{n}", f"{t}/data/{n}")
    assert store.read_entries(spark, t).count() == 2


def test_streams_into_one_table(spark, tmp_path):
    """Two feeds as streams, the second one's checkpoint lost and begun anew."""
    t, u = str(tmp_path / "t"), [("oisd-big", "gull.com\ntern.org\n"), ("urlhaus-online", "https://a.plover.net/x.exe\n")]
    for name, text in u:
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.txt").write_text(text)
    run = lambda name, state: jobs.stream_ingest(spark, str(tmp_path / name), name, t, str(tmp_path / state), F.lit(1), {"availableNow": True}).awaitTermination(120)
    run("oisd-big", "c0")
    run("urlhaus-online", "c1")
    (tmp_path / "urlhaus-online" / "1.txt").write_text("https://b.plover.net\n")
    run("urlhaus-online", "c1")
    store.compact(spark, t)
    run("urlhaus-online", "c2")
    got = store.read_entries(spark, t)
    assert got.count() == 4 and got.groupBy("source").count().count() == 2


def test_check_needs_a_table(spark, tmp_path):
    checks = spark.createDataFrame([(1, "https://a.plover.net")], "url_id long, url string")
    checks.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in"))
    t = str(tmp_path / "t")
    with pytest.raises(Exception, match="stream_bootstrap"):
        jobs.stream_check(stream(), t, str(tmp_path / "o"), str(tmp_path / "s"), {"availableNow": True}).awaitTermination()
    jobs.stream_bootstrap(feeds.make_entries(lines(spark, "https://a.plover.net"), F.lit("r"), F.lit(1))[0], t)
    jobs.stream_check(stream(), t, str(tmp_path / "o"), str(tmp_path / "s2"), {"availableNow": True}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).first()["likely"]
    store.clear_all(spark, t, 5, "x", 0)
    jobs.stream_check(stream(), t, str(tmp_path / "o2"), str(tmp_path / "s3"), {"availableNow": True}).awaitTermination()
    assert not spark.read.parquet(str(tmp_path / "o2")).first()["likely"]
