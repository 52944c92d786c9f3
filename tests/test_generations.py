"""The store of generations: two writers, interrupted writers, foreign and damaged files, sealed snapshots."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.operators.graph import shared_dir
from factloom.sources import generations as G


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def numbers(spark, n):
    return {"numbers": spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 2).alias("twice")), "one": spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")}


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_")) and not f.endswith(".parquet"))


def test_digest_of_a_table(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    same = df.repartition(7).select("x", "id")
    assert G.table_digest(df) == G.table_digest(same)
    assert G.table_digest(df)[0] != G.table_digest(df.unionAll(df.limit(1)))[0]
    assert G.table_digest(df)[0] != G.table_digest(df.withColumn("x", F.col("x").cast("int")))[0]
    assert len({G.table_digest(spark.createDataFrame(rows, "a int, b int"))[0] for rows in ([], [(1, None)], [(None, 1)], [(1, 1)])}) == 4


def test_append_and_open(spark, root):
    assert G.latest(spark, root) is None
    with pytest.raises(G.SnapshotError):
        G.open_snapshot(spark, root)
    first = G.publish(spark, root, numbers(spark, 10), expected=None)
    again = G.publish(spark, root, numbers(spark, 10))
    second = G.publish(spark, root, numbers(spark, 20), expected=first["digest"])
    assert again == first and (first["sequence"], second["sequence"], second["predecessor"]) == (1, 2, first["digest"])
    assert files(root) == ["generations/0000000001.json", "generations/0000000002.json"]
    assert len(os.listdir(f"{root}/objects")) == 3  # the table that stayed the same is there once
    old, new = G.open_snapshot(spark, root, 1, ["one", "numbers"]), G.open_snapshot(spark, root)
    assert (old.tables["numbers"].count(), new.tables["numbers"].count()) == (10, 20)
    assert [tuple(r) for r in old.tables["one"].orderBy("k").collect()] == [("a", None), ("b", 2)]
    with pytest.raises(G.SnapshotError, match="other tables"):
        G.open_snapshot(spark, root, 2, ["numbers"])
    with pytest.raises(G.PublicationConflict):
        G.publish(spark, root, numbers(spark, 30), expected=first["digest"])


def test_one_of_two_writers_wins(spark, root):
    first = G.publish(spark, root, numbers(spark, 3), expected=None)

    def other(step):
        if step == "staged":
            G.publish(spark, root, numbers(spark, 5), expected=first["digest"])

    with pytest.raises(G.PublicationConflict):
        G.publish(spark, root, numbers(spark, 4), expected=first["digest"], failpoint=other)
    assert G.latest(spark, root)["sequence"] == 2
    assert G.open_snapshot(spark, root).tables["numbers"].count() == 5
    assert files(root) == ["generations/0000000001.json", "generations/0000000002.json"]


@pytest.mark.parametrize("step,result,rows", [("staged", None, 3), ("intended", "complete", 4), ("named", "complete", 4), ("created", "complete", 4)])
def test_killed_writers_are_recovered(spark, root, step, result, rows):
    G.publish(spark, root, numbers(spark, 3), expected=None)

    def die(at):
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        G.publish(spark, root, numbers(spark, 4), failpoint=die)
    found = G.recover(spark, root)
    assert [r["result"] for r in found] == ([result] if result else [])
    assert G.open_snapshot(spark, root).tables["numbers"].count() == rows
    assert [r["result"] for r in G.recover(spark, root, abandoned=True)] == ([] if result else ["discarded"])
    assert G.publish(spark, root, numbers(spark, 6))["sequence"] == (3 if result else 2)
    assert all(not f.startswith(("intents", "staging")) for f in files(root))


def test_lost_staging_and_taken_places(spark, root):
    first = G.publish(spark, root, numbers(spark, 3), expected=None)
    body = G._bound({"version": G.VERSION, "sequence": 2, "predecessor": first["digest"], "tables": {"numbers": {"digest": "sha256:" + "0" * 64, "rows": 1, "schema": spark.range(1).schema.jsonValue()}}})
    os.makedirs(f"{root}/intents", exist_ok=True)
    with open(f"{root}/intents/lost.json", "w") as f:
        f.write(G._canonical(body))
    assert G.recover(spark, root) == [{"run": "lost", "result": "discarded"}]
    rival = G._bound({"version": G.VERSION, "sequence": 2, "predecessor": first["digest"], "tables": {"numbers": first["tables"]["numbers"]}})
    G.publish(spark, root, numbers(spark, 9))
    with open(f"{root}/intents/late.json", "w") as f:
        f.write(G._canonical(rival))
    assert G.recover(spark, root) == [{"run": "late", "result": "superseded"}]


def test_foreign_intents_stop_writers(spark, root):
    G.publish(spark, root, numbers(spark, 3), expected=None)
    for text in ("no json", "[]", "{}", json.dumps({"version": G.VERSION, "sequence": 2, "tables": {}, "digest": "x"})):
        os.makedirs(f"{root}/intents", exist_ok=True)
        with open(f"{root}/intents/foreign.json", "w") as f:
            f.write(text)
        for name in os.listdir(f"{root}/intents"):
            if name.endswith(".crc"):
                os.remove(f"{root}/intents/{name}")
        assert G.recover(spark, root) == [{"run": "foreign", "result": "investigate"}]
        with pytest.raises(G.PublicationConflict):
            G.publish(spark, root, numbers(spark, 4))
    assert G.latest(spark, root)["sequence"] == 1


def rewrite(path, text):
    with open(path, "w") as f:
        f.write(text)
    crc = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_damage_is_seen(spark, root):
    first = G.publish(spark, root, numbers(spark, 3), expected=None)
    G.publish(spark, root, numbers(spark, 4))
    marker = f"{root}/generations/0000000001.json"
    told = open(marker).read()
    rewrite(marker, told.replace('"rows":3', '"rows":4'))
    with pytest.raises(G.SnapshotError, match="digest"):
        G.open_snapshot(spark, root)
    rewrite(marker, G._canonical(G._bound({**json.loads(told), "tables": {}})))
    with pytest.raises(G.SnapshotError, match="lineage"):
        G.open_snapshot(spark, root)
    rewrite(marker, told)
    place = f"{root}/{G._object('numbers', first['tables']['numbers'])}"
    spark.range(3).select("id", F.lit(1).cast("long").alias("twice")).write.mode("append").parquet(place)
    with pytest.raises(G.SnapshotError, match="numbers"):
        G.open_snapshot(spark, root, 1)
    assert G.open_snapshot(spark, root, 1, verify=False).tables["numbers"].count() == 6
    os.remove(f"{place}/_SUCCESS")
    with pytest.raises(G.SnapshotError, match="whole"):
        G.open_snapshot(spark, root, 1, verify=False)


def test_versions_advance(spark):
    then = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 2, "a"), (4, 1, "a")], "k int, version int, x string")
    now = spark.createDataFrame([(1, 2, "b"), (2, 1, "a"), (3, 2, "b"), (4, 1, "a"), (5, 1, "z")], "k int, version int, x string")
    assert {r["k"]: r["problem"] for r in G.not_advancing(then, now, "k", "version").collect()} == {2: "version_goes_back", 3: "version_stays"}
