import json

import pytest
from pairloom.sources import io
from pairloom.streaming import increments


def test_text_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("barcode,px,py\na,1,2\nb,3,4\n")
    got = io.coordinates(spark, str(tmp_path / "c.csv"), ["px", "py"], "barcode").collect()
    assert [(r.cell, r.x, r.y) for r in got] == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    (tmp_path / "n.tsv").write_text("a\t1\t2\n")
    assert io.coordinates(spark, str(tmp_path / "n.tsv"), [1, 2]).count() == 1
    with pytest.raises(ValueError):
        io.coordinates(spark, str(tmp_path / "n.tsv"), [1])
    (tmp_path / "p.txt").write_text("Ligand\tReceptor\nL1\tR1_R2\n\nshort\nL2 \t R2\n")
    assert {tuple(r) for r in io.pairs(spark, str(tmp_path / "p.txt")).collect()} == {("L1", "R1_R2"), ("L2", "R2")}
    (tmp_path / "g.gmt").write_text("R1\tnote\tT1\tT2\nR2\tnote\tT1\n")
    assert io.programs(spark, str(tmp_path / "g.gmt")).count() == 3
    (tmp_path / "w.tsv").write_text("receptor\ttarget\tweight\nR1\tT1\t-0.5\nR1\tT2\n")
    assert {r.target: r.weight for r in io.programs(spark, str(tmp_path / "w.tsv")).collect()} == {"T1": -0.5, "T2": 1.0}
    (tmp_path / "l.tsv").write_text("cell\tlabel\na\tx\nb\tNA\nc\tunassigned\n")
    assert {r.cell: r.label for r in io.labels(spark, str(tmp_path / "l.tsv")).collect()} == {"a": "x", "b": None, "c": None}
    (tmp_path / "d.tsv").write_text("a\tx\na\ty\n")
    with pytest.raises(ValueError):
        io.labels(spark, str(tmp_path / "d.tsv"))
    square = {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]]}
    (tmp_path / "r.json").write_text(json.dumps({"features": [{"properties": {"name": "in"}, "geometry": square}]}))
    assert len(io.regions(spark, str(tmp_path / "r.json"))["in"][0]) == 5


def test_stacking_and_coverage(spark, tmp_path):
    for name, rows in (("one", [("a", "f", 1), ("a", "g", 2)]), ("two", [("a", "f", 3)])):
        spark.createDataFrame(rows, "cell string, feature string, count int").write.parquet(str(tmp_path / f"{name}.parquet"))
    both = io.counts(spark, [str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet")])
    assert {r.cell for r in both.collect()} == {"a@one", "a@two"}
    assert {r.feature for r in io.shared_features(both).collect()} == {"f"}
    cells = both.select("cell", "source").distinct()
    assert {r.feature: r.mass for r in io.measured_mass(cells, io.coverage(both)).collect()} == {"f": 2, "g": 1}
    with pytest.raises(ValueError):
        io.counts(spark, [str(tmp_path / "one.parquet")] * 2)
    assert io.batches(spark, None, cells).filter("batch = 'one'").count() == 1


def test_wide_tables(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    spark.createDataFrame([("a", 0.25, 0.75, 1)], "cell string, C0 double, C1 double, cluster int").write.parquet(path)
    assert {(r.community, r.share) for r in io.memberships(spark, path).collect()} == {(0, 0.25), (1, 0.75)}
    assert io.labelled_matrix(spark, path, "cell").count() == 3
    assert io.keyed_columns(spark, path, "cell", ["C1"]).columns == ["cell", "C1"]


def test_staging_and_manifest(spark, tmp_path):
    for k in (1, 2):
        st = io.Staging(spark, str(tmp_path / "run"))
        st.write(spark.range(k), "cells")
        path = st.commit()
    m = io.Manifest.open(spark, str(tmp_path / "run"))
    assert spark.read.parquet(m.resolve(path, "cells")).count() == 2
    assert not [p for p in (tmp_path / "run").iterdir() if p.name.startswith(".staging") or p.name.endswith(".old")]


def test_manifest_updates_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "manifest.json")
    io.Manifest("fit", settings={"k": 3}).write(spark, path)

    def add(i):
        io.Manifest.update(spark, path, lambda m: m.outputs.update({f"t{i}": f"t{i}.parquet"}))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(8)))
    m = io.Manifest.open(spark, path)
    assert m.outputs == {f"t{i}": f"t{i}.parquet" for i in range(8)} and m.settings == {"k": 3} and m.command == "fit"
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"manifest.json"}
    with io.locked(spark, path), pytest.raises(TimeoutError), io.locked(spark, path, wait=0.1):
        pass


def test_contacts_and_batches_of_both_ends(spark, tmp_path):
    full, bare = str(tmp_path / "full.parquet"), str(tmp_path / "bare.parquet")
    rows = [("a", "b", 2, 0, "s1", "s1"), ("b", "c", -1, 1, "s1", "s2"), ("c", "d", 5, 0, "s2", "s2")]
    spark.createDataFrame(rows, "left_cell string, right_cell string, community int, edge_kind int, left_batch string, right_batch string").write.parquet(full)
    got = {r.left_cell: (r.community, r.spatial, r.batch, r.right_batch) for r in io.contacts(spark, full).collect()}
    assert got == {"a": (2, True, "s1", "s1"), "b": (0, False, None, "s2"), "c": (5, True, "s2", "s2")}
    assert {r.community for r in io.contacts(spark, full, community=False).collect()} == {0}
    spark.createDataFrame([r[:3] for r in rows] + [("d", "e", 1)], "left_cell string, right_cell string, community long").write.parquet(bare)
    edges = io.contacts(spark, bare)
    assert all(r.spatial and r.batch is None for r in edges.collect())
    pairs = spark.read.parquet(full)
    named = {r.left_cell: (r.left_batch, r.batch) for r in io.with_batches(edges, pairs.unionByName(pairs)).collect()}
    assert named == {"a": ("s1", "s1"), "b": ("s1", None), "c": ("s2", "s2"), "d": (None, None)}
    assert io.with_batches(edges, pairs.drop("left_batch")).columns == edges.columns
    with pytest.raises(ValueError):
        io.with_batches(edges, spark.createDataFrame([("a", "b", "all", "s1")], "left_cell string, right_cell string, left_batch string, right_batch string"))
    with pytest.raises(ValueError):
        io.with_batches(edges, pairs.unionByName(pairs.withColumn("left_batch", pairs["right_batch"])))


def test_increments(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "totals")
    for k in range(3):
        spark.createDataFrame([("f", float(k)), ("g", 1.0)], "feature string, count double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("feature string, count double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream.writeStream.foreachBatch(increments.merge_totals(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.feature: r.total for r in increments.totals(spark, out).collect()} == {"f": 3.0, "g": 3.0}
    increments.merge_totals(out)(spark.createDataFrame([("f", 9.0)], "feature string, count double"), 0)
    assert {r.feature: r.total for r in increments.totals(spark, out).collect()}["f"] == 3.0
