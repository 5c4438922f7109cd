"""Record operators, sources and generators on small fixtures."""

import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions.predicates import Term, chain
from tessera.operators import longitem, mutation, scans, sets, sorting
from tessera.sources import adjacency, generate
from tessera.sources.records import Index, Volume

TERMS = [Term("k_int", "<=", 5), Term("k_str", "!=", "key-7"), Term("k_short", "<", 3), Term("k_float", ">=", 6.0), Term("k_long", "!=", 6), Term("k_double", ">", 4.5)]


def test_boolean_terms(spark):
    df = generate.boolean_records(spark)
    assert [df.where(chain([t])).count() for t in TERMS] == [6, 9, 6, 5, 9, 7]
    assert [r["k_int"] for r in df.where(chain(TERMS)).collect()] == [5]
    assert df.where(chain(TERMS, "not")).count() == 9
    assert [df.where(chain([], c)).count() for c in ("and", "or", "not", "none")] == [10, 10, 0, 10]
    with pytest.raises(ValueError):
        chain([Term("k_int", "~", 1)])


def test_numbering_and_neighbours(spark):
    df = scans.numbered(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), "k")
    assert {(r["k"], r["rid"]) for r in df.collect()} == {(i, i) for i in range(100)}
    after = {r["rid"]: r["next_k"] for r in scans.fetch_next(df, ["k"]).collect()}
    assert after[5] == 6 and after[99] is None


def test_unique(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(sets.DuplicateKey):
        sets.require_unique(df, "k")
    assert sets.unique_insert(df.distinct(), spark.createDataFrame([(2,), (3,), (3,)], "k int"), "k").count() == 3


def test_mutation(spark):
    df = spark.createDataFrame([(1, 29), (2, 30), (3, None)], "id int, age int")
    assert {tuple(r) for r in mutation.update(df, F.col("id") > 1, {"age": F.col("age") + 1}).collect()} == {(1, 29), (2, 31), (3, None)}
    assert {r["id"] for r in mutation.delete(df, F.col("age") >= 30).collect()} == {1, 3}


def test_long_items(spark):
    t = F.lit("abcdefgh")
    made = [longitem.read(t, 2, 3), longitem.insert_before(t, 2, F.lit("XY")), longitem.insert_after(t, 2, F.lit("XY")), longitem.overwrite(t, 6, F.lit("XYZ")), longitem.delete(t, 2, 3), longitem.length_to_nul(F.lit("ab\0c"))]
    assert list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(made))).first()) == ["cde", "abXYcdefgh", "abcXYdefgh", "abcdefXY", "abfgh", 2]


def test_adjacency_file(spark, tmp_path):
    lists = {0: [1, 2], 1: [2], 2: [3], 3: [], 4: [5], 5: [], 6: []}
    (tmp_path / "g.bin").write_bytes(b"".join(struct.pack(f"<{2 + len(v)}i", k, len(v), *v) for k, v in lists.items()))
    (tmp_path / "a.bin").write_bytes(struct.pack("<3i", 7, 8, 9))
    stream = adjacency.read_adjacency(spark, str(tmp_path / "g.bin"))
    assert {tuple(r) for r in adjacency.arcs(stream).collect()} == {(k, x) for k, v in lists.items() for x in v}
    assert adjacency.dense_vertices(stream).count() == 7
    assert [r["value"] for r in adjacency.read_attribute(spark, str(tmp_path / "a.bin")).orderBy("id").collect()] == [7, 8, 9]


def test_fixed_width(spark, tmp_path):
    (tmp_path / "s").write_text("  1" + "jacobs,t".ljust(20) + "m 29 5 3.6\n")
    assert tuple(adjacency.read_fixed(spark, str(tmp_path / "s"), adjacency.STUDENT).first())[:5] == (1, "jacobs,t", "m", 29, 5)


def test_sorted_copies(spark, tmp_path):
    df = spark.range(50).select((49 - F.col("id")).alias("k"))
    assert [r["k"] for r in sorting.sort_into(df, str(tmp_path / "s"), "k").collect()] == list(range(50))
    assert sorting.clustered(df, str(tmp_path / "c"), "k", 3).count() == 50


def test_wisconsin(spark):
    rows = generate.wisconsin(spark, 1000)
    assert rows.count() == 1000 and rows.select("unique1").distinct().count() == 1000
    parts, links = generate.part_graph(spark, 200)
    assert parts.count() == 200 and links.count() == 600 and links.where("dst < 1 OR dst > 200").count() == 0


def test_volume(spark):
    v = Volume(spark, "tessera_test").create()
    try:
        v.indices["f"] = [Index("k", unique=True)]
        v.create_file("f", spark.range(3).select(F.col("id").alias("k")))
        with pytest.raises(sets.DuplicateKey):
            v.append("f", spark.range(1).select(F.col("id").alias("k")))
        v.append("f", spark.range(3, 5).select(F.col("id").alias("k")))
        v.replace("f", v.open_file("f").where("k > 1"))
        assert v.open_file("f").count() == 3 and v.files() == ["f"]
    finally:
        v.destroy()


def test_attribute_files(spark, tmp_path):
    big = 2**53 + 1
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.bin").write_bytes(struct.pack("<3q", 5, big, -1))
    found = adjacency.read_attribute(spark, str(tmp_path / "a"), "<i8")
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(0, 5), (1, big), (2, -1)]
    (tmp_path / "a" / "two.bin").write_bytes(struct.pack("<q", 6))
    with pytest.raises(ValueError):
        adjacency.read_attribute(spark, str(tmp_path / "a"), "<i8")
    again = adjacency.write_attribute(found.where("id < 2"), str(tmp_path / "w"))
    again = adjacency.write_attribute(spark.range(4).select("id", (F.col("id") * 2).alias("value")), str(tmp_path / "w"))
    assert [tuple(r) for r in again.orderBy("id").collect()] == [(0, 0), (1, 2), (2, 4), (3, 6)]
    for n in (1, 2):
        adjacency.write_results(spark.createDataFrame([(f"{n} iteration visited 3 nodes",)], "line string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_neighbours_over_borders_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(scans, "STRETCH", 4)
    df = scans.numbered(spark.range(11).withColumnRenamed("id", "k"), "k")
    for step in (1, 3, 6):
        after = {r["rid"]: r["next_k"] for r in scans.fetch_next(df, ["k"], step).collect()}
        before = {r["rid"]: r["previous_k"] for r in scans.fetch_previous(df, ["k"], step).collect()}
        assert after == {i: i + step if i + step < 11 else None for i in range(11)}
        assert before == {i: i - step if i >= step else None for i in range(11)}
    assert scans.numbered(df.drop("rid").where("false"), "k").count() == 0


def test_cursors(spark):
    assert [scans.set_cursor(5, 20, 3, w) for w in (0, 1, 2)] == [3, 8, 16] and scans.set_cursor(5, 20, 0, 2) == 20
    with pytest.raises(ValueError):
        scans.set_cursor(0, 0, 0, 3)
    df = spark.range(5).select("id", F.lit("abcdef").alias("item"))
    assert [r["id"] for r in scans.cursor(scans.index_scan(df, "id", 1, 3))] == [1, 2, 3]
    assert scans.long_scan(df, "item", 4, 9).first()["part"] == "ef"


def test_records_by_rid(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 3)], "rid long, s string, n int")
    out = mutation.write_by_rid(df, spark.createDataFrame([(1, None), (9, "z")], "rid long, s string"))
    assert {tuple(r) for r in out.collect()} == {(0, "a", 1), (1, None, 2), (2, "c", 3)}
    assert {r["s"] for r in mutation.expand_by_rid(df, "s", spark.createDataFrame([(2, "!!")], "rid long, piece string")).collect()} == {"a", "b", "c!!"}
    assert mutation.delete_by_rid(df, df.where("n > 1")).count() == 1


def test_bytes(spark):
    item = F.lit(bytes([1, 255, 16, 0, 7]))
    made = [longitem.bytes_to_nul(item).cast("int"), longitem.bytes_to_nul(longitem.empty()).cast("int"), longitem.delete(item, 1, 2), longitem.insert_before(item, 1, F.lit(b"\xfe")), longitem.read(item, 3, 9)]
    assert list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(made))).first()) == [3, 0, bytearray([1, 0, 7]), bytearray([1, 254, 255, 16, 0, 7]), bytearray([0, 7])]


def test_indices_and_protection(spark):
    v = Volume(spark, "tessera_test_index").create()
    try:
        v.create_file("f", spark.range(100).select((F.col("id") % 10).alias("k"), "id"))
        with pytest.raises(sets.DuplicateKey):
            v.create_index("f", Index("k", unique=True))
        v.create_index("f", Index("k", buckets=4))
        v.append("f", spark.createDataFrame([(7, 1000)], "id long, k long"))
        assert {r["id"] for r in scans.hash_scan(v.open_file("f"), "k", 1000).collect()} == {7}
        buckets = lambda: {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED tessera_test_index.f").collect()}.get("Num Buckets")
        assert buckets() == "4"
        assert "Exchange" not in v.open_file("f").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ValueError):
            v.create_index("f", Index("id", buckets=2))
        v.drop_index("f", "k")
        assert v.open_file("f").count() == 101 and buckets() is None
        v.create_index("f", Index("id", clustered=True))
        v.protect("f", False)
        with pytest.raises(PermissionError):
            v.append("f", v.open_file("f"))
        v.protect("f", True)
        assert v.append("f", v.open_file("f").limit(1)).count() == 102
    finally:
        v.destroy()


def test_generator_bound(spark):
    with pytest.raises(ValueError):
        generate.permutation(spark, 100_000_001)


def test_shared_folder(spark):
    from types import SimpleNamespace

    from tessera.plans import lineage

    unset = SimpleNamespace(get=lambda *a: None)
    made = lambda master, conf=unset: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId="x"), conf=unset)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            lineage.shared_dir(made(master))
        assert lineage.shared_dir(made(master, SimpleNamespace(get=lambda *a: "s3a://b/c/"))) == "s3a://b/c"
    assert lineage.shared_dir(made("local[8]")) == lineage.shared_dir(made("local[8]")) != ""


def test_entry_without_the_llm_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    for gone in ("tessera.llm", "public_tokenizers", "xxhash_or_any_other", "corpus_pipeline"):
        code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; n = len(e.queries()); print(n, len(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
        assert out.returncode == 0 and int(out.stdout.split()[0]) > 60, out.stderr
