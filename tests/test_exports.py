"""Exports of many groups: archives and folders hold the same files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from linkloom.sources import exports, writers
from tests.conftest import rows


def _folders(path):
    return {p.parent.name: sorted(p.read_text().splitlines()) for p in path.glob("file=*/*.json")}


def test_archives_unpack_to_the_folders(spark, tmp_path, monkeypatch):
    data = spark.createDataFrame([("g1", "u", True), ("g1", "v\n é", None), ("g2", "u", False), ("g2", "u", False), ("other", "u", True), (None, "u", True)], "group string, url string, fixed boolean")
    groups = spark.createDataFrame([("g1", "a b%=/é"), ("g2", None), ("none", "x")], "group string, file string")
    writers.bulk_export(data, groups, str(tmp_path / "plain"))
    writers.bulk_export(data.limit(1), groups, str(tmp_path / "in zips"), packed=True)
    writers.bulk_export(data, groups, str(tmp_path / "in zips"), packed=True)  # replaces the first
    want = [("g1", "u", True, "a b%=/é"), ("g1", "v\n é", None, "a b%=/é"), ("g2", "u", False, None), ("g2", "u", False, None)]
    schema = "group string, url string, fixed boolean"
    assert rows(exports.read_archives(spark, str(tmp_path / "in zips"), schema)) == want
    assert rows(spark.read.schema(schema + ", file string").json(str(tmp_path / "plain"))) == want
    for at in (tmp_path / "in zips").glob("*.zip"):
        with zipfile.ZipFile(at) as archive:
            archive.extractall(tmp_path / "out")
    assert _folders(tmp_path / "out") == _folders(tmp_path / "plain") and set(_folders(tmp_path / "plain")) == {"file=a b%25%3D%2Fé", "file=__HIVE_DEFAULT_PARTITION__"}
    writers.bulk_export(data.limit(0), groups, str(tmp_path / "none"), packed=True)
    assert (tmp_path / "none/_SUCCESS").exists() and not list((tmp_path / "none").glob("*.zip"))
    assert exports.read_archives(spark, str(tmp_path / "none"), schema).count() == 0


def test_many_groups_need_few_files(spark, tmp_path):
    data = spark.range(60_000).select(F.format_string("g%d", F.col("id") % 30_000).alias("group"), F.col("id").cast("string").alias("url"))
    writers.bulk_export(data, data.select("group", F.col("group").alias("file")).distinct(), str(tmp_path / "bulk"), packed=True)
    names = [n for p in (tmp_path / "bulk").glob("*.zip") for n in zipfile.ZipFile(p).namelist()]
    assert len(set(names)) == len(names) == 30_000 and len(list((tmp_path / "bulk").rglob("*"))) < 40
    got = exports.read_archives(spark, str(tmp_path / "bulk"), "url string")
    assert got.count() == 60_000 and got.where("file <> concat('g', cast(url AS long) % 30000)").count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_a_large_group_is_dealt_to_several_tasks(spark, tmp_path, packed):
    n = exports.LINES * 3 + 1
    data = spark.range(n).select(F.lit("g").alias("group"), F.repeat(F.lit("x"), 30).alias("pad"), F.col("id").alias("url"))
    folder = tmp_path / "bulk"
    writers.bulk_export(data, spark.createDataFrame([("g", "f")], "group string, file string"), str(folder), packed=packed)
    back = exports.read_archives(spark, str(folder), "url long") if packed else spark.read.schema("url long, file string").json(str(folder))
    assert back.agg(F.count("url"), F.count_distinct("url"), F.sum("url"), F.max("file")).first() == (n, n, n * (n - 1) // 2, "f")
    names = [i for p in folder.glob("*.zip") for i in zipfile.ZipFile(p).namelist()] if packed else [p.name for p in folder.glob("file=f/*.json")]
    assert len(names) >= 2


def test_a_member_is_bounded_in_bytes():
    import pyarrow as pa

    batch = pa.record_batch({"file": ["a"] * 5 + ["b"], "value": ["x" * (exports.BLOCK // 2)] * 5 + ["y"]})
    members = list(exports._members(iter([batch, batch.slice(5)]), "part-00000"))
    assert [(n, d.count(b"\n")) for n, d in members] == [("file=a/part-00000-00000.json", 3), ("file=a/part-00000-00001.json", 2), ("file=b/part-00000-00000.json", 2)]
