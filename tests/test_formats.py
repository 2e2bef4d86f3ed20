"""Folders of documents as sources: real files, damaged ones, chosen ones."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import formats

XBRL = '<xbrl><context id="C"><period><startDate>2024-01-01</startDate><endDate>2024-03-31</endDate></period></context><Revenue contextRef="C" unitRef="U">5</Revenue></xbrl>'
FEED = "<rss><channel><item><title>a</title><link>u</link></item><item><title>b</title></item></channel></rss>"


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    for name, text in {"a.xml": XBRL, "deep/b%2Fc.xml": XBRL.replace("5", "6"), "broken.xml": "<xbrl><", "other.xml": "<y/>", "empty.xml": "", "_SUCCESS": "", ".hidden.xml": XBRL, "f.rss": FEED, "p.html": "<p>one</p><table><tr><td>2</td></tr></table>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.html").write_bytes(b"PK\0\1")
    return str(tmp_path)


def test_instances(spark, folder):
    for at in (folder, f"file://{folder}"):
        got = spark.read.format("xbrl").option("pathGlobFilter", "*.xml").load(at).collect()
        assert {(r.file, r.text) for r in got if r.kind == "fact"} == {(f"{at}/a.xml", "5"), (f"{at}/deep/b%2Fc.xml", "6")}
        assert {r.file.rsplit("/", 1)[1] for r in got if r.error} == {"broken.xml", "other.xml", "empty.xml"}


def test_feeds_and_exhibits(spark, folder):
    got = spark.read.format("feed").load(folder).collect()
    assert [(r.title, r.link) for r in got if r.file.endswith("f.rss")] == [("a", "u"), ("b", None)]
    assert {r.file.rsplit("/", 1)[1] for r in got if r.error} >= {"broken.xml", "bad.html"}
    pages = spark.read.format("exhibit").option("pathGlobFilter", "*.html").load(folder)
    assert [(r.table, r.text) for r in pages.where("error is null").orderBy("line").collect()][0] == (0, "one")
    assert [r.error for r in pages.where("error is not null").collect()] == ["ValueError: not text"]


def test_filters_choose_files(spark, folder):
    (formats_read := spark.read.format("xbrl").option("pathGlobFilter", "*.xml").load(folder)).createOrReplaceTempView("filed")
    one, none = f"{folder}/a.xml", formats_read.where(F.col("file") == "nowhere")
    assert {r.file for r in formats_read.where(F.col("file") == one).collect()} == {one} and none.isEmpty()
    assert {r.file for r in formats_read.where(F.col("file").startswith(f"{folder}/deep")).collect()} == {f"{folder}/deep/b%2Fc.xml"}
    assert {r.file for r in formats_read.where(F.col("file").isin(one, f"{folder}/deep/b%2Fc.xml") & (F.col("kind") == "fact")).collect()} == {one, f"{folder}/deep/b%2Fc.xml"}
    reader = formats.FolderReader(formats.Xbrl({"path": folder}), 12)
    assert list(reader.pushFilters([formats.EqualTo(("file",), one), formats.EqualTo(("kind",), "fact")])) == [formats.EqualTo(("kind",), "fact")]
    assert [p.paths for p in reader.partitions()] == [[one]]


def test_an_empty_folder_and_none(spark, tmp_path):
    formats.register(spark)
    assert spark.read.format("feed").load(str(tmp_path)).isEmpty()
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format("feed").load().collect()
