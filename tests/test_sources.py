"""Sources and sinks: round trips on small files."""

import bz2
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.functions.charset import ASCII_LETTERS
from glyphframe.sources import corpus, exchange


def test_shards_and_columns(spark, tmp_path):
    schema = "image struct<bytes: binary, path: string>, Text string"
    rows = [((bytearray(b"\x89PNG\r\n\x1a\nx"), "a.jpg"), "அ")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "data/val-00000"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / ".cache/test"))
    df = corpus.read_shards(spark, str(tmp_path))
    assert corpus.pick_columns(df.schema) == ("image", "Text") and [r.split for r in df.collect()] == ["val"]
    assert corpus.unpack_image(df, "image", "Text").select("hint", "label").first() == ("a.jpg", "அ")
    other = T.StructType([T.StructField("x", T.StringType()), T.StructField("b", T.BinaryType())])
    assert corpus.pick_columns(other) == ("b", "x") and corpus.pick_columns(other, "q", "r") == ("q", "r")
    splits = spark.createDataFrame([("a/Dev_set/x.parquet",), ("test/train-1.parquet",), ("none.parquet",)], "p string")
    assert [r[0] for r in splits.select(corpus.split_of(F.col("p"))).collect()] == ["val", "train", "train"]


def test_manifest_round_trip(spark, tmp_path):
    rows = [("train", "s1", k, bytearray(b"\xff\xd8\xff0") if k != 2 else None, None, f"ab{chr(97 + k)}") for k in range(5)]
    df = spark.createDataFrame(rows, "split string, shard string, row int, bytes binary, hint string, label string")
    made = corpus.manifest_rows(df, "src", ASCII_LETTERS)
    assert [r.image for r in made.orderBy("number").collect()] == [f"train/{k:06d}.jpg" for k in range(4)]
    corpus.write_manifest(made, str(tmp_path / "m"))
    files = list((tmp_path / "m/split=train").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines()]
    (tmp_path / "one.jsonl").write_text("\n".join([lines[0], "", *lines[1:]]) + "\n")
    got = corpus.read_manifest(spark, str(tmp_path / "one.jsonl"), {"source": "src"}, ASCII_LETTERS).orderBy("line").collect()
    assert [r.line for r in got] == [0, 2, 3, 4] and {r.label for r in got} == {"aba", "abb", "abd", "abe"}


def test_samples_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(2, "b", "bx"), (1, "a", "a")], "manifest_index long, ref string, hyp string")
    exchange.write_samples(s, str(tmp_path / "s"), kept=2, skipped=1)
    rows, meta = exchange.read_samples(spark, str(tmp_path / "s"))
    assert [(r.manifest_index, r.ref) for r in rows.orderBy("manifest_index").collect()] == [(1, "a"), (2, "b")]
    assert json.loads(meta.first().meta) == {"n_kept": 2, "n_scored": 2, "n_unreadable_skipped": 1}


def test_vocab_texts_and_wiki(spark, tmp_path):
    v = spark.createDataFrame([("அ", 2), ("b\"q", 9), ("c", 2)], "word string, freq long")
    value = corpus.vocab_json(v).first().value
    assert list(json.loads(value).items()) == [("b\"q", 9), ("c", 2), ("அ", 2)]
    corpus.write_vocab(v, str(tmp_path / "v"))
    assert {(r.word, r.freq) for r in corpus.read_vocab(spark, str(tmp_path / "v")).collect()} == {("அ", 2), ("b\"q", 9), ("c", 2)}
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/sub/a.txt").write_bytes("ab\xff\nc".encode("latin1"))
    (tmp_path / "t/skip.md").write_text("no")
    assert [r.value for r in corpus.read_text_dir(spark, str(tmp_path / "t")).collect()] == ["ab\nc"]
    xml = "<mediawiki><page><title>A</title><revision><text bytes='3'>one\ntwo &amp; x</text></revision></page>\n<page><revision><text>z</text></revision></page></mediawiki>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert sorted(r.value for r in corpus.read_wiki_pages(spark, str(tmp_path / "w.xml.bz2")).collect()) == ["one\ntwo & x", "z"]


BOX = {"id": "a", "x": 1, "y": 2, "w": 3, "h": 4, "line_index": 0, "column_index": 0}


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        ({"version": 1, "boxes": [BOX, BOX | {"id": "b"}]}, [None, None]), ({"version": 2, "boxes": [BOX]}, ["version"]), ({"version": 1, "boxes": [BOX, BOX]}, ["id not unique"] * 2),
        ({"version": 1, "boxes": [BOX | {"z": 1}]}, ["fields"]), ({"version": 1, "boxes": [BOX | {"x": 1.5}]}, ["not an integer"]), ({"version": 1, "boxes": [BOX | {"id": ""}]}, ["id"]),
    ],
)
def test_boxes_json(spark, tmp_path, doc, want):
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=1))
    rows = exchange.read_boxes_json(spark, str(tmp_path / "b.json")).orderBy("seq").collect()
    assert [r.violation for r in rows] == want
    if not any(want):
        again = spark.createDataFrame([(7, r.seq, *[r[f] for f in BOX]) for r in rows], "page_id int, seq int, id string, x int, y int, w int, h int, line_index int, column_index int")
        assert json.loads(exchange.boxes_json(again).first().value) == doc


def test_boxes_csv(spark, tmp_path):
    head = "id,x,y,w,h,line_index,column_index"
    (tmp_path / "b.csv").write_text(f"﻿{head}\n\na,1,2,3,4,0,0\nb,-1,2,3,4,0,1\n", encoding="utf-8")
    rows = exchange.read_boxes_csv(spark, str(tmp_path / "b.csv")).orderBy("seq").collect()
    assert [(r.id, r.x, r.column_index) for r in rows] == [("a", 1, 0), ("b", -1, 1)]
    (tmp_path / "h.csv").write_text("id,x\n")
    with pytest.raises(ValueError, match="header"):
        exchange.read_boxes_csv(spark, str(tmp_path / "h.csv"))
    (tmp_path / "n.csv").write_text(f"{head}\na,1.0,2,3,4,0,0\n")
    with pytest.raises(Exception, match="whole number"):
        exchange.read_boxes_csv(spark, str(tmp_path / "n.csv")).collect()


def test_files_of_many_splits(spark, tmp_path):
    """Lines keep their numbers whatever the splits, and writers keep their order over many tasks."""
    lines = [f'{{"image": "i{k}", "label": "{k}", "source": "s"}}' if k % 7 else "" for k in range(3000)]
    (tmp_path / "m.jsonl").write_bytes("\r\n".join(lines).encode() + b"\n\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = corpus.read_lines(spark, str(tmp_path / "m.jsonl"))
        assert rows.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path / "m.jsonl")).rdd.getNumPartitions() > 20
        assert {r.line: r.value for r in rows.collect()} == {k: v for k, v in enumerate(lines) if v}
        assert corpus.read_manifest(spark, str(tmp_path / "m.jsonl")).agg(F.max("line")).first()[0] == 2999

        s = spark.range(5000).repartition(9).selectExpr("id AS manifest_index", "concat('r', id) AS ref", "'h' AS hyp")
        exchange.write_samples(s, str(tmp_path / "s"), kept=5000)
        got, meta = exchange.read_samples(spark, str(tmp_path / "s"))
        assert meta.count() == 1 and sorted(r.ref for r in got.collect()) == sorted(f"r{k}" for k in range(5000))
        said = next((tmp_path / "s").glob("part-*")).read_text().splitlines()
        assert "_meta" in said[0] and [json.loads(x)["manifest_index"] for x in said[1:]] == list(range(5000))

        v = spark.range(4000).repartition(5).selectExpr('concat(\'w"\', id) AS word', "id % 50 AS freq")
        corpus.write_vocab(v, str(tmp_path / "v"))
        assert len(json.loads(next((tmp_path / "v").glob("part-*")).read_text())) == 4000
        assert sorted(map(tuple, corpus.read_vocab(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, v.collect()))

        b = spark.range(3000).repartition(6).selectExpr("id AS seq", "concat('b', id) AS id", *(f"cast(id AS int) AS {c}" for c in ("x", "y", "w", "h", "line_index", "column_index")))
        exchange.write_boxes_csv(b, str(tmp_path / "b"))
        again = exchange.read_boxes_csv(spark, str(tmp_path / "b"))
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, b.collect()))
        with pytest.raises(FileExistsError):
            exchange.write_boxes_csv(b, str(tmp_path / "b"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=cmd.png", 1), ("-1", 2), ("ok", 3)], "name string, n int")
    exchange.write_csv_safe(df, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_text(encoding="utf-8")
    assert text.splitlines() == ["﻿name,n", "'=cmd.png,1", "'-1,2", "ok,3"]
    items = spark.createDataFrame([(1, "a\tb", "x", None), (2, "c", None, "too small")], "seq int, name string, text string, error string")
    assert [r.value for r in exchange.batch_lines(items).collect()] == ["a b\tx", "c\t[not recognized: too small]"]
    assert [r.value for r in exchange.batch_lines(items.limit(1)).collect()] == ["x"]


def test_write_once_and_inventory(spark, tmp_path):
    df = spark.range(3)
    out = exchange.write_once(df, str(tmp_path), "run", "a" * 64, {"b": 1, "a": 2})
    assert out == exchange.run_folder(str(tmp_path), "run", "a" * 64, {"a": 2, "b": 1})
    with pytest.raises(Exception, match="(?i)exist"):
        exchange.write_once(df, str(tmp_path), "run", "a" * 64, {"a": 2, "b": 1})
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.txt").write_text("one\ntwo\n")
    (tmp_path / "f/y.png").write_bytes(b"png")
    inv = exchange.file_inventory(spark, str(tmp_path / "f"))
    assert sorted((r.bytes, r.lines) for r in inv.collect()) == [(3, 0), (8, 2)]
    assert [(r.files, r.bytes, r.png) for r in exchange.folder_counts(inv).collect()] == [(2, 11, 1)]
    listing = spark.createDataFrame(exchange.checksum_lines(inv).collect(), "value string")
    exchange.assert_checksums(listing, inv)
    with pytest.raises(ValueError, match="MISSING"):
        exchange.assert_checksums(listing, inv.where("bytes = 3"))
