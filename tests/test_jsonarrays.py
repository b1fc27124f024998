"""Large JSON arrays: chunk by chunk and through Spark, against plain parsing of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import annotations, jsonarrays, tasks

STRINGS = ["s", "}", '{"', "\\", '\\"', "[}]", 'é"', "a:[", "\\\\", '"images": [{']


def value(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.35:
        return {rng.choice(["a", "images", 'k"}', "x\\", "{["]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 3 and kind < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, None, True, 2.5, *STRINGS])


def document(rng, field):
    objects = [{f"f{i}": value(rng, 1) for i in range(rng.randrange(3))} for _ in range(rng.randrange(7))]
    if field is None:
        return objects, objects
    return {"info": value(rng), "other": [{"images": [{"z": 1}]}], field: objects, "tail": {"images": [{"q": 2}]}}, objects


def through_chunks(text, chunks, field):
    """What the passes do, in plain Python."""
    in_string, depth, key, begun, found = False, 0, None, None, []
    for data in chunks:
        for kind, piece in jsonarrays.cut(data, in_string, depth, key, text.lstrip()[:1].decode(), field):
            if kind == "whole":
                found.append(piece)
            elif kind == "start":
                begun = piece
            else:
                begun += piece
                if kind == "end":
                    found.append(begun)
        marks = jsonarrays._Marks(data)
        effect = jsonarrays._effect(marks, in_string)
        left = dict(effect["keys"]).get(1 - depth)
        key = key if left is None else left
        depth += effect["delta"]
        in_string ^= len(marks.quotes) % 2 == 1
    return found


@pytest.mark.parametrize("field", [None, "images", "annotations"])
def test_any_chunks_give_all_objects(field):
    rng = random.Random(str(field))
    for _ in range(600):
        whole, objects = document(rng, field)
        text = json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
        records = text.split(b"}")
        chunks, now = [], b""
        for record in records if records[-1] else records[:-1]:
            now += record + b"}"
            if rng.random() < 0.4:
                chunks, now = [*chunks, now], b""
        assert [json.loads(x) for x in through_chunks(text, [*chunks, now] if now else chunks, field)] == objects


@pytest.mark.parametrize("chunk_bytes", [1, 60, 1 << 20])
def test_elements_of_files(spark, tmp_path, chunk_bytes):
    """Several files with several splits each; objects longer than a chunk and than a split."""
    rng = random.Random(chunk_bytes)
    want = []
    for n in range(4):
        whole, objects = document(rng, "images")
        objects += [{"long": "}" * rng.randrange(3000)}, {"nested": [{"a": [{"b": i}]} for i in range(40)]}] * 2
        (tmp_path / f"f {n}.json").write_text(json.dumps(whole, indent=n % 2))
        want += [(f"f%20{n}.json", i, json.dumps(o)) for i, o in enumerate(objects)]
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = jsonarrays.elements(jsonarrays.land_chunks(spark, str(tmp_path / "*.json"), chunk_bytes), "images").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file.rsplit("/", 1)[1], r.position, json.dumps(json.loads(r.json))) for r in got) == sorted(want)


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    """One file of 200 MB, against the reader that takes a file whole."""
    path = str(tmp_path / "large.json")
    rows = spark.range(1_200_000).selectExpr(
        "id", "concat('im \\\\ \"}{', id, '\\n.jpg') AS image", "struct(id % 7 AS a, array(id, 2) AS b) AS nested", "IF(id % 3 = 0, NULL, repeat('q]} ', 30)) AS question"
    )
    jsonarrays.write_json_array(rows, path, ["id"])
    size = (tmp_path / "large.json").stat().st_size
    assert size > 180_000_000
    schema = "id bigint, image string, nested struct<a:bigint,b:array<bigint>>, question string"
    chunks = jsonarrays.land_chunks(spark, path)
    assert chunks.select("split").distinct().count() >= 8 and chunks.selectExpr("max(length(text))").first()[0] < 5 << 20
    got = tasks.read_rows(spark, path, "json", schema)
    sums = "count(*)", "sum(xxhash64(to_json(struct(*)))::decimal(38,0))", "count(DISTINCT id)"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    assert got.selectExpr(*sums).first() == whole.selectExpr(*sums).first() == rows.select(*got.columns).selectExpr(*sums).first()


def test_read_rows_finds_the_schema(spark, tmp_path):
    whole = [{"image": "a\n", "question": "q", "extra": {"x": [1, 2]}}, {"image": "b", "label": None, "n": 2.5}, {}]
    for indent in (None, 2):
        (tmp_path / "t.json").write_text(json.dumps(whole, indent=indent))
        got = tasks.read_rows(spark, str(tmp_path / "t.json"))
        want = spark.read.option("multiLine", True).json(str(tmp_path / "t.json"))
        assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    (tmp_path / "one.json").write_text('{"a": {"b": 1}}')
    assert tasks.read_rows(spark, str(tmp_path / "one.json"), schema="a struct<b:int>").collect() == [((1,),)]


def test_array_sink(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "IF(id % 2 = 0, NULL, concat('\"]', id)) AS t").repartition(9)
    path = tmp_path / "sub" / "a.json"
    for _ in range(2):  # writing again replaces the file
        jsonarrays.write_json_array(rows, str(path), ["id"])
    assert json.loads(path.read_text()) == [{"id": i, "t": None if i % 2 == 0 else f'"]{i}'} for i in range(5000)]
    tasks.write_rows(rows.limit(3), str(tmp_path / "b.json"), "array")
    assert len(json.loads((tmp_path / "b.json").read_text())) == 3
    tasks.write_rows(rows.where("id < 0"), str(tmp_path / "c.json"), "array")
    assert json.loads((tmp_path / "c.json").read_text()) == []
    assert tasks.read_rows(spark, str(tmp_path / "c.json"), schema="id int").collect() == []


def test_field_sink(spark, tmp_path):
    tables = {"a": spark.range(3), "none": spark.range(0), "b": spark.range(2500).withColumn("t", F.lit('"')), "last": spark.range(0)}
    path = tmp_path / "f.json"
    jsonarrays.write_json_fields(tables, str(path), ["id"])
    assert json.loads(path.read_text()) == {
        "a": [{"id": i} for i in range(3)], "none": [], "b": [{"id": i, "t": '"'} for i in range(2500)], "last": [],
    }
    jsonarrays.write_json_fields({"x": spark.range(0), "y": spark.range(0)}, str(path))
    assert json.loads(path.read_text()) == {"x": [], "y": []}


def test_annotations_over_many_chunks(spark, tmp_path):
    whole = {
        "info": {"images": [{"id": 99}]}, "images": [{"id": i, "file_name": f"{i}}}.jpg"} for i in range(300)],
        "annotations": [{"id": i, "image_id": i % 300, "category_id": i % 5, "bbox": [i, 1, 2, 3.5], "area": i / 2, "segmentation": [[1] * 9]} for i in range(2000)],
        "categories": [{"id": i, "name": "c"} for i in range(5)],
    }
    (tmp_path / "i.json").write_text(json.dumps(whole))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        tables = annotations.read_instances(spark, str(tmp_path / "i.json"))
        assert [(r.image_id, r.file_name, r.ord) for r in tables["images"].orderBy("ord").collect()] == [(i, f"{i}}}.jpg", i) for i in range(300)]
        boxes = tables["instances"].orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.image_id, r.category_id, r.bbox, r.area, r.ord) for r in boxes] == [(i % 300, i % 5, [i, 1, 2, 3.5], i / 2, i) for i in range(2000)]
    assert tables["categories"].count() == 5


def test_one_file_has_many_writers(spark, tmp_path, monkeypatch):
    put = []
    whole = jsonarrays._assemble
    monkeypatch.setattr(jsonarrays, "_assemble", lambda spark, parts, names, path: put.append([len(p) for p in parts]) or whole(spark, parts, names, path))
    tables = {"a": spark.range(60_000).selectExpr("id", "repeat(sha2(string(id), 256), 3) AS t"), "none": spark.range(0), "b": spark.range(7)}
    path = tmp_path / "f.json"
    jsonarrays.write_json_fields({k: t.orderBy(F.desc("id")) for k, t in tables.items()}, str(path), ["id"])
    assert put[0][0] > 1 and put[0][1:] == [0, 1]
    held = json.loads(path.read_text())
    assert {k: [x["id"] for x in v] for k, v in held.items()} == {"a": list(range(60_000)), "none": [], "b": list(range(7))}
    monkeypatch.setattr(jsonarrays, "_local_path", lambda *_: None)  # a file system that only appends
    jsonarrays.write_json_fields(tables, str(tmp_path / "g.json"), ["id"])
    assert json.loads((tmp_path / "g.json").read_text()) == held


def test_annotations_are_not_brought_to_one_task(spark, tmp_path):
    path = tmp_path / "i.json"
    path.write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [], "categories": []}))
    images = annotations.read_instances(spark, str(path))["images"]
    assert "SinglePartition" not in images._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in images.select("image_id", "ord").collect()] == [(1, 0)]
