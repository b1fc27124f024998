"""Large JSON arrays, read and written by many tasks.

A file that holds one array, or one object with arrays in its fields, has no line that a split could begin at.
Spark's text source splits at any delimiter, so ``}`` is one here: a split then begins after a brace,
never within an escape. Whether that brace stood in a string, how deep and under which key, is not known there.
So a first pass lands the text in chunks of some ``CHUNK_BYTES``, each with what it does to that state under both
assumptions (begun outside or inside a string): quotes, change of depth, last key at each depth. These facts
are small; running sums over them in file order give the state every chunk begins with. A second pass cuts each
chunk into elements, and the ends of chunks, where an element goes on, are put together by a small shuffle.

No row holds more than a chunk, or one element if that is longer. Files are independent; compressed ones can't be split
but are still read in chunks. Elements that aren't objects are left out. Text after the array's end is not read.
"""

from __future__ import annotations

import json
import os
import shutil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import materialise, shared_dir, ship_package

CHUNK_BYTES = 4 << 20
_QUOTE, _BACKSLASH, _COLON = 34, 92, 58
_STEP = np.zeros(256, np.int8)
_STEP[[123, 91]] = 1
_STEP[[125, 93]] = -1
_MARK = _STEP != 0
_MARK[_COLON] = True
_SPACE = b" \t\r\n"

_STATE = "delta bigint, keys map<bigint,string>"
_CHUNK = f"file string, split bigint, no bigint, opener string, quotes bigint, outside struct<{_STATE}>, inside struct<{_STATE}>, text binary"
_EFFECT = pa.struct([("delta", pa.int64()), ("keys", pa.map_(pa.int64(), pa.string()))])
_CHUNK_TYPES = {
    "file": pa.string(), "split": pa.int64(), "no": pa.int64(), "opener": pa.string(), "quotes": pa.int64(),
    "outside": _EFFECT, "inside": _EFFECT, "text": pa.binary(),
}


# --- one chunk ---------------------------------------------------------------------------------


class _Marks:
    """Unescaped quotes of a text, and the braces, brackets and colons before each of which their number is even or odd."""

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(raw == _QUOTE)
        if b"\\" in data and len(quotes):
            at = np.arange(len(raw))
            plain = np.maximum.accumulate(np.where(raw != _BACKSLASH, at, -1))  # last byte that is no backslash
            before = np.maximum(quotes - 1, 0)
            run = np.where(quotes > 0, before - plain[before], 0)
            quotes = quotes[run % 2 == 0]
        self.quotes = quotes
        at = np.flatnonzero(_MARK[raw])
        odd = np.searchsorted(quotes, at) % 2 == 1
        self.places = (at[~odd], at[odd])
        self.raw = raw

    def structure(self, in_string: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of marks outside strings, their bytes, and the depth before each, from 0 at the beginning."""
        at = self.places[in_string]
        kinds = self.raw[at]
        after = np.cumsum(_STEP[kinds], dtype=np.int64)
        return at, kinds, after - _STEP[kinds]

    def key_before(self, colon: int) -> str | None:
        """The key that a colon follows, if an array follows the colon."""
        rest = self.data[colon + 1 : colon + 200].lstrip(_SPACE)
        n = int(np.searchsorted(self.quotes, colon))
        if not rest.startswith(b"[") or n < 2:
            return None
        return self.data[self.quotes[n - 2] + 1 : self.quotes[n - 1]].decode("utf-8", "replace")


def _effect(marks: _Marks, in_string: bool) -> dict:
    """What a chunk does to the state, if it begins inside or outside a string."""
    at, kinds, before = marks.structure(in_string)
    delta = int(_STEP[kinds].sum())
    colons = np.flatnonzero((kinds == _COLON) & (before <= 1))
    depths, last = np.unique(before[colons][::-1], return_index=True)
    places = at[colons][::-1][last]
    # "" stands for a key whose value is no array: it ends the array of the key before
    return {"delta": delta, "keys": [(int(d), marks.key_before(int(p)) or "") for d, p in zip(depths, places)]}


def _chunks(batches, chunk_bytes: int):
    """Records (text up to a brace) of a task as chunks with their effects."""

    def chunk(place, no, records):
        data = b"".join(records)
        marks = _Marks(data)
        opener = data.lstrip(b"\xef\xbb\xbf" + _SPACE)[:1].decode("latin-1")
        row = [place[0], place[1], no, opener, len(marks.quotes), _effect(marks, False), _effect(marks, True), data]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNK_TYPES.values())], names=list(_CHUNK_TYPES))

    place, no, records, size = None, 0, [], 0
    for batch in batches:
        values = batch.column("value").cast(pa.binary())
        files, starts = batch.column("file"), batch.column("split").to_numpy()
        names = files.dictionary_encode().indices.to_numpy()
        changes = np.flatnonzero((np.diff(starts) != 0) | (np.diff(names) != 0)) + 1
        bounds = [0, *changes.tolist(), len(starts)] if len(starts) else []
        for low, high in zip(bounds, bounds[1:]):
            here = (files[low].as_py(), int(starts[low]))
            if here != place:
                if records:
                    yield chunk(place, no, records)
                place, no, records, size = here, 0, [], 0
            for value in values.slice(low, high - low).to_pylist():
                records += (value, b"}")  # one too many at a file's end closes nothing
                size += len(value) + 1
                if size >= chunk_bytes:
                    yield chunk(place, no, records)
                    no, records, size = no + 1, [], 0
    if records:
        yield chunk(place, no, records)


def cut(data: bytes, in_string: bool, depth: int, key: str | None, opener: str, field: str | None) -> list[tuple[str, bytes]]:
    """(kind, text) of the elements in a chunk that begins in the given state.

    ``whole`` elements, the ``end`` of one that began earlier, ``middle`` for a chunk within one, and the ``start``
    of one that goes on.
    """
    level = 2 if field is not None else 1 if opener == "[" else 0
    if (opener == "{") != (field is not None or level == 0):
        return []
    marks = _Marks(data)
    at, kinds, before = marks.structure(in_string)
    before = before + depth
    wanted = np.ones(len(at), bool)
    if field is not None:
        colons = np.flatnonzero((kinds == _COLON) & (before == 1))
        match = np.array([key == field, *(marks.key_before(int(at[c])) == field for c in colons)])
        wanted = match[np.searchsorted(colons, np.arange(len(at)))]
    begins = at[wanted & (kinds == 123) & (before == level)]
    ends = at[wanted & (kinds == 125) & (before == level + 1)] + 1
    found = []
    open_at_start = depth > level and (field is None or key == field)
    if open_at_start:
        if not len(ends):
            return [("middle", data)]
        found.append(("end", data[: ends[0]]))
        ends = ends[1:]
    found += [("whole", data[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]
    if len(begins) > len(ends):
        found.append(("start", data[begins[-1] :]))
    return found


# --- files ---------------------------------------------------------------------------------------


def land_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The files' texts in chunks, with the state each one begins with."""
    ship_package(spark)
    records = spark.read.option("lineSep", "}").text(path)
    records = records.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    landed = materialise(records.mapInArrow(lambda batches: _chunks(batches, chunk_bytes), _CHUNK))

    # only the effects go through the windows: some tens of bytes for a chunk
    effects = landed.drop("text")
    earlier = Window.partitionBy("file").orderBy("split", "no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("split", "no")
    before = effects.withColumn("in_string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    effect = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    before = before.withColumn("effect", effect).withColumn("depth", F.coalesce(F.sum("effect.delta").over(earlier), F.lit(0)))
    before = before.withColumn("left", F.try_element_at("effect.keys", 1 - F.col("depth")))  # the last key at depth 1
    states = before.select(
        "file", "split", "no", "in_string", "depth",
        F.last("left", ignorenulls=True).over(earlier).alias("key"),
        F.first(F.nullif(F.col("opener"), F.lit("")), ignorenulls=True).over(upto).alias("opener"),
        (F.row_number().over(upto) - 1).cast("long").alias("chunk"),
    )
    return landed.select("file", "split", "no", "text").join(materialise(states), ["file", "split", "no"])


def elements(chunks: DataFrame, field: str | None = None) -> DataFrame:
    """(file, position, json): the objects of each file's array, or of the array in a top-level ``field``, from 0.

    A file that is one object and no array is one element.
    """

    def task(batches):
        columns = ("file", "chunk", "in_string", "depth", "key", "opener")
        for batch in batches:
            facts = [batch.column(c).to_pylist() for c in columns]
            for text, file, chunk, *state in zip(batch.column("text").to_pylist(), *facts):
                found = cut(text, *state, field)
                kinds = [k for k, _ in found]
                goes_on = bool(kinds) and kinds[0] in ("end", "middle")  # what began earlier is no item of this chunk
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(found), pa.string()),
                        pa.array([chunk] * len(found), pa.int64()),
                        pa.array(range(-goes_on, len(found) - goes_on), pa.int32()),
                        pa.array(kinds, pa.string()),
                        pa.array([t for _, t in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["file", "chunk", "item", "kind", "json"],
                )

    ship_package(chunks.sparkSession)
    pieces = materialise(chunks.mapInArrow(task, "file string, chunk bigint, item int, kind string, json string"))
    whole = pieces.where(F.col("kind") == "whole").select("file", "chunk", "item", "json")
    # at most one end or middle, and one start, for a chunk
    ends = pieces.where(F.col("kind") != "whole")
    order = Window.partitionBy("file").orderBy("chunk", "item")
    begun = ends.select("file", "chunk", "item", F.count_if(F.col("kind") == "start").over(order).alias("number"))
    joined = (
        ends.join(begun, ["file", "chunk", "item"])
        .groupBy("file", "number")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "item", "kind", "json"))).alias("p"))
        .where((F.element_at("p", 1)["kind"] == "start") & (F.element_at("p", -1)["kind"] == "end"))
        .select("file", F.element_at("p", 1)["chunk"].alias("chunk"), F.element_at("p", 1)["item"].alias("item"),
                F.array_join(F.transform("p", lambda x: x["json"]), "").alias("json"))
    )
    counts = pieces.groupBy("file", "chunk").agg(F.count_if(F.col("item") >= 0).alias("n"))
    upto = Window.partitionBy("file").orderBy("chunk")
    before = materialise(counts.select("file", "chunk", (F.sum("n").over(upto) - F.col("n")).alias("before")))  # a row a chunk
    found = whole.unionByName(joined).join(before, ["file", "chunk"])
    return found.select("file", (F.col("before") + F.col("item")).alias("position"), "json")


def read_json_array(
    spark: SparkSession, path: str, schema: StructType | str | None = None, mode: str = "PERMISSIVE", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """The objects of the files' arrays as rows. Without a schema it is found by reading the landed elements once more."""
    found = elements(land_chunks(spark, path, chunk_bytes))
    if schema is not None:
        return found.select(F.from_json("json", schema, {"mode": mode}).alias("x")).select("x.*")
    # one object a line: line ends inside of strings are escaped, those between tokens are white space
    lines = f"{shared_dir(spark)}/lines"
    found.select(F.translate("json", "\r\n", "  ")).write.text(lines)
    return spark.read.option("mode", mode).json(lines)


def _framed(batches, names: list[str] | None):
    """Texts in order of their field's number as the lines of one document: an object of arrays, or one array without names."""

    def opening(n: int) -> str:
        return "[" if names is None else ("{" if n == 0 else ",") + json.dumps(names[n]) + ":["

    last = 0 if names is None else len(names) - 1
    now, before = 0, opening(0)
    for batch in batches:
        fields, values = batch.column("_field").to_numpy(), batch.column("value")
        bounds = [0, *(np.flatnonzero(np.diff(fields)) + 1).tolist(), len(fields)] if len(fields) else []
        for low, high in zip(bounds, bounds[1:]):
            while now < fields[low]:
                now += 1
                before = before.removesuffix(",") + "]" + opening(now)
            firsts = pa.array([before] + [","] * (high - low - 1), pa.string())
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(firsts, values.slice(low, high - low), "")], names=["value"])
            before = ","
    end = before.removesuffix(",") + "]" + "".join(opening(n) + "]" for n in range(now + 1, last + 1)) + ("" if names is None else "}")
    yield pa.RecordBatch.from_arrays([pa.array([end])], names=["value"])


def _text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def _write(tables: list[DataFrame], names: list[str] | None, path: str, order: list[Column | str]) -> None:
    spark = tables[0].sparkSession
    ship_package(spark)
    made = shared_dir(spark)
    folder = _local_path(spark, made)
    if folder is None:
        _write_by_one(tables, names, path, order, made)
        return
    for n, df in enumerate(tables):
        keys = [F.struct(*order).alias("_order")] if order else []
        rows = df.select(*keys, F.concat(F.lit(","), _text(df)).alias("value"))
        if order:
            rows = rows.repartitionByRange("_order").sortWithinPartitions("_order")
        rows.select("value").write.text(f"{made}/{n}")
    parts = [_parts(f"{folder}/{n}") for n in range(len(tables))]
    _assemble(spark, parts, names, f"{folder}/array")
    for n in range(len(tables)):
        shutil.rmtree(f"{folder}/{n}", ignore_errors=True)  # their text is in the file now
    _name(spark, f"{made}/array", path)


def _local_path(spark: SparkSession, path: str) -> str | None:
    """A path as the operating system knows it, if it lies in a file system that can be written at any place."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _parts(folder: str) -> list[tuple[str, int]]:
    """The part files that hold anything, in the order of their tasks, with their sizes."""
    files = [x for x in os.scandir(folder) if x.name.startswith("part-") and x.stat().st_size > 0]
    return [(x.path, x.stat().st_size) for x in sorted(files, key=lambda x: int(x.name.split("-")[1]))]


def _assemble(spark: SparkSession, parts: list[list[tuple[str, int]]], names: list[str] | None, path: str) -> None:
    """Put sorted parts, in which each line begins with a comma, into one file: their sizes tell each its place."""
    frame, copies, at = [], [], 0
    for n, files in enumerate(parts):
        opening = "[" if names is None else ("{" if n == 0 else "],") + json.dumps(names[n]) + ":["
        frame.append((at, opening.encode()))
        at += len(opening.encode())
        for i, (file, size) in enumerate(files):
            skipped = int(i == 0)  # the comma before the first element
            copies.append((file, skipped, at))
            at += size - skipped
    frame.append((at, b"]\n" if names is None else b"]}\n"))
    with open(path, "wb") as out:
        for place, text in frame:
            out.seek(place)
            out.write(text)
    if not copies:
        return

    def copy(batches):
        for batch in batches:
            for file, skipped, place in zip(*(batch.column(c).to_pylist() for c in ("file", "skipped", "at"))):
                with open(file, "rb") as source, open(path, "r+b") as target:
                    source.seek(skipped)
                    target.seek(place)
                    shutil.copyfileobj(source, target, 4 << 20)
                    done = target.tell() - place
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    tasks = min(len(copies), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(copies, "file string, skipped long, at long").repartition(tasks)
    done = rows.mapInArrow(copy, "done long").agg(F.sum("done")).first()[0]
    if done != sum(size for files in parts for _, size in files) - sum(map(bool, parts)):
        raise OSError(f"cannot write {path}")


def _write_by_one(tables: list[DataFrame], names: list[str] | None, path: str, order: list[Column | str], scratch: str) -> None:
    """For file systems that only append: one task streams the sorted texts."""
    spark = tables[0].sparkSession
    texts = None
    for n, df in enumerate(tables):
        keys = F.struct(*order) if order else F.lit(None).cast("string")
        part = df.select(F.lit(n).alias("_field"), keys.alias("_order"), _text(df).alias("value"))
        texts = part if texts is None else texts.unionByName(part)
    sorting = ["_field", "_order"] if order else ["_field"]
    held = texts.repartition(1).sortWithinPartitions(*sorting).select("_field", "value")
    made = f"{scratch}/array"
    held.mapInArrow(lambda batches: _framed(batches, names), "value string").write.text(made)
    (nothing,) = _framed([], names)
    _name_single_part(spark, made, path, nothing.column("value")[0].as_py())


def write_json_array(df: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """Write rows as one file that holds one JSON array.

    Rows become text in parallel, sorted by ``order`` into ranges; many tasks then copy the ranges to their places in the
    file, and the driver only adds what makes them an array and names the result. Where the shared folder is no file system
    that can be written at any place, a single task streams the sorted texts. An empty table is an empty array.
    """
    _write([df], None, path, order or [])


def write_json_fields(tables: dict[str, DataFrame], path: str, order: list[Column | str] | None = None) -> None:
    """Write tables as one file that holds one JSON object with an array for each, as annotation files do.

    ``order`` names what all of them are sorted by.
    """
    _write(list(tables.values()), list(tables), path, order or [])


def _name_single_part(spark: SparkSession, folder: str, path: str, empty: str) -> None:
    """Move the one part file of a folder to ``path``; without rows no task may have run, then ``empty`` is written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    files, home = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = [s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    home.mkdirs(target.getParent())
    home.delete(target, False)
    if not parts:
        out = home.create(target)
        out.write(bytearray(empty.encode()))
        out.close()
        return
    (part,) = parts
    _name(spark, part.toString(), path)


def _name(spark: SparkSession, made: str, path: str) -> None:
    """Move a file to ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    files, home = part.getFileSystem(conf), target.getFileSystem(conf)
    home.mkdirs(target.getParent())
    home.delete(target, False)
    same = files.getUri().equals(home.getUri())
    moved = files.rename(part, target) if same else jvm.org.apache.hadoop.fs.FileUtil.copy(files, part, home, target, True, conf)
    if not moved:
        raise OSError(f"cannot name {path}")
