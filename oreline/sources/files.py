"""Landed files to all-text staging frames.

Staging is faithful: every column is text, every row has the ordinal it has in
its file, and headers are judged against a declaration before a row is read.
Archives and office files are read in the tasks, a member at a time, from
``binaryFile`` rows; nothing is unpacked to local disk.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreline.storage import written

ORDINAL = "source_row_ordinal"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def check_header(declared: list[str], actual: list[str], policy: str = "contains") -> None:
    """Refuse a drifted header: missing columns, or with ``declared`` also new ones."""
    missing, extra = sorted(set(declared) - set(actual)), sorted(set(actual) - set(declared))
    if missing or (policy == "declared" and extra):
        raise ValueError(f"header differs: missing {missing}, new {extra}")


def read_csv(spark: SparkSession, path: str, columns: list[str], *, sep: str = ",", policy: str = "declared") -> DataFrame:
    """CSV with a header as text columns; the header is read first and judged."""
    actual = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns
    check_header(columns, actual, policy)
    return spark.read.option("header", True).option("sep", sep).schema(text_schema(actual)).option("enforceSchema", False).csv(path).select(*columns)


def read_positional(spark: SparkSession, path: str, names: list[str], width: int, proof: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Headerless quoted records by pinned position; what fails the proof is set apart.

    ``proof`` maps positions to patterns that a record must match before any of
    its columns is believed.
    """
    raw = spark.read.text(path)
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    parsed = raw.select("value", cells.alias("c"))
    ok = F.size("c") == width
    for at, pattern in proof.items():
        ok = ok & F.coalesce(F.try_element_at("c", F.lit(at + 1)).rlike(pattern), F.lit(False))
    kept = parsed.where(ok).select(*[F.element_at("c", i + 1).alias(n) for i, n in enumerate(names)])
    return kept, parsed.where(~ok).select("value", F.lit("layout_mismatch").alias("reason_code"))


def read_geojson_lines(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """One FeatureCollection a line: text properties, geometry as JSON, walk ordinal."""
    raw = spark.read.text(path).select(F.from_json("value", "features array<struct<properties:map<string,string>,geometry:string>>").alias("v"))
    rows = raw.select(F.posexplode("v.features").alias(ORDINAL, "f"))
    return rows.select(ORDINAL, *[F.try_element_at("f.properties", F.lit(p)).alias(p) for p in properties], F.col("f.geometry").alias("geometry"))


def reconcile_pages(pages: DataFrame, page: str, declared: str, key: str) -> DataFrame:
    """Faults of a paged walk: short, duplicated or missing rows against the declared total."""
    sums = pages.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys"), F.max(declared).alias("declared"), F.count_distinct(page).alias("pages"))
    fault = F.when(F.col("n") != F.col("distinct_keys"), "duplicate_rows").when(F.col("distinct_keys") < F.col("declared"), "short").when(F.col("distinct_keys") > F.col("declared"), "more_than_declared")
    return sums.withColumn("fault", fault)


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, columns: list[str], charset: str = "UTF-16") -> tuple[DataFrame, DataFrame]:
    """Row-set XML as text columns; records of a broken tail are set apart.

    Records are parsed once and staged, since both branches read them.
    """
    schema = T.StructType([*text_schema(columns).fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", row_tag).option("charset", charset).option("mode", "PERMISSIVE").option("ignoreNamespace", True).schema(schema).load(path)
    rows = written(rows, "xml-rows")
    bad = F.col("_corrupt_record").isNotNull()
    return rows.where(~bad).select(*columns), rows.where(bad).select("_corrupt_record", F.lit("malformed").alias("reason_code"))


def _per_file(spark: SparkSession, path: str, parse, schema: T.StructType) -> DataFrame:
    """Rows of binary files, parsed one file at a time in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for chunk in parse(name, bytes(content)):
                    yield pd.DataFrame(chunk, columns=schema.names).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _chunks(rows: Iterator[tuple], size: int = 20_000) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str], *, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A CSV member of each archive, streamed; headers are judged per archive."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField(ORDINAL, T.LongType()), *text_schema(columns).fields])

    def parse(name: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for inner in sorted(n for n in z.namelist() if re.fullmatch(member, n)):
                with io.TextIOWrapper(z.open(inner), encoding=encoding, newline="") as f:
                    reader = csv.DictReader(f, delimiter=sep)
                    check_header(columns, list(reader.fieldnames or []))
                    yield from _chunks((name, i, *(r[c] for c in columns)) for i, r in enumerate(reader))

    return _per_file(spark, path, parse, schema)


def zip_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Members of archives with sizes and SHA-256 of their bytes."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType())])

    def parse(name: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                digest = hashlib.sha256()
                with z.open(info) as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                yield [(name, info.filename, info.file_size, digest.hexdigest())]

    return _per_file(spark, path, parse, schema)


def _sheet_rows(content: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        book = ET.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(rel)] for s in book.find("m:sheets", ns)}
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        for row in ET.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{{{ns['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", ns):
                letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [None] * (at - len(cells))
                value = c.find("m:v", ns)
                inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                text = shared[int(value.text)] if c.get("t") == "s" else (inline or None) if value is None else value.text
                cells[at - 1] = text
            yield cells


def read_workbook(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """Worksheet rows of each workbook as text, under the header row's names."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField(ORDINAL, T.LongType()), *text_schema(columns).fields])

    def parse(name: str, content: bytes):
        rows = _sheet_rows(content, sheet)
        header = [h or "" for h in next(rows, [])]
        check_header(columns, header)
        at = [header.index(c) for c in columns]
        yield from _chunks((name, i, *(r[j] if j < len(r) else None for j in at)) for i, r in enumerate(rows))

    return _per_file(spark, path, parse, schema)


def _dbf_rows(data: bytes) -> tuple[list[str], Iterator[list[str]]]:
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32

    def rows():
        for i in range(count):
            cell, out = head + i * size + 1, []
            for _, width in fields:
                out.append(data[cell : cell + width].decode("utf-8", "replace").strip())
                cell += width
            yield out

    return [f for f, _ in fields], rows()


def _shapes(data: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """Parts of points, lines and polygons in file order; an empty list for null shapes."""
    at = 100
    while at + 8 <= len(data):
        length = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + length]
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (1, 11, 21):
            yield [[struct.unpack("<2d", body[4:20])]]
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            points = list(zip(flat[::2], flat[1::2]))
            yield [points[a:b] for a, b in zip(starts, starts[1:])]
        else:
            yield []
        at += 8 + length


# Names of coordinate systems in projection files and their codes.
_SYSTEMS = {"GCS_WGS_1984": 4326, "GCS_North_American_1983": 4269, "GCS_North_American_1927": 4267, "WGS_1984_Web_Mercator_Auxiliary_Sphere": 3857}


def epsg_of(projection: str) -> int:
    name = re.match(r'\s*(?:GEOGCS|PROJCS)\["([^"]+)"', projection)
    if not name or name[1] not in _SYSTEMS:
        raise ValueError("coordinate system is not one that is known")
    return _SYSTEMS[name[1]]


def read_zipped_shapes(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Shapes of zipped layers: text attributes, parts of points, coordinate system."""
    parts = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField(ORDINAL, T.LongType()), T.StructField("epsg", T.IntegerType()), *text_schema(columns).fields, T.StructField("parts", parts)])

    def parse(name: str, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for shp in sorted(n for n in z.namelist() if n.lower().endswith(".shp")):
                stem = shp[:-4]
                epsg = epsg_of(z.read(stem + ".prj").decode())
                names, rows = _dbf_rows(z.read(stem + ".dbf"))
                check_header(columns, names)
                at = [names.index(c) for c in columns]
                shapes = ([[{"x": x, "y": y} for x, y in part] for part in s] for s in _shapes(z.read(shp)))
                yield from _chunks((name, i, epsg, *(r[j] for j in at), s) for i, (r, s) in enumerate(zip(rows, shapes)))

    return _per_file(spark, path, parse, schema)


def landed(spark: SparkSession, path: str, source_id: str, vintage: Column) -> DataFrame:
    """Manifest rows of landed files: content address by SHA-256, nothing copied."""
    files = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    return files.select(
        F.concat(F.lit("mf_"), F.substring(F.sha2(F.concat_ws("|", F.lit(source_id), "path", sha), 256), 1, 24)).alias("manifest_id"),
        F.lit(source_id).alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("source_key"), sha.alias("sha256"), F.col("length").alias("n_bytes"), vintage.alias("fetch_vintage"),
    )
