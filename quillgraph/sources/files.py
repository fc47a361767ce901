"""File sources: spreadsheets, texts in several encodings, graph snapshots and triple payloads; a spreadsheet sink.

Files are read by Spark (`binaryFile`), so any store that Spark reads will do; decoding runs next to the data.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")


def decoded(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else decoded(bytes(x)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files in UTF-8 with or without a mark, or GB18030."""
    return spark.read.format("binaryFile").load(path).select("path", decode_text("content").alias("text"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheet_cells(content: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, str, str]]:
    """(sheet, row, column letters, trimmed text) of every cell that has a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        targets = {}
        for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")):
            targets[link.get("Id")] = link.get("Target", "").lstrip("/")
        for entry in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
            if _local(entry.tag) != "sheet" or (sheet is not None and entry.get("name") != sheet):
                continue
            target = targets[next(v for k, v in entry.attrib.items() if _local(k) == "id")]
            path = target if target.startswith("xl/") else f"xl/{target}"
            for cell in ElementTree.fromstring(archive.read(path)).iter():
                if _local(cell.tag) != "c":
                    continue
                kind, found = cell.get("t"), {_local(x.tag): x for x in cell}
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                else:
                    text = (found["v"].text or "") if "v" in found else ""
                    text = shared[int(text)] if kind == "s" and text else text
                column, row = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.get("r", "A1")).groups()
                if text := text.replace("\r\n", "\n").strip():
                    yield entry.get("name"), int(row), column, text


def read_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, column, value) of .xlsx files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                cells = [(name, *cell) for cell in sheet_cells(bytes(content), sheet)]
                yield pd.DataFrame(cells, columns=["path", "sheet", "row", "column", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row int, column string, value string")


def read_records(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, record): a map from header (the first row) to value for each later row."""
    cells = read_cells(spark, path, sheet)
    heads = cells.where("row = 1").select("path", "sheet", "column", F.col("value").alias("header"))
    rows = cells.where("row > 1").join(heads, ["path", "sheet", "column"])
    return rows.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "value")))).alias("record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header row; a byte mark, blanks around names and values, and unnamed columns go."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    names = {c: c.lstrip("﻿").strip() for c in rows.columns}
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in names.items() if n and not re.fullmatch(r"_c\d+", n)])


SNAPSHOT = "nodes array<struct<id:string,name:string,type:string,description:string,aliases:array<string>>>, edges array<struct<source:string,target:string,type:string>>"
PAYLOAD = "entities array<struct<id:string,name:string,type:string>>, relations array<struct<id:string,name:string,subject_type:string,object_type:string>>, triples array<struct<id:string,subject_id:string,predicate_id:string,object_id:string>>"


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph in one JSON document."""
    whole = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    return whole.select(F.inline("nodes")), whole.select(F.inline("edges"))


def read_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, triples) of a JSON payload; a triple without id is named by its place."""
    whole = spark.read.schema(PAYLOAD).option("multiLine", True).json(path)
    triples = whole.select(F.posexplode("triples").alias("n", "t")).select(F.coalesce("t.id", F.concat(F.lit("triple:"), F.col("n").cast("string"))).alias("id"), "t.subject_id", "t.predicate_id", "t.object_id")
    return whole.select(F.inline("entities")), whole.select(F.inline("relations")), triples


def payload_faults(entities: DataFrame, relations: DataFrame, triples: DataFrame) -> DataFrame:
    """(kind, id): blank names, repeated ids and references to nothing."""
    faults = None
    for kind, rows in (("entity", entities), ("relation", relations)):
        blank = rows.where("coalesce(trim(id), '') = '' or coalesce(trim(name), '') = ''").select(F.lit(f"blank {kind}").alias("kind"), "id")
        again = rows.groupBy("id").count().where("count > 1").select(F.lit(f"repeated {kind}").alias("kind"), "id")
        faults = blank.unionByName(again) if faults is None else faults.unionByName(blank).unionByName(again)
    for column, rows in (("subject_id", entities), ("predicate_id", relations), ("object_id", entities)):
        lost = triples.join(rows.select(F.col("id").alias(column)), column, "left_anti")
        faults = faults.unionByName(lost.select(F.lit(f"unknown {column}").alias("kind"), "id"))
    return faults


def column_name(n: int) -> str:
    """Letters of the n-th column, from 1."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_xlsx(rows: list[list[object]], path: str, title: str = "Sheet1") -> None:
    """A report of a bounded number of rows as a spreadsheet, on the driver."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    body = []
    for r, row in enumerate(rows, 1):
        cells = "".join(f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for c, v in enumerate(row, 1))
        body.append(f'<row r="{r}">{cells}</row>')
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        out.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        out.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
