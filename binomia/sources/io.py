"""Tables from and to files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.sources.spreadsheet import read_sheet, write_sheets

FORMATS = "parquet, csv, tsv (also .gz), sqlite, xlsx, geojson"


def read_table(spark: SparkSession, path: str, table: str | None = None, sheet: str | int | None = None, start_row: int = 1) -> DataFrame:
    """A table by the file's ending. SQLite needs ``table``; a spreadsheet's sheet is its first one unless named (see :func:`binomia.operators.add_data.read_data` to find it)."""
    low = path.lower().removesuffix("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True)
    if low.endswith((".tsv", ".tsv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t", quote="")
    if low.endswith((".sqlite", ".db", ".sqlite3")):
        if not table:
            raise ValueError("a SQLite file needs the name of a table")
        return read_sqlite(spark, path, table)
    if low.endswith(".xlsx"):
        return read_sheet(spark, path, sheet, start_row)
    if low.endswith((".geojson", ".json", ".geojsonl", ".geojsonseq")):
        return read_polygons(spark, path)
    raise ValueError(f"cannot read {path!r}; formats: {FORMATS}")


#: Rows of a SQLite table that one task reads.
SQLITE_ROWS = 200_000


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a SQLite file that every executor can open, read by ranges of row ids.

    Types follow the declared affinity; values that don't fit it are null. Views and tables
    without row ids are read by one task, row by row.
    """
    quoted = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(path) as con:
        if not con.execute("select 1 from sqlite_master where name = ?", (table,)).fetchone():
            raise ValueError(f"no table {table!r}")
        cols = [(c[1], (c[2] or "").upper()) for c in con.execute(f"pragma table_info({quoted})")]
        try:
            low, high = con.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
        except sqlite3.OperationalError:
            low, high = None, None
    kinds = [("long", pa.int64()) if "INT" in t else ("binary", pa.binary()) if "BLOB" in t else ("double", pa.float64()) if any(x in t for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else ("string", pa.string()) for _, t in cols]
    cast = {"long": int, "double": float, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}

    def value(v: object, kind: str):
        try:
            return None if v is None else cast[kind](v)
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                with sqlite3.connect(path) as con:
                    where = "" if low is None else f" where rowid >= {lo} and rowid < {lo + SQLITE_ROWS}"
                    rows = con.execute(f"select * from {quoted}{where}")
                    while part := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([value(r[k], kind) for r in part], t) for k, (kind, t) in enumerate(kinds)], [c for c, _ in cols])

    parts = 1 if low is None else -(-(high - low + 1) // SQLITE_ROWS)
    starts = spark.range(0 if low is None else low, 1 if low is None else high + 1, SQLITE_ROWS if low is not None else 1, parts)
    return starts.mapInArrow(run, ", ".join(f"`{c}` {k}" for (c, _), (k, _) in zip(cols, kinds, strict=True)))


def export(df: DataFrame, path: str) -> None:
    """Write by the file's ending, Parquet without one; an existing path is an error. Spreadsheets become a folder of them."""
    low, out = path.lower(), df.write.mode("errorifexists")
    if low.endswith(".csv"):
        out.csv(path, header=True)
    elif low.endswith(".tsv"):
        out.csv(path, header=True, sep="\t", quote="\u0000", escapeQuotes=False)
    elif low.endswith(".xlsx"):
        write_sheets(df, path)
    else:
        out.parquet(path)


def read_polygons(spark: SparkSession, path: str, code: str = "LEVEL3_COD") -> DataFrame:
    """``feature_idx, code, polys`` of a GeoJSON file of polygons; multi-polygons keep their parts.

    ``polys`` is an array of polygons, each an array of rings of [lon, lat]. A collection is
    one JSON value and so one row of one task; large sets of features come one a line
    (``.geojsonl``), are split like text and numbered by place in the file.
    """
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    if path.lower().rstrip("/").endswith(("l", "seq")):
        raw = spark.read.text(path).filter(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
        f = raw.select(F.col("n").alias("feature_idx"), F.from_json(F.regexp_replace("value", "^\x1e", ""), feature).alias("f"))
    else:
        raw = spark.read.text(path, wholetext=True)
        f = raw.select(F.from_json("value", f"struct<features:array<{feature}>>").alias("j")).select(F.posexplode("j.features").alias("feature_idx", "f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    polys = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).otherwise(many)
    return f.select("feature_idx", F.try_element_at("f.properties", F.lit(code)).alias("code"), polys.alias("polys"))
