"""Scans (S1-S13)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lupaspark.functions import columns as C


def read_delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ";", encoding: str = "latin1") -> DataFrame:
    """Delimited text with a header. encoding: latin1, utf-8, utf-8-sig, utf-16, or sniff (which finds the separator too).

    UTF-16 is read as one piece a file; such files are to be written as Parquet once.
    """
    if encoding == "sniff":
        encoding, sep = sniff(spark, path)
    names = {"latin1": "ISO-8859-1", "utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16"}
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", names[encoding]).option("quote", '"').option("escape", '"')
    if encoding == "utf-16":
        reader = reader.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of the first file by path. The listing reads no contents; the file is opened where it lies, and no more than its head is read."""
    row = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).first()
    if row is None:
        return b""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(row[0])
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str, head: int = 65536) -> tuple[str, str]:
    """Encoding and separator by the first file's first bytes."""
    data = first_bytes(spark, path, head)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16", ";"
    try:
        data[: max(0, len(data) - 4)].decode("utf-8")
        encoding = "utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8"
    except UnicodeDecodeError:
        encoding = "latin1"
    first = data.split(b"\n", 1)[0]
    return encoding, ";" if first.count(b";") >= first.count(b",") else ","


def _plain(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", s.lower().translate(str.maketrans(C.ACCENTED, C.PLAIN))).strip()


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], prefix: bool = False) -> DataFrame:
    """Columns under canonical names, found by any of their normalised aliases, or by its beginning. A column that is absent is an error."""
    have = {_plain(c): c for c in reversed(df.columns)}
    out = []
    for name, aliases in wanted.items():
        keys = [_plain(a) for a in aliases]
        found = next((have[k] for k in keys if k in have), None)
        if found is None and prefix:
            found = next((c for k in keys for h, c in have.items() if h.startswith(k)), None)
        if found is None:
            raise ValueError(f"no column for {name}: none of {aliases} in {df.columns}")
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def read_parts(spark: SparkSession, glob: str, exclude: str, **options) -> DataFrame:
    """The parts of a source but those whose path has the pattern (a national duplicate)."""
    df = spark.read.options(header=True, sep=";", encoding="ISO-8859-1", **options).csv(glob)
    return df.where(~F.input_file_name().rlike(exclude))


def read_months(df: DataFrame, col: str, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the months YYYYMM in range, which prunes partitions, and the months without any."""
    rows = df.where(F.col(col).between(first, last))
    day = lambda m: F.to_date(F.lit(m + "01"), "yyyyMMdd")
    wanted = df.sparkSession.range(1).select(F.explode(F.sequence(day(first), day(last), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyyMM").alias("month"))
    return rows, wanted.join(rows.select(F.col(col).cast("string").alias("month")).distinct(), "month", "left_anti")


def latest_partition(df: DataFrame, col: str, newest, max_back) -> DataFrame:
    """Rows of the newest period in [newest - max_back, newest]."""
    near = df.where(F.col(col).between(newest - max_back, newest))
    top = near.agg(F.max(col)).first()[0]
    return near.where(F.col(col) == F.lit(top))


def from_api_json(df: DataFrame, col: str, schema: str, array: str) -> DataFrame:
    """A row for each element of an API document's array; documents without any keep one row of nulls."""
    return df.select(F.explode_outer(F.from_json(col, schema)[array]).alias("item")).select("item.*")


def as_array(c: Column, element: str) -> Column:
    """A JSON value that is a list or a single element, as an array; null is empty."""
    many = F.from_json(c, f"array<{element}>")
    return F.when(c.isNull(), F.from_json(F.lit("[]"), f"array<{element}>")).when(F.startswith(F.trim(c), F.lit("[")), many).otherwise(F.array(F.from_json(F.concat(F.lit('{"x":'), c, F.lit("}")), f"x {element}")["x"]))


def header_rows(df: DataFrame, header: str, order: str, value: str) -> DataFrame:
    """Rows after the first whose value matches the header pattern; a sheet comes as a table (order, value, ...)."""
    at = df.where(F.col(value).rlike(header)).agg(F.min(order).alias("_h"))
    return df.join(F.broadcast(at)).where(F.col(order) > F.col("_h")).drop("_h")  # one row


def read_rules(spark: SparkSession, rows: list[dict], schema: str, key: str) -> DataFrame:
    """A curated table from its entries; a key that occurs twice is an error."""
    seen = [r[key] for r in rows]
    if twice := sorted({k for k in seen if seen.count(k) > 1}):
        raise ValueError(f"{key} occurs twice: {twice}")
    return spark.createDataFrame([{**r} for r in rows], schema)
