"""Delimited text with `#` metadata lines, and its writer."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import DataError
from ..functions.schema import inferred_types, repaired_header, typed


@dataclass
class CsvTable:
    df: DataFrame
    meta: dict[str, object] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)


def parsed_meta(lines: list[str], delimiter: str = ",") -> dict[str, object]:
    """`#KEY=value` gives a text; `#KEY: a,b` and `#KEY,a,b` give lists. Keys are lower-cased."""
    meta: dict[str, object] = {}
    for line in lines:
        body = line.lstrip("#").strip()
        if "=" in body:
            key, value = body.split("=", 1)
            meta[key.strip().lower()] = value.strip()
        elif body:
            key, rest = (body.split(":", 1) + [""])[:2] if ":" in body else (body.split(delimiter, 1) + [""])[:2]
            meta[key.strip().lower()] = [v.strip() for v in rest.strip().split(delimiter)]
    return meta


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, types: dict[str, str] | None = None) -> CsvTable:
    """A typed table. Types come from the metadata (`#dtypes`), the argument, or a pass over all rows."""
    # the header is the first line that is no comment, wherever it stands, and the metadata are the comments before it
    lines = spark.read.text(path).select(F.rtrim(F.ltrim("value", F.lit("\ufeff")), F.lit("\r")).alias("v"), F.monotonically_increasing_id().alias("i"))
    found = lines.where("NOT startswith(v, '#')").first()
    if found is None:
        raise DataError(f"{path} has no header")
    first = found["v"]
    comments = [r["v"] for r in lines.where(F.col("v").startswith("#") & (F.col("i") < found["i"])).orderBy("i").collect()]
    meta = parsed_meta(comments, delimiter)
    cells = [c.strip().strip('"') for c in first.split(delimiter)]
    names = repaired_header(cells if header else None, len(cells))
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.option("sep", delimiter).option("comment", "#").option("header", header).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(schema).csv(path)
    given = {"int": "long", "float": "double", "str": "string"}
    if types is None and isinstance(meta.get("dtypes"), list) and len(meta["dtypes"]) == len(names):
        types = {n: given.get(t, "string") for n, t in zip(names, meta["dtypes"], strict=True)}
    types = inferred_types(raw) if types is None else types
    return CsvTable(typed(raw, types), meta, types)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in the given order."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; NULL as nan."""
    df.write.mode(mode).option("header", True).option("nullValue", "nan").csv(path)


def write_rejects(rejects: DataFrame, path: str) -> bool:
    """Writes the reasons as text lines, if there are any."""
    if rejects.isEmpty():
        return False
    rejects.select(F.concat(F.lit("Object with ID: "), F.col("object_id").cast("string"), F.lit(" -> "), "reason")).write.mode("overwrite").text(path)
    return True
