"""Narration documents as JSON: sink (A15) and source (A16), with an explicit schema or,
where documents may hold more than it knows, as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import file_stem
from ..operators.narration import NARRATION

DOC_SCHEMA = T.StructType([T.StructField("g", T.LongType())] + NARRATION.fields)


def write_narrations(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line; NULL fields are written, not dropped."""
    docs.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_narrations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read narration documents with the fixed schema (no inference; a pretty
    printed file per document needs ``multi_line``). ``stem`` is the file name
    without extension; documents without a ``g`` field get ``g`` NULL."""
    df = (spark.read.schema(DOC_SCHEMA).option("multiLine", multi_line)
          .option("mode", "PERMISSIVE").json(path))
    return df.withColumn("stem", file_stem())


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Documents with whatever fields they have: ``(stem, doc, raw)``, one per line.

    ``doc`` is the document as VARIANT, with fields that no schema names. A line that
    is no JSON object is a reject: ``doc`` is NULL and ``raw`` keeps its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    doc = F.try_parse_json("value")
    doc = F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)
    return lines.select(file_stem().alias("stem"), doc.alias("doc"), F.when(doc.isNull(), F.col("value")).alias("raw"))


def known_fields(variants: DataFrame) -> DataFrame:
    """The fields that the library works with, NULL where one is missing or of another
    kind, in front of the document itself."""
    fields = [F.try_variant_get("doc", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in DOC_SCHEMA.fields]
    return variants.where("doc IS NOT NULL").select("stem", *fields, "doc")


def write_variants(variants: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line, with all its fields; rejects as they came."""
    line = F.coalesce(F.to_json("doc"), F.col("raw"))
    variants.select(line.alias("value")).write.mode(mode).text(path)
