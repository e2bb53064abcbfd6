"""Scanning folders of text files, and integers inside texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a crawl leaves out, and the largest file that it takes.
LEFT_OUT = ["node_modules", "target", "build", "dist", "__pycache__", "venv"]
LARGEST_BYTES = 32 << 20
LARGEST_DIGITS = 19


def crawl(spark: SparkSession, path: str, largest: int = LARGEST_BYTES) -> DataFrame:
    """path, length, content of files below a folder: no hidden ones, none of the left-out folders, none empty or too large.

    The sizes are filtered by the source, so larger files aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") > 0) & (F.col("length") <= largest))
    # hidden or left-out names count below the folder only; its own path may have any
    root = path.rstrip("/").split("/")[-1]
    below = F.regexp_replace("path", f"^.*?/{re.escape(root)}/", "")
    return files.where(~below.rlike("(^|/)(\\.[^/]*|" + "|".join(LEFT_OUT) + ")(/|$)"))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 1024."""
    return F.contains(F.substring(content, 1, 1024), F.lit(b"\0"))


def text_files(spark: SparkSession, path: str, largest: int = LARGEST_BYTES) -> DataFrame:
    """path, text of the files that aren't binary."""
    return crawl(spark, path, largest).where(~is_binary(F.col("content"))).select("path", F.decode("content", "UTF-8").alias("text"))


def integers(text: Column) -> Column:
    """All signed integers of a text that fit 64 bits; runs of more than 19 digits are none."""
    found = F.regexp_extract_all(text, F.lit("([+-]?[0-9]+)"), F.lit(1))
    fitting = F.filter(found, lambda x: F.length(F.regexp_replace(x, "^[+-]", "")) <= LARGEST_DIGITS)
    return F.filter(F.transform(fitting, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def csv_integers(text: Column, skip_header: bool = False) -> Column:
    return integers(F.regexp_replace(text, "^[^\n]*\n?", "") if skip_header else text)


def json_integers(text: Column) -> Column:
    """Only integers inside square brackets."""
    inside = F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\]?)"), F.lit(1))
    return integers(F.array_join(inside, " "))


def keys_of(name: Column, text: Column, skip_header: bool = False) -> Column:
    """Integers of a member by its extension: .csv, .json or .js, else text."""
    low = F.lower(name)
    return F.when(low.endswith(".csv"), csv_integers(text, skip_header)).when(low.rlike(r"\.(json|js)$"), json_integers(text)).otherwise(integers(text))
