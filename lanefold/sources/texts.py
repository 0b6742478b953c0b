"""Texts and image listings from files."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanefold.functions.json_leaves import MIN_LEAF, string_leaves
from lanefold.functions.text import collapse_spaces, strip_spaces
from lanefold.operators.corpus import seeded_order
from lanefold.sources.vectors import files

logger = logging.getLogger(__name__)

TEXT_SUFFIXES = ("txt", "tsv", "csv")
SHEET_SUFFIXES = ("xlsx", "xls")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp")


def _glob(*suffixes: str) -> str:
    """A file pattern for suffixes in any letter case."""
    cased = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*.{" + ",".join(cased) + "}"


def _reader(spark: SparkSession, path: str, folder: bool, *suffixes: str):
    reader = spark.read
    if folder:
        reader = reader.option("pathGlobFilter", _glob(*suffixes)).option("recursiveFileLookup", "true")
    return reader


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _place():
    return (
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def _lines(reader, path: str, whole: bool = False) -> DataFrame:
    lines = reader.text(path, wholetext=whole).select(strip_spaces(F.col("value")).alias("text"), *_place())
    return lines.where(F.col("text") != "").select("path", "block", "at", F.lit(0).alias("pos"), "text")


def _json(reader, path: str, whole: bool) -> DataFrame:
    rows = reader.text(path, wholetext=whole).select("value", *_place())
    return rows.select("path", "block", "at", F.posexplode(string_leaves(F.col("value"))).alias("pos", "text"))


def _sheets(spark: SparkSession, path: str, folder: bool) -> DataFrame:
    """String cells of every sheet. Without a spreadsheet library, or for a broken file: none."""
    reader = spark.read.format("binaryFile")
    if folder:
        reader = reader.option("pathGlobFilter", _glob(*SHEET_SUFFIXES)).option("recursiveFileLookup", "true")
    content = reader.load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            for file, raw in zip(frame["path"], frame["content"]):
                try:
                    sheets = pd.read_excel(io.BytesIO(raw), sheet_name=None, header=None, dtype=object)
                except Exception as exc:
                    logger.warning("skipping spreadsheet %s: %s", file, exc)
                    continue
                cells = [v.strip() for s in sheets.values() for row in s.itertuples(index=False) for v in row if isinstance(v, str)]
                cells = [c for c in cells if len(c) >= MIN_LEAF]
                yield pd.DataFrame({"path": file, "block": 0, "at": 0, "pos": range(len(cells)), "text": cells})

    return content.mapInPandas(run, "path string, block long, at long, pos int, text string")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, pos, text): the strings of a file or of all text-like files of a folder.

    Text files give their non-blank lines, JSON its string leaves, spreadsheets their string
    cells. A single file of unknown kind is read as lines. The first four columns order the rows.
    """
    suffix = _suffix(path)
    if suffix in SHEET_SUFFIXES:
        return _sheets(spark, path, False)
    if suffix in ("json", "jsonl"):
        return _json(spark.read, path, suffix == "json")
    if suffix:
        return _lines(spark.read, path)
    parts = [
        _lines(_reader(spark, path, True, *TEXT_SUFFIXES), path),
        _json(_reader(spark, path, True, "json"), path, True),
        _json(_reader(spark, path, True, "jsonl"), path, False),
        _sheets(spark, path, True),
    ]
    return reduce(DataFrame.unionByName, parts)


def read_queries(spark: SparkSession, path: str, max_queries: int | None = None, collapse: bool = False) -> DataFrame:
    """(ord columns, text): one query per file of a folder, or per non-blank line of a file.

    In a folder ``*kis*.txt`` files come first; without any, all ``*.txt`` files are taken.
    """
    if _suffix(path):
        rows = _lines(spark.read, path)
    else:
        pattern = "*kis*.txt"
        if files(spark, path, pattern, recursive=True).isEmpty():
            pattern = "*.txt"
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        rows = _lines(reader, path, whole=True)
    if collapse:
        rows = rows.withColumn("text", collapse_spaces(F.col("text")))
    ordered = rows.orderBy("path", "block", "at")
    return ordered.limit(max_queries) if max_queries else ordered


def discover_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length) of the images in a folder, by path."""
    return files(spark, folder, _glob(*IMAGE_SUFFIXES), recursive).orderBy("path")


def sample_keyframes(spark: SparkSession, root: str, n: int, seed: int = 0, shuffled: bool = False) -> DataFrame:
    """``n`` of the ``.jpg`` files below ``root`` (all if fewer), by path or in shuffled order."""
    found = files(spark, root, "*.jpg", recursive=True)
    rank = seeded_order(F.col("path"), seed)
    picked = found.orderBy(rank, "path").limit(n)
    return picked if shuffled else picked.orderBy("path")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A contrastive corpus as written by ``sinks.tables.write_pairs``."""
    return spark.read.parquet(path)


def held_out_or_file(spark: SparkSession, queries_file: str | None, harvested: DataFrame | None) -> DataFrame:
    """(text): queries from exactly one of a file and a harvested held-out set; none is an error."""
    if (queries_file is None) == (harvested is None):
        raise ValueError("give either a query file or a held-out set")
    rows = harvested if harvested is not None else read_queries(spark, queries_file)
    if rows.isEmpty():
        raise ValueError("no queries")
    return rows.select("text")
