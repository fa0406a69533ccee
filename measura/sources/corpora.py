"""Text corpora as rows: treebank files and atom records, read with Spark's text source and parsed by column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def treebank(spark: SparkSession, path: str, fold_case: bool = True) -> DataFrame:
    """(sentence, place, form, reading) of files in ten-column token rows: a blank line ends a sentence, whose id is in its
    ``sent_id`` comment.  Rows of several words and empty nodes (ids with a dash or a dot) are passed over.

    A file is one row until it is split, so files are the unit of work.
    """
    files = spark.read.text(path, wholetext=True)
    sentences = files.select(F.explode(F.split("value", r"\n\s*\n")).alias("s"))
    rows = sentences.select(F.regexp_extract("s", r"# sent_id = (\S+)", 1).alias("sentence"), F.explode(F.split("s", "\n")).alias("line"))
    cells = rows.where(F.col("line").rlike(r"^[0-9]+\t")).select("sentence", F.split("line", "\t").alias("c")).where(F.size("c") >= 6)
    form = F.lower(F.col("c")[1]) if fold_case else F.col("c")[1]
    return cells.select("sentence", F.col("c")[0].cast("long").alias("place"), form.alias("form"), F.concat_ws("|", F.lower(F.col("c")[2]), F.col("c")[3], F.col("c")[5]).alias("reading"))


def atoms(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(serial, atom, residue, chain, number, x, y, z) of fixed-width atom records, coordinates in thousandths; ``name``
    keeps the atoms of that name alone."""
    line = F.col("value")
    part = lambda start, size: F.trim(F.substring(line, start, size))
    thousandths = lambda start: (part(start, 8).cast("decimal(12,3)") * 1000).cast("long")
    rows = spark.read.text(path).where(line.startswith("ATOM  ")).select(
        part(7, 5).cast("long").alias("serial"), part(13, 4).alias("atom"), part(18, 3).alias("residue"), part(22, 1).alias("chain"), part(23, 4).cast("long").alias("number"),
        thousandths(31).alias("x"), thousandths(39).alias("y"), thousandths(47).alias("z"),
    )
    return rows if name is None else rows.where(F.col("atom") == name)
