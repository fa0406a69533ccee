"""Queries whose plan is stated in SQL over the readings of measura.sources.views.

The plan's text is shared with the checking engine, which gets its own SQL form of every reading.  Three things are
spelled differently by the engines and are written as macros: DIV(a, b), division toward zero, XOR(a, b), and PAIR(a, b), a
value that is ordered by a and then b.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from measura.sources import views
from measura.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
INNER = r"((?:[^(),]|\((?:[^()]|\([^()]*\))*\))+)"
MACRO = re.compile(r"\b(DIV|XOR|PAIR)\(" + INNER + ", " + INNER + r"\)")
SPARK_FORM = {"DIV": "(({0}) div ({1}))", "XOR": "(({0}) ^ ({1}))", "PAIR": "struct({0}, {1})"}
OTHER_FORM = {"DIV": "(({0}) // ({1}))", "XOR": "xor({0}, {1})", "PAIR": "struct_pack(a := {0}, b := {1})"}


def spelled(sql: str, forms: dict[str, str]) -> str:
    while MACRO.search(sql):
        sql = MACRO.sub(lambda m: forms[m[1]].format(m[2].strip(), m[3].strip()), sql)
    return sql


def names_in(sql: str) -> list[str]:
    """Readings and tables the text reads: names that stand after FROM or JOIN and aren't defined in the text."""
    found = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) - set(re.findall(r"\b(\w+)(?:\s*\([^()]*\))?\s+AS\s*\(\s*(?:SELECT|WITH)", sql))
    return [n for n in (*views.SPARK, *views.TABLES) if n in found]


#: Rows of the benchmark up to which what is derived from it, a few short rows for each item, is broadcast.
FEW_ITEMS = 250_000


def hinted(sql: str, spark: SparkSession, sf_dir: str) -> str:
    """FEW(x) as a hint that suits the number of benchmark items.  Without it the planner goes by the documents' size on
    disk, which says nothing of their exploded characters, and may broadcast those."""
    if "FEW(" not in sql:
        return sql
    few = table(spark, sf_dir, "benchmark").count() <= FEW_ITEMS
    return sql.replace("FEW(", "BROADCAST(" if few else "SHUFFLE_HASH(")


#: Counts of symbols by document, as a plan states them, and from rows that were counted where they stand.
COUNTED = (
    ("SELECT doc_id, sym, COUNT(*) AS n FROM s GROUP BY doc_id, sym", "SELECT doc_id, sym, SUM(n) AS n FROM sn GROUP BY doc_id, sym"),
    ("SELECT sym, doc_id, COUNT(*) AS n, MIN(pos) AS first_pos FROM s GROUP BY sym, doc_id", "SELECT sym, doc_id, SUM(n) AS n, MIN(first_pos) AS first_pos FROM sn GROUP BY sym, doc_id"),
    ("SELECT doc_id, sym, COUNT(*) AS n, MIN(pos) AS first_pos FROM s GROUP BY doc_id, sym", "SELECT doc_id, sym, SUM(n) AS n, MIN(first_pos) AS first_pos FROM sn GROUP BY doc_id, sym"),
    ("SELECT doc_id, sym, MIN(pos) AS first_pos, COUNT(*) AS n FROM s GROUP BY doc_id, sym", "SELECT doc_id, sym, MIN(first_pos) AS first_pos, SUM(n) AS n FROM sn GROUP BY doc_id, sym"),
)


def spark_form(sql: str) -> Query:
    for stated, made in COUNTED:
        sql = sql.replace(stated, made)
    used = names_in(sql)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: views.SPARK[n](spark, sf_dir) if n in views.SPARK else table(spark, sf_dir, n) for n in used}
        text = hinted(spelled(sql, SPARK_FORM), spark, sf_dir)
        text = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" + f" AS {m[3]}" * (not re.match(r"\s+(?:AS\s+)?(?!ON\b|WHERE\b|GROUP\b|JOIN\b|LEFT\b|ORDER\b|USING\b|FULL\b|CROSS\b|UNION\b|EXCEPT\b|INTERSECT\b|HAVING\b|LIMIT\b|WINDOW\b|INNER\b|TABLESAMPLE\b)[A-Za-z_]", text[m.end() :])) if m[3] in frames else m[0], text)
        return spark.sql(text, **frames)

    return query


def other_form(sql: str) -> str:
    readings = [n for n in names_in(sql) if n in views.SPARK]
    other = spelled(sql, OTHER_FORM)
    if readings:
        heads = ", ".join(f"{n} AS ({views.SQL[n]})" for n in readings)
        other = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", lambda m: f"WITH {m[1] or ''}{heads}, ", other, count=1) if re.match(r"\s*WITH\b", other) else f"WITH {heads} {other}"
    return other


def family(**texts: str | tuple[str, str]) -> dict[str, tuple[Query, str]]:
    """One text for both engines, or a plan of Spark's own and the text it is checked against."""
    both = {name: (sql, sql) if isinstance(sql, str) else sql for name, sql in texts.items()}
    return {name: (spark_form(own), other_form(other)) for name, (own, other) in both.items()}
