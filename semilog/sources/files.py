"""Fact files: TSV, CSV and JSON, checked cell by cell before any fact is taken.

A predicate's columns come first; a Trop predicate has an integer weight behind them, a neural one a probability.
Small files are read on the driver, as their facts become part of the program. ``scan`` reads files of any size as a
DataFrame with the same checks, for ``Program.bind``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilog.errors import LoadError
from semilog.lang import tree as t
from semilog.lang.checker import Checked, Soft

LEAST, MOST = -(2**63), 2**63 - 1
WHOLE = re.compile(r"[+-]?[0-9]+")
FORMATS = {"": "tsv", ".tsv": "tsv", ".csv": "csv", ".json": "json"}


def csv_cells(line: str, where: str) -> list[str]:
    """Cells of a strict CSV line: a quoted cell is quoted as a whole, a bare quote is refused."""
    cells, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            cell, at = "", at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    raise LoadError(f"{where}: a quoted cell doesn't end")
                cell += line[at:end]
                at = end + 1
                if line[at : at + 1] != '"':
                    break
                cell, at = cell + '"', at + 1
            if at < len(line) and line[at] != ",":
                raise LoadError(f"{where}: characters after a quoted cell")
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            cell = line[at:end]
            if '"' in cell:
                raise LoadError(f"{where}: a quote inside an unquoted cell")
            at = end
        cells.append(cell)
        if at >= len(line):
            return cells
        at += 1


def rows_of(path: str, shown: str) -> Iterator[tuple[str, list]]:
    """(place, cells) of every row; JSON cells keep their type."""
    kind = FORMATS.get(os.path.splitext(path)[1])
    if kind is None:
        raise LoadError(f"{shown}: unsupported extension; use .tsv, .csv or .json")
    try:
        text = open(path, encoding="utf-8", newline="").read()
    except (OSError, UnicodeDecodeError) as e:
        raise LoadError(f"{shown}: can't be read: {e}") from e
    if kind == "json":
        try:
            rows = json.loads(text)
        except ValueError as e:
            raise LoadError(f"{shown}: not JSON: {e}") from e
        if not isinstance(rows, list) or not all(isinstance(r, list) for r in rows):
            raise LoadError(f"{shown}: an array of arrays is needed")
        for i, r in enumerate(rows):
            yield f"{shown}: row {i + 1}", r
        return
    for i, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r")
        if line.strip():
            where = f"{shown}:{i + 1}"
            yield where, line.split("\t") if kind == "tsv" else csv_cells(line, where)


def whole(cell, where: str) -> int:
    if type(cell) is int or type(cell) is str and WHOLE.fullmatch(cell.strip()):
        if LEAST <= int(cell) <= MOST:
            return int(cell)
    raise LoadError(f"{where}: {cell!r} is no 64-bit integer")


def probability(cell, where: str) -> float:
    try:
        p = float(cell) if type(cell) in (int, float, str) else None
    except ValueError:
        p = None
    if p is None or not 0 <= p <= 1:
        raise LoadError(f"{where}: {cell!r} is no probability in [0, 1]")
    return p


def symbol(cell, where: str) -> str:
    if type(cell) is not str:
        raise LoadError(f"{where}: {cell!r} stands where a symbol is declared")
    if not cell:
        raise LoadError(f"{where}: an empty cell")
    return cell


def fact(decl: t.Predicate, cells: list, where: str) -> tuple[tuple, int | None, float | None]:
    trop, neural = decl.annotation.kind == "trop", decl.model is not None
    wanted = len(decl.args) + (trop or neural)
    if len(cells) != wanted:
        raise LoadError(f"{where}: {len(cells)} cells, `{decl.name}` needs {wanted}")
    args = tuple(whole(c, where) if a[0] == "int" else symbol(c, where) for a, c in zip(decl.args, cells))
    return args, whole(cells[-1], where) if trop else None, probability(cells[-1], where) if neural else None


def load_inputs(checked: Checked, base: str) -> None:
    """All ``input`` files' facts, or none: everything is checked before anything is taken, and only once."""
    if checked.inputs_loaded:
        raise LoadError("inputs are loaded already; loading them again would repeat their facts")
    facts, soft = [], []
    for i in checked.inputs:
        decl = checked.decls[i.pred]
        for where, cells in rows_of(os.path.join(base, i.path), i.path):
            args, weight, p = fact(decl, cells, where)
            if p is not None:
                soft.append(Soft(i.pred, args, p))
            else:
                facts.append((i.pred, args, weight))
    checked.facts += facts
    checked.soft += soft
    checked.inputs_loaded = True


def scan(spark: SparkSession, path: str, decl: t.Predicate) -> DataFrame:
    """A TSV, CSV or JSON-lines file (or folder) of any size, with the declared types.

    Cells are checked where they are read: a wrong one fails the query and says which row. JSON here is one array a
    line. CSV cells can't hold line feeds.
    """
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1])
    if kind is None:
        raise LoadError(f"{path}: unsupported extension; use .tsv, .csv or .json")
    trop, neural = decl.annotation.kind == "trop", decl.model is not None
    n = len(decl.args) + (trop or neural)
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{path}: {why}: "), F.col("value")))
    if kind == "json":
        cells = lines.withColumn("v", F.try_parse_json("value")).withColumn("cells", F.when(F.json_array_length("value") == n, F.array(*[F.to_json(F.variant_get("v", f"$[{i}]", "variant")) for i in range(n)])))
        cell = lambda i: F.col("cells")[i]
        text = lambda i: F.when(cell(i).startswith('"'), F.variant_get("v", f"$[{i}]", "string")).otherwise(bad("a symbol is needed").cast("string"))
    else:
        value = F.regexp_replace("value", "\r$", "")
        if kind == "tsv":
            parts = F.split(value, "\t", -1)
        else:
            strict = r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
            quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(r',("(?:[^"]|"")*"|[^",]*)'), 1), lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
            parts = F.when(value.rlike(strict), quoted).otherwise(bad("bad quotes").cast("array<string>"))
        cells = lines.withColumn("cells", parts)
        cells = cells.withColumn("cells", F.when(F.size("cells") == n, F.col("cells")))
        cell = lambda i: F.col("cells")[i]
        text = lambda i: F.when(cell(i) != "", cell(i)).otherwise(bad("an empty cell").cast("string"))
    checked = cells.withColumn("cells", F.when(F.col("cells").isNull(), bad(f"`{decl.name}` needs {n} cells").cast("array<string>")).otherwise(F.col("cells")))
    number = lambda i: F.trim(cell(i)).cast("bigint")  # noqa: E731  ANSI casts raise
    out = [(number(i) if a[0] == "int" else text(i)).alias(f"c{i}") for i, a in enumerate(decl.args)]
    if trop:
        out.append(number(n - 1).alias("w"))
    if neural:
        p = cell(n - 1).cast("double")
        out.append(F.when(p.between(0, 1), p).otherwise(bad("a probability is needed").cast("double")).alias("p"))
    return checked.select(*out)
