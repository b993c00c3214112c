"""Blocks of workbooks: which sheet and place a name means, and which merged area a cell is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_ROWS, TILE_COLUMNS = 1024, 64
_PLACE = r"^[A-Z]+[0-9]+$"
_SHORT = r"^([A-Z]{1,3})([0-9]+)$"


def column_number(letters: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda n, x: n * 26 + F.ascii(x) - 64)


def area_bounds(ref: Column) -> list[Column]:
    """r1, c1, r2, c2 of a reference such as B2:D5 or B2, dollar signs allowed; null where it is none."""
    parts = F.split(F.regexp_replace(F.upper(ref), r"\$", ""), ":")
    first, last = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.get(parts, 0))
    good = first.rlike(_SHORT) & last.rlike(_SHORT) & (F.size(parts) <= 2)
    row = lambda x: F.when(good, F.regexp_extract(x, _SHORT, 2).cast("long"))
    column = lambda x: F.when(good, column_number(F.regexp_extract(x, _SHORT, 1)))
    r, c = [row(first), row(last)], [column(first), column(last)]
    return [F.least(*r).alias("r1"), F.least(*c).alias("c1"), F.greatest(*r).alias("r2"), F.greatest(*c).alias("c2")]


def routed(blocks: DataFrame, sheets: DataFrame, books: list[str], id: str = "id", sheet: str = "sheet") -> DataFrame:
    """``blocks`` with sheet and suffix, of those whose id names a sheet of their workbook (``books``: its key columns, on both sides).

    An id is a sheet's name, an underscore, and a cell (A1), shape_ or chart_ with more.  The longest such name wins.  Each id is cut
    before every underscore that such a suffix follows, and the cuts meet the names by equality, so no id meets all sheets.
    """
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(id), F.lit(1))), lambda i: F.substring(F.col(id), i, F.lit(1)) == "_")
    cuts = F.transform(at, lambda i: F.struct(F.substring(F.col(id), F.lit(1), i - 1).alias("name"), F.substring(F.col(id), i + 1, F.char_length(id)).alias("suffix")))
    fits = lambda c: c["suffix"].rlike(_PLACE) | F.startswith(c["suffix"], F.lit("shape_")) | F.startswith(c["suffix"], F.lit("chart_"))
    keys = [*books, id]
    tried = blocks.select(*keys).distinct().select(*keys, F.explode(F.filter(cuts, fits)).alias("cut"))
    names = sheets.select(*books, F.col(sheet).alias("__name")).distinct()
    same = F.col("cut.name") == F.col("__name")
    for b in books:
        same &= tried[b] == names[b]
    found = tried.join(names, same).groupBy(*[tried[k] for k in keys]).agg(F.max_by("cut", F.char_length("cut.name")).alias("cut"))
    return blocks.join(found, keys).withColumn("sheet", F.col("cut.name")).withColumn("suffix", F.col("cut.suffix")).drop("cut")


def targets(rows: DataFrame) -> DataFrame:
    """``rows`` of ``routed`` with kind (cell, shape, chart), row, column, number and part; those whose suffix says no place go."""
    s = F.col("suffix")
    parts = F.split(s, "_")
    kind = F.when(F.startswith(s, F.lit("shape_")), "shape").when(F.startswith(s, F.lit("chart_")), "chart").otherwise("cell")
    number = F.when(kind == "shape", F.substring(s, 7, 1 << 20)).when(kind == "chart", F.get(parts, 1))
    part = F.when(kind == "chart", F.when(F.get(parts, 2) == "title", "title").when(F.get(parts, 2) == "axis", F.get(parts, 3)))
    cell = s.rlike(_SHORT)
    out = rows.select(
        "*", kind.alias("kind"), F.when(cell, F.try_to_number(F.regexp_extract(s, _SHORT, 2), F.lit("9" * 18)).cast("long")).alias("row"),
        F.when(cell, column_number(F.regexp_extract(s, _SHORT, 1))).alias("column"), F.when(number.rlike("^[0-9]{1,18}$"), number).cast("long").alias("number"), part.alias("part"),
    )
    return out.where("CASE kind WHEN 'cell' THEN row > 0 WHEN 'shape' THEN number IS NOT NULL ELSE number IS NOT NULL AND part IS NOT NULL END")


def in_areas(cells: DataFrame, areas: DataFrame, sheet: list[str], row: str = "row", column: str = "column") -> DataFrame:
    """``cells`` with the columns of each area (r1, c1, r2, c2, ends included) of their sheet that they are in; others are left out.

    Areas are dealt to the tiles that they touch and meet the cells of a tile by equality.
    """
    tile = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    dealt = areas.withColumn("__tr", tile("r1", "r2", TILE_ROWS)).withColumn("__tc", tile("c1", "c2", TILE_COLUMNS))
    own = cells.withColumn("__tr", F.floor(F.col(row) / TILE_ROWS)).withColumn("__tc", F.floor(F.col(column) / TILE_COLUMNS))
    return own.join(dealt, [*sheet, "__tr", "__tc"]).where(F.col(row).between(F.col("r1"), F.col("r2")) & F.col(column).between(F.col("c1"), F.col("c2"))).drop("__tr", "__tc")
