"""Field dictionary from spreadsheet cells.

Input is a long ``cells(workbook, sheet, sheet_idx, row_idx, col_idx, value)``
table -- one row per non-empty cell -- so every step is a filter, a join or
an aggregate keyed by sheet; no sheet is ever pulled whole into one task
except the single systems row, whose width is the sheet's column count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_ws, is_field_name
from ..session import cut_lineage

# Fixed values the dictionary must reproduce.
HEADER_CELL = "Campo"
SUMMARY_SHEET = "resumen"
SUMMARY_HEADER = "Entidad"
SYSTEMS_ROW_KEYWORDS = ("TIPO", "MAPEO", "PK", "ENTIDAD/MAESTRO", "CAMPO", "NOMBRE", "RESUMEN")
HEADER_KEYWORDS = ("TIPO", "MAPEO", "PK", "ENTIDAD/MAESTRO", "CAMPO", "NOMBRE")
CELL_MAX_LEN = 250
MIN_DESCRIPTION_CHARS = 20
DATA_OFFSET = 4          # systems start four columns right of "Campo"
EMPTY_CELL = "—"

SHEET = ["workbook", "sheet"]


def _upper_word(v: Column) -> Column:
    s = F.trim(v)
    return (s != "") & (F.upper(s) == s)


def data_sheets(cells: DataFrame) -> DataFrame:
    return cells.filter(F.lower("sheet") != SUMMARY_SHEET)


def find_header(cells: DataFrame) -> DataFrame:
    """First cell equal to ``Campo`` in row-major order, per sheet."""
    h = (data_sheets(cells).filter(F.col("value") == HEADER_CELL)
         .groupBy(*SHEET).agg(F.min(F.struct("row_idx", "col_idx")).alias("h")))
    return h.select(*SHEET, F.col("h.row_idx").alias("header_row"),
                    F.col("h.col_idx").alias("campo_col"))


def find_systems_row(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """First row above the header with an upper-case, non-keyword name
    (longer than one character) at column ``campo + 4`` or beyond."""
    c = cells.join(headers, SHEET)
    v = F.trim("value")
    cand = c.filter((F.col("row_idx") < F.col("header_row"))
                    & (F.col("col_idx") >= F.col("campo_col") + DATA_OFFSET)
                    & _upper_word(F.col("value")) & ~v.isin(*SYSTEMS_ROW_KEYWORDS)
                    & (F.length(v) > 1))
    return cand.groupBy(*SHEET).agg(F.min("row_idx").alias("systems_row"))


def _suffix_duplicates(df: DataFrame) -> DataFrame:
    """Second and later uses of a name become ``name (k)``."""
    w = Window.partitionBy(*SHEET, "name").orderBy("tipo_col")
    k = F.row_number().over(w)
    return df.withColumn("system", F.when(k == 1, F.col("name"))
                         .otherwise(F.concat(F.col("name"), F.lit(" ("), k.cast("string"),
                                             F.lit(")"))))


def paired_systems(cells: DataFrame, headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Systems declared as (TIPO, MAPEO) column pairs on the systems row.

    The reference walks the row left to right, taking a named cell and
    skipping the column after it; that is a fold over the row's cells in
    column order, done with ``aggregate`` on the (bounded) row.
    """
    c = (cells.join(headers, SHEET).join(rows, SHEET)
         .filter((F.col("row_idx") == F.col("systems_row"))
                 & (F.col("col_idx") >= F.col("campo_col") + DATA_OFFSET)
                 & (F.trim("value") != "")))
    per_row = c.groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", F.trim("value").alias("name"))))
        .alias("cells"))
    init = F.struct(F.lit(-1).alias("next"),
                    F.array().cast("array<struct<col_idx:int,name:string>>").alias("taken"))
    walked = per_row.select(*SHEET, F.aggregate(
        "cells", init,
        lambda acc, x: F.when(x["col_idx"] >= acc["next"],
                              F.struct((x["col_idx"] + 2).alias("next"),
                                       F.concat(acc["taken"], F.array(x)).alias("taken")))
        .otherwise(acc))["taken"].alias("taken"))
    sys = walked.select(*SHEET, F.explode("taken").alias("t")).select(
        *SHEET, F.col("t.name").alias("name"), F.col("t.col_idx").alias("tipo_col"),
        (F.col("t.col_idx") + 1).alias("mapeo_col"))
    return _suffix_duplicates(sys).select(*SHEET, "system", "tipo_col", "mapeo_col",
                                          F.lit(False).alias("inline"))


def inline_systems(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Upper-case, non-keyword names on the header row itself."""
    c = cells.join(headers, SHEET)
    v = F.trim("value")
    sys = (c.filter((F.col("row_idx") == F.col("header_row"))
                    & (F.col("col_idx") >= F.col("campo_col") + DATA_OFFSET)
                    & _upper_word(F.col("value")) & ~v.isin(*HEADER_KEYWORDS))
           .select(*SHEET, v.alias("name"), F.col("col_idx").alias("tipo_col")))
    return _suffix_duplicates(sys).select(*SHEET, "system", "tipo_col",
                                          F.lit(None).cast("int").alias("mapeo_col"),
                                          F.lit(True).alias("inline"))


def sheet_systems(cells: DataFrame) -> DataFrame:
    """Systems of every sheet: paired when a systems row exists, else inline."""
    headers = find_header(cells)
    rows = find_systems_row(cells, headers)
    paired = paired_systems(cells, headers, rows)
    inline = inline_systems(cells, headers).join(rows, SHEET, "left_anti")
    return paired.unionByName(inline)


def field_rows(cells: DataFrame) -> DataFrame:
    """Rows below the header whose ``Campo`` cell is a snake_case name:
    ``(workbook, sheet, row_idx, campo, nombre, descripcion, maestro)``."""
    headers = find_header(cells)
    c = cells.join(headers, SHEET).filter(F.col("row_idx") > F.col("header_row"))
    off = F.col("col_idx") - F.col("campo_col")
    piv = c.groupBy(*SHEET, "row_idx").agg(
        F.max(F.when(off == 0, F.col("value"))).alias("v0"),
        F.max(F.when(off == 1, F.col("value"))).alias("v1"),
        F.max(F.when(off == 2, F.col("value"))).alias("v2"),
        F.max(F.when(off == 3, F.col("value"))).alias("v3"))
    return (piv.filter(is_field_name(F.trim("v0")))
            .select(*SHEET, "row_idx", clean_ws("v0").alias("campo"),
                    F.coalesce(clean_ws("v1"), F.lit("")).alias("nombre"),
                    F.coalesce(clean_ws("v2"), F.lit("")).alias("descripcion"),
                    F.coalesce(clean_ws("v3"), F.lit("")).alias("maestro")))


def system_cells(cells: DataFrame, fields: DataFrame, systems: DataFrame) -> DataFrame:
    """Per field row and system, ``**tipo**: mapeo`` / either / ``—``,
    cut at 250 characters (inline systems: the cell text)."""
    f = fields.select(*SHEET, "row_idx")
    fs = f.join(systems, SHEET)
    vals = cells.select(*SHEET, "row_idx", "col_idx", clean_ws("value").alias("v"))
    tipo = vals.select(*SHEET, "row_idx", F.col("col_idx").alias("tipo_col"),
                       F.col("v").alias("tipo"))
    mapeo = vals.select(*SHEET, "row_idx", F.col("col_idx").alias("mapeo_col"),
                        F.col("v").alias("mapeo"))
    j = (fs.join(tipo, [*SHEET, "row_idx", "tipo_col"], "left")
         .join(mapeo, [*SHEET, "row_idx", "mapeo_col"], "left"))
    t = F.coalesce(F.col("tipo"), F.lit(""))
    m = F.coalesce(F.col("mapeo"), F.lit(""))
    paired = (F.when((t != "") & (m != ""), F.concat(F.lit("**"), t, F.lit("**: "), m))
              .when(t != "", t).when(m != "", m).otherwise(F.lit(EMPTY_CELL)))
    inline = F.when(t != "", t).otherwise(F.lit(EMPTY_CELL))
    cell = F.substring(F.when(F.col("inline"), inline).otherwise(paired), 1, CELL_MAX_LEN)
    return j.select(*SHEET, "row_idx", "system", "tipo_col", cell.alias("cell"))


def sheet_description(cells: DataFrame) -> DataFrame:
    """First text longer than 20 characters between row 1 and the header."""
    headers = find_header(cells)
    c = cells.join(headers, SHEET).filter(
        (F.col("row_idx") >= 1) & (F.col("row_idx") < F.col("header_row"))
        & (F.length(F.trim("value")) > MIN_DESCRIPTION_CHARS))
    return c.groupBy(*SHEET).agg(
        F.min_by(clean_ws("value"), F.struct("row_idx", "col_idx")).alias("description"))


def entity_summary(cells: DataFrame) -> DataFrame:
    """Rows of the summary sheet (first four columns), header excluded."""
    s = cells.filter(F.lower("sheet") == SUMMARY_SHEET)
    piv = s.groupBy("workbook", "row_idx").agg(
        *[F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(f"c{i}") for i in range(4)])
    return (piv.filter(F.col("c0").isNotNull() & (F.col("c0") != "")
                       & (F.col("c0") != SUMMARY_HEADER))
            .select("workbook", "row_idx",
                    *[F.coalesce(clean_ws(f"c{i}"), F.lit("")).alias(n) for i, n in
                      enumerate(["entidad", "tipo", "descripcion", "dataset"])]))


def field_counts(cells: DataFrame) -> DataFrame:
    """Number of field rows per sheet."""
    return field_rows(cells).groupBy(*SHEET).agg(
        F.count(F.lit(1)).cast("bigint").alias("fields"))


def dictionary_lines(cells: DataFrame) -> DataFrame:
    """The markdown of every data sheet as ordered lines
    ``(workbook, sheet_idx, line_no, line)``; line order is carried by
    ``(part, row_idx, sub)`` so no sheet is gathered into one group.  Write
    them with ``sortWithinPartitions`` to get the file text."""
    cells = cut_lineage(cells, "cells")
    headers = cut_lineage(find_header(cells), "headers")
    sheets = data_sheets(cells).select(*SHEET, "sheet_idx").distinct()
    systems = cut_lineage(sheet_systems(cells), "systems")
    sys_list = systems.groupBy(*SHEET).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tipo_col", "system"))),
                    lambda x: x["system"]).alias("names"))
    desc = sheet_description(cells)
    fields = cut_lineage(field_rows(cells), "fields")
    sc = system_cells(cells, fields, systems)
    row_cells = sc.groupBy(*SHEET, "row_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tipo_col", "cell"))),
                    lambda x: x["cell"]).alias("cells"))
    counts = fields.groupBy(*SHEET).agg(F.count("*").cast("bigint").alias("fields"))
    head = (sheets.join(headers, SHEET, "left").join(sys_list, SHEET, "left")
            .join(desc, SHEET, "left").join(counts, SHEET, "left"))
    n = F.size(F.coalesce("names", F.array().cast("array<string>")))
    header_line = F.when(n > 0, F.concat(
        F.lit("| Campo | Nombre | Descripción funcional | Maestro | "),
        F.array_join("names", " | "), F.lit(" |"))).otherwise(
        F.lit("| Campo | Nombre | Descripción funcional | Maestro |"))
    sep_line = F.concat(F.lit("|---|---|---|---|"), F.repeat(F.lit("---|"), n))
    no_header = F.col("header_row").isNull()
    top = head.select(*SHEET, "sheet_idx", F.explode(F.when(no_header, F.array(
        F.struct(F.lit(0).alias("sub"), F.concat(F.lit("## "), F.col("sheet"), F.lit("\n"))
                 .alias("line")),
        F.struct(F.lit(1).alias("sub"), F.lit("(Sin estructura de campos reconocida)\n")
                 .alias("line")))).otherwise(F.filter(F.array(
        F.struct(F.lit(0).alias("sub"), F.concat(F.lit("## "), F.col("sheet"), F.lit("\n"))
                 .alias("line")),
        F.struct(F.lit(1).alias("sub"), F.when(F.col("description").isNotNull(),
                                               F.concat(F.col("description"), F.lit("\n")))
                 .alias("line")),
        F.struct(F.lit(2).alias("sub"), header_line.alias("line")),
        F.struct(F.lit(3).alias("sub"), sep_line.alias("line"))),
        lambda s: s["line"].isNotNull()))).alias("t"))
    top = top.select(*SHEET, "sheet_idx", F.lit(0).alias("part"), F.lit(0).alias("row_idx"),
                     F.col("t.sub").alias("sub"), F.col("t.line").alias("line"))
    body = (fields.join(row_cells, [*SHEET, "row_idx"], "left")
            .join(sheets, SHEET)
            .select(*SHEET, "sheet_idx", F.lit(1).alias("part"), "row_idx",
                    F.lit(0).alias("sub"),
                    F.concat(F.lit("| "), F.col("campo"), F.lit(" | "), F.col("nombre"),
                             F.lit(" | "), F.col("descripcion"), F.lit(" | "), F.col("maestro"),
                             F.lit(" |"),
                             F.when(F.size(F.coalesce("cells", F.array())) > 0,
                                    F.concat(F.lit(" "), F.array_join("cells", " | "),
                                             F.lit(" |"))).otherwise(F.lit("")))
                    .alias("line")))
    tail = head.filter(~no_header).select(
        *SHEET, "sheet_idx", F.lit(2).alias("part"), F.lit(0).alias("row_idx"),
        F.explode(F.filter(F.array(
            F.struct(F.lit(0).alias("sub"),
                     F.when(F.coalesce("fields", F.lit(0)) == 0,
                            F.lit("*(Sin definiciones de campos encontradas)*")).alias("line")),
            F.struct(F.lit(1).alias("sub"),
                     F.concat(F.lit("\n*"), F.coalesce("fields", F.lit(0)).cast("string"),
                              F.lit(" campos definidos*\n")).alias("line"))),
            lambda s: s["line"].isNotNull())).alias("t"))
    tail = tail.select(*SHEET, "sheet_idx", "part", "row_idx", F.col("t.sub").alias("sub"),
                       F.col("t.line").alias("line"))
    return top.unionByName(body).unionByName(tail)


def changed_sources(files: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Sources to (re)convert -- no output yet, or the source is newer
    than its output; everything when ``force``.  ``files(name, mtime)``,
    ``outputs(name, mtime)``."""
    if force:
        return files
    o = outputs.select("name", F.col("mtime").alias("out_mtime"))
    j = files.join(o, "name", "left")
    return j.filter(F.col("out_mtime").isNull() | (F.col("mtime") > F.col("out_mtime"))) \
        .drop("out_mtime")
