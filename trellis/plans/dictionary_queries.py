"""Registered field-dictionary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..sources.fixtures import spreadsheet_cells
from . import oracle as O


def _cells(spark, d):
    return spreadsheet_cells(spark, d)


def q_header(spark, d):
    return D.find_header(_cells(spark, d))


def q_systems_row(spark, d):
    c = _cells(spark, d)
    return D.find_systems_row(c, D.find_header(c))


def q_paired(spark, d):
    c = _cells(spark, d)
    h = D.find_header(c)
    return D.paired_systems(c, h, D.find_systems_row(c, h)).select(
        "workbook", "sheet", "system", "tipo_col", "mapeo_col")


def q_inline(spark, d):
    c = _cells(spark, d)
    return D.inline_systems(c, D.find_header(c)).select("workbook", "sheet", "system",
                                                         "tipo_col")


def q_fields(spark, d):
    return D.field_rows(_cells(spark, d))


def q_system_cells(spark, d):
    c = _cells(spark, d)
    return D.system_cells(c, D.field_rows(c), D.sheet_systems(c)).select(
        "workbook", "sheet", "row_idx", "system", "cell")


def q_description(spark, d):
    return D.sheet_description(_cells(spark, d))


def q_summary(spark, d):
    return D.entity_summary(_cells(spark, d))


def q_counts(spark, d):
    return D.field_counts(_cells(spark, d))


def q_lines(spark, d):
    return D.dictionary_lines(_cells(spark, d))


_CELLS = """
SELECT workbook, sheet, sheet_idx, CAST(row_idx AS INTEGER) AS row_idx,
       CAST(col_idx AS INTEGER) AS col_idx, value FROM (
  SELECT workbook, sheet, sheet_idx, 0 AS row_idx, 0 AS col_idx, n_name AS value FROM nr
  UNION ALL SELECT workbook, sheet, sheet_idx, 1, 0, descr FROM nr
  UNION ALL SELECT workbook, sheet, sheet_idx, 3, h.c, h.v FROM nr,
    (VALUES (0, 'Campo'), (1, 'Nombre'), (2, 'Descripción'), (3, 'Maestro')) h(c, v)
  UNION ALL SELECT workbook, sheet, sheet_idx, h.r, h.c, h.v FROM nr,
    (VALUES (2, 4, 'ERP'), (2, 6, 'CRM'), (2, 8, 'ERP'), (3, 4, 'TIPO'), (3, 5, 'MAPEO'),
            (3, 6, 'TIPO'), (3, 7, 'MAPEO'), (3, 8, 'TIPO'), (3, 9, 'MAPEO')) h(r, c, v)
    WHERE n_nationkey % 2 = 0
  UNION ALL SELECT workbook, sheet, sheet_idx, h.r, h.c, h.v FROM nr,
    (VALUES (3, 4, 'ERP'), (3, 5, 'CRM'), (3, 6, 'PK'), (3, 7, 'ERP'), (3, 8, 'notas')) h(r, c, v)
    WHERE n_nationkey % 2 = 1
  UNION ALL SELECT workbook, sheet, sheet_idx, 1073741824, 0, 'Notas finales' FROM nr
  UNION ALL SELECT workbook, sheet, sheet_idx, s_suppkey + 4, x.c, x.v FROM sr,
    LATERAL (SELECT * FROM (VALUES
      (0, 'supp_' || s_suppkey), (1, s_name),
      (2, 'Saldo ' || CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR)),
      (3, CASE WHEN s_acctbal > 0 THEN 'SI' END),
      (4, CASE WHEN n_nationkey % 2 = 0 THEN 'decimal' ELSE 's_acctbal' END),
      (5, CASE WHEN n_nationkey % 2 = 0 THEN 's_acctbal' ELSE s_name END),
      (6, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 <> 0 THEN 'string' END
               ELSE 'x' END),
      (7, CASE WHEN n_nationkey % 2 = 0 THEN s_name
               ELSE CASE WHEN s_suppkey % 3 <> 0 THEN 'erp2_' || s_suppkey END END),
      (9, CASE WHEN n_nationkey % 2 = 0 AND s_suppkey % 5 = 0 THEN 'legacy_' || s_suppkey END)
    ) t(c, v)) x
  UNION ALL SELECT workbook, 'Resumen', -1, n_nationkey + 1, x.c, x.v FROM nr,
    LATERAL (SELECT * FROM (VALUES (0, n_name), (1, 'maestro'), (2, descr),
                                   (3, 'lake/suppliers_' || lower(n_name))) t(c, v)) x
  UNION ALL SELECT lower(r_name), 'Resumen', -1, 0, h.c, h.v FROM region,
    (VALUES (0, 'Entidad'), (1, 'Tipo de entidad'), (2, 'Descripción'), (3, 'Dataset')) h(c, v)
) WHERE value IS NOT NULL"""

_NR = """
SELECT lower(r_name) AS workbook, n_name AS sheet, CAST(n_nationkey AS INTEGER) AS sheet_idx,
  n_nationkey, n_name, 'Proveedores de ' || n_name || ' con saldo y nombre por sistema' AS descr
FROM nation JOIN region ON n_regionkey = r_regionkey"""

_SR = "SELECT * FROM supplier JOIN nr ON s_nationkey = n_nationkey"

_HDR = """
SELECT workbook, sheet, min_rc[1] AS header_row, min_rc[2] AS campo_col FROM (
  SELECT workbook, sheet, min([row_idx, col_idx]) AS min_rc FROM cells
  WHERE value = 'Campo' AND lower(sheet) <> 'resumen' GROUP BY workbook, sheet)"""

_FIELDS = r"""
SELECT workbook, sheet, row_idx, trim(regexp_replace(v0, '\s+', ' ', 'g')) AS campo,
  coalesce(trim(regexp_replace(v1, '\s+', ' ', 'g')), '') AS nombre,
  coalesce(trim(regexp_replace(v2, '\s+', ' ', 'g')), '') AS descripcion,
  coalesce(trim(regexp_replace(v3, '\s+', ' ', 'g')), '') AS maestro
FROM (SELECT c.workbook, c.sheet, c.row_idx,
        max(CASE WHEN c.col_idx - h.campo_col = 0 THEN value END) AS v0,
        max(CASE WHEN c.col_idx - h.campo_col = 1 THEN value END) AS v1,
        max(CASE WHEN c.col_idx - h.campo_col = 2 THEN value END) AS v2,
        max(CASE WHEN c.col_idx - h.campo_col = 3 THEN value END) AS v3
      FROM cells c JOIN hdr h USING (workbook, sheet) WHERE c.row_idx > h.header_row
      GROUP BY c.workbook, c.sheet, c.row_idx)
WHERE regexp_matches(trim(v0), '^[a-z][a-z0-9_]{1,}$')"""


def _dict_sql(body: str, *extra) -> str:
    return O.sql(body, extra=(("nr", _NR), ("sr", _SR), ("cells", _CELLS), ("hdr", _HDR),
                              *extra), recursive=True)


#: Systems declared in (TIPO, MAPEO) pairs: from the left, a named cell is taken
#: and the next one that may be is two columns on.
_PAIRED_CTES = (
    ("sysrow", """
SELECT c.workbook, c.sheet, min(c.row_idx) AS systems_row
FROM cells c JOIN hdr h USING (workbook, sheet)
WHERE c.row_idx < h.header_row AND c.col_idx >= h.campo_col + 4 AND trim(c.value) <> ''
  AND upper(trim(c.value)) = trim(c.value)
  AND trim(c.value) NOT IN ('TIPO', 'MAPEO', 'PK', 'ENTIDAD/MAESTRO', 'CAMPO', 'NOMBRE', 'RESUMEN')
  AND length(trim(c.value)) > 1
GROUP BY c.workbook, c.sheet"""),
    ("named", """
SELECT c.workbook, c.sheet, c.col_idx, trim(c.value) AS name
FROM cells c JOIN hdr h USING (workbook, sheet) JOIN sysrow s USING (workbook, sheet)
WHERE c.row_idx = s.systems_row AND c.col_idx >= h.campo_col + 4 AND trim(c.value) <> ''"""),
    ("taken(workbook, sheet, col_idx)", """
  SELECT workbook, sheet, min(col_idx) FROM named GROUP BY workbook, sheet
  UNION
  SELECT workbook, sheet, col_idx FROM (
    SELECT n.workbook, n.sheet, min(n.col_idx) AS col_idx
    FROM taken t JOIN named n ON n.workbook = t.workbook AND n.sheet = t.sheet
      AND n.col_idx >= t.col_idx + 2
    GROUP BY n.workbook, n.sheet)"""),
    ("paired", """
SELECT workbook, sheet, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS system,
  tipo_col, tipo_col + 1 AS mapeo_col
FROM (SELECT workbook, sheet, name, col_idx AS tipo_col, row_number() OVER (
        PARTITION BY workbook, sheet, name ORDER BY col_idx) AS k
      FROM taken JOIN named USING (workbook, sheet, col_idx))"""))


QUERIES = {
    "d01_find_header": (q_header, _dict_sql(
        "SELECT workbook, sheet, CAST(header_row AS INTEGER) AS header_row, "
        "CAST(campo_col AS INTEGER) AS campo_col FROM hdr")),
    "d02_systems_row": (q_systems_row, _dict_sql("""
SELECT c.workbook, c.sheet, min(c.row_idx) AS systems_row
FROM cells c JOIN hdr h USING (workbook, sheet)
WHERE c.row_idx < h.header_row AND c.col_idx >= h.campo_col + 4 AND trim(c.value) <> ''
  AND upper(trim(c.value)) = trim(c.value)
  AND trim(c.value) NOT IN ('TIPO', 'MAPEO', 'PK', 'ENTIDAD/MAESTRO', 'CAMPO', 'NOMBRE', 'RESUMEN')
  AND length(trim(c.value)) > 1
GROUP BY c.workbook, c.sheet""")),
    "d03_paired_systems": (q_paired, _dict_sql("""
SELECT workbook, sheet, system, tipo_col, mapeo_col FROM paired""", *_PAIRED_CTES)),
    "d04_inline_systems": (q_inline, _dict_sql("""
SELECT workbook, sheet,
  CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END AS system, tipo_col
FROM (SELECT c.workbook, c.sheet, trim(c.value) AS name, c.col_idx AS tipo_col,
        row_number() OVER (PARTITION BY c.workbook, c.sheet, trim(c.value)
                           ORDER BY c.col_idx) AS k
      FROM cells c JOIN hdr h USING (workbook, sheet)
      WHERE c.row_idx = h.header_row AND c.col_idx >= h.campo_col + 4
        AND trim(c.value) <> '' AND upper(trim(c.value)) = trim(c.value)
        AND trim(c.value) NOT IN ('TIPO', 'MAPEO', 'PK', 'ENTIDAD/MAESTRO', 'CAMPO', 'NOMBRE'))""")),
    "d05_field_rows": (q_fields, _dict_sql("SELECT * FROM fields", ("fields", _FIELDS))),
    "d06_system_cells": (q_system_cells, _dict_sql(r"""
SELECT workbook, sheet, row_idx, system, substr(
  CASE WHEN inline THEN CASE WHEN t <> '' THEN t ELSE '—' END
       WHEN t <> '' AND m <> '' THEN '**' || t || '**: ' || m
       WHEN t <> '' THEN t WHEN m <> '' THEN m ELSE '—' END, 1, 250) AS cell
FROM (SELECT f.workbook, f.sheet, f.row_idx, s.system, s.inline,
        coalesce(trim(regexp_replace(a.value, '\s+', ' ', 'g')), '') AS t,
        coalesce(trim(regexp_replace(b.value, '\s+', ' ', 'g')), '') AS m
      FROM fields f JOIN systems s USING (workbook, sheet)
      LEFT JOIN cells a ON a.workbook = f.workbook AND a.sheet = f.sheet
        AND a.row_idx = f.row_idx AND a.col_idx = s.tipo_col
      LEFT JOIN cells b ON b.workbook = f.workbook AND b.sheet = f.sheet
        AND b.row_idx = f.row_idx AND b.col_idx = s.mapeo_col)""",
        *_PAIRED_CTES, ("fields", _FIELDS), ("systems", """
SELECT workbook, sheet, system, tipo_col, mapeo_col, false AS inline FROM paired
UNION ALL
SELECT workbook, sheet, CASE WHEN k = 1 THEN name ELSE name || ' (' || k || ')' END, tipo_col,
  NULL, true
FROM (SELECT c.workbook, c.sheet, trim(c.value) AS name, c.col_idx AS tipo_col,
        row_number() OVER (PARTITION BY c.workbook, c.sheet, trim(c.value)
                           ORDER BY c.col_idx) AS k
      FROM cells c JOIN hdr h USING (workbook, sheet)
      WHERE c.row_idx = h.header_row AND c.col_idx >= h.campo_col + 4
        AND trim(c.value) <> '' AND upper(trim(c.value)) = trim(c.value)
        AND trim(c.value) NOT IN ('TIPO', 'MAPEO', 'PK', 'ENTIDAD/MAESTRO', 'CAMPO', 'NOMBRE'))
WHERE (workbook, sheet) NOT IN (SELECT (workbook, sheet) FROM sysrow)"""))),
    "d07_sheet_description": (q_description, _dict_sql(r"""
SELECT workbook, sheet, arg_min(trim(regexp_replace(value, '\s+', ' ', 'g')), [row_idx, col_idx])
  AS description
FROM cells c JOIN hdr h USING (workbook, sheet)
WHERE c.row_idx >= 1 AND c.row_idx < h.header_row AND length(trim(c.value)) > 20
GROUP BY workbook, sheet""")),
    "d08_entity_summary": (q_summary, _dict_sql(r"""
SELECT workbook, row_idx,
  coalesce(trim(regexp_replace(c0, '\s+', ' ', 'g')), '') AS entidad,
  coalesce(trim(regexp_replace(c1, '\s+', ' ', 'g')), '') AS tipo,
  coalesce(trim(regexp_replace(c2, '\s+', ' ', 'g')), '') AS descripcion,
  coalesce(trim(regexp_replace(c3, '\s+', ' ', 'g')), '') AS dataset
FROM (SELECT workbook, row_idx, max(CASE WHEN col_idx = 0 THEN value END) AS c0,
        max(CASE WHEN col_idx = 1 THEN value END) AS c1,
        max(CASE WHEN col_idx = 2 THEN value END) AS c2,
        max(CASE WHEN col_idx = 3 THEN value END) AS c3
      FROM cells WHERE lower(sheet) = 'resumen' GROUP BY workbook, row_idx)
WHERE c0 IS NOT NULL AND c0 <> '' AND c0 <> 'Entidad'""")),
    "a11_field_counts": (q_counts, _dict_sql("""
SELECT workbook, sheet, CAST(count(*) AS BIGINT) AS fields FROM fields GROUP BY ALL""",
                                             ("fields", _FIELDS))),
    "d09_dictionary_lines": (q_lines, None),
}
