"""DuckDB text of the mix, written from its rules rather than from its plan: draws
are numbered per source in one window, and shares come from one sorted pass."""

from __future__ import annotations

from .mixing import BLOCK_WORDS, CAP, ROUNDS, SEED, WEIGHTS


def _hashed(*parts) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _rounds() -> str:
    """One pair of CTEs per round of the permutation: rotate, then scramble."""
    out, before = [], "place0"
    for i, (turn, odd, factor) in enumerate(ROUNDS):
        out.append(f"""
turned{i} AS (
  SELECT * REPLACE ((x + floor(blocks * {turn})::BIGINT + key % blocks) % blocks AS x)
  FROM {before}),
mixed{i} AS (
  SELECT * REPLACE (CASE WHEN x <= mask
                         THEN (x * {odd} + (key % 65536) * {factor}) & mask ELSE x END AS x)
  FROM turned{i}),
round{i} AS (
  SELECT * REPLACE (CASE WHEN x <= mask THEN xor(x, x >> half) ELSE x END AS x)
  FROM mixed{i})""")
        before = f"round{i}"
    return ",".join(out)


_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

SQL = f"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM d GROUP BY source),
weighed AS (
  SELECT *, CASE sid % {len(WEIGHTS)} {_WEIGHT} END AS weight FROM totals),
stepped AS (
  SELECT *, ({CAP} * source_size) / weight::DOUBLE AS reach,
         (sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS share
  FROM weighed
  WINDOW before AS (ORDER BY ({CAP} * source_size) / weight::DOUBLE, sid
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT arg_min(share, (reach, sid)) FILTER (WHERE share <= reach) AS share
           FROM stepped),
s AS (
  SELECT sid, source, source_size,
         least(({CAP} * source_size)::DOUBLE, weight * shared.share) AS target
  FROM weighed, shared),
line AS (
  SELECT sid, blocks, quota::BIGINT AS quota,
         (coalesce(sum(quota) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING
                                    AND 1 PRECEDING), 0))::BIGINT AS lo,
         (1::BIGINT << (length(bin(blocks)) - 1)) - 1 AS mask,
         greatest(1, length(bin(blocks)) // 2) AS half,
         {_hashed(SEED, "'order'", "sid")} AS key
  FROM (SELECT *, least({CAP} * blocks, floor(target / source_size * blocks + 0.5)) AS quota
        FROM (SELECT *, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks
              FROM s WHERE source_size > 0))),
slots AS (
  SELECT slot, {_hashed(SEED, "slot")} % (SELECT sum(quota)::BIGINT FROM line) AS pos
  FROM (SELECT unnest(range((SELECT sum(quota)::BIGINT FROM line))) AS slot)),
draws AS (
  SELECT sid, quota, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS j
  FROM slots JOIN line ON pos >= lo AND pos < lo + quota),
got AS (
  SELECT *, (coalesce(sum(surplus) OVER ahead, 0))::BIGINT AS s_lo,
         (coalesce(sum(short) OVER ahead, 0))::BIGINT AS d_lo
  FROM (SELECT sid, quota, drawn, greatest(drawn - quota, 0) AS surplus,
               greatest(quota - drawn, 0) AS short
        FROM (SELECT l.sid, l.quota, count(d.sid) AS drawn
              FROM line l LEFT JOIN draws d USING (sid) GROUP BY l.sid, l.quota))
  WINDOW ahead AS (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (
  SELECT sid, d_lo + i AS k, drawn + i AS j
  FROM (SELECT *, unnest(range(short::BIGINT)) AS i FROM got WHERE short > 0)),
spare AS (
  SELECT s_lo + j - quota AS k FROM (SELECT sid, j FROM draws) JOIN got USING (sid)
  WHERE j >= quota),
taken_slots AS (
  SELECT sid, j FROM draws WHERE j < quota
  UNION ALL SELECT sid, j FROM spare JOIN wanted USING (k)),
place0 AS (
  SELECT sid, blocks, mask, half, key, j % blocks AS x FROM taken_slots JOIN line USING (sid)),
{_rounds().lstrip()},
times AS (
  SELECT sid, x AS block, count(*) AS times FROM round{len(ROUNDS) - 1} GROUP BY sid, x),
laid AS (
  SELECT doc_id, size, sid, source_size, target,
         (sum(size) OVER (PARTITION BY sid ORDER BY {_hashed("'lot'", "doc_id")},
                          doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
words AS (
  SELECT sid, pos, sum((least((block + 1) * {BLOCK_WORDS}, pos + size)
                       - greatest(block * {BLOCK_WORDS}, pos)) * times) AS taken
  FROM (SELECT sid, pos, size,
               unnest(range(pos // {BLOCK_WORDS}, (pos + size - 1) // {BLOCK_WORDS} + 1)) AS block
        FROM laid WHERE size > 0) JOIN times USING (sid, block)
  GROUP BY sid, pos)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken
FROM laid LEFT JOIN words USING (sid, pos)"""
