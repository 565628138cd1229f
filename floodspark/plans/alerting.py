"""Queries on weather alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import alerts as C
from floodspark.operators import alerts as op
from floodspark.operators import nearby
from floodspark.plans import query
from floodspark.sources import adapt as A
from floodspark.sources.adapt import MESSAGES, NOW, POINTS, ZONES

_EVENTS = "('Flash Flood Warning', 'Flash Flood Watch', 'Flash Flood Statement', 'Flood Warning', 'Flood Watch', 'Flood Advisory', 'Flood Statement')"
_LEVEL = """CASE split_part(event, ' ', -1) WHEN 'Watch' THEN 'watch' WHEN 'Advisory' THEN 'advisory'
  ELSE CASE WHEN NOT starts_with(event, 'Flash Flood') THEN 'warning' WHEN catastrophic THEN 'emergency' ELSE 'flash' END END"""
_KEY = "substr(vtec, 8, 4) || '.' || substr(vtec, 13, 2) || '.' || substr(vtec, 16, 1) || '.' || substr(vtec, 18, 4)"
_KEPT = f"""kept AS (SELECT *, {_LEVEL} AS level, coalesce({_KEY}, cap_id) AS key FROM messages
  WHERE event IN {_EVENTS} AND coalesce(status, 'Actual') = 'Actual' AND coalesce(message_type, '') NOT IN ('Cancel', 'Ack', 'Error')
    AND (vtec IS NULL OR vtec NOT LIKE '/T.%' AND substr(vtec, 4, 3) NOT IN ('CAN', 'UPG')) AND coalesce(coalesce(ends, expires) > TIMESTAMP '{NOW}', true))"""
_OPEN = f"""gone AS (SELECT {_KEY} AS key, max(sent) AS cancelled FROM messages WHERE vtec NOT LIKE '/T.%' AND (substr(vtec, 4, 3) = 'CAN' OR message_type = 'Cancel') GROUP BY 1),
  open_ AS (SELECT k.* FROM kept k LEFT JOIN gone g USING (key) WHERE cancelled IS NULL OR sent > cancelled)"""


def _union(name: str, column: str) -> str:
    first = f"SELECT *, row_number() OVER (PARTITION BY key, part ORDER BY sent DESC, id, i) AS r FROM (SELECT key, sent, id, unnest({column}) AS part, unnest(range(0, 2)) AS i FROM open_)"
    return f"{name} AS (SELECT key, list(part ORDER BY sent DESC, id, i) AS {column} FROM ({first}) WHERE r = 1 GROUP BY key)"


_MERGED = f"""{_union('codes', 'ugc')}, {_union('named', 'areas')},
  base AS (SELECT key, arg_max(id, (sent, -id)) AS id, arg_max(event, (sent, -id)) AS event, arg_max(level, (sent, -id)) AS level, max(sent) AS sent, max(expires) AS expires, max(ends) AS ends, count(*) AS n,
    arg_max(own_x, (sent, -id)) FILTER (WHERE own_x IS NOT NULL) AS own_x, arg_max(own_y, (sent, -id)) FILTER (WHERE own_x IS NOT NULL) AS own_y FROM open_ GROUP BY key),
  merged AS (SELECT base.*, ugc, array_to_string(areas, '; ') AS area_desc FROM base JOIN codes USING (key) JOIN named USING (key))"""


def _merged(spark, sf_dir):
    return op.merge_events(op.without_cancelled(A.messages(spark, sf_dir), A.now()))


@query(f"WITH {MESSAGES}, {_KEPT} SELECT id, level, lower(split_part(event, ' ', -1)) AS kind, key FROM kept")
def alert_filter(spark, sf_dir):
    return op.alert_filter(A.messages(spark, sf_dir), A.now()).select("id", "level", C.alert_kind(F.col("event")).alias("kind"), "key")


@query(f"WITH {MESSAGES} SELECT id, coalesce(coalesce(ends, expires) > TIMESTAMP '{NOW}', true) AS active FROM messages")
def alert_active(spark, sf_dir):
    return A.messages(spark, sf_dir).select("id", C.alert_active(F.col("ends"), F.col("expires"), A.now()).alias("active"))


@query(f"WITH {MESSAGES} SELECT id, substr(vtec, 2, 1) AS class, substr(vtec, 4, 3) AS action, substr(vtec, 8, 4) AS office, substr(vtec, 18, 4) AS etn, CASE WHEN vtec IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS ends, coalesce('https://www.weather.gov/' || lower(substr(vtec, 9, 3)) || '/', 'https://www.weather.gov/alerts') AS link FROM messages")
def parse_vtec(spark, sf_dir):
    v = C.parse_vtec(F.col("vtec"))
    return A.messages(spark, sf_dir).drop("ends").withColumn("v", v).select("id", "v.class", "v.action", "v.office", "v.etn", "v.ends", C.office_link(F.col("v.office")).alias("link"))


@query(f"WITH {MESSAGES}, {_KEPT}, {_OPEN} SELECT id, key FROM open_")
def alert_cancel(spark, sf_dir):
    return op.without_cancelled(A.messages(spark, sf_dir), A.now()).select("id", "key")


@query(f"WITH {MESSAGES}, {_KEPT}, {_OPEN}, {_MERGED} SELECT key, id, event, level, 'Headline ' || id AS headline, CASE WHEN id % 3 = 0 THEN 'Move to higher ground, ' || id END AS instruction, sent, expires, ends, n, array_to_string(ugc, ',') AS ugc, area_desc, own_x IS NOT NULL AS shaped FROM merged")
def alert_event_merge(spark, sf_dir):
    x = _merged(spark, sf_dir).withColumn("ugc", F.array_join("ugc", ","))
    return x.select("key", "id", "event", "level", "headline", "instruction", "sent", "expires", "ends", "n", "ugc", "area_desc", F.col("own_polys").isNotNull().alias("shaped"))


@query(f"WITH {MESSAGES}, {_KEPT}, {_OPEN}, {_MERGED} SELECT l AS level, count(key) AS n FROM (SELECT unnest(['advisory', 'watch', 'warning', 'flash', 'emergency']) AS l) LEFT JOIN merged ON level = l GROUP BY 1")
def alert_counts(spark, sf_dir):
    return op.level_counts(_merged(spark, sf_dir))


_SHAPED = "shaped AS (SELECT key FROM (SELECT key, unnest(ugc) AS code FROM merged WHERE own_x IS NULL) LEFT JOIN zones USING (code) WHERE code LIKE 'TX%' GROUP BY key HAVING bool_and(coalesce(has_shape, false)))"


@query(f"WITH {MESSAGES}, {_KEPT}, {_OPEN}, {_MERGED}, {ZONES}, {_SHAPED} SELECT key, CASE WHEN own_x IS NOT NULL THEN 1 WHEN key IN (SELECT key FROM shaped) THEN len(list_filter(ugc, lambda c: starts_with(c, 'TX'))) END::INTEGER AS n_polygons FROM merged")
def zone_geometry_join(spark, sf_dir):
    x = op.zone_geometry(_merged(spark, sf_dir), A.zones(spark, sf_dir))
    return x.select("key", F.when(F.col("polys").isNotNull(), F.size("polys")).alias("n_polygons"))


@query(f"""WITH {MESSAGES}, {_KEPT}, {_OPEN}, {_MERGED}, {ZONES}, {_SHAPED}, {POINTS},
  z AS (SELECT DISTINCT key, x, y FROM (SELECT key, unnest(ugc) AS code FROM merged WHERE key IN (SELECT key FROM shaped)) JOIN zones USING (code)),
  inside AS (SELECT p.id, code FROM points p JOIN zones ON has_shape AND p.lon >= x AND p.lon < x + 2.5 AND p.lat >= y AND p.lat < y + 2.0 AND NOT (p.lon >= x + 1.0 AND p.lon < x + 1.5 AND p.lat >= y + 0.75 AND p.lat < y + 1.25)),
  h AS (SELECT DISTINCT i.id, m.key FROM inside i JOIN (SELECT key, unnest(ugc) AS code FROM merged WHERE key IN (SELECT key FROM shaped)) m USING (code)
    UNION ALL SELECT p.id, key FROM points p JOIN merged ON own_x IS NOT NULL AND p.lon >= own_x AND p.lon < own_x + 1 AND p.lat >= own_y AND p.lat < own_y + 1)
  SELECT h.id, h.key AS pid, level, row_number() OVER (PARTITION BY h.id ORDER BY list_position(['advisory', 'watch', 'warning', 'flash', 'emergency'], level) DESC, sent DESC, h.key)::INTEGER AS place FROM h JOIN merged m ON m.key = h.key""")
def alerts_at_points(spark, sf_dir):
    """All alerts at each point, ranked: points meet zones and own shapes once, then alerts follow zones by their codes."""
    points, zones = A.points(spark, sf_dir), A.zones(spark, sf_dir)
    return nearby.alerts_at(points, op.zone_geometry(_merged(spark, sf_dir), zones), zones)


@query(f"WITH {ZONES} SELECT code, CASE WHEN has_shape THEN age < 7 * 24 ELSE age < 6 END AS fresh, has_shape OR age < 6 AS serves FROM (SELECT *, substr(code, 4)::INTEGER * 10 AS age FROM zones)")
def zone_cache_freshness(spark, sf_dir):
    age = F.substring("code", 4, 3).cast("int") * 10
    z = A.zones(spark, sf_dir).withColumn("fetched_at", F.timestamp_add("HOUR", -age, A.now()))
    return op.zone_cache(z, A.now())


@query("""SELECT id, state, CASE WHEN state = 'ready' THEN age END AS age_s, CASE WHEN state = 'ready' THEN age > 600 END AS stale FROM (SELECT event_id AS id, greatest(age_s, 0) AS age,
    CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'unavailable' ELSE 'loading' END WHEN age_s IS NULL OR age_s > 21600 THEN 'unavailable' ELSE 'ready' END AS state
  FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id * 13 % 40000 - 50 END AS age_s FROM events))""")
def alerts_state(spark, sf_dir):
    i = F.col("event_id")
    return op.feed_state(A.table(spark, sf_dir, "events").select(i.alias("id"), (i % 7 != 0).alias("held"), (i % 2 == 0).alias("failed"), F.when(i % 11 != 0, i * 13 % 40000 - 50).alias("age_s")))


@query(f"WITH {MESSAGES} SELECT id, array_to_string(ugc, ',') AS codes FROM messages")
def ugc_codes(spark, sf_dir):
    u = F.col("ugc")
    some = F.when(F.col("id") % 2 == 0, u)
    zones = F.transform(u, lambda c: F.concat(F.lit("https://api/zones/"), c))
    return A.messages(spark, sf_dir).select("id", F.array_join(C.ugc_codes(some, zones), ",").alias("codes"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 600 THEN substr(t, 1, 599) || '…' ELSE nullif(t, '') END AS statement FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)""")
def clean_statement(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", C.clean_statement(F.col("text")).alias("statement"))


#: A break becomes a blank, but one before a bullet first becomes a mark that no text holds.
_MARKED = r"""regexp_replace(p, '\n(\s*[*\-•]\s)', chr(1) || '\1', 'g')"""


@query(rf"""WITH d AS (SELECT doc_id, list_transform(regexp_split_to_array(replace(text, chr(13), ''), '\n{{2,}}'), lambda p: trim(replace(regexp_replace(replace({_MARKED}, chr(10), ' '), '[ \t]{{2,}}', ' ', 'g'), chr(1), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12))) AS ps FROM documents)
  SELECT doc_id, CASE WHEN ps IS NOT NULL THEN coalesce(array_to_string(list_filter(ps, lambda p: p <> ''), chr(10) || chr(10)), '') END AS text FROM d""")
def reflow_text(spark, sf_dir):
    """All documents; tests show the rules of paragraphs and bullets one by one."""
    return A.table(spark, sf_dir, "documents").select("doc_id", C.reflow_text(F.col("text")).alias("text"))


@query(f"""WITH {MESSAGES}, d AS (SELECT id, epoch_ms(sent) - epoch_ms(TIMESTAMP '{NOW}') AS ms FROM messages), m AS (SELECT *, floor(abs(ms) / 60000.0 + 0.5)::BIGINT AS m FROM d),
  t AS (SELECT *, (m // 60) || ' h' || CASE WHEN m % 60 <> 0 THEN ' ' || m % 60 || ' min' ELSE '' END AS hours FROM m)
  SELECT id, CASE WHEN m < 1 THEN 'just now' ELSE CASE WHEN ms > 0 THEN 'in ' ELSE '' END || CASE WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN hours ELSE floor(m / 1440.0 + 0.5)::BIGINT || ' d' END || CASE WHEN ms > 0 THEN '' ELSE ' ago' END END AS relative,
    CASE WHEN m < 1 THEN 'Updated just now' WHEN m < 60 THEN 'Updated ' || m || ' min ago' ELSE 'Updated ' || hours || ' ago' END AS updated FROM t""")
def alert_times(spark, sf_dir):
    sent = F.col("sent")
    age = F.abs(F.unix_millis(A.now().cast("timestamp")) - F.unix_millis(sent.cast("timestamp")))
    return A.messages(spark, sf_dir).select("id", C.relative_time(sent, A.now()).alias("relative"), C.updated_text(age).alias("updated"))
