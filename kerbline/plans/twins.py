"""DuckDB definitions of the domain's tables, for the SQL twins."""

from __future__ import annotations

import re


def _pick(values: str, index: str) -> str:
    return f"([{values}])[{index} + 1]"


H = "'residential', 'residential', 'tertiary', 'secondary', 'primary', 'trunk', 'cycleway', 'track', 'trunk_link', 'motorway'"
S = "'asphalt', 'paved', 'gravel', 'dirt'"
P = "'Ride', 'EBikeRide', 'GravelRide', 'VirtualRide', 'Run', 'MountainBikeRide'"
CELL = "(15.0e0 * (1.0e0 / 111320.0e0))"


def hav(a: str, b: str, c: str, d: str, r: str = "6371000.0e0") -> str:
    s = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(2.0e0 * {r} * atan2(sqrt({s}), sqrt(greatest(0.0e0, 1.0e0 - {s}))))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360.0e0"
    return f"(({x}) - 360.0e0 * floor(({x}) / 360.0e0))"


DEFS = {
    "nodes": "SELECT p_partkey AS node_id, (47600000 + 1000 * (p_partkey // 20)) / 1e6 AS lat, (-117400000 + 1000 * (p_partkey % 20)) / 1e6 AS lon FROM part",
    "way_nodes": "SELECT p_partkey // 20 AS way_id, p_partkey % 20 AS pos, p_partkey AS node_id FROM part UNION ALL SELECT 1000000 + p_partkey % 20, p_partkey // 20, p_partkey FROM part",
    "ways": f"SELECT way_id, CASE WHEN way_id % 29 = 7 THEN 'service' WHEN way_id % 23 <> 5 THEN {_pick(H, 'way_id % 10')} END AS highway, CASE WHEN way_id % 19 = 3 THEN 'woodchips' WHEN way_id % 31 <> 7 THEN {_pick(S, 'way_id % 4')} END AS surface, CASE WHEN way_id % 11 = 0 THEN 'minor' END AS construction, CASE WHEN way_id % 13 = 4 THEN 'residential' END AS construction_highway, CASE WHEN way_id % 17 = 0 THEN 'private' END AS access FROM (SELECT DISTINCT way_id FROM way_nodes)",
    "pairs": "SELECT * FROM (SELECT way_id, pos, node_id AS u, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS v FROM way_nodes) WHERE v IS NOT NULL",
    "segments": f"""SELECT p.*, w.highway, w.surface, w.construction, w.construction_highway, w.access, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS length_m,
  {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} * CASE w.highway WHEN 'trunk' THEN 12e0 WHEN 'trunk_link' THEN 30e0 ELSE 1e0 END AS weight,
  w.highway IN ('trunk', 'trunk_link', 'motorway_link') AS is_avoided, w.construction IS NOT NULL OR w.construction_highway IS NOT NULL AS has_construction
FROM pairs p JOIN ways w USING (way_id) JOIN nodes a ON p.u = a.node_id JOIN nodes b ON p.v = b.node_id WHERE w.highway NOT IN ('motorway', 'service') AND w.access IS DISTINCT FROM 'private'""",
    "steps": "SELECT user_id * 100 + datediff('day', DATE '2024-01-01', ts::DATE) // 7 AS activity_id, user_id AS athlete_id, ts, event_id, value, CASE WHEN event_id % 2 = 0 THEN (event_id * 7 // 2) % 3 - 1 ELSE 0 END AS di, CASE WHEN event_id % 2 = 1 THEN (event_id * 5 // 2) % 3 - 1 ELSE 0 END AS dj FROM events",
    "points": """SELECT activity_id, athlete_id, ts, event_id, value, row_number() OVER w AS seq,
  (47600000 + 1000 * (athlete_id % 10 + sum(di) OVER r) + ((event_id * 31) % 13 - 6) * 10)::DOUBLE / 1e6 AS lat, (-117400000 + 1000 * (athlete_id % 20 + sum(dj) OVER r) + ((event_id * 17) % 13 - 6) * 10)::DOUBLE / 1e6 AS lon,
  CASE WHEN event_id % 9 > 0 THEN (event_id % 400)::DOUBLE END AS ele, event_id % 7 = 0 AS construction
FROM steps WINDOW w AS (PARTITION BY activity_id ORDER BY ts, event_id), r AS (PARTITION BY activity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "activities": f"""SELECT activity_id, athlete_id, floor(sum(floor(value * 100 + 0.5e0)) / 10)::DOUBLE AS distance_m, sum(floor(value + 0.5e0))::DOUBLE AS gain_m, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS start_date,
  CASE WHEN activity_id % 13 = 0 THEN '' WHEN activity_id % 31 = 4 THEN 'Handcycle' WHEN activity_id % 31 = 9 THEN 'EMountainBikeRide' ELSE {_pick(P, 'activity_id % 6')} END AS sport_type, CASE WHEN activity_id % 13 = 0 THEN {_pick(P, 'activity_id % 5')} ELSE 'Workout' END AS type FROM points GROUP BY ALL""",
    "biking": "SELECT * FROM activities WHERE lower(coalesce(nullif(sport_type, ''), type)) IN ('ride', 'ebikeride', 'gravelride', 'mountainbikeride', 'handcycle', 'velomobile')",
    "extents": f"SELECT *, {hav('south', 'west', 'north', 'east')} AS diagonal_m FROM (SELECT activity_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east, count(*) AS n FROM points GROUP BY 1)",
    "moving": "SELECT b.* FROM biking b JOIN extents x USING (activity_id) WHERE n >= 2 AND diagonal_m >= 250",
    "rides": "SELECT p.* FROM points p JOIN moving m USING (activity_id)",
    "legs": f"SELECT *, {hav('lat0', 'lon0', 'lat', 'lon')} AS leg_m FROM (SELECT activity_id, athlete_id, seq, lat, lon, ele, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lag(ele) OVER w AS ele0, count(*) OVER (PARTITION BY activity_id) AS n, construction FROM rides WINDOW w AS (PARTITION BY activity_id ORDER BY seq))",
    "cells": f"SELECT DISTINCT activity_id, athlete_id, floor((lat0 + (lat - lat0) * k / st) / {CELL})::BIGINT AS ci, floor((lon0 + (lon - lon0) * k / st) / {CELL})::BIGINT AS cj FROM (SELECT *, unnest(range(0, st::BIGINT + 1)) AS k FROM (SELECT *, greatest(1.0e0, ceil(leg_m / 15.0e0)) AS st FROM legs WHERE lat0 IS NOT NULL))",
    "densified": "SELECT activity_id, lat0 + (lat - lat0) * k / st AS lat, lon0 + (lon - lon0) * k / st AS lon FROM (SELECT *, unnest(range(0, st::BIGINT)) AS k FROM (SELECT *, greatest(1.0e0, floor(sqrt(power((lat - lat0) * 111320.0e0, 2) + power((lon - lon0) * 111320.0e0 * cos(radians(lat0)), 2)) / 12.0e0)) AS st FROM legs WHERE lat0 IS NOT NULL)) UNION ALL SELECT activity_id, lat, lon FROM legs WHERE seq = n",
    "seg_cells": "SELECT DISTINCT way_id, pos, lat1, lon1, lat2, lon2, floor(y / 0.005e0)::BIGINT AS ci, floor(x / 0.005e0)::BIGINT AS cj FROM (SELECT *, unnest([lat1, lat2, (lat1 + lat2) / 2]) AS y, unnest([lon1, lon2, (lon1 + lon2) / 2]) AS x FROM segments)",
    "near": """SELECT way_id, pos, t, len FROM (SELECT way_id, pos, t, sqrt(dx * dx + dy * dy) AS len, sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS dist FROM (
  SELECT *, greatest(0.0e0, least(1.0e0, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0.0e0), 0.0e0))) AS t FROM (
  SELECT s.way_id, s.pos, (lon2 - lon1) * cos(radians(d.lat)) * 111320.0e0 AS dx, (lat2 - lat1) * 111320.0e0 AS dy, (d.lon - lon1) * cos(radians(d.lat)) * 111320.0e0 AS px, (d.lat - lat1) * 111320.0e0 AS py
  FROM densified d JOIN seg_cells s ON floor(d.lat / 0.005e0)::BIGINT = s.ci AND floor(d.lon / 0.005e0)::BIGINT = s.cj))) WHERE dist <= 20.0e0""",
    "touched": "SELECT way_id, pos, min(t) AS t0, max(t) AS t1, max(len) AS len FROM near GROUP BY ALL",
    "ridden": "SELECT way_id, pos FROM touched WHERE (t1 - t0) * len >= 11.0e0 OR t1 - t0 >= 0.6e0",
    "vertices": "SELECT n.* FROM nodes n SEMI JOIN (SELECT DISTINCT unnest([u, v]) AS node_id FROM segments) s USING (node_id)",
    "boxes": "SELECT s_suppkey AS area_id, (47600000 + 1000 * (s_suppkey % 90)) / 1e6 AS south, (-117400000 + 1000 * (s_suppkey % 14)) / 1e6 AS west, (47600000 + 1000 * (s_suppkey % 90 + 5)) / 1e6 AS north, (-117400000 + 1000 * (s_suppkey % 14 + 5)) / 1e6 AS east FROM supplier",
    "corners": "SELECT s_suppkey AS polygon_id, i, (47600500 + 1000 * (s_suppkey % 90 + ([0, 0, 6, 3, 6])[i])) / 1e6 AS y1, (-117400500 + 1000 * (s_suppkey % 14 + ([0, 6, 6, 3, 0])[i])) / 1e6 AS x1, (47600500 + 1000 * (s_suppkey % 90 + ([0, 0, 6, 3, 6])[i % 5 + 1])) / 1e6 AS y2, (-117400500 + 1000 * (s_suppkey % 14 + ([0, 6, 6, 3, 0])[i % 5 + 1])) / 1e6 AS x2 FROM supplier, range(1, 6) r(i)",
    "inside": "SELECT polygon_id, node_id FROM corners JOIN nodes ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0.0e0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1",
    "required": "SELECT DISTINCT area_id, least(u, v) AS u, greatest(u, v) AS v, min(length_m) AS length_m FROM boxes JOIN segments s ON NOT is_avoided AND ((lat1 BETWEEN south - 0.0001e0 AND north + 0.0001e0 AND lon1 BETWEEN west - 0.0001e0 AND east + 0.0001e0) OR (lat2 BETWEEN south - 0.0001e0 AND north + 0.0001e0 AND lon2 BETWEEN west - 0.0001e0 AND east + 0.0001e0)) ANTI JOIN ridden r ON s.way_id = r.way_id AND s.pos = r.pos GROUP BY ALL",
    "streets": "SELECT area_id, least(u, v) AS u, greatest(u, v) AS v, min(round(s.weight)) AS w, min(round(s.weight) * CASE WHEN r.way_id IS NULL THEN 1 ELSE 4 END) AS w4, bool_or(r.way_id IS NOT NULL) AS took, min(CASE WHEN r.way_id IS NULL AND NOT is_avoided AND highway NOT IN ('cycleway', 'track') THEN round(s.weight) END) AS fresh FROM boxes JOIN segments s ON ((lat1 BETWEEN south - 0.0001e0 AND north + 0.0001e0 AND lon1 BETWEEN west - 0.0001e0 AND east + 0.0001e0) OR (lat2 BETWEEN south - 0.0001e0 AND north + 0.0001e0 AND lon2 BETWEEN west - 0.0001e0 AND east + 0.0001e0)) LEFT JOIN ridden r ON s.way_id = r.way_id AND s.pos = r.pos GROUP BY ALL",
    "places": "SELECT n_nationkey::BIGINT AS place_key, 'City ' || (n_nationkey % 9) AS city, 'County ' || (n_nationkey % 6) AS county, n_name AS state, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "centers": "SELECT activity_id, athlete_id, avg(lat) AS lat, avg(lon) AS lon FROM rides GROUP BY ALL",
    "buckets": "SELECT y AS bucket_lat, x AS bucket_lon, p.* FROM (SELECT unnest(range(min(floor(lat * 20 + 0.5e0))::BIGINT - 3, max(floor(lat * 20 + 0.5e0))::BIGINT + 4)) AS y FROM nodes) CROSS JOIN (SELECT unnest(range(min(floor(lon * 20 + 0.5e0))::BIGINT - 3, max(floor(lon * 20 + 0.5e0))::BIGINT + 4)) AS x FROM nodes) JOIN places p ON ((y * 7 + x * 3) % 25 + 25) % 25 = place_key",
    "located": "SELECT c.activity_id, c.athlete_id, b.* FROM centers c JOIN buckets b ON floor(c.lat * 20 + 0.5e0) = bucket_lat AND floor(c.lon * 20 + 0.5e0) = bucket_lon",
    "comments": "SELECT event_id, user_id AS athlete_id, ts, CASE event_id % 4 WHEN 0 THEN 'my FTP is ' || k || '0 today, felt like ' || k WHEN 1 THEN k || '4W for the 20 min test which is ' || k || '2W ftp' WHEN 2 THEN 'rode ' || k || ' miles at 200 watts' ELSE 'Ftp? ' || k || '1 or 2' || k END AS text FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)",
    "tokens": "SELECT event_id, athlete_id, ts, tok, sum(length(tok)) OVER (PARTITION BY event_id ORDER BY i) - length(tok) AS spot FROM (SELECT event_id, athlete_id, ts, unnest(regexp_extract_all(text, '[fF][tT][pP]|[0-9]{2,3}|(?s:.)')) AS tok, generate_subscripts(regexp_extract_all(text, '[fF][tT][pP]|[0-9]{2,3}|(?s:.)'), 1) AS i FROM comments)",
}


def sql(body: str, recursive: bool = False) -> str:
    """The body behind WITH and the definitions that it needs."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in DEFS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(DEFS[name])
                if name not in need:
                    need.append(name)

    add(body)
    lead = ",\n".join(f"{n} AS ({DEFS[n]})" for n in need)
    if body.startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{lead}{', ' if lead else ''}{body[5:]}"
    return f"WITH {lead}\n{body}" if lead else body
