"""The p1, p2, p5 and p7 queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import flatten, hierarchy, spatial, split_values
from orrery.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    links = cut(hierarchy.stated_links(table(spark, sf, "entities")))
    return hierarchy.resolve_hierarchy(links, with_paths=False)


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    links = cut(hierarchy.stated_links(table(spark, sf, "entities")))
    r = hierarchy.resolve_hierarchy(links)
    return r.select("node_id", "root_id", "parent_id", "depth", F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    links = cut(hierarchy.stated_links(table(spark, sf, "entities")))
    return hierarchy.descendants(hierarchy.resolve_hierarchy(links))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for t, key, c in (("entities", "record_id", "aliases"), ("entities", "record_id", "parentof"), ("associations", "assoc_id", "persons")):
        parts.append(split_values.split_packed(table(spark, sf, t), key, c, least=2).select(F.lit(f"{t}.{c}").alias("src_field"), "row_id", "pos", "item"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    cities = table(spark, sf, "cities")
    near = spatial.near_pairs(cities, "city_id", km=1.0).select(F.lit("near").alias("relation"), "id_1", "id_2")
    inside = spatial.points_in_areas(cities, table(spark, sf, "geo_areas"), "city_id")
    return near.unionByName(inside.select(F.lit("area").alias("relation"), F.col("area_id").alias("id_1"), F.col("id").alias("id_2")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.flatten_entities(table(spark, sf, "entity_raw"))


def p7_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.child_tables(p7_found(spark, sf))["addresses"]


def p1_multiple_parents(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.multiple_parents(cut(hierarchy.stated_links(table(spark, sf, "entities"))))


def p5_near(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.near_pairs(table(spark, sf, "cities"), "city_id", km=1.0)


def p5_areas(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.points_in_areas(table(spark, sf, "cities"), table(spark, sf, "geo_areas"), "city_id")


def p5_near_members(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.near_classes(table(spark, sf, "cities"), "city_id", km=1.0)[0]


def p5_near_classes(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.near_classes(table(spark, sf, "cities"), "city_id", km=1.0)[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_multiple_parents, p2_found, p5_found, p5_near, p5_areas, p5_near_members, p5_near_classes, p7_found, p7_addresses)}

# The stated links, each node's smallest parent, and the way up from each node until it ends or meets itself.
KEY = "regexp_replace(upper(trim(regexp_replace({0}, '[\\s_\\-]+', '', 'g'))), '^([^0-9]*)0+([0-9])', '\\1\\2')"
PIECES = "unnest(regexp_extract_all({0}, '([A-Za-z]+[-_ ]?[0-9]+|[0-9]+)'))"
LINKS = f"""nodes AS (SELECT {KEY.format("entity_id")} AS k, min(entity_id) AS node FROM entities WHERE regexp_matches(entity_id, '[0-9]') GROUP BY 1),
    stated AS (SELECT {KEY.format("entity_id")} AS child, {KEY.format("p")} AS parent FROM (SELECT entity_id, {PIECES.format("childof")} AS p FROM entities)
        UNION SELECT {KEY.format("p")}, {KEY.format("entity_id")} FROM (SELECT entity_id, {PIECES.format("parentof")} AS p FROM entities)),
    links AS (SELECT DISTINCT a.node AS child, b.node AS parent FROM stated JOIN nodes a ON a.k = child JOIN nodes b ON b.k = parent)"""
WAYS = f"""{LINKS}, up AS (SELECT child, min(parent) AS parent FROM links GROUP BY 1), linked AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
    ways(node, way) AS (SELECT node, [node] FROM linked UNION ALL SELECT node, list_append(way, parent) FROM ways JOIN up ON child = way[-1] WHERE NOT list_contains(way, parent)),
    ends AS (SELECT node, way, parent FROM ways LEFT JOIN up ON child = way[-1] WHERE parent IS NULL OR list_contains(way, parent)),
    solved AS (SELECT node AS node_id, CASE WHEN parent IS NULL THEN way[-1] ELSE list_min(way[list_position(way, parent):]) END AS root_id, CASE WHEN parent IS NULL THEN len(way) - 1 ELSE -1 END AS depth, CASE WHEN parent IS NULL THEN list_reverse(way) END AS path FROM ends)"""
CIRCLE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
PLACED = "placed AS (SELECT city_id, latitude, longitude FROM cities WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))"
SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {WAYS} SELECT node_id, root_id, depth FROM solved",
    "p1_paths": f"WITH RECURSIVE {WAYS} SELECT node_id, root_id, parent AS parent_id, depth, array_to_string(path, '/') AS path FROM solved LEFT JOIN up ON child = node_id",
    "p1_descendants": f"WITH RECURSIVE {WAYS} SELECT path[i] AS ancestor_id, node_id, depth + 1 - i AS distance FROM solved, unnest(range(1, len(path))) AS u(i) WHERE path IS NOT NULL",
    "p1_multiple_parents": f"WITH {LINKS} SELECT child AS node_id, parent AS parent_id, parent = min(parent) OVER (PARTITION BY child) AS followed FROM links QUALIFY count(*) OVER (PARTITION BY child) > 1",
    "p5_near": f"WITH {PLACED} SELECT a.city_id AS id_1, b.city_id AS id_2 FROM placed a JOIN placed b ON a.city_id < b.city_id AND b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 WHERE {CIRCLE} <= 1.0",
    "p5_near_members": f"WITH {PLACED} SELECT min(city_id) OVER (PARTITION BY latitude, longitude) AS rep, city_id AS id FROM placed",
    "p5_near_classes": f"WITH {PLACED}, spots AS (SELECT min(city_id) AS rep, latitude, longitude FROM placed GROUP BY 2, 3) SELECT a.rep AS rep_1, b.rep AS rep_2 FROM spots a JOIN spots b ON a.rep < b.rep AND b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 WHERE {CIRCLE} <= 1.0",
    # Crossings of a ray to the east with the edges of all rings.
    "p5_areas": f"""WITH {PLACED}, rings AS (SELECT area_id, unnest(regexp_extract_all(wkt, '\\(([^()]+)\\)', 1)) AS ring FROM geo_areas), pts AS (SELECT area_id, string_split(ring, ',') AS p FROM rings),
    edges AS (SELECT area_id, CAST(string_split(trim(p[i]), ' ')[1] AS DOUBLE) AS x1, CAST(string_split(trim(p[i]), ' ')[-1] AS DOUBLE) AS y1, CAST(string_split(trim(p[i + 1]), ' ')[1] AS DOUBLE) AS x2, CAST(string_split(trim(p[i + 1]), ' ')[-1] AS DOUBLE) AS y2 FROM pts, unnest(range(1, len(p))) AS u(i))
    SELECT area_id, city_id AS id FROM placed JOIN edges ON (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
}
