"""Library operators applied to the driver tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import library as L
from medialake.operators import relations as O
from medialake.plans.catalogue_queries import Tables, _hav, query, scaled

_TAG = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'custom' ELSE 'c' || doc_id % 4 END AS category, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'q' || quality END AS value, CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'path' WHEN 2 THEN 'ai' ELSE 'other' END AS source FROM labels"


def _tags(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    source = F.element_at(F.array(*map(F.lit, ("user", "path", "ai", "other"))), (d % 4 + 1).cast("int"))
    return Tables(spark, sf_dir).labels.select("doc_id", F.when(d % 3 == 0, "custom").otherwise(F.concat(F.lit("c"), d % 4)).alias("category"), F.when(F.col("toxic") == 1, "toxic").otherwise(F.concat(F.lit("q"), F.col("quality"))).alias("value"), source.alias("source"))


@query(f"""WITH t AS ({_TAG}), u AS (SELECT * FROM t UNION ALL SELECT doc_id, category, value, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'other' END FROM t WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'z', 'z', 'path' FROM t WHERE doc_id % 3 = 1),
r AS (SELECT *, CASE source WHEN 'user' THEN 0 WHEN 'path' THEN 1 WHEN 'ai' THEN 2 ELSE 3 END AS k FROM u), b AS (SELECT doc_id, category, value, arg_min(source, k) AS source, min(k) AS k FROM r GROUP BY 1, 2, 3),
a AS (SELECT doc_id, string_agg(category || '=' || value || '/' || source, ',' ORDER BY k, category, value) AS tags FROM b GROUP BY 1)
SELECT d.doc_id, d.source, coalesce(a.tags, '') AS tags FROM documents d LEFT JOIN a USING (doc_id)""")
def footage_scan(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    again = tags.where("doc_id % 5 = 0").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "user").otherwise("other"))
    more = tags.where("doc_id % 3 = 1").select("doc_id", *[F.lit(v).alias(c) for c, v in (("category", "z"), ("value", "z"), ("source", "path"))])
    rows = L.with_tags(Tables(spark, sf_dir).documents.select("doc_id", F.col("source").alias("folder")), tags.unionByName(again).unionByName(more), "doc_id")
    return rows.select("doc_id", F.col("folder").alias("source"), F.array_join(F.transform("tags", lambda t: F.concat(t["category"], F.lit("="), t["value"], F.lit("/"), t["source"])), ",").alias("tags"))


@query("WITH g AS (SELECT sha256(text) AS h FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT h, doc_id FROM documents d JOIN g ON sha256(d.text) = h")
def dup_members(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.sha2("text", 256).alias("h"), "doc_id")
    return L.with_members(O.duplicate_groups(d, "h"), d, "h", "doc_id").select("h", "doc_id")


@query(f"""WITH t AS ({_TAG}) SELECT 'folder' AS how, doc_id FROM documents WHERE source = 'src1' OR starts_with(source, 'src1/') UNION ALL SELECT 'category', doc_id FROM t WHERE category = 'custom'
UNION ALL SELECT 'warehouse', doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'itinerary', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def select_by(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = L.with_tags(t.documents.select("doc_id", F.col("lang").alias("warehouse"), F.col("source").alias("directory")), _tags(spark, sf_dir), "doc_id")
    members = t.labels.where("quality = 1").select("doc_id", F.lit("trip").alias("owner"))
    out = None
    for name, value in (("folder", "src1"), ("category", "custom"), ("warehouse", "en"), ("itinerary", "trip")):
        part = L.select_by(rows, name, value, members, key="doc_id").select(F.lit(name).alias("how"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


_PLACED = """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 0.0 ELSE CAST(doc_id % 100 - 5 AS DOUBLE) END AS latitude, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 0.0 ELSE CAST(doc_id % 179 AS DOUBLE) END AS longitude,
CASE doc_id % 6 WHEN 0 THEN 'itinerary' WHEN 1 THEN 'gpx' WHEN 2 THEN 'user' WHEN 3 THEN 'header' END AS gps_source, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 2 THEN 'audio' ELSE 'video' END AS kind, CASE WHEN doc_id % 10 = 0 THEN 'missing' ELSE 'available' END AS status, n_chars, source, lang FROM documents"""
_USABLE = "(latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (abs(latitude) < 1e-4 AND abs(longitude) < 1e-4))"
_MISPLACED = f"(coalesce(gps_source = 'itinerary', false) OR ((latitude IS NOT NULL OR longitude IS NOT NULL OR gps_source IS NOT NULL) AND NOT {_USABLE}))"


def _placed(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    part = lambda m, s: F.when(d % 5 == 0, None).when(d % 7 == 0, 0.0).otherwise((d % m - s).cast("double"))
    source = F.when(d % 6 == 0, "itinerary").when(d % 6 == 1, "gpx").when(d % 6 == 2, "user").when(d % 6 == 3, "header")
    kind = F.when(d % 4 == 0, "image").when(d % 4 == 2, "audio").otherwise("video")
    return Tables(spark, sf_dir).documents.select(d.alias("id"), part(100, 5).alias("latitude"), part(179, 0).alias("longitude"), source.alias("gps_source"), kind.alias("kind"), F.when(d % 10 == 0, "missing").otherwise("available").alias("status"), "n_chars", "source", "lang")


@query(f"SELECT id, CASE WHEN {_MISPLACED} THEN NULL ELSE latitude END AS latitude, CASE WHEN {_MISPLACED} THEN NULL ELSE gps_source END AS gps_source FROM ({_PLACED})")
def clear_misplaced(spark, sf_dir):
    return L.clear_misplaced_gps(_placed(spark, sf_dir))[0].select("id", "latitude", "gps_source")


@query(f"""SELECT id, CASE WHEN {_USABLE} THEN coalesce(gps_source, 'header') END AS resolved, coalesce(CASE WHEN {_USABLE} THEN coalesce(gps_source, 'header') END IN ('header', 'user'), false) AS anchor,
NOT {_USABLE} OR coalesce(gps_source = 'gpx', false) AS may_write, status = 'available' AND (kind = 'image' OR kind = 'video' AND n_chars >= 8192) AS taggable, CASE kind WHEN 'video' THEN 0 WHEN 'image' THEN 1 ELSE 2 END AS kind_order FROM ({_PLACED})""")
def row_facts(spark, sf_dir):
    at = [F.col(c) for c in ("latitude", "longitude", "gps_source")]
    return _placed(spark, sf_dir).select("id", C.gps_source(*at).alias("resolved"), C.reliable_anchor(*at).alias("anchor"), C.may_write_gps(*at).alias("may_write"), C.ai_taggable(F.col("status"), F.col("kind"), F.col("n_chars")).alias("taggable"), C.kind_order(F.col("kind")).alias("kind_order"))


@query(f"SELECT id FROM ({_PLACED}) WHERE status = 'available' AND kind IN ('image', 'video') AND NOT {_USABLE} AND n_chars % 3 <> 0")
def gpx_eligible(spark, sf_dir):
    return L.gpx_eligible(_placed(spark, sf_dir).withColumn("captured_s", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")))).select("id")


@query(f"""WITH s AS (SELECT source AS target, min(n_chars) + 10 AS a, max(n_chars) - 50 AS b FROM ({_PLACED}) GROUP BY 1)
SELECT target, count(*) AS n FROM ({_PLACED}) JOIN s ON source = target WHERE status = 'available' AND kind IN ('image', 'video') AND n_chars BETWEEN a AND b GROUP BY 1""")
def gpx_belongs(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumnsRenamed({"source": "target", "n_chars": "captured_s"})
    spans = rows.groupBy("target").agg((F.min("captured_s") + 10).alias("start_s"), (F.max("captured_s") - 50).alias("end_s"))
    return L.belongs_to_track(rows, spans).groupBy("target").agg(F.count("*").alias("n"))


@query(f"WITH t AS ({_TAG}) SELECT doc_id, category, value, source FROM t WHERE NOT (doc_id % 2 = 0 AND source = 'ai') AND doc_id % 9 <> 0")
def tag_remove(spark, sf_dir):
    tags, keys = _tags(spark, sf_dir), ["doc_id", "category", "value"]
    return L.remove_tags(L.remove_tags(tags, tags.where("doc_id % 2 = 0"), keys, "ai"), tags.where("doc_id % 9 = 0"), keys)


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 3 <> 0")
def delete_cascade(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs, labels = L.delete_cascade(t.documents.where("doc_id % 3 = 0"), "doc_id", t.documents.select("doc_id"), t.labels)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("documents", docs).unionByName(count("labels", labels))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'merged' END ELSE c_mktsegment END AS resolution FROM customer")
def set_resolution(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "merged").alias("resolution"))
    return L.set_value(c.select("c_custkey", F.col("c_mktsegment").alias("resolution")), changes, "c_custkey", "resolution")


_RANK = "CASE {} WHEN 'user' THEN 0 WHEN 'path' THEN 1 WHEN 'ai' THEN 2 ELSE 3 END"


@query(f"WITH t AS ({_TAG}) SELECT doc_id, category, value, 'path' AS source FROM t WHERE {_RANK.format('source')} >= 1 UNION ALL SELECT doc_id, 'new', 'x', 'path' FROM t WHERE doc_id % 5 = 0")
def tag_incoming(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    incoming = tags.withColumn("source", F.lit("path")).unionByName(tags.where("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("category"), F.lit("x").alias("value"), F.lit("path").alias("source")))
    return L.keep_by_precedence(tags, incoming, ["doc_id", "category", "value"])


_SORTED = "SELECT doc_id AS id, 'f' || doc_id % 200 AS filename, lpad(CAST(doc_id % 200 AS VARCHAR), 20, '0') AS nat, n_chars % 50 AS score, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars % 90 END AS captured_at, n_chars % 70 AS modified, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars % 40 END AS duration, n_chars AS size, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 2 THEN 'audio' ELSE 'video' END AS kind FROM documents"
_ORDERS = [("relevance", "score DESC"), ("filename", "nat ASC"), ("captured_at", "captured_at DESC NULLS LAST"), ("modified", "modified DESC"), ("duration", "duration DESC NULLS LAST"), ("size", "size DESC"), ("kind", "CASE kind WHEN 'video' THEN 0 WHEN 'image' THEN 1 ELSE 2 END ASC")]


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS sort, id, CAST(row_number() OVER (ORDER BY {o}, nat, id) AS INT) AS place FROM ({_SORTED}) ORDER BY place LIMIT 30)" for n, o in _ORDERS))
def library_sort(spark, sf_dir):
    from pyspark.sql import Window

    d, n = F.col("doc_id"), F.col("n_chars")
    kind = F.when(d % 4 == 0, "image").when(d % 4 == 2, "audio").otherwise("video")
    rows = Tables(spark, sf_dir).documents.select(d.alias("id"), F.concat(F.lit("f"), d % 200).alias("filename"), (n % 50).alias("score"), F.when(d % 6 != 0, n % 90).alias("captured_at"), (n % 70).alias("modified"), F.when(d % 4 != 0, n % 40).alias("duration"), n.alias("size"), kind.alias("kind"))
    out = None
    for name in L.ASCENDING:
        top = rows.orderBy(*L.sort_order(name)).limit(30)
        part = top.select(F.lit(name).alias("sort"), "id", F.row_number().over(Window.orderBy(*L.sort_order(name))).alias("place"))  # 30 rows
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_name, row_number() OVER (ORDER BY last DESC NULLS LAST, p_name) AS place FROM (SELECT p_name, max(CASE WHEN p_partkey % 10 = 0 THEN p_partkey END) AS last FROM part GROUP BY 1) ORDER BY place LIMIT 20")
def recent_first(spark, sf_dir):
    from pyspark.sql import Window

    p = Tables(spark, sf_dir).part
    used = p.where("p_partkey % 10 = 0").select("p_name", F.col("p_partkey").alias("at"))
    top = L.recent_first(p, used, "p_name", "at", 20).join(used.groupBy("p_name").agg(F.max("at").alias("last")), "p_name", "left")
    return top.select("p_name", F.row_number().over(Window.orderBy(F.col("last").desc_nulls_last(), "p_name")).cast("long").alias("place"))  # 20 rows


@query("""WITH k AS (SELECT c_custkey AS k, 'old' AS label, c_custkey % 97 AS used FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, 'new' AS label, 1000 + c_custkey AS used FROM customer WHERE c_custkey % 11 = 0)
SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM k WHERE k NOT IN (SELECT k FROM n)) ORDER BY used DESC, k LIMIT 60""")
def lru_upsert(spark, sf_dir):
    k = F.col("c_custkey")
    c = Tables(spark, sf_dir).customer
    old = c.where(k % 2 == 0).select(k.alias("k"), F.lit("old").alias("label"), (k % 97).alias("used"))
    return L.move_to_front(old, c.where(k % 11 == 0).select(k.alias("k"), F.lit("new").alias("label"), (k + 1000).alias("used")), "k", "used", 60)


_NAMES = [("subject", "widget", "Widget", "Apparat", 0), ("subject", "bolt", "Screw Bolt", "Bolzen", 1), ("colour", "red", "Red", "rot", 2), ("colour", "ruby", "red", "rubin", 3)]


def _catalogue(spark) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("category"), F.lit(t).alias("tag"), F.create_map(F.lit("en"), F.lit(e), F.lit("de"), F.lit(d)).alias("names"), F.lit(o).alias("ord")) for c, t, e, d, o in _NAMES]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_CAT = "(VALUES " + ", ".join(f"('{c}', '{t}', '{e}', '{d}', {o})" for c, t, e, d, o in _NAMES) + ") AS c(category, tag, en, de, ord)"


@query(f"""WITH c AS (SELECT * FROM {_CAT}), x AS (SELECT DISTINCT p_partkey, 'custom' AS category, unnest(string_split(p_name, ' ')) AS value FROM part UNION SELECT p_partkey, 'subject', 'bolt' FROM part WHERE p_partkey % 7 = 0),
n AS (SELECT w, arg_min(category, ord) AS category, arg_min(tag, ord) AS tag, arg_min(en, ord) AS en FROM (SELECT lower(unnest([tag, en, de])) AS w, category, tag, en, ord FROM c) GROUP BY w),
g AS (SELECT 'gear' AS w, 'cog' AS o UNION ALL SELECT 'cog', 'gear')
SELECT DISTINCT p_partkey, category, value FROM (SELECT * FROM x UNION ALL SELECT p_partkey, 'custom', o FROM x JOIN g ON category = 'custom' AND lower(value) = w UNION ALL SELECT p_partkey, n.category, tag FROM x JOIN n ON x.category = 'custom' AND lower(value) = w
UNION ALL SELECT p_partkey, 'custom', lower(en) FROM x JOIN n ON x.category = 'custom' AND lower(value) = w WHERE lower(en) <> lower(value) UNION ALL SELECT p_partkey, 'custom', lower(en) FROM x JOIN c ON x.category = c.category AND value = tag)""")
def catalog_expand(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    words = p.select("p_partkey", F.lit("custom").alias("category"), F.explode(F.split("p_name", " ")).alias("value")).distinct()
    tags = words.unionByName(p.where("p_partkey % 7 = 0").select("p_partkey", F.lit("subject").alias("category"), F.lit("bolt").alias("value"))).withColumn("source", F.lit("user"))
    glossary = spark.range(1).select(F.lit("gear").alias("a"), F.lit("cog").alias("b"))
    return L.expand_tags(tags, _catalogue(spark), glossary, ["p_partkey"]).drop("source")


_WORDS = [("small ring", "band"), ("red", "crimson"), ("widget", "device"), ("wi", "short"), ("olt", "latch"), ("bolt", "fastener"), ("ring", "loop"), ("gea", "wheel")]


@query(f"""WITH RECURSIVE d AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _WORDS)}) AS t(w, e)), t AS (SELECT p_partkey, lower(trim(p_name)) AS s FROM part), x AS (SELECT p_partkey, e FROM t JOIN d ON s = w),
m AS (SELECT s, i, max(length(w)) AS len FROM (SELECT DISTINCT s, unnest(range(1, length(s) + 1)) AS i FROM t WHERE s NOT IN (SELECT w FROM d)) JOIN d ON substr(s, i, length(w)) = w AND length(w) <= 6 GROUP BY ALL),
f AS (SELECT s, 0 AS e_at, 0 AS i FROM m GROUP BY s UNION ALL SELECT * FROM (SELECT f.s, CAST(m.i + m.len - 1 AS INT), CAST(m.i AS INT) FROM f JOIN m ON m.s = f.s AND m.i > f.e_at QUALIFY row_number() OVER (PARTITION BY f.s ORDER BY m.i) = 1))
SELECT DISTINCT p_partkey, e AS english FROM (SELECT * FROM x UNION ALL SELECT p_partkey, d.e FROM t JOIN f USING (s) JOIN d ON f.i > 0 AND d.w = substr(f.s, f.i, f.e_at - f.i + 1))""")
def dictionary_lookup(spark, sf_dir):
    words = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("word"), F.lit(b).alias("english")) for a, b in _WORDS])).alias("r")).select("r.*")
    return L.dictionary_words(Tables(spark, sf_dir).part, "p_partkey", "p_name", words)


@query(f"""WITH t AS ({_TAG}) SELECT doc_id, category, value FROM t WHERE (category = 'c1' AND value = 'q1') OR (category = 'custom' AND value <> 'toxic' AND value = 'q0')
UNION ALL SELECT doc_id, 'custom', 'über' FROM t WHERE doc_id % 4 = 0""")
def allowed_tags(spark, sf_dir):
    tags = _tags(spark, sf_dir).drop("source")
    more = tags.unionByName(tags.where("doc_id % 4 = 0").select("doc_id", F.lit("custom").alias("category"), F.lit("über").alias("value")))
    one = lambda **kw: spark.range(1).select(*[F.lit(v).alias(k) for k, v in kw.items()])
    return L.allowed_tags(more, one(category="c1", tag="q1"), one(value="q0").unionByName(one(value="toxic")), one(value="#Toxic"))


@query("""WITH t AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT id, CAST(floor(value * 10000 + 0.5) AS BIGINT) AS value FROM (SELECT p.id, t.value, row_number() OVER (PARTITION BY p.id ORDER BY abs(epoch_us(t.ts) - epoch_us(p.ts)), t.ts) AS k FROM p LEFT JOIN t ON t.user_id = p.user_id) WHERE k = 1""")
def nearest_time(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    probes = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return L.nearest_in_time(probes, e.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("id", scaled(F.col("value")).alias("value"))


_STAYS = "SELECT user_id, event_id AS stay, epoch_us(ts) // 1000000 AS a, least(epoch_us(ts) // 1000000 + event_id % 4 * 30 * 40, coalesce(lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) - 1, epoch_us(ts) // 1000000 + event_id % 4 * 30 * 40)) AS b FROM (SELECT * FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000000 ORDER BY event_id) = 1)"


@query(f"""WITH s AS ({_STAYS}), p AS (SELECT event_id AS id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'error'),
j AS (SELECT id, p.user_id, t, (SELECT arg_min(stay, a) FROM s WHERE s.user_id = p.user_id AND t BETWEEN a - 400000 AND b + 400000) AS inside, (SELECT max(b) FROM s WHERE s.user_id = p.user_id AND b <= t) AS pb, (SELECT min(a) FROM s WHERE s.user_id = p.user_id AND a >= t) AS na FROM p)
SELECT j.user_id, id, CASE WHEN inside IS NOT NULL THEN 'inside' WHEN pb IS NULL AND na IS NULL THEN NULL WHEN na IS NULL OR t - pb <= na - t THEN 'previous' ELSE 'next' END AS relation,
CASE WHEN inside IS NOT NULL THEN inside WHEN pb IS NULL AND na IS NULL THEN NULL WHEN na IS NULL OR t - pb <= na - t THEN x.stay ELSE y.stay END AS stay FROM j LEFT JOIN s x ON x.user_id = j.user_id AND x.b = pb LEFT JOIN s y ON y.user_id = j.user_id AND y.a = na""")
def stay_lookup(spark, sf_dir):
    from pyspark.sql import Window

    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t_s"))
    begun = O.first_by(e.where("event_type = 'signup'"), ["user_id", "t_s"], F.col("event_id"))
    following = F.lead("t_s").over(Window.partitionBy("user_id").orderBy("t_s")) - 1
    long = F.col("t_s") + F.col("event_id") % 4 * 1200
    stays = begun.select("user_id", F.col("event_id").alias("stay"), F.col("t_s").alias("start_s"), F.least(long, F.coalesce(following, long)).alias("end_s"))
    return L.stay_of(e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", "t_s"), stays, ["user_id"], 400_000).select("user_id", "id", "relation", "stay")


_ZONED = """SELECT user_id, event_id AS pos, epoch_us(ts) // 1000000 AS utc_s, epoch_us(ts) // 1000000 + (user_id % 5) * 3600 + event_id % 3 * 100 + CASE WHEN user_id % 4 = 0 THEN 100000 ELSE 0 END AS civil_s,
CASE WHEN user_id % 7 = 0 THEN NULL ELSE 10.0 END AS latitude, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(event_id % 170 AS DOUBLE) - 80 END AS longitude, event_type = 'view' AS has_zone FROM events"""
_OFFSETS = f"""SELECT u.user_id, coalesce(q, CAST(floor(abs(lon) / 15 + 0.5) * sign(lon) * 3600 AS BIGINT), 0) AS offset_s FROM (SELECT DISTINCT user_id FROM z) u
LEFT JOIN (SELECT user_id, q FROM (SELECT user_id, CAST(floor((civil_s - utc_s) / 900.0 + 0.5) * 900 AS BIGINT) AS q FROM z WHERE latitude IS NOT NULL AND has_zone) WHERE abs(q) <= 50400 GROUP BY user_id, q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, q) = 1) m USING (user_id)
LEFT JOIN (SELECT user_id, arg_min(longitude, pos) AS lon FROM z WHERE latitude IS NOT NULL GROUP BY 1) l USING (user_id)"""


def _zoned(spark, sf_dir) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    utc = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    civil = utc + (u % 5) * 3600 + e % 3 * 100 + F.when(u % 4 == 0, 100000).otherwise(0)
    return Tables(spark, sf_dir).events.select("user_id", e.alias("pos"), utc.alias("utc_s"), civil.alias("civil_s"), F.when(u % 7 != 0, 10.0).alias("latitude"), F.when(u % 7 != 0, (e % 170).cast("double") - 80).alias("longitude"), (F.col("event_type") == "view").alias("has_zone"))


@query(f"WITH z AS ({_ZONED}) {_OFFSETS}")
def utc_offset(spark, sf_dir):
    return L.utc_offset(_zoned(spark, sf_dir), ["user_id"])


@query(f"WITH z AS ({_ZONED}), o AS ({_OFFSETS}) SELECT pos, CAST(CASE WHEN has_zone THEN utc_s ELSE coalesce(civil_s - offset_s, utc_s) END AS BIGINT) AS aligned_s FROM z JOIN o USING (user_id)")
def aligned_instant(spark, sf_dir):
    rows = _zoned(spark, sf_dir)
    return L.aligned_instant(rows, L.utc_offset(rows, ["user_id"]), ["user_id"]).select("pos", "aligned_s")


@query(f"""SELECT s_suppkey AS id, CAST(floor({_hav("CAST(s_suppkey % 80 AS DOUBLE)", "179.999", "CAST(s_suppkey % 80 AS DOUBLE)", "-179.9995")} + 0.5) AS BIGINT) AS metres FROM supplier""")
def date_line_nearest(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    probes = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 80).cast("double").alias("lat"), F.lit(179.999).alias("lon"))
    places = probes.select((F.col("id") % 80).alias("place"), "lat", F.lit(-179.9995).alias("lon")).distinct()
    return O.grid_nearest(probes, places, 1000.0).select("id", scaled(F.col("metres"), 1).alias("metres"))


@query("""WITH u AS (SELECT 'n' || c_custkey % 7 || ' ' || c_custkey // 7 AS name FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT 'n' || r_regionkey FROM region), b AS (SELECT 'n' || i AS name FROM range(9) t(i) UNION ALL SELECT ' '),
c AS (SELECT name, i, CASE WHEN i = 1 THEN s ELSE s || ' ' || i END AS x FROM (SELECT name, coalesce(nullif(trim(name), ''), 'n1') AS s FROM b), range(1, 200) t(i))
SELECT name, arg_min(x, i) AS "unique" FROM c WHERE x NOT IN (SELECT name FROM u) GROUP BY 1""")
def unique_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = F.col("c_custkey")
    numbered = t.customer.where(k % 11 != 0).select(F.concat(F.lit("n"), k % 7, F.lit(" "), F.floor(k / 7)).alias("name"))
    used = numbered.unionByName(t.region.select(F.concat(F.lit("n"), "r_regionkey").alias("name")))
    wanted = spark.range(9).select(F.concat(F.lit("n"), "id").alias("name")).unionByName(spark.range(1).select(F.lit(" ").alias("name")))
    return L.unique_names(wanted, used, "name", "n1")


@query(f"WITH t AS ({_TAG}) SELECT doc_id, category, value, CASE WHEN doc_id % 2 = 0 AND source <> 'user' THEN 'path' ELSE source END AS source FROM t UNION ALL SELECT doc_id, 'new', 'x', 'ai' FROM t WHERE doc_id % 5 = 0")
def union_tags(spark, sf_dir):
    tags = _tags(spark, sf_dir)
    new = tags.where("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("category"), F.lit("x").alias("value"), F.lit("ai").alias("source"))
    return L.union_tags(tags, tags.where("doc_id % 2 = 0").withColumn("source", F.lit("path")).unionByName(new), ["doc_id", "category", "value"])


@query("SELECT l_orderkey, l_returnflag, CAST(floor(max(CAST(l_discount AS DOUBLE)) * 1e4 + 0.5) AS BIGINT) AS confidence FROM lineitem GROUP BY 1, 2")
def label_confidence(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_returnflag", F.col("l_discount").cast("double").alias("confidence"))
    return L.label_confidence(rows, ["l_orderkey"], "l_returnflag", "confidence").withColumn("confidence", scaled(F.col("confidence")))


@query("SELECT count(*) FILTER (doc_id % 6 = 0) AS n_tagged, count(*) FILTER (doc_id % 6 = 1) AS n_failed, count(*) FILTER (doc_id % 6 = 2) AS n_skipped, count(*) FILTER (doc_id % 6 > 2) AS n_remaining FROM documents")
def run_tallies(spark, sf_dir):
    m = F.col("doc_id") % 6
    outcome = F.when(m == 0, "tagged").when(m == 1, "failed").when(m == 2, "skipped").when(m == 3, "running")
    return L.run_tallies(Tables(spark, sf_dir).documents.select(outcome.alias("outcome")), "outcome")


@query(f"SELECT id FROM ({_PLACED}) WHERE status = 'available' AND (id % 3 = 0 OR kind <> 'image' AND n_chars % 4 = 0)")
def needs_analysis(spark, sf_dir):
    flagged, duration = F.when(F.col("id") % 3 < 2, F.col("id") % 3 == 0), F.when(F.col("n_chars") % 4 != 0, F.col("n_chars"))
    return _placed(spark, sf_dir).where(L.needs_analysis(F.col("status"), F.col("kind"), flagged, duration)).select("id")


_TRIM = "SELECT o_orderkey, CAST(o_custkey % 100 AS DOUBLE) / 10 - 1 AS s, CAST(o_orderkey % 90 AS DOUBLE) / 10 AS e, greatest(CAST(o_orderkey % 70 AS DOUBLE) / 10 - 0.5, 0.2::DOUBLE) AS lim FROM orders"


@query(f"""WITH a AS (SELECT *, least(greatest(0::DOUBLE, s), greatest(0::DOUBLE, lim - 0.2::DOUBLE)) AS x FROM ({_TRIM})), b AS (SELECT *, least(greatest(x + 0.2::DOUBLE, e), lim) AS y FROM a)
SELECT o_orderkey, CAST(floor(x * 1e4 + 0.5) AS BIGINT) AS "start", CAST(floor(y * 1e4 + 0.5) AS BIGINT) AS "end" FROM b""")
def trim_range(spark, sf_dir):
    number = lambda c, m: (F.col(c) % m).cast("double") / 10
    cut = L.trim_range(number("o_custkey", 100) - 1, number("o_orderkey", 90), number("o_orderkey", 70) - 0.5)
    return Tables(spark, sf_dir).orders.select("o_orderkey", cut.alias("c")).select("o_orderkey", scaled(F.col("c.start")).alias("start"), scaled(F.col("c.end")).alias("end"))
