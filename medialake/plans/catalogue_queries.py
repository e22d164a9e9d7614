"""Catalogue operators applied to the driver tables, each with its DuckDB oracle.

Floats leave as scaled integers and times as microseconds, so that results can
be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialake.functions import columns as C
from medialake.operators import reconcile as R
from medialake.operators import relations as O
from medialake.operators import search as S
from medialake.operators import sequences as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def scaled(c: Column, by: float = 1e4) -> Column:
    return F.floor(c * by + 0.5).cast("long")


# -- search -------------------------------------------------------------------------------------------------------------
TOKENS = ["the", "en", "src3", "idiot"]


def _cases(t: str) -> Column:
    return S.token_score(t, exact=[F.col("source")], categories=[F.col("lang")], notes=F.col("text"))


_SCORE = " + ".join(f"greatest(CASE WHEN lower(source) = '{t}' THEN 100 ELSE 0 END, CASE WHEN lower(lang) = '{t}' THEN 40 ELSE 0 END, CASE WHEN contains(lower(text), '{t}') THEN 15 ELSE 0 END)" for t in TOKENS)


@query(f"SELECT doc_id, CAST(s AS INT) AS score FROM (SELECT doc_id, {_SCORE} AS s FROM documents) WHERE s > 0")
def search_rank(spark, sf_dir):
    return S.rank(Tables(spark, sf_dir).documents, TOKENS, _cases).select("doc_id", F.col("score").cast("int").alias("score"))


@query(f"SELECT doc_id, CAST(s AS INT) AS score FROM (SELECT doc_id, {_SCORE} AS s FROM documents) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 50")
def search_topk(spark, sf_dir):
    return search_rank(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(50)


_BITS = "list_aggregate(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) >= list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) / len(embedding) THEN '1' ELSE '0' END), 'string_agg', '')"


@query(f"SELECT vec_id, {_BITS} AS bits FROM embeddings")
def avg_hash(spark, sf_dir):
    return Tables(spark, sf_dir).embeddings.select("vec_id", C.mean_hash(F.col("embedding")).alias("bits"))


@query(f"""WITH h AS (SELECT vec_id, 10 + label AS score, {_BITS} AS bits FROM embeddings WHERE label >= 5), t AS (SELECT vec_id AS tv, bits AS tb FROM h ORDER BY score DESC, vec_id LIMIT 1)
SELECT vec_id, CAST(score + CASE WHEN vec_id <> tv AND bits <> tb AND hamming(bits, tb) <= 24 THEN 24 - hamming(bits, tb) ELSE 0 END AS INT) AS score FROM h, t""")
def similarity_nudge(spark, sf_dir):
    hits = Tables(spark, sf_dir).embeddings.where("label >= 5").select("vec_id", (F.col("label") + 10).alias("score"), C.mean_hash(F.col("embedding")).alias("bits"))
    return S.nudge(hits, "vec_id", "bits", 24).select("vec_id", F.col("score").cast("int").alias("score"))


# -- selections, facets, tags -------------------------------------------------------------------------------------------
@query("""SELECT count(*) FILTER (s <> 'src0' AND NOT m) AS n_all, count(*) FILTER (s <> 'src0' AND NOT m AND t > 0) AS n_tagged, count(*) FILTER (s <> 'src0' AND NOT m AND t = 0) AS n_untagged, count(*) FILTER (m) AS n_missing
FROM (SELECT d.source AS s, d.doc_id % 10 = 0 AS m, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS t FROM documents d LEFT JOIN labels l USING (doc_id))""")
def smart_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(1).alias("tag")), "doc_id", "left")
    return O.smart_counts(rows, F.col("source") != "src0", F.when(F.col("doc_id") % 10 == 0, "missing").otherwise("available"), F.coalesce("tag", F.lit(0)))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def tagged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def untagged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


CATALOGUE = [("LARGE", 0), ("MEDIUM", 1), ("SMALL", 2), ("STANDARD", 3)]


@query("SELECT category, o AS ord FROM (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'custom' ELSE p_type END AS category FROM part) JOIN (VALUES ('LARGE', 0), ('MEDIUM', 1), ('SMALL', 2), ('STANDARD', 3), ('custom', 1073741824)) AS t(c, o) ON c = category")
def facets(spark, sf_dir):
    values = Tables(spark, sf_dir).part.select(F.when(F.col("p_type") == "PROMO", "custom").otherwise(F.col("p_type")).alias("category"))
    return O.facets(values, spark.createDataFrame(CATALOGUE, "category string, ord int"))


_SRC = "CASE CAST(json_extract_string(props, '$.k') AS INT) % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'path' WHEN 2 THEN 'ai' ELSE 'other' END"


@query(f"""SELECT user_id, event_type, source, pos FROM (SELECT user_id, event_type, s AS source, min(event_id) OVER (PARTITION BY user_id, event_type) AS pos,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE s WHEN 'user' THEN 0 WHEN 'path' THEN 1 WHEN 'ai' THEN 2 ELSE 3 END, event_id) AS k FROM (SELECT *, {_SRC} AS s FROM events)) WHERE k = 1""")
def tag_precedence(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    rows = Tables(spark, sf_dir).events.select("user_id", "event_type", F.when(k == 0, "user").when(k == 1, "path").when(k == 2, "ai").otherwise("other").alias("source"), F.col("event_id").alias("pos"))
    return O.best_source(rows, ["user_id", "event_type"], "source", "pos")


@query("""WITH o AS (SELECT user_id, event_type, 'ai' AS source FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id, event_type, 'user' AS source FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""")
def tag_add(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    old = e.where("event_id % 2 = 0").select("user_id", "event_type", F.lit("ai").alias("source")).distinct()
    new = e.where("event_id % 3 = 0").select("user_id", "event_type", F.lit("user").alias("source")).distinct()
    return O.add_tags(old, new, ["user_id", "event_type"])


# -- duplicates ---------------------------------------------------------------------------------------------------------
@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return O.duplicate_groups(Tables(spark, sf_dir).documents.select(F.sha2("text", 256).alias("content_hash")), "content_hash")


@query("SELECT sha256(text) AS content_hash, count(*) AS n, CASE WHEN min(doc_id) % 2 = 0 THEN 'merged' ELSE 'unresolved' END AS resolution FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_resolution(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    old = d.groupBy("content_hash").agg(F.min("doc_id").alias("m")).where("m % 2 = 0").select("content_hash", F.lit("merged").alias("resolution"))
    return O.carry_resolution(O.duplicate_groups(d, "content_hash"), old, "content_hash")


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND bool_or(lang = 'en')")
def dup_scope(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.where("text IS NOT NULL").select(F.sha2("text", 256).alias("content_hash"), "lang")
    return d.groupBy("content_hash").agg(F.count("*").alias("n"), F.bool_or(F.col("lang") == "en").alias("inside")).where("n > 1 and inside").drop("inside")


@query("SELECT sha256(text) AS content_hash, string_agg(DISTINCT source, ',' ORDER BY source) AS tags, min(source) AS keeper_note FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_merge_tags(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.where("text IS NOT NULL").select(F.sha2("text", 256).alias("content_hash"), "source")
    return d.groupBy("content_hash").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tags"), F.min("source").alias("keeper_note")).where("n > 1").drop("n")


# -- paths --------------------------------------------------------------------------------------------------------------
_PATH = "regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


def _paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "^[^:]*://([^?#]*)", 1).alias("path"))


SCOPES = ["thther.example.com", "m.tionsh.example.net/de", "blog.tionsh.example.net/en", "blog.tiontion.example.net"]


@query(f"""SELECT page_id, directory FROM (SELECT page_id, regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) AS directory FROM pages)
WHERE {" OR ".join(f"directory = '{s}' OR starts_with(directory, '{s}/')" for s in SCOPES)}""")
def folder_scope(spark, sf_dir):
    rows = _paths(Tables(spark, sf_dir)).select("page_id", C.directory(F.col("path")).alias("directory"))
    return O.in_scopes(rows, "directory", SCOPES)


@query(f"""WITH p AS (SELECT list_filter(string_split({_PATH}, '/'), lambda x: x <> '' AND x <> '.') AS a FROM pages)
SELECT array_to_string(list_slice(a, 1, i), '/') AS folder, count(*) AS n FROM (SELECT a, unnest(range(1, len(a))) AS i FROM p) GROUP BY 1""")
def folder_tree(spark, sf_dir):
    path = C.normalize_path(F.col("path"))
    steps = _paths(Tables(spark, sf_dir)).select(F.explode(C.ancestors(C.directory(path))).alias("folder"))
    return steps.groupBy("folder").agg(F.count("*").alias("n"))


FOLDERS = [("", "root.gpx"), ("ththble.example.com", "a.gpx"), ("ththble.example.com/fr", "b.gpx"), ("free-bets.example.com/en", "c.gpx")]


@query(f"""WITH d AS (SELECT page_id, regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) AS directory FROM pages), f AS (SELECT * FROM (VALUES ('', 'root.gpx'), ('ththble.example.com', 'a.gpx'), ('ththble.example.com/fr', 'b.gpx'), ('free-bets.example.com/en', 'c.gpx')) AS t(folder, target))
SELECT page_id, arg_max(target, length(folder)) AS target FROM d JOIN f ON folder = '' OR directory = folder OR starts_with(directory, folder || '/') GROUP BY page_id""")
def longest_prefix(spark, sf_dir):
    rows = _paths(Tables(spark, sf_dir)).select("page_id", C.directory(F.col("path")).alias("directory"))
    return O.longest_prefix(rows, "directory", spark.createDataFrame(FOLDERS, "folder string, target string"), ["page_id"]).select("page_id", "target")


@query("SELECT doc_id, 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mov' WHEN 2 THEN '.wav' ELSE '.xyz' END AS filename, source AS directory, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 2 THEN 'audio' ELSE 'video' END AS kind FROM documents")
def media_kind(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".mov", ".wav", ".xyz"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/f"), "doc_id", ext)
    return Tables(spark, sf_dir).documents.select("doc_id", C.filename(path).alias("filename"), C.directory(path).alias("directory"), C.media_kind(path).alias("kind"))


# -- reconciliation -----------------------------------------------------------------------------------------------------
_STORED = "SELECT o_orderkey AS id, 'p' || o_orderkey AS path, o_custkey AS size, o_orderkey % 7 AS mtime, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'h' || (o_orderkey // 2) END AS hash, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' ELSE 'available' END AS status, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 <> 0"
_DISK = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'q' ELSE 'p' END || o_orderkey AS path, o_custkey AS size, o_orderkey % 7 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS mtime, 'h' || (CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey // 2 END) AS hash, o_orderkey AS pos FROM orders WHERE o_orderkey % 4 <> 0"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    stored = t.orders.where(k % 3 != 0).select(k.alias("id"), F.concat(F.lit("p"), k).alias("path"), F.col("o_custkey").alias("size"), (k % 7).alias("mtime"), F.when(k % 11 != 0, F.concat(F.lit("h"), F.floor(k / 2))).alias("hash"), F.when(k % 13 == 0, "missing").otherwise("available").alias("status"), k.alias("pos"))
    disk = t.orders.where(k % 4 != 0).select(F.concat(F.when(k % 5 == 0, "q").otherwise("p"), k).alias("path"), F.col("o_custkey").alias("size"), (k % 7 + F.when(k % 17 == 0, 1).otherwise(0)).alias("mtime"), F.concat(F.lit("h"), F.when(k % 19 == 0, k + 1000000).otherwise(F.floor(k / 2))).alias("hash"), k.alias("pos"))
    return disk, stored


_STABLE = "coalesce(d.size = s.size AND d.mtime = s.mtime AND s.status = 'available' AND s.hash IS NOT NULL, false)"


@query(f"""WITH s AS ({_STORED}), d AS ({_DISK}),
bp AS (SELECT s.id, d.path, CASE WHEN {_STABLE} THEN 'stable' WHEN s.hash IS NULL THEN 'first_hash' WHEN s.hash = d.hash THEN 'touched' ELSE 'changed' END AS outcome FROM d JOIN s USING (path)),
fd AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY pos) AS rn FROM d WHERE path NOT IN (SELECT path FROM s)),
fs AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY pos) AS rn FROM s WHERE path NOT IN (SELECT path FROM d)),
rn AS (SELECT fs.id, fd.path, 'renamed' AS outcome FROM fd JOIN fs ON fd.hash = fs.hash AND fd.rn = fs.rn),
ld AS (SELECT *, row_number() OVER (PARTITION BY size, mtime ORDER BY pos) AS k FROM fd WHERE path NOT IN (SELECT path FROM rn)),
ls AS (SELECT * FROM fs WHERE id NOT IN (SELECT id FROM rn)),
ln AS (SELECT *, count(*) OVER (PARTITION BY size, mtime) AS n FROM ls WHERE hash IS NULL),
lg AS (SELECT ln.id, ld.path, 'legacy' AS outcome FROM ld JOIN ln ON ld.size = ln.size AND ld.mtime = ln.mtime AND ln.n = 1 AND ld.k = 1)
SELECT * FROM bp UNION ALL SELECT * FROM rn UNION ALL SELECT * FROM lg UNION ALL SELECT NULL, path, 'new' FROM ld WHERE path NOT IN (SELECT path FROM lg) UNION ALL SELECT id, path, 'missing' FROM ls WHERE id NOT IN (SELECT id FROM lg)""")
def reconcile(spark, sf_dir):
    return R.reconcile(*_sides(Tables(spark, sf_dir)))


@query(f"WITH s AS ({_STORED}), d AS ({_DISK}) SELECT d.path, d.hash FROM d LEFT JOIN s USING (path) WHERE NOT {_STABLE}")
def needs_hash(spark, sf_dir):
    return R.needs_hash(*_sides(Tables(spark, sf_dir))).select("path", "hash")


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal FROM (SELECT c_custkey AS k, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer WHERE c_custkey % 3 <> 0) o
FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'new' END AS name, CAST(1 AS BIGINT) AS bal FROM customer WHERE c_custkey % 5 <> 0) n ON o.k = n.k""")
def upsert(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.floor("c_acctbal").alias("bal"))
    new = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 != 0, "new").alias("name"), F.lit(1).cast("long").alias("bal"))
    return O.upsert(old, new, ["k"])


# -- time ---------------------------------------------------------------------------------------------------------------
_TRACK = "SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL"


@query(f"""WITH t AS ({_TRACK}), p AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT id, p.user_id, p.ts, (SELECT max(t.ts) FROM t WHERE t.user_id = p.user_id AND t.ts <= p.ts) AS a, (SELECT min(t.ts) FROM t WHERE t.user_id = p.user_id AND t.ts >= p.ts) AS b FROM p)
SELECT id, CAST(floor((x.value + (y.value - x.value) * CASE WHEN a = b THEN 0.0 ELSE CAST(epoch_us(j.ts) - epoch_us(a) AS DOUBLE) / CAST(epoch_us(b) - epoch_us(a) AS DOUBLE) END) * 10000 + 0.5) AS BIGINT) AS value FROM j LEFT JOIN t x ON x.user_id = j.user_id AND x.ts = a LEFT JOIN t y ON y.user_id = j.user_id AND y.ts = b""")
def asof_lerp(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    track = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.min("value").alias("value"))
    probes = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return O.asof_interpolate(probes, track, ["user_id"], "ts", ["value"]).select("id", scaled(F.col("value")).alias("value"))


@query("""WITH p AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'error'), e AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'),
j AS (SELECT id, user_id, epoch_us(ts) - (SELECT max(epoch_us(e.ts)) FROM e WHERE e.user_id = p.user_id AND e.ts <= p.ts) AS back, (SELECT min(epoch_us(e.ts)) FROM e WHERE e.user_id = p.user_id AND e.ts >= p.ts) - epoch_us(ts) AS ahead FROM p)
SELECT user_id, id, CASE WHEN back IS NULL AND ahead IS NULL THEN NULL WHEN ahead IS NULL OR back <= ahead THEN 'previous' ELSE 'next' END AS side, least(back, ahead) AS gap_us FROM j""")
def nearest_gap(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return O.nearest_gap(e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "user_id", "ts"), e.where("event_type = 'signup'").select("user_id", "ts"), ["user_id"], "ts")


@query("SELECT event_id, epoch_us(ts + CASE event_type WHEN 'view' THEN INTERVAL '1 year 1 hour' WHEN 'click' THEN INTERVAL '-2 days 30 seconds' ELSE INTERVAL '0 seconds' END) AS t FROM events")
def time_offset(spark, sf_dir):
    offsets = spark.createDataFrame([("view", 1, 0, 1, 0, 0), ("click", 0, -2, 0, 0, 30)], "event_type string, y int, d int, h int, m int, s int")
    rows = Tables(spark, sf_dir).events.join(F.broadcast(offsets), "event_type", "left")
    part = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("event_id", micros(C.offset_apply(F.col("ts"), part("y"), part("d"), part("h"), part("m"), part("s"))).alias("t"))


@query("""WITH s AS (SELECT user_id, min(ts) - INTERVAL 30 MINUTE AS a, max(ts) + INTERVAL 30 MINUTE AS b FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT event_id FROM events e JOIN s USING (user_id) WHERE event_type = 'click' AND ts BETWEEN a AND b""")
def interval_pad(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    span = e.where("event_type = 'view'").groupBy("user_id").agg((F.min("ts") - F.expr("INTERVAL 30 MINUTES")).alias("a"), (F.max("ts") + F.expr("INTERVAL 30 MINUTES")).alias("b"))
    return e.where("event_type = 'click'").join(span, "user_id").where(F.col("ts").between(F.col("a"), F.col("b"))).select("event_id")


@query("SELECT o_orderkey, epoch_us(o_orderdate + to_seconds(o_orderkey % 86400)) AS dji, epoch_us(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END) AS clock FROM orders")
def clock_parse(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    at = d + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))
    name = F.concat(F.lit("DJI_"), F.date_format(at.cast("timestamp"), "yyyyMMddHHmmss"), F.lit("_0001_D.MP4"))
    text = F.when(k % 3 == 0, "20xx-01-01").when(k % 3 == 1, F.date_format(d.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(d.cast("timestamp"), "yyyy:MM:dd HH:mm:ss"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", micros(C.dji_clock(name)).alias("dji"), micros(C.metadata_clock(text)).alias("clock"))


# -- fingerprints -------------------------------------------------------------------------------------------------------
#: The driver's vectors are no copies of each other, so they're compared at a larger distance than edited photos.
LOOKALIKE = 18


def _codes(spark, sf_dir) -> DataFrame:
    return avg_hash(spark, sf_dir).select("vec_id", C.bit_code(F.col("bits")).alias("code"))


@query(f"WITH h AS (SELECT vec_id, {_BITS} AS bits FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, CAST(hamming(x.bits, y.bits) AS INT) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id AND hamming(x.bits, y.bits) <= 18")
def hamming_pairs(spark, sf_dir):
    return O.hamming_pairs(_codes(spark, sf_dir), "vec_id", "code", LOOKALIKE)


@query(f"""WITH h AS (SELECT vec_id, {_BITS} AS bits FROM embeddings), p AS (SELECT y.vec_id AS edited, x.vec_id AS original, hamming(x.bits, y.bits) AS d FROM h x JOIN h y ON x.vec_id < y.vec_id AND hamming(x.bits, y.bits) <= 18 WHERE y.vec_id % 5 <> 0)
SELECT edited, original, CAST(d AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY edited ORDER BY d, original DESC) AS k FROM p) WHERE k = 1""")
def lookalike_best(spark, sf_dir):
    pairs = O.hamming_pairs(_codes(spark, sf_dir), "vec_id", "code", LOOKALIKE)
    declined = Tables(spark, sf_dir).embeddings.where("vec_id % 5 = 0").select(F.col("vec_id").alias("b"))
    best = O.first_by(pairs.join(declined, "b", "left_anti"), ["b"], F.col("distance"), F.desc("a"))
    return best.select(F.col("b").alias("edited"), F.col("a").alias("original"), "distance")


# -- aggregates ---------------------------------------------------------------------------------------------------------
@query("SELECT user_id, o AS mode_offset FROM (SELECT user_id, o, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, o) AS k FROM (SELECT user_id, CAST(floor(value) AS BIGINT) % 5 AS o FROM events) GROUP BY user_id, o) WHERE k = 1")
def mode_offset(spark, sf_dir):
    counts = Tables(spark, sf_dir).events.select("user_id", (F.floor("value") % 5).alias("o")).groupBy("user_id", "o").count()
    return counts.groupBy("user_id").agg(F.max_by("o", F.struct("count", -F.col("o"))).alias("mode_offset"))


@query("SELECT user_id, CAST(floor(median(value) * 10000 + 0.5) AS BIGINT) AS center, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def median_center(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(scaled(F.median("value")).alias("center"), micros(F.min("ts")).alias("first_us"), micros(F.max("ts")).alias("last_us"))


_GEO = "SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 170 - 85 AS DOUBLE) + CAST(s_suppkey % 10 AS DOUBLE) / 1000 AS lat, CAST(s_suppkey * 91 % 360 - 180 AS DOUBLE) + CAST(s_suppkey % 7 AS DOUBLE) / 1000 AS lon FROM supplier"


def _geo(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), ((k * 37 % 170 - 85).cast("double") + (k % 10).cast("double") / 1000).alias("lat"), ((k * 91 % 360 - 180).cast("double") + (k % 7).cast("double") / 1000).alias("lon"))


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


@query(f"WITH g AS ({_GEO}) SELECT id % 5 AS g, CAST(floor(greatest((max(lat) - min(lat)) * 1.45, 0.0025) * 10000 + 0.5) AS BIGINT) AS span, CAST(floor(min(lat) * 10000 + 0.5) AS BIGINT) AS south FROM g GROUP BY 1")
def bbox(spark, sf_dir):
    rows = _geo(Tables(spark, sf_dir)).groupBy((F.col("id") % 5).alias("g"))
    return rows.agg(scaled(F.greatest((F.max("lat") - F.min("lat")) * 1.45, F.lit(0.0025))).alias("span"), scaled(F.min("lat")).alias("south"))


@query(f"WITH g AS ({_GEO}) SELECT id, CAST(floor({_hav('lat', 'lon', '35.0', '139.0')} / 10 + 0.5) AS BIGINT) AS dam FROM g")
def haversine(spark, sf_dir):
    return _geo(Tables(spark, sf_dir)).select("id", scaled(C.haversine(F.col("lat"), F.col("lon"), F.lit(35.0), F.lit(139.0)), 0.1).alias("dam"))


@query(f"""WITH g AS ({_GEO}), d AS (SELECT p.id, q.id AS place, {_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS m FROM (SELECT id, lat + 0.002 AS lat, lon FROM g) p, g q WHERE abs(p.lat - q.lat) < 0.1)
SELECT id, arg_min(place, (m, -place)) AS place, CAST(floor(min(m) + 0.5) AS BIGINT) AS metres FROM d WHERE m <= 1000 GROUP BY id""")
def grid_nearest(spark, sf_dir):
    g = _geo(Tables(spark, sf_dir))
    found = O.grid_nearest(g.select("id", (F.col("lat") + 0.002).alias("lat"), "lon"), g.select(F.col("id").alias("place"), "lat", "lon"), 1000.0)
    return found.select("id", "place", scaled(F.col("metres"), 1).alias("metres"))


BOXES = [("north", 20.0, 90.0, -180.0, 180.0), ("islands", 24.0, 46.0, 122.0, 146.0), ("south", -90.0, -10.0, -70.0, 150.0)]


@query(f"WITH g AS ({_GEO}), b AS (SELECT * FROM (VALUES ('north', 20.0, 90.0, -180.0, 180.0), ('islands', 24.0, 46.0, 122.0, 146.0), ('south', -90.0, -10.0, -70.0, 150.0)) AS t(mass, s, n, w, e)) SELECT id, mass FROM g JOIN b ON lat BETWEEN s AND n AND lon BETWEEN w AND e")
def landmass_join(spark, sf_dir):
    boxes = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("mass", "s", "n", "w", "e"), b)]) for b in BOXES])
    inside = F.filter(boxes, lambda b: F.col("lat").between(b["s"], b["n"]) & F.col("lon").between(b["w"], b["e"]))
    return _geo(Tables(spark, sf_dir)).select("id", F.explode(inside).alias("b")).select("id", F.col("b.mass").alias("mass"))


# -- sequences ----------------------------------------------------------------------------------------------------------
@query("""SELECT event_id, CASE WHEN d IS NULL THEN NULL WHEN d < 1 THEN true WHEN s <= 0.75 THEN d <= 2000 ELSE d / s <= 300 END AS plausible FROM
(SELECT event_id, abs(value - lag(value) OVER w) * 100000 AS d, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w AS DOUBLE) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def plausible_hops(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.abs(F.col("value") - F.lag("value").over(w)) * 100000
    s = (micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w)).cast("double") / 1e6
    rows = Tables(spark, sf_dir).events.select("event_id", d.alias("d"), s.alias("s"))
    return rows.select("event_id", F.when(F.col("d").isNotNull(), C.plausible_hop(F.col("d"), F.col("s"))).alias("plausible"))


def _line(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).events.select("user_id", "event_id", micros(F.col("ts")).alias("t"), "value")


def _folded(source: str, reach, on_jump: bool) -> str:
    """The fold over (user_id, event_id, k, p, ahead) as a recursive query; ``p`` is a row's position, ``reach(a, b)`` SQL."""
    jump = "run + 1" if on_jump else "run"
    kept = "1" if on_jump else "kept + 1"
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, p, row_number() OVER w AS k, lead(p) OVER w AS ahead FROM ({source}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, event_id, k, event_id AS last_id, p AS last, 1 AS kept, CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS own, CAST(NULL AS BIGINT) AS dropped FROM o WHERE k = 1
UNION ALL SELECT user_id, e, k + 1, CASE WHEN c = 'spike' THEN last_id ELSE e END, CASE WHEN c = 'spike' THEN last ELSE q END, CASE c WHEN 'near' THEN kept + 1 WHEN 'spike' THEN kept WHEN 'first' THEN 1 ELSE {kept} END,
CASE WHEN c = 'jump' THEN {jump} ELSE run END, CASE c WHEN 'spike' THEN NULL WHEN 'jump' THEN {jump} ELSE run END, CASE WHEN c = 'first' THEN last_id END
FROM (SELECT f.*, o.event_id AS e, o.p AS q, CASE WHEN {reach("f.last", "o.p")} THEN 'near' WHEN o.ahead IS NOT NULL AND {reach("f.last", "o.ahead")} THEN 'spike' WHEN f.kept = 1 AND o.ahead IS NOT NULL AND {reach("o.p", "o.ahead")} THEN 'first' ELSE 'jump' END AS c
FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)),
g AS (SELECT user_id, event_id, own AS run FROM f WHERE own IS NOT NULL AND event_id NOT IN (SELECT dropped FROM f WHERE dropped IS NOT NULL))"""


_LONG = """, n AS (SELECT user_id, run, count(*) AS n FROM g GROUP BY ALL), l AS (SELECT user_id, run, n, max(n) OVER (PARTITION BY user_id) AS most, max(run) OVER (PARTITION BY user_id) AS last FROM n)
SELECT g.user_id, event_id, g.run FROM g JOIN l ON g.user_id = l.user_id AND g.run = l.run WHERE l.n > 1 OR l.most = 1 AND l.run = l.last"""
_ON_LINE = "SELECT user_id, event_id, ts, value AS p FROM events"


def _near(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= 15"


@query(_folded(_ON_LINE, _near, False) + " SELECT user_id, event_id FROM g")
def spike_filter(spark, sf_dir):
    return Q.drop_spikes(_line(spark, sf_dir), ["user_id"], ["t", "event_id"], ["value"], Q.within(15.0)).select("user_id", "event_id")


@query(_folded(_ON_LINE, _near, True) + _LONG)
def runs(spark, sf_dir):
    return Q.plausible_runs(_line(spark, sf_dir), ["user_id"], ["t", "event_id"], ["value"], Q.within(15.0)).select("user_id", "event_id", "run")


_ON_EARTH = "SELECT user_id, event_id, ts, {'s': CAST(epoch_us(ts) AS DOUBLE) / 1e6, 'lat': CAST(event_id % 60 AS DOUBLE), 'lon': CASE WHEN event_type = 'error' THEN -170.0 ELSE value % 20 END} AS p FROM events"


def _hops(a: str, b: str) -> str:
    d, s = _hav(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon"), f"abs({b}.s - {a}.s)"
    return f"({d} < 1 OR CASE WHEN {s} <= 0.75 THEN {d} <= 2000 ELSE {d} / {s} <= 300 END)"


def _gps(spark, sf_dir) -> DataFrame:
    lon = F.when(F.col("event_type") == "error", -170.0).otherwise(F.col("value") % 20)
    return Tables(spark, sf_dir).events.select("user_id", "event_id", (micros(F.col("ts")).cast("double") / 1e6).alias("s"), (F.col("event_id") % 60).cast("double").alias("lat"), lon.alias("lon"))


@query(_folded(_ON_EARTH, _hops, False) + " SELECT user_id, event_id FROM g")
def gps_spikes(spark, sf_dir):
    return Q.drop_spikes(_gps(spark, sf_dir), ["user_id"], ["s", "event_id"], ["s", "lat", "lon"]).select("user_id", "event_id")


@query(_folded(_ON_EARTH, _hops, True) + _LONG)
def gps_runs(spark, sf_dir):
    return Q.plausible_runs(_gps(spark, sf_dir), ["user_id"], ["s", "event_id"], ["s", "lat", "lon"]).select("user_id", "event_id", "run")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, CAST(0 AS BIGINT) AS stay, 1 AS n, value AS total, value AS last FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN far THEN stay + 1 ELSE stay END, CASE WHEN far THEN 1 ELSE n + 1 END, CASE WHEN far THEN o.value ELSE total + o.value END, o.value
FROM (SELECT f.*, o.event_id AS e2, o.k AS k2, o.value AS v2, abs(o.value - f.total / f.n) > 8 AND abs(o.value - f.last) > 8 AS far FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) g JOIN o ON o.user_id = g.user_id AND o.k = g.k2)
SELECT user_id, event_id, stay FROM f""")
def stays(spark, sf_dir):
    return Q.cluster_line(_line(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 8.0).select("user_id", "event_id", "stay")


@query("""SELECT user_id, run, event_type AS kind, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
(SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS f FROM events)) GROUP BY ALL""".replace("SELECT user_id, run,", "SELECT user_id, CAST(run AS BIGINT) AS run,"))
def route_segments(spark, sf_dir):
    rows = O.islands(Tables(spark, sf_dir).events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return rows.groupBy("user_id", "run", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_type) AS INT) AS rank FROM (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY ALL) QUALIFY rank <= 3")
def recent_tags(spark, sf_dir):
    last = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.max("ts").alias("t"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), "event_type"))
    return last.select("user_id", "event_type", rank.alias("rank")).where("rank <= 3")


@query("SELECT event_id, first_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM events")
def next_presentable(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    return Tables(spark, sf_dir).events.select("event_id", F.last(F.when(F.col("event_type") != "error", F.col("event_id")), ignorenulls=True).over(w).alias("next_id"))


@query("""WITH d AS (SELECT user_id, event_type, floor(value) AS label, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY value DESC, event_id) = 1),
c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 2)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM c QUALIFY rank <= 8""")
def capped_pick(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.withColumn("label", F.floor("value"))
    return O.capped_pick(rows, "user_id", "event_type", "label", [F.desc("value"), F.col("event_id")], 2, 8).select("user_id", "event_id", "rank")


@query("""WITH g AS (SELECT conv_id, list(turn ORDER BY turn) AS a, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(CASE WHEN n <= 3 THEN a ELSE [a[1], a[CAST(round_even((n - 1) / 2.0, 0) AS INT) + 1], a[n]] END, ',') AS turns FROM g""")
def even_pick(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("a"))
    return rows.select("conv_id", F.array_join(C.even_pick(F.col("a"), 3), ",").alias("turns"))


# -- sets and dictionaries ----------------------------------------------------------------------------------------------
_SETS = {"scope_union": ("union", "UNION"), "tag_except": ("subtract", "EXCEPT"), "tag_intersect": ("intersect", "INTERSECT")}


def _set_query(method: str):
    def run(spark, sf_dir):
        e = Tables(spark, sf_dir).events
        a, b = e.where("event_type = 'view'").select("user_id").distinct(), e.where("event_type = 'click' and value > 150").select("user_id").distinct()
        return getattr(a, method)(b).distinct()

    return run


for _name, (_method, _op) in _SETS.items():
    QUERIES[_name] = _set_query(_method)
    ORACLE[_name] = f"SELECT user_id FROM events WHERE event_type = 'view' {_op} SELECT user_id FROM events WHERE event_type = 'click' AND value > 150"

GLOSSARY = [("widget", "gadget"), ("bolt", "screw"), ("gear", "cog")]


@query("""WITH g AS (SELECT * FROM (VALUES ('widget', 'gadget'), ('bolt', 'screw'), ('gear', 'cog')) AS t(a, b)), s AS (SELECT a AS w, b AS o FROM g UNION SELECT b, a FROM g),
x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT DISTINCT p_partkey, t FROM (SELECT p_partkey, w AS t FROM x UNION ALL SELECT p_partkey, o FROM x JOIN s USING (w))""")
def glossary(spark, sf_dir):
    g = spark.createDataFrame(GLOSSARY, "w string, o string")
    both = g.unionByName(g.select(F.col("o").alias("w"), F.col("w").alias("o"))).distinct()
    words = Tables(spark, sf_dir).part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    return words.select("p_partkey", F.col("w").alias("t")).unionByName(words.join(F.broadcast(both), "w").select("p_partkey", F.col("o").alias("t"))).distinct()


DICTIONARY = ["re", "red", "wid", "widget", "get", "bo", "bolt", "all"]


@query("SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '(widget|bolt|all|get|red|wid|bo|re)'), ',') AS hits FROM part")
def contained_match(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(C.longest_matches(F.col("p_name"), DICTIONARY), ",").alias("hits"))


@query(f"SELECT page_id, n AS tag FROM (SELECT page_id, string_split(lower({_PATH}), '/') AS s FROM pages), (VALUES ('fr'), ('casino'), ('example')) AS t(n) WHERE len(list_filter(s, lambda x: contains(replace(replace(x, '.', ''), '-', ''), n))) > 0")
def path_tags(spark, sf_dir):
    segments = F.split(F.col("path"), "/")
    needles = F.array(*map(F.lit, ("fr", "casino", "example")))
    hits = F.filter(needles, lambda n: F.exists(segments, lambda s: C.fold(s).contains(n)))
    return _paths(Tables(spark, sf_dir)).select("page_id", F.explode(hits).alias("tag"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def json_tolerant(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "no json here").when(F.col("event_id") % 5 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("x "), "props"))
    return Tables(spark, sf_dir).events.select("event_id", C.tolerant_json(text, "k INT")["k"].alias("k"))


@query(r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM documents) WHERE length(w) BETWEEN 3 AND 40 AND regexp_full_match(w, '[a-z0-9-]+') GROUP BY 1")
def keyword_valid(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", C.count_keyword_words(F.col("text")).cast("long").alias("n")).where("n > 0")


# -- extensions ---------------------------------------------------------------------------------------------------------
@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def tumble_ext(spark, sf_dir):
    from medialake.streaming import events as E

    return E.tumbling(Tables(spark, sf_dir).events, "ts", "1 hour", "event_type").select("event_type", micros(F.col("start")).alias("start_us"), "n")


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s""")
def session_ext(spark, sf_dir):
    from medialake.streaming import events as E

    return E.sessions(Tables(spark, sf_dir).events, "ts", "6 hours", "user_id").select("user_id", micros(F.col("start")).alias("start_us"), "n")
