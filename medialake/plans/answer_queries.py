"""Models' answers on the driver tables: parsed as VARIANT, held against what was seen; each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import variants as V
from medialake.operators import gate as G
from medialake.plans.catalogue_queries import Tables, query


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'c' || user_id % 3 || '/v/' || event_type WHEN 1 THEN 'a/b/' || event_type ELSE '' END AS tags,
CASE event_id % 6 WHEN 2 THEN 'ice breaker,' || event_type || ',arctic ' || event_type WHEN 4 THEN 'big ' || event_type ELSE '' END AS keywords,
CASE event_id % 6 WHEN 0 THEN '{"n": [' || user_id || ', -3, 0.5, true, null], "tags": [{"category": "c' || user_id % 3 || '", "value": " v\\/' || event_type || ' "}, {"category": "c' || user_id % 3 || '", "value": "v\\/' || event_type || '"}, {"category": "", "value": "skip"}]}'
WHEN 1 THEN '[{"category": "a\\/b", "value": "' || event_type || '"}, {"category": "a", "value": "b\\/' || event_type || '"}, ' || user_id || ', "x, y: z"]'
WHEN 2 THEN '{"keywords": ["Ice  Breaker", "#ice breaker", {"keyword": "no", "value": "' || event_type || '"}, {"keyword": "arctic ' || event_type || '"}, "ab", 7], "tags": [{"category": "n", "value": ' || user_id || '}]}'
WHEN 4 THEN '{"keywords": ["big ' || event_type || '", "big ' || event_type || '"]}' END AS compact FROM events""")
def model_answers(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    c = F.concat(F.lit('{"category":"c'), (F.col("user_id") % 3).cast("string"), F.lit('","value":"'))
    forms = {
        0: F.concat(F.lit('```json\n{"tags":['), c, F.lit(" v/"), kind, F.lit(' "},'), c, F.lit("v/"), kind, F.lit('"},{"value":"skip","category":""}],"n":['), user, F.lit(".0,-3.00,0.50,true,null]}\n```")),
        1: F.concat(F.lit('[{"category":"a/b","value":"'), kind, F.lit('"},{"category":"a","value":"b/'), kind, F.lit('"},'), user, F.lit(',"x, y: z"]')),
        2: F.concat(F.lit('Sure: {"tags":[{"category":"n","value":'), user, F.lit('}],"keywords":["Ice  Breaker","#ice breaker",{"value":"'), kind, F.lit('","keyword":"no"},{"keyword":"arctic '), kind, F.lit('"},"ab",7]} done')),
        3: F.lit("not json"),
        4: F.concat(F.lit('{"keywords":["big '), kind, F.lit('","big '), kind, F.lit('"]}')),
    }
    text = F.lit(None).cast("string")
    for i, form in forms.items():
        text = F.when(F.col("event_id") % 6 == i, form).otherwise(text)
    parsed = e.select("event_id", V.answer(text).alias("v"))
    tags = F.transform(V.answer_tags(F.col("v")), lambda t: F.concat(t["category"], F.lit("/"), t["value"]))
    return parsed.select("event_id", F.array_join(tags, ",").alias("tags"), F.array_join(V.answer_keywords(F.col("v")), ",").alias("keywords"), V.compact_json(F.col("v")).alias("compact"))


_VALUES = {0: ("people", ["none", "portrait", "distant", "hands", "child", "silhouette", "night"]), 1: ("animals", ["pet", "bird"]), 2: ("lifestyle", ["family", "city"]), 3: ("custom", ["March", "a puppy house", "House Pet", "no people", "two men", "harbour", " person "]), 4: ("custom", ["friday", "March walk", "kitten", "crowd"])}


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH t AS (SELECT event_id // 6 AS id, event_id AS pos, CASE user_id % 5 {" ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in _VALUES.items())} END AS category,
CASE user_id % 5 {" ".join(f"WHEN {i} THEN {_listed(v)}[event_id % {len(v)} + 1]" for i, (_, v) in _VALUES.items())} END AS value FROM events),
s AS (SELECT DISTINCT event_id // 6 AS id, (event_id // 6) % 5 <> 0 AS sure, ['none', 'one', 'two', 'group'][(event_id // 6) % 4 + 1] AS p, (event_id // 6) % 3 = 0 AS h, ['portrait', 'distant', 'visible'][(event_id // 6) % 3 + 1] AS f, (event_id // 6) % 2 = 0 AS a FROM events WHERE (event_id // 6) % 7 <> 0),
o AS (SELECT id, CASE WHEN sure THEN p ELSE 'none' END AS p, sure AND h AS h, CASE WHEN sure THEN f ELSE 'none' END AS f, sure AND a AS a FROM s),
k AS (SELECT t.*, o.p IS NULL AS unseen, p = 'none' AS nobody, h, f, a, lower(trim(value)) AS w FROM t LEFT JOIN o USING (id)),
g AS (SELECT * FROM k WHERE NOT CASE WHEN category = 'custom' AND w IN ('march', 'friday') THEN true WHEN unseen THEN false
WHEN category = 'people' THEN value = 'none' OR (nobody AND value IN ('portrait', 'distant', 'silhouette', 'hands', 'child')) OR (value = 'portrait' AND f <> 'portrait') OR (value = 'distant' AND f <> 'distant') OR (value = 'hands' AND (NOT h OR nobody))
WHEN category = 'animals' THEN value = 'pet' AND NOT a WHEN category = 'lifestyle' THEN value = 'family' AND nobody
ELSE (nobody AND w IN ('two men', 'person', 'crowd')) OR (NOT a AND w IN ('a puppy house', 'house pet', 'kitten')) END),
u AS (SELECT id, category, value, 'model' AS source, pos FROM g UNION ALL SELECT id, 'people', p, 'ai', 1073741824 FROM o UNION ALL SELECT id, 'people', 'hands', 'ai', 1073741825 FROM o WHERE h AND p <> 'none')
SELECT id, category, value, arg_min(source, pos) AS source, min(pos) AS pos FROM u GROUP BY 1, 2, 3""")
def gate_filter(spark, sf_dir):
    d, row = F.col("event_id"), F.floor(F.col("event_id") / 6)
    category, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (c, values) in _VALUES.items():
        category = F.when(F.col("user_id") % 5 == i, c).otherwise(category)
        value = F.when(F.col("user_id") % 5 == i, F.get(F.array(*map(F.lit, values)), (d % len(values)).cast("int"))).otherwise(value)
    events = Tables(spark, sf_dir).events
    tags = events.select(row.alias("id"), category.alias("category"), value.alias("value"), F.lit("model").alias("source"), d.alias("pos"))
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int"))
    ids = events.select(row.alias("id")).distinct().where("id % 7 <> 0")
    seen = ids.select("id", pick("none", "one", "two", "group").alias("people"), (F.col("id") % 3 == 0).alias("hands"), pick("portrait", "distant", "visible").alias("face"), F.when(F.col("id") % 2 == 0, F.array(F.lit("dog"))).alias("animals"), (F.col("id") % 5 != 0).alias("reliable"))
    return G.apply_gate(tags, seen, "id")
