"""Registered queries of the message, store, evaluation and greedy operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.cluster import ship
from tokenloom.functions import text
from tokenloom.operators import agents, greedy, memory
from tokenloom.plans.catalogue import query
from tokenloom.plans.inputs import EDGES, REQUESTS, edges, requests, table


@query("""WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS call_id FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, conv_id * 1000 + turn - 1 AS call_id FROM conversations WHERE role <> 'user')
SELECT c.conv_id, c.turn, list_sort(list(DISTINCT r.turn)) AS answers FROM c JOIN r USING (conv_id, call_id) GROUP BY c.conv_id, c.turn""")
def tool_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 3, 4, 76."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return agents.tool_units(c.where("role = 'user'").select("conv_id", "turn", key.alias("call_id")), c.where("role != 'user'").select("conv_id", "turn", (key - 1).alias("call_id")))


@query("""WITH n AS (SELECT user_id % 40 AS call_id, arg_max(event_type, event_id) AS name FROM events WHERE user_id % 40 < 30 GROUP BY 1) SELECT event_id, user_id % 40 AS call_id, name FROM events e LEFT JOIN n ON n.call_id = user_id % 40""")
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 77."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("call_id"), "event_type")
    return agents.last_names(e.select("event_id", "call_id"), e.where("call_id < 30").select("call_id", F.col("event_type").alias("name"), F.col("event_id").alias("turn")))


@query("""WITH a AS (SELECT conv_id AS request, turn AS place, length(text) AS n FROM conversations), b AS (SELECT conv_id AS request, turn AS place, length(text) // 2 AS m FROM conversations WHERE conv_id % 2 = 0 OR turn > 0),
s AS (SELECT request FROM (SELECT request, count(*) AS x FROM a GROUP BY 1) JOIN (SELECT request, count(*) AS y FROM b GROUP BY 1) USING (request) WHERE x = y)
SELECT request, place, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m FROM a JOIN b USING (request, place) WHERE request IN (SELECT request FROM s)""")
def compressed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 78."""
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("request"), F.col("turn").alias("place"), F.length("text").cast("long").alias("n"))
    b = c.where("conv_id % 2 = 0 OR turn > 0").select(F.col("conv_id").alias("request"), F.col("turn").alias("place"), F.floor(F.length("text") / 2).cast("long").alias("m"))
    return agents.zipped(a, b)


@query("""WITH m AS (SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS hash FROM documents), s AS (SELECT DISTINCT substr(md5(CAST(page_id AS VARCHAR)), 1, 16) AS hash, url AS content, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 MINUTE AS created, 3000 AS ttl FROM pages)
SELECT m.doc_id, m.hash, CASE WHEN created IS NULL THEN 'missing' WHEN created + ttl * INTERVAL 1 SECOND > TIMESTAMP '2024-01-01 01:20:00' THEN 'found' ELSE 'expired' END AS status,
CASE WHEN created + ttl * INTERVAL 1 SECOND > TIMESTAMP '2024-01-01 01:20:00' THEN content END AS content FROM m LEFT JOIN s USING (hash)""")
def marker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 79, 80, 411: markers of all documents against a store of all pages."""
    marked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see hash="), text.short_hash(F.col("doc_id").cast("string")), F.lit(" there")).alias("t"))
    created = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=F.col("page_id").cast("int"))
    store = table(spark, sf_dir, "pages").select(text.short_hash(F.col("page_id").cast("string")).alias("hash"), F.col("url").alias("content"), created.alias("created_at"), F.lit(3000).alias("ttl")).distinct()
    return memory.resolve(agents.marker_hashes(marked, "doc_id", F.col("t")), store, F.to_timestamp(F.lit("2024-01-01 01:20:00")))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= greatest(2, greatest(length(a.p_name), length(b.p_name)) // 3)""")
def likely_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 85."""
    return agents.likely_typos(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_name", "p_partkey")


@query("""WITH r AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders) SELECT a, b FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.a = r.b AND x.b = r.a)""")
def kept_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 87."""
    return agents.without_contradictions(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).distinct())


@query("""WITH d AS (SELECT event_type, event_id AS direct, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events WHERE event_id % 2 = 0), p AS (SELECT event_type, event_id AS proxied, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events WHERE event_id % 2 = 1)
SELECT coalesce(d.event_type, p.event_type) AS event_type, CAST(coalesce(d.turn, p.turn) AS INTEGER) AS turn, direct, proxied FROM d FULL JOIN p ON d.event_type = p.event_type AND d.turn = p.turn""")
def capture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 89."""
    e = table(spark, sf_dir, "events")
    return agents.captures(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type", "event_id")


@query("""WITH d(name, price) AS (VALUES ('view', 1.0), ('click:1', 2.0), ('signup', 3.0)) SELECT event_id AS id, CAST(coalesce(a.price, b.price) AS DOUBLE) AS price FROM events LEFT JOIN d a ON a.name = event_type || ':' || event_id % 2 LEFT JOIN d b ON b.name = event_type""")
def first_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 92."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    names = F.array(F.concat_ws(":", "event_type", (F.col("id") % 2).cast("string")), F.col("event_type"))
    d = spark.createDataFrame([("view", 1.0), ("click:1", 2.0), ("signup", 3.0)], "name string, price double")
    return agents.first_match(e, names, d, "name", "price").select("id", "price")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 7."""
    return agents.last_write_wins(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query(f"""WITH {REQUESTS} SELECT id, model, before AS tokens, id % 2 = 0 AS has_tools, CASE WHEN model = 'view' AND before >= 5000 THEN 'large' WHEN id % 2 = 1 AND before <= 2000 THEN 'small' ELSE model END AS target FROM requests""")
def model_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 68."""
    rules = spark.createDataFrame([(1, "view", 5000, None, None, "large"), (2, None, None, 2000, False, "small")], "rule_no int, model string, least long, most long, tools boolean, target string")
    return agents.routed(requests(spark, sf_dir).select("id", "model", F.col("before").alias("tokens"), (F.col("id") % 2 == 0).alias("has_tools")), rules)


@query(f"""WITH {REQUESTS} SELECT CASE WHEN mode = 'audit' THEN 'bypass' WHEN model IN ('click', 'error') THEN 'unsupported' WHEN before < 2500 THEN 'too_small' ELSE 'compress' END AS reason, count(*) AS n FROM requests GROUP BY 1""")
def compression_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 39, 70."""
    supported = ~agents.excluded(F.col("model"), ["CLICK", "err*"])
    return requests(spark, sf_dir).groupBy(agents.decision(F.col("mode") == "audit", F.col("before"), 2500, supported).alias("reason")).agg(F.count("*").alias("n"))


@query(r"""WITH u AS (SELECT page_id, url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || CASE page_id % 3 WHEN 0 THEN 'utm_source=a&id=' || page_id || '&ref=b' WHEN 1 THEN 'sig=x&utm_a=1' ELSE 'fbclid=1' END AS url FROM pages),
q AS (SELECT page_id, url, split_part(url, '?', 1) AS base, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS anchor FROM u),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: NOT regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid|ref|mc_eid|igshid)(=|$)')) AS kept FROM q)
SELECT page_id, CASE WHEN regexp_matches(q, '(?i)(^|&)(signature|sig|x-amz-signature|token)=') THEN url ELSE base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || anchor END AS url FROM k""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 19."""
    tail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("utm_source=a&id="), F.col("page_id").cast("string"), F.lit("&ref=b"))).when(F.col("page_id") % 3 == 1, "sig=x&utm_a=1").otherwise("fbclid=1")
    return table(spark, sf_dir, "pages").select("page_id", agents.without_tracking(F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), tail)).alias("url"))


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS k, sum(CAST(floor(value) AS BIGINT)) AS v FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS r FROM s) SELECT CASE WHEN r <= 8 THEN k ELSE 'other' END AS k, CAST(sum(v) AS BIGINT) AS v FROM r GROUP BY 1""")
def top_or_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 110."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("k"), F.floor("value").cast("long").alias("v"))
    return agents.top_or_other(e, "k", "v", 8)


@query("""WITH c AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1) SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS counts FROM c""")
def kind_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 103."""
    return agents.breakdown(table(spark, sf_dir, "events"), F.col("event_type"))


@query("""SELECT event_id FROM events WHERE ts + (event_id % 10) * INTERVAL 1 DAY > (SELECT max(ts) FROM events)""")
def unexpired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 107, 378."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").cast("timestamp").alias("last"))
    return agents.unexpired(e.crossJoin(F.broadcast(last)), "ts", (F.col("event_id") % 10) * 86400, F.col("last")).select("event_id")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, text, 'word' AS dimension, unnest(list_distinct(string_split(text, ' ')))  AS target FROM conversations) SELECT dimension, count(*) AS total, count(*) FILTER (contains(substr(text, 1, 100), target)) AS retained, count(*) FILTER (NOT contains(substr(text, 1, 100), target)) AS recoverable FROM t GROUP BY 1""")
def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 141: what the first hundred characters keep of a text's words."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.substring("text", 1, 100).alias("text"), F.col("text").alias("stored"))
    return agents.probe_report(c, c.select("id", F.lit("word").alias("dimension"), F.explode(F.array_distinct(F.split("stored", " "))).alias("target")))


@query("""WITH g AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS class, p.position, length(text) AS n, length(d) AS m, text, d, CASE p.position WHEN 'start' THEN text || ' ' || d WHEN 'end' THEN d || ' ' || text ELSE d || ' ' || text || ' ' || d END AS t
FROM benchmark, (SELECT arg_max(text, (n_chars, doc_id)) AS d FROM documents GROUP BY lang) c, (VALUES ('start'), ('middle'), ('end')) p(position)) SELECT class, position, count(*) AS cases, count(*) FILTER (contains(substr(t, 1, 500), text)) AS survived FROM g GROUP BY ALL""")
def survival_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 142: every item within the longest document of each language."""
    payloads = table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("class"), F.col("text").alias("payload"))
    carriers = table(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("text", F.struct("n_chars", "doc_id")).alias("carrier")).select("carrier")
    return agents.grid(payloads, carriers, ["start", "middle", "end"], F.substring("text", 1, 500).contains(F.col("payload")))


@query("""SELECT lang AS category, count(*) AS cases, round(avg(n_chars / 1000.0), 6) AS f1, count(*) FILTER (doc_id % 3 = 0) AS same FROM documents GROUP BY ROLLUP (lang)""")
def suite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 143."""
    return agents.suite(table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), (F.col("n_chars") / 1000).alias("f1"), (F.col("doc_id") % 3 == 0).alias("same")))


@query("""SELECT 's0' AS a0, 'n' || s_nationkey AS a1, 'r' || n_regionkey AS a2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 0""".replace("SELECT 's0' AS a0, 'n' || s_nationkey AS a1, 'r' || n_regionkey AS a2", "SELECT ['s0', 'n' || s_nationkey, 'r' || n_regionkey] AS path").replace("s_suppkey = 0", "s_suppkey = (SELECT min(s_suppkey) FROM supplier)").replace("'s0'", "'s' || s_suppkey"))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 335: from the first supplier to its region."""
    first = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).orderBy("s_suppkey").select("s_suppkey", "n_regionkey").first()
    return agents.shortest_path(edges(spark, sf_dir), f"s{first[0]}", f"r{first[1]}", 4)


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 5 AS session_id, o_totalprice / 500000 AS importance FROM orders) SELECT id, user_id, session_id, CAST(NULL AS BIGINT) AS promoted_from FROM m UNION ALL SELECT id, user_id, NULL, session_id FROM m WHERE importance >= 0.8""")
def bubbled_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 339."""
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 5).alias("session_id"), (F.col("o_totalprice") / 500000).alias("importance"))
    return agents.bubbled(m, 0.8).drop("importance")


@query("""WITH r AS (SELECT event_id % 2000 AS id, max(ts) AS "at" FROM events GROUP BY 1) SELECT o_orderkey AS id, o_orderkey % 9 + CAST(r."at" IS NOT NULL AS BIGINT) AS accesses, coalesce(r."at", o_orderdate) AS last_accessed FROM orders LEFT JOIN r ON r.id = o_orderkey""")
def recorded_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 343."""
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).alias("accesses"), F.col("o_orderdate").alias("last_accessed"))
    return agents.accessed(m, table(spark, sf_dir, "events").select((F.col("event_id") % 2000).alias("id"), F.col("ts").alias("at")))


@query("""SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 40 > 30""")
def stale_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 345."""
    refs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("o_orderkey") % 40).alias("refs"))
    return agents.stale(refs, spark.range(31).select(F.col("id").alias("file")))


@query("""WITH s AS (SELECT conv_id, turn AS place, length(text) AS tokens, role <> 'system' AS cacheable FROM conversations), e AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS rank FROM e WHERE cacheable AND upto >= 1024)
SELECT conv_id, place, CAST(upto AS BIGINT) AS upto, rank FROM k WHERE rank <= 4""")
def cache_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 361."""
    s = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.length("text").cast("long").alias("tokens"), (F.col("role") != "system").alias("cacheable"))
    return agents.breakpoints(s, "conv_id").select("conv_id", "place", "upto", "rank")


@query("""SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS before, round(avg(s), 4) AS after, round(round(avg(s), 4) - round(avg(c_acctbal), 4), 6) AS delta FROM customer, (SELECT avg(s_acctbal) AS s FROM supplier) GROUP BY 1""")
def compared_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 444."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.avg("c_acctbal"), 4).alias("v"))
    s = table(spark, sf_dir, "supplier").agg(F.round(F.avg("s_acctbal"), 4).alias("v"))
    return agents.compared(c, c.select("segment").crossJoin(F.broadcast(s)), "segment", "v")


# greedy rules: no SQL; tested against their own steps in plain Python --------------------------------------------


@query()
def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 144, 155, 156: for each conversation how many turns are worth keeping and how many differ."""
    ship(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf["text"].tolist()
        return pd.DataFrame({"conv_id": [pdf["conv_id"][0]], "n": [len(items)], "different": [greedy.unique_count(items)], "k": [greedy.keep_count(items)]})

    return greedy.by_group(c, "conv_id", ["turn"], rule, "conv_id long, n long, different long, k long")


@query()
def memory_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 185: which of a customer's orders fit into a budget, the dearest first."""
    ship(spark)
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("rank"), (F.floor(F.col("o_totalprice")) % 900).cast("long").alias("size"))
    return greedy.first_fit_rows(m, "user_id", ["rank", "id"], "size", 2000).select("user_id", "id", "kept")


@query()
def crushed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 184, 258, 259: a third of each document by its best sentences that say something new."""
    ship(spark)
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n"), lambda s: s != "")
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("n", "sentence")).withColumn("score", text.keyword_density(F.col("sentence")))

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = pdf["sentence"].tolist()
        kept = greedy.novel_sentences(all_, pdf["score"].tolist(), max(200, sum(map(len, all_)) // 3))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[kept], "n": pdf["n"].iloc[kept], "sentence": pdf["sentence"].iloc[kept]})

    return greedy.by_group(s, "doc_id", ["n"], rule, "doc_id long, n int, sentence string")


@query()
def turn_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 309: how much of a turn's words, in order, the turn before had."""
    ship(spark)
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(text.words(F.col("text")), F.array().cast("array<string>")).alias("w")).withColumn("before", before)
    return c.select("conv_id", "turn", F.when(F.col("before").isNull(), 0.0).otherwise(greedy.rouge_column("before", "w")).alias("rouge"))


@query()
def unit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 352: neighbouring turns of one role in batches of at most 3 units and 2,000 characters."""
    ship(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("size"))

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "batch": greedy.batches(pdf["size"].tolist(), pdf["role"].tolist(), 3, 2000)})

    return greedy.by_group(c, "conv_id", ["turn"], rule, "conv_id long, turn long, batch long")


#: Queries without SQL in this module.
QUERIES_OF_GREEDY_RULES = ("kept_items", "memory_budget", "crushed_texts", "turn_rouge", "unit_batches")
