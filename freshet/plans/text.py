"""Queries over texts, ledgers and the graph of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import ledger as L
from ..operators import text as T
from .registry import gappy, passages, query, read

WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
CHUNKS = f"(SELECT doc_name, CAST(i AS INTEGER) AS chunk_idx, array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') AS text FROM (SELECT doc_name, w, unnest(range(0, greatest(CAST(ceil((len(w) - 200) / 160) AS BIGINT), 0) + 1)) AS i FROM (SELECT doc_name, {WORDS} AS w FROM docs_) WHERE len(w) > 0))"


@query("t1_chunk_passages", f"SELECT * FROM {CHUNKS}")
def t1(spark, d):
    return T.chunk_passages(passages(spark, d))


HASH = "substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16)"


@query("t2_passage_hash", f"SELECT doc_name, chunk_idx, {HASH} AS passage_hash FROM {CHUNKS}")
def t2(spark, d):
    return T.chunk_passages(passages(spark, d)).select("doc_name", "chunk_idx", S.text_hash(F.col("text")).alias("passage_hash"))


@query("t3_first_of_duplicates", f"SELECT * FROM (SELECT doc_name, chunk_idx, text, {HASH} AS passage_hash FROM {CHUNKS}) QUALIFY row_number() OVER (PARTITION BY passage_hash ORDER BY doc_name, chunk_idx) = 1")
def t3(spark, d):
    return T.first_of_duplicates(T.chunk_passages(passages(spark, d)))


TAGS = f"(SELECT doc_name AS asked, CASE chunk_idx % 4 WHEN 0 THEN upper({HASH}) WHEN 1 THEN ' ' || {HASH} WHEN 2 THEN substr({HASH}, 1, 12) ELSE 'tag' || chunk_idx END AS tag FROM {CHUNKS})"


@query("t3_resolve_hashes", f"SELECT a.asked, a.tag, f.doc_name, f.chunk_idx, f.passage_hash IS NOT NULL AS found FROM {TAGS} a LEFT JOIN (SELECT * FROM (SELECT doc_name, chunk_idx, {HASH} AS passage_hash FROM {CHUNKS}) QUALIFY row_number() OVER (PARTITION BY passage_hash ORDER BY doc_name, chunk_idx) = 1) f ON f.passage_hash = lower(trim(a.tag)) AND regexp_full_match(lower(trim(a.tag)), '[0-9a-f]{{12,20}}')")
def t3_resolve(spark, d):
    """Every passage's hash as a tag, in capitals, with a blank, cut short, or no hash at all."""
    p = T.chunk_passages(passages(spark, d))
    own, k = S.text_hash(F.col("text")), F.col("chunk_idx") % 4
    tag = F.when(k == 0, F.upper(own)).when(k == 1, F.concat(F.lit(" "), own)).when(k == 2, F.substring(own, 1, 12)).otherwise(F.concat(F.lit("tag"), F.col("chunk_idx").cast("string")))
    return T.resolve_hashes(p.select(F.col("doc_name").alias("asked"), tag.alias("tag")), p).select("asked", "tag", "doc_name", "chunk_idx", "found")


@query("t4_query_terms", "SELECT item_id, array_to_string(list_transform(list_filter(list_transform(w, lambda x, i: {'x': x, 'k': list_position(w, x) = i}), lambda s: s.k), lambda s: s.x), ' ') AS terms FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x)) AS w FROM benchmark)")
def t4(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


def search_set(spark, d):
    """Passages of all documents; each benchmark text asks by its first twelve words for the four that follow them."""
    p = T.chunk_passages(passages(spark, d)).select(F.concat_ws("#", "doc_name", F.lpad(F.col("chunk_idx").cast("string"), 5, "0")).alias("passage_id"), "text")
    words = F.split("text", r"\s+")
    gold = read(spark, d, "benchmark").where(F.size(words) >= 16).select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 12), " ").alias("question"), F.array_join(F.slice(words, 13, 4), " ").alias("answer_phrase"))
    return p, gold


@query("t5_bm25")
def t5(spark, d):
    p, gold = search_set(spark, d)
    return T.bm25(p, gold).withColumn("score", F.round("score", 6))


PASSAGES = f"(SELECT doc_name || '#' || lpad(CAST(chunk_idx AS VARCHAR), 5, '0') AS passage_id, lower(text) AS t FROM {CHUNKS})"
QUESTIONS = "(SELECT item_id AS query_id, lower(array_to_string(string_split_regex(text, '\\s+')[1:12], ' ')) AS q FROM benchmark WHERE len(string_split_regex(text, '\\s+')) >= 16)"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query("t6_grep_rank", f"SELECT query_id, passage_id, CAST(n AS INTEGER) AS distinct_words, times AS occurrences, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, times DESC, passage_id) AS rank FROM (SELECT query_id, passage_id, count(*) AS n, CAST(sum((length(t) - length(replace(t, w, ''))) // length(w)) AS BIGINT) AS times FROM {PASSAGES} JOIN (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(regexp_extract_all(q, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM {QUESTIONS}) WHERE length(w) >= 2 AND NOT list_contains({STOPS}, w)) ON contains(t, w) GROUP BY ALL)) WHERE rank <= 5")
def t6(spark, d):
    p, gold = search_set(spark, d)
    return T.grep_rank(p, gold)


@query("t6_density_rank", f"SELECT query_id, passage_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (SELECT query_id, passage_id, len(list_filter(w, lambda x: len(list_filter(parts, lambda y: contains(x, y))) > 0)) / len(w) AS score FROM (SELECT passage_id, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM {PASSAGES}) CROSS JOIN (SELECT query_id, list_filter(list_distinct(string_split_regex(q, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')), lambda x: length(x) >= 3) AS parts FROM {QUESTIONS}))) WHERE rank <= 5")
def t6_density(spark, d):
    p, gold = search_set(spark, d)
    return T.density_rank(p, gold).withColumn("score", F.round("score", 9))


@query("a44_search_recall")
def a44(spark, d):
    p, gold = search_set(spark, d)
    return T.recall_by_ranker(p, gold)


@query("t7_excerpts", "SELECT doc_name, replace(substr(text, 1, 800), chr(10), ' ') AS excerpt FROM docs_ WHERE contains(lower(doc_name), 'the ') OR contains(lower(replace(substr(text, 1, 800), chr(10), ' ')), 'the ')")
def t7(spark, d):
    return T.search_excerpts(T.excerpts(passages(spark, d)), "the ")


def answers(spark, d):
    o = read(spark, d, "orders")
    text = F.concat(F.lit("Flow is "), F.round(F.col("o_totalprice") / 1000, 1).cast("string"), F.lit(" [run:r"), (F.col("o_custkey") % 50).cast("string"), F.lit("#mean.q] see [lit:tag"), F.col("o_orderkey").cast("string"), F.lit("] and [claim:c"), (F.col("o_orderkey") % 30).cast("string"), F.lit("]."))
    return o.select(F.col("o_orderkey").alias("answer_id"), text.alias("text"))


@query("t9_citation_markers", "SELECT o_orderkey AS answer_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS place, unnest(['run', 'lit', 'claim']) AS kind, unnest(['r' || (o_custkey % 50), 'tag' || o_orderkey, 'c' || (o_orderkey % 30)]) AS id, unnest(['mean.q', NULL, NULL]) AS path FROM orders")
def t9(spark, d):
    return T.citation_markers(answers(spark, d))


@query("t10_marked_numbers", "SELECT o_orderkey AS answer_id, CASE WHEN o_orderstatus = 'P' THEN 'unresolved' WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN abs(round(o_totalprice / 1000, 1) - o_totalprice / 1000) <= 0.05 + 1e-9 THEN 'match' ELSE 'mismatch' END WHEN o_orderpriority = '2-HIGH' THEN 'match' WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN abs(floor(o_totalprice / 1000) - o_totalprice / 1000) <= 0.5 + 1e-9 OR abs(floor(o_totalprice / 1000) / 100 - o_totalprice / 1000) <= (0.5 + 1e-9) / 100 THEN 'match' ELSE 'mismatch' END WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE WHEN abs(floor(o_totalprice) * 1e-3 - o_totalprice / 1000) <= 0.0005 + 1e-9 THEN 'match' ELSE 'mismatch' END ELSE 'mismatch' END AS verdict FROM orders")
def t10(spark, d):
    """Each order's price in thousands, as printed in five ways: a decimal, a power of ten, a percentage, e-notation, no number."""
    o = read(spark, d, "orders")
    k, priority = F.col("o_totalprice") / 1000, F.col("o_orderpriority")
    shown = F.when(priority == "1-URGENT", F.round(k, 1).cast("string")).when(priority == "2-HIGH", F.concat(F.format_number(F.col("o_totalprice"), 2), F.lit("×10⁻³"))).when(priority == "3-MEDIUM", F.concat(F.floor(k).cast("string"), F.lit("%"))).when(priority == "4-NOT SPECIFIED", F.concat(F.floor("o_totalprice").cast("string"), F.lit("e-3"))).otherwise("1.2.3")
    markers = o.select(F.col("o_orderkey").alias("answer_id"), shown.alias("shown"), F.col("o_orderkey").cast("string").alias("run_id"), F.lit("q.mean").alias("path"))
    outputs = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("run_id"), F.lit("q.mean").alias("path"), k.alias("value"))
    return L.check_marked_numbers(markers, outputs).select("answer_id", "verdict")


@query("t11_stale_claims_cited", "SELECT o_orderkey AS answer_id, 'c' || (o_orderkey % 30) AS id, CASE o_orderkey % 30 % 3 WHEN 0 THEN 'stale' ELSE 'unknown_claim' END AS problem FROM orders WHERE o_orderkey % 30 % 3 = 0 OR o_orderkey % 30 >= 25")
def t11(spark, d):
    claims = spark.range(30).where("id < 25 OR id % 3 = 0").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("claim_id"), F.when(F.col("id") % 3 == 0, "stale").otherwise("supported").alias("status"))
    return L.stale_claims_cited(T.citation_markers(answers(spark, d)), claims)


@query("t10_coverage", "SELECT l_orderkey AS answer_id, count(*) FILTER (l_quantity > 5) AS counted, count(*) FILTER (l_quantity > 5 AND l_returnflag <> 'N') AS cited, round(count(*) FILTER (l_quantity > 5 AND l_returnflag <> 'N') / nullif(count(*) FILTER (l_quantity > 5), 0), 6) AS coverage FROM lineitem GROUP BY 1")
def t10_coverage(spark, d):
    numbers = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), (F.col("l_quantity") > 5).alias("counted"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("[run:"), F.col("l_suppkey").cast("string"), F.lit("]"))).alias("marker"))
    return L.citation_coverage(numbers).withColumn("coverage", F.round("coverage", 6))


@query("t12_report_verdict", "SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN bool_or(o_totalprice > 495000) THEN 'flagged' WHEN count(o_orderkey) > 0 THEN 'advisory' ELSE 'clean' END AS verdict FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY c_custkey")
def t12(spark, d):
    issues = read(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").cast("string").alias("session_id"), F.when(F.col("o_totalprice") > 495000, "error").otherwise("info").alias("severity"))
    return L.report_verdict(issues, read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session_id")))


@query("t12_assumptions", "SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS assumption_id, n AS n_supported FROM orders JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0 GROUP BY 1) ON k = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O'")
def t12_assumptions(spark, d):
    o = read(spark, d, "orders").withColumn("session_id", F.col("o_custkey").cast("string"))
    assumptions = o.select("session_id", F.col("o_orderkey").alias("assumption_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("risk"), (F.col("o_orderstatus") == "O").alias("validated"))
    good = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    claims = o.join(good, "o_custkey").select("session_id", F.when(F.col("o_orderstatus") == "F", "supported").otherwise("proposed").alias("status"))
    return L.assumption_violations(assumptions, claims)


#: Each order has two runs as parents, of a third and a fifth of its number; few are in the log at small sizes.
WALK = "WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM (SELECT o_orderkey AS child, o_orderkey // 3 AS parent FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 5 FROM orders)), w AS (SELECT o_orderkey AS start, o_orderkey AS run_id, 0 AS steps FROM orders UNION SELECT w.start, e.parent, w.steps + 1 FROM w JOIN e ON e.child = w.run_id WHERE w.steps < 8), s AS (SELECT start, run_id, CAST(min(steps) AS INTEGER) AS steps FROM w GROUP BY ALL)"
OPEN = "(SELECT DISTINCT s.start FROM s JOIN e ON e.child = s.run_id WHERE s.steps = 8 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.start = s.start AND t.run_id = e.parent))"


def run_edges(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o, o.select(k.alias("child"), F.floor(k / 3).alias("parent")).union(o.select(k, F.floor(k / 5)))


@query("t13_lineage", f"{WALK} SELECT start, run_id, steps, start IN (SELECT * FROM {OPEN}) AS stopped FROM s")
def t13(spark, d):
    o, edges = run_edges(spark, d)
    return L.lineage(edges, o.select(F.col("o_orderkey").alias("start")))


@query("t13_lineage_down", "WITH RECURSIVE e AS (SELECT o_orderkey AS child, o_orderkey // 3 AS parent FROM orders UNION SELECT o_orderkey, o_orderkey // 5 FROM orders), w AS (SELECT o_orderkey AS start, o_orderkey AS run_id, 0 AS steps FROM orders UNION SELECT w.start, e.child, w.steps + 1 FROM w JOIN e ON e.parent = w.run_id WHERE w.steps < 3) SELECT start, count(DISTINCT run_id) AS n FROM w GROUP BY start")
def t13_down(spark, d):
    o, edges = run_edges(spark, d)
    return L.lineage(edges, o.select(F.col("o_orderkey").alias("start")), depth=3, down=True).groupBy("start").agg(F.count(F.lit(1)).alias("n"))


@query("t13_states", f"{WALK}, r AS (SELECT o_orderkey AS run_id, o_orderstatus <> 'P' OR o_totalprice < 400000 AS rec, o_orderpriority = '1-URGENT' AND o_totalprice > 350000 AS acq, o_orderpriority = '5-LOW' AND o_totalprice > 450000 AS lost FROM orders) SELECT start, CASE WHEN bool_or(coalesce(rec AND acq, false)) THEN 'observed' WHEN bool_or(NOT coalesce(rec, false) OR lost) OR start IN (SELECT * FROM {OPEN}) THEN 'unknown' ELSE 'undeclared' END AS state, count(*) AS walked FROM s LEFT JOIN r ON r.run_id = s.run_id GROUP BY start")
def t13_states(spark, d):
    o, edges = run_edges(spark, d)
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    runs = o.select(F.col("o_orderkey").alias("run_id"), ((F.col("o_orderstatus") != "P") | (price < 400000)).alias("has_record"), ((priority == "1-URGENT") & (price > 350000)).alias("acquires"), F.when((priority == "5-LOW") & (price > 450000), "lost").alias("parent_unresolved"), F.lit(2).alias("n_parents"), F.lit(False).alias("basis"))
    return L.lineage_states(L.lineage(edges, o.select(F.col("o_orderkey").alias("start"))), runs)


DIGEST = "'sha256:' || sha256(string_agg(strftime(date, '%Y-%m-%d') || chr(9) || CASE WHEN value IS NULL THEN 'nan' ELSE CAST(value AS VARCHAR) END || chr(10), '' ORDER BY date))"


@query("t14_series_digest", f"SELECT site_id, {DIGEST} AS digest FROM gappy GROUP BY site_id")
def t14(spark, d):
    return L.series_digest(gappy(spark, d))


@query("t14_verified_series", "SELECT site_id, CASE WHEN site_id = 'g1' THEN NULL ELSE date END AS date, CASE WHEN site_id = 'g1' THEN NULL ELSE value END AS value, CASE WHEN site_id = 'g1' THEN 'mismatch' ELSE 'verified' END AS verdict FROM gappy WHERE site_id <> 'g1' OR date = (SELECT min(date) FROM gappy WHERE site_id = 'g1')")
def t14_verified(spark, d):
    s = gappy(spark, d)
    then = L.series_digest(s).withColumn("digest", F.when(F.col("site_id") == "g1", "sha256:0").otherwise(F.col("digest")))
    return L.verified_series(s, then)


@query("t8_search_results", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent')")
def t8(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.to_json(F.struct("o_orderpriority")).alias("data"), F.col("o_orderstatus").alias("notes"))
    return L.search_results(rows, "URGENT").select("o_orderkey", "o_orderpriority")


@query("t8_compare_sessions", "SELECT c_mktsegment AS slot, max(c_name) FILTER (c_nationkey = 1) AS s1, max(c_name) FILTER (c_nationkey = 2) AS s2 FROM customer WHERE c_nationkey IN (1, 2) GROUP BY 1")
def t8_compare(spark, d):
    rows = read(spark, d, "customer").where("c_nationkey IN (1, 2)").select(F.col("c_mktsegment").alias("slot"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("session_id"), F.col("c_name").alias("data"))
    return L.compare_sessions(rows, ["s1", "s2"])


@query("j14_span_problems", "SELECT l_orderkey AS claim_id, l_suppkey AS span, CASE WHEN l_quantity < 3 THEN 'no_id' WHEN s_suppkey IS NULL OR s_acctbal > 9500 THEN 'run_absent' WHEN s_acctbal < 0 THEN 'hollow_run' WHEN NOT ((l_returnflag = 'A') OR (l_returnflag = 'R' AND s_nationkey < 12)) THEN 'metric_absent' END AS problem FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey")
def j14(spark, d):
    spans = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("span"), F.when(F.col("l_quantity") < 3, "").otherwise(F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("q."), "l_returnflag").alias("metric_ref"))
    s = read(spark, d, "supplier").withColumn("run_id", F.col("s_suppkey").cast("string"))
    outputs = s.select("run_id", F.lit("q.A").alias("path")).union(s.where("s_nationkey < 12").select("run_id", F.lit("q.R")))
    return L.span_problems(spans, s.where("s_acctbal <= 9500").select("run_id", (F.col("s_acctbal") < 0).alias("hollow")), outputs).select("claim_id", "span", "problem")


@query("j15_stale_evidence", "SELECT coalesce(v.claim_id, s.claim_id) AS claim_id, coalesce(v.source_id, s.source_id) AS source_id, CASE WHEN v.claim_id IS NULL THEN 'no_version' WHEN s.claim_id IS NULL THEN 'no_span' WHEN p_partkey IS NULL THEN 'source_missing' ELSE 'changed' END AS reason FROM (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS source_id FROM lineitem WHERE l_returnflag <> 'R') v FULL JOIN (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS source_id FROM lineitem WHERE l_linestatus = 'F') s ON s.claim_id = v.claim_id AND s.source_id = v.source_id LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = coalesce(v.source_id, s.source_id) WHERE v.claim_id IS NULL OR s.claim_id IS NULL OR p_partkey IS NULL OR p_retailprice > 1000")
def j15(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("source_id"), "l_returnflag", "l_linestatus")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("source_id"), "p_brand", "p_size", "p_retailprice")
    then = part.select("source_id", F.col("p_brand").alias("digest"))
    now = part.where("p_size > 5").select("source_id", F.when(F.col("p_retailprice") > 1000, "new").otherwise(F.col("p_brand")).alias("digest"))
    versions = li.where("l_returnflag <> 'R'").select("claim_id", "source_id").distinct().join(then, "source_id")
    return L.stale_evidence(versions, li.where("l_linestatus = 'F'"), now)


@query("j16_scope_overreach", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS session_id, CAST(10000000 + o_orderkey AS VARCHAR) AS gauge_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def j16(spark, d):
    o = read(spark, d, "orders")
    gauge = (F.lit(10000000) + F.col("o_orderkey")).cast("string")
    texts = o.select(F.col("o_custkey").cast("string").alias("session_id"), F.concat(F.lit("At gauge "), gauge, F.lit(", 12 m3/s")).alias("text"))
    scopes = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("session_id"), gauge.alias("gauge_id"))
    return L.scope_overreach(texts, scopes)


@query("a39_experiment_summary", "SELECT metric, round(avg(v), 4) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max, count(v) AS n FROM (SELECT unnest(['avg', 'top']) AS metric, unnest([a, t]) AS v FROM (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS a, max(o_totalprice) AS t FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1) WHERE a IS NOT NULL) GROUP BY metric")
def a39(spark, d):
    o = read(spark, d, "orders")
    g = o.groupBy(F.col("o_custkey").cast("string").alias("feature")).agg(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("avg"), F.max("o_totalprice").alias("top"))
    long = g.unpivot(["feature"], ["avg", "top"], "metric", "value").withColumn("run_id", F.when(F.col("feature").cast("long") % 9 != 0, F.concat(F.lit("r"), "feature")))
    return L.experiment_summary(L.experiment_table(long, ["avg", "top"]), ["avg", "top"])


NAMES = [*L.SIGNATURES, "BFI", "Runoff-Coefficient", "nse", "mean"]
SIGNATURE_SQL = "CASE l_suppkey % 22 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate([*L.SIGNATURES, "baseflow_index", "runoff_ratio"])) + " END"


RUNS = f"SELECT {SIGNATURE_SQL} AS metric, CAST(l_linenumber AS VARCHAR) AS feature, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS period, l_linestatus AS tool, CAST(l_suppkey % 3 AS VARCHAR) AS method, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS run_id, l_quantity AS value FROM lineitem WHERE l_suppkey % 22 < 20"


@query("a40_metric_conflicts", f"SELECT metric, feature, period, min(value) AS low, max(value) AS high, count(*) AS n FROM (SELECT * FROM ({RUNS}) WHERE period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metric, feature, period, tool, method ORDER BY ts DESC, run_id DESC) = 1) GROUP BY ALL HAVING count(*) > 1 AND max(value) - min(value) > 0.01 * max(value)")
def a40(spark, d):
    li = read(spark, d, "lineitem")
    rows = li.select(F.get(F.array(*map(F.lit, NAMES)), (F.col("l_suppkey") % 22).cast("int")).alias("metric"), F.col("l_linenumber").cast("string").alias("feature"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("period"), F.col("l_linestatus").alias("tool"), (F.col("l_suppkey") % 3).cast("string").alias("method"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_quantity").alias("value"))
    return L.metric_conflicts(rows)


GAUGE_RUNS = "(SELECT DISTINCT CAST(o_custkey // 15 AS VARCHAR) AS gauge_id, o_orderpriority AS study, CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate AS ts FROM orders)"


def gauge_runs(spark, d):
    return read(spark, d, "orders").select(F.floor(F.col("o_custkey") / 15).cast("string").alias("gauge_id"), F.col("o_orderpriority").alias("study"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("ts"))


@query("a41_runs_of_gauge", f"SELECT gauge_id, study, count(*) AS n_runs, array_to_string((list(run_id ORDER BY ts DESC, run_id DESC))[1:5], ',') AS newest, count(*) > 5 AS truncated FROM {GAUGE_RUNS} GROUP BY ALL")
def a41(spark, d):
    return L.runs_of_gauge(gauge_runs(spark, d), 5).withColumn("newest", F.array_join("newest", ","))


@query("a41_studies_of_gauge", f"SELECT gauge_id, study, bound_to_gauge, n_runs, CAST(rank AS INTEGER) AS rank, n_studies, n_studies > 4 AS studies_truncated FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY bound_to_gauge DESC, n_runs DESC, study) AS rank, count(*) OVER (PARTITION BY gauge_id) AS n_studies FROM (SELECT coalesce(r.gauge_id, b.gauge_id) AS gauge_id, coalesce(r.study, b.study) AS study, b.study IS NOT NULL AS bound_to_gauge, coalesce(n, 0) AS n_runs FROM (SELECT gauge_id, study, count(*) AS n FROM {GAUGE_RUNS} GROUP BY ALL) r FULL JOIN (SELECT DISTINCT CAST(c_custkey // 15 AS VARCHAR) AS gauge_id, c_mktsegment AS study FROM customer WHERE c_acctbal < -500) b ON b.gauge_id = r.gauge_id AND b.study = r.study)) WHERE rank <= 4")
def a41_studies(spark, d):
    bound = read(spark, d, "customer").where("c_acctbal < -500").select(F.floor(F.col("c_custkey") / 15).cast("string").alias("gauge_id"), F.col("c_mktsegment").alias("study"))
    return L.studies_of_gauge(gauge_runs(spark, d), bound, most=4).select("gauge_id", "study", "bound_to_gauge", "n_runs", "rank", "n_studies", "studies_truncated")


@query("a42_edge_states", "SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'no_record' WHEN o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderkey // 2 <> o_orderkey) OR (o_orderpriority = '5-LOW' AND o_custkey <> o_orderkey) THEN 'declared' WHEN o_totalprice < 50000 THEN 'declared_unresolved' WHEN o_totalprice < 200000 THEN 'acquisition_root' ELSE 'undeclared' END AS state, count(*) AS n FROM orders GROUP BY 1")
def a42(spark, d):
    k, priority, price = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice")
    refs = F.when(priority == "2-HIGH", F.array(F.floor(k / 2), F.lit(-1).cast("bigint"))).when(priority == "5-LOW", F.array("o_custkey")).otherwise(F.array(F.lit(-1).cast("bigint")))
    runs = read(spark, d, "orders").select(k.alias("run_id"), F.when(priority == "1-URGENT", F.array(F.floor(k / 3))).otherwise(F.array().cast("array<bigint>")).alias("parents"), refs.alias("input_refs"), F.when(price < 50000, "lost").alias("parent_unresolved"), (price < 200000).alias("acquires"), (~((F.col("o_orderstatus") == "P") & (price > 300000))).alias("has_record"))
    return L.edge_states(runs).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("a48_ledger_listing", "SELECT CAST(o_custkey % 50 AS VARCHAR) AS session_id, o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS stale, count(*) FILTER (o_orderkey % 5 = 0) AS unapproved FROM orders GROUP BY ALL")
def a48(spark, d):
    k = F.col("o_orderkey")
    return L.ledger_listing(read(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("session_id"), F.col("o_orderstatus").alias("status"), (k % 4 == 0).alias("stale"), F.when(k % 5 != 0, "ok").alias("approval")))


@query("w16_merge_shards", "SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderpriority AS slot, arg_max(CAST(o_orderkey AS VARCHAR), (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS shard_id, arg_max(o_totalprice, (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS value, count(*) - 1 AS n_overridden FROM orders GROUP BY ALL")
def w16(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderpriority").alias("slot"), F.col("o_orderkey").cast("string").alias("shard_id"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("value"))
    return L.merge_shards(rows)


@query("w16_shard_conflicts", "SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderpriority AS slot, CAST(o_orderkey AS VARCHAR) AS shard_id, lead(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS replaced_by FROM orders) WHERE replaced_by IS NOT NULL")
def w16_conflicts(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderpriority").alias("slot"), F.col("o_orderkey").cast("string").alias("shard_id"), F.col("o_orderdate").alias("mtime"))
    return L.shard_conflicts(rows)


@query("w16_union_of_items", "SELECT session_id, kind, item, row_number() OVER (PARTITION BY session_id, kind ORDER BY d, k, item) AS position FROM (SELECT CAST(o_custkey AS VARCHAR) AS session_id, kind, item, arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS d, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM (SELECT o_custkey, o_orderdate, o_orderkey, unnest(['note', 'citation']) AS kind, unnest([o_orderpriority, o_orderstatus]) AS item FROM orders) GROUP BY ALL)")
def w16_union(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("shard_id"), F.col("o_orderdate").alias("mtime"), F.lit(0).alias("place"), F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("citation"))
    items = o.unpivot(["session_id", "shard_id", "mtime", "place"], ["note", "citation"], "kind", "item")
    return L.union_of_items(items).withColumn("position", F.col("position").cast("long"))


@query("w17_holm", "SELECT family, test_id, round(least(1.0, max(f) OVER (PARTITION BY family ORDER BY p, test_id ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM (SELECT p_brand AS family, p_partkey AS test_id, p, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) * p AS f FROM (SELECT *, p_retailprice / 100000 AS p FROM part))")
def w17(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("test_id"), (F.col("p_retailprice") / 100000).alias("p"))
    return L.holm(rows).select("family", "test_id", F.round("p_holm", 9).alias("p_holm"))


@query("w15_hydrograph_frames", "SELECT event_id, i, t AS time_hr, until, q AS discharge FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) AS r FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, i = min(i) FILTER (q = mx) OVER (PARTITION BY event_id) AS peak FROM (SELECT *, max(q) OVER (PARTITION BY event_id) AS mx FROM (SELECT CAST(o_custkey // 15 AS VARCHAR) AS event_id, row_number() OVER w - 1 AS i, CAST(o_orderkey AS DOUBLE) AS t, coalesce(lead(CAST(o_orderkey AS DOUBLE)) OVER w, o_orderkey + 0.25) AS until, o_totalprice AS q FROM orders WINDOW w AS (PARTITION BY o_custkey // 15 ORDER BY o_orderkey)))) WHERE n <= 12 OR list_contains(list_transform(range(0, 11), lambda x: CASE WHEN x = 10 THEN n - 1 ELSE CAST(floor(x * ((n - 1) / 10.0::DOUBLE)) AS BIGINT) END), i) OR peak OR i = 0 OR i = n - 1) WHERE r <= 12")
def w15(spark, d):
    rows = read(spark, d, "orders").select(F.floor(F.col("o_custkey") / 15).cast("string").alias("event_id"), F.col("o_orderkey").cast("double").alias("time_hr"), F.col("o_totalprice").alias("discharge"))
    return L.hydrograph_frames(rows, 12)


#: A run an order, with its lines; the price stands in two places, one number is hidden, one lies in a list only.
RUN_DOCUMENTS = """(SELECT o_orderkey AS run_id, json_object('key_outputs', json_object('total', o_totalprice, 'status', o_orderstatus, 'stats', json_object('mean', avg(l_quantity), 'n', count(*), '_raw', max(l_tax)), '_uncertainty', json_object('half', min(l_discount))), 'evidence', json_object('data', json_object('total', -o_totalprice, 'late', bool_or(l_returnflag = 'R'), 'spread', max(l_extendedprice) - min(l_extendedprice))), 'inputs', json_object('customer', o_custkey, 'day', CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), 'lines', list({'part': l_partkey, 'price': l_extendedprice, 'flags': [l_returnflag, l_linestatus]} ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_linestatus)) AS doc FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_orderstatus, o_custkey, o_orderdate)"""


def run_documents(spark, d):
    """JSON texts of nested run documents, made from orders and their lines."""
    met = read(spark, d, "orders").join(read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    line = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.array("l_returnflag", "l_linestatus").alias("flags")).alias("line"))
    g = met.groupBy(F.col("o_orderkey").alias("run_id"), "o_totalprice", "o_orderstatus", "o_custkey", "o_orderdate").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("raw"), F.min("l_discount").alias("half"), F.bool_or(F.col("l_returnflag") == "R").alias("late"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"), F.array_sort(F.collect_list(line)).alias("lines"))
    outputs = F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.struct("mean", "n", F.col("raw").alias("_raw")).alias("stats"), F.struct("half").alias("_uncertainty"))
    evidence = F.struct(F.struct((-F.col("o_totalprice")).alias("total"), "late", "spread").alias("data"))
    inputs = F.struct(F.col("o_custkey").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return g.select("run_id", F.to_json(F.struct(outputs.alias("key_outputs"), evidence.alias("evidence"), inputs.alias("inputs"), F.col("lines.line").alias("lines"))).alias("doc"))


@query("json_leaves", f"SELECT run_id, path, kind, round(CASE WHEN kind = 'number' THEN CAST(atom AS DOUBLE) END, 6) AS number, CASE WHEN kind = 'string' THEN atom ->> '$' END AS text FROM (SELECT d.run_id, replace(regexp_replace(substr(t.fullkey, 3), '\\[(\\d+)\\]', '.\\1', 'g'), chr(34), '') AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, t.atom FROM {RUN_DOCUMENTS} d, json_tree(d.doc) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))")
def json_leaves(spark, d):
    leaves = D.json_leaves(run_documents(spark, d), ["run_id"], "doc")
    return leaves.select("run_id", "path", "kind", F.round("number", 6).alias("number"), F.when(F.col("kind") == "string", F.col("text")).alias("text"))


OUTPUTS = "(SELECT o_orderkey AS run_id, unnest(['key_outputs.total', 'key_outputs.stats.mean', 'key_outputs.stats.n', 'key_outputs._uncertainty.half', 'key_outputs.spread', 'inputs.customer']) AS path, unnest([o_totalprice, avg(l_quantity), count(*), min(l_discount), max(l_extendedprice) - min(l_extendedprice), o_custkey]) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_custkey)"


@query("t10_run_documents", f"SELECT m.answer_id, m.path, CASE WHEN value IS NULL THEN 'unresolved' WHEN abs(shown - value) <= 0.05 + 1e-9 THEN 'match' ELSE 'mismatch' END AS verdict FROM (SELECT o_orderkey AS answer_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'key_outputs.total' WHEN '2-HIGH' THEN 'key_outputs.stats.mean' WHEN '3-MEDIUM' THEN 'key_outputs.stats._raw' WHEN '5-LOW' THEN 'lines.0.price' ELSE 'key_outputs.spread' END AS path, CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice, 1) ELSE 25.5 END AS shown FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) m LEFT JOIN {OUTPUTS} o ON o.run_id = m.answer_id AND o.path = m.path")
def t10_documents(spark, d):
    """Marked numbers against what their runs' documents hold; hidden numbers and those in lists do not resolve."""
    docs = run_documents(spark, d)
    path = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("1-URGENT", "key_outputs.total", "2-HIGH", "key_outputs.stats.mean", "3-MEDIUM", "key_outputs.stats._raw", "5-LOW", "lines.0.price"))), "o_orderpriority"), F.lit("key_outputs.spread"))
    shown = F.when(F.col("o_orderstatus") == "O", F.format_number("o_totalprice", 1)).otherwise("25.5")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))  # orders without lines have no document
    o = read(spark, d, "orders").withColumn("run_id", F.col("o_orderkey")).join(lines, "run_id", "left_semi")
    markers = o.select(F.col("o_orderkey").alias("answer_id"), "run_id", path.alias("path"), shown.alias("shown"))
    outputs = D.run_outputs(D.json_leaves(docs, ["run_id"], "doc", lists=False))
    return L.check_marked_numbers(markers, outputs).select("answer_id", "path", "verdict")


@query("j14_run_documents", f"SELECT l_orderkey AS claim_id, l_linenumber AS span, CASE WHEN s.run_id IS NULL THEN 'run_absent' WHEN s.path IS NOT NULL AND o.path IS NULL THEN 'metric_absent' END AS problem FROM (SELECT l_orderkey, l_linenumber, r.o_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'key_outputs.total' WHEN 'R' THEN 'key_outputs.status' END AS path FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) r ON r.o_orderkey = l_suppkey) s LEFT JOIN {OUTPUTS} o ON o.run_id = s.run_id AND o.path = s.path")
def j14_documents(spark, d):
    """Evidence spans against runs and the numbers that their documents hold."""
    docs = run_documents(spark, d)
    spans = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("span"), F.col("l_suppkey").cast("string").alias("source_id"), F.when(F.col("l_returnflag") == "A", "key_outputs.total").when(F.col("l_returnflag") == "R", "key_outputs.status").alias("metric_ref"))
    outputs = D.run_outputs(D.json_leaves(docs, ["run_id"], "doc")).select(F.col("run_id").cast("string").alias("run_id"), "path")
    runs = docs.select(F.col("run_id").cast("string").alias("run_id"), F.lit(False).alias("hollow"))
    return L.span_problems(spans, runs, outputs).select("claim_id", "span", "problem")
