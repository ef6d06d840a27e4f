"""Queries of validation, cache, catalog, metric, request-log and routing operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyr.functions import validate as v
from papyr.operators import logs
from papyr.plans.inputs import FILES, KEYS, TASKS, USERS, cte, made, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NOW = "TIMESTAMP '1997-01-01 00:00:00'"
_EXT = "lower(regexp_extract(filename, '(\\.[^./]+)$', 1))"
_LIMIT = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN {n}" for e, n in v.LIMITS.items()) + " END"
_MEDIA = " OR ".join(f"({_EXT} = '{e}' AND media IN ({', '.join(repr(x) for x in k)}))" for e, k in v.MEDIA.items())
_HIT = " OR ".join(f"contains(substr(content, 1, {v.SCANNED}), '{p}')" for p in v.SUSPICIOUS)
_SCAN = f"CASE WHEN {_HIT} THEN 'suspicious' WHEN sha256(content) IN ({', '.join(repr(x) for x in v.MALICIOUS)}) THEN 'infected' ELSE 'clean' END"


def _listed(patterns, c: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{p}') THEN '{p}' END" for p in patterns) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT page_id, {_EXT} AS ext, {_EXT} IN {v.EXTENSIONS} AS allowed, CASE WHEN {_EXT} = '.hwpx' THEN 'hwpx' WHEN {_EXT} = '.pdf' THEN 'pdf' ELSE 'hwp' END AS parser FROM {cte(FILES)}")
def ext_dispatch(spark, sf_dir):
    name = F.col("filename")
    ext = v.extension(name)
    return made(spark, sf_dir, FILES).select("page_id", ext.alias("ext"), ext.isin(*v.EXTENSIONS).alias("allowed"), v.parser_of(name).alias("parser"))


@query(f"SELECT page_id, strlen(content)::BIGINT AS n, CASE WHEN strlen(content) > {v.UPLOAD_LIMIT} THEN 413 WHEN strlen(content) = 0 THEN 400 ELSE 200 END::BIGINT AS status, coalesce(strlen(content) <= {_LIMIT}, false) AS within FROM {cte(FILES)}")
def size_validation(spark, sf_dir):
    n = F.octet_length("content")
    status = F.when(n > v.UPLOAD_LIMIT, 413).when(n == 0, 400).otherwise(200).cast("long")
    within = F.coalesce(n <= v.limit_of(v.extension(F.col("filename"))), F.lit(False))
    return made(spark, sf_dir, FILES).select("page_id", n.cast("long").alias("n"), status.alias("status"), within.alias("within"))


@query(f"SELECT page_id, {_MEDIA} AS media_ok FROM {cte(FILES)}")
def media_validation(spark, sf_dir):
    return made(spark, sf_dir, FILES).select("page_id", v.media_ok(v.extension(F.col("filename")), F.col("media")).alias("media_ok"))


@query(f"SELECT page_id, {_listed(v.DANGEROUS, 'html')} AS threats FROM pages")
def threat_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(v.found(F.col("html"), v.DANGEROUS), ",").alias("threats"))


@query(f"SELECT page_id, {_SCAN} AS verdict, {_listed(v.SUSPICIOUS, f'substr(content, 1, {v.SCANNED})')} AS patterns FROM {cte(FILES)}")
def virus_verdict(spark, sf_dir):
    c = F.col("content")
    patterns = v.found(F.substring(c, 1, v.SCANNED), v.SUSPICIOUS)
    return made(spark, sf_dir, FILES).select("page_id", v.scan_verdict(c).alias("verdict"), F.array_join(patterns, ",").alias("patterns"))


_VALID = f"CASE WHEN {_EXT} NOT IN {v.EXTENSIONS} THEN 'extension' WHEN strlen(content) = 0 THEN 'empty' WHEN strlen(content) > {_LIMIT} THEN 'size' WHEN NOT ({_MEDIA}) THEN 'media' WHEN {_SCAN} <> 'clean' THEN 'virus' ELSE 'ok' END"


@query(f"SELECT page_id, {_VALID} AS verdict FROM {cte(FILES)}")
def validation_verdict(spark, sf_dir):
    return made(spark, sf_dir, FILES).select("page_id", v.validation(F.col("filename"), F.col("content"), F.col("media")).alias("verdict"))


@query(f"SELECT page_id, CASE WHEN kind = 'validation' THEN 400 WHEN kind = 'size' THEN 413 ELSE 500 END::BIGINT AS status, kind AS error, filename AS path FROM (SELECT page_id, filename, CASE {_VALID} WHEN 'ok' THEN NULL WHEN 'size' THEN 'size' WHEN 'virus' THEN 'parsing' ELSE 'validation' END AS kind FROM {cte(FILES)}) WHERE kind IS NOT NULL")
def error_envelope(spark, sf_dir):
    """Errors as a column: a bad file is a row of the result and never fails the job."""
    verdict = v.validation(F.col("filename"), F.col("content"), F.col("media"))
    kind = F.when(verdict == "ok", None).when(verdict == "size", "size").when(verdict == "virus", "parsing").otherwise("validation")
    out = made(spark, sf_dir, FILES).select("page_id", v.error_envelope(kind, verdict, F.col("filename")).alias("e")).where("e is not null")
    return out.select("page_id", F.col("e.status").cast("long").alias("status"), "e.error", "e.path")


#: Whole contents of files as bytes: pages behind the first bytes of containers, and pages as they are.
_BYTES = "SELECT page_id, concat(unhex(CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'D0CF11E0A1B11AE1' WHEN 1 THEN '504B030414000600' WHEN 2 THEN '255044462D312E34' WHEN 3 THEN '4857502044' WHEN 4 THEN 'D0CF11E0' ELSE '' END), encode(coalesce(html, ''){}))"


@query("SELECT page_id, CASE WHEN h LIKE 'D0CF11E0A1B11AE1%' THEN 'ole' WHEN h LIKE '504B0304%' THEN 'zip' WHEN h LIKE '255044462D%' THEN 'pdf' WHEN h LIKE '485750%' THEN 'hwp' ELSE 'unknown' END AS container, bytes FROM (SELECT page_id, left(hex(content), 16) AS h, octet_length(content)::BIGINT AS bytes FROM ("
       + _BYTES.format("").replace("concat(unhex(", "(unhex(").replace("END), encode", "END) || encode") + " AS content FROM pages))")
def container_magic(spark, sf_dir):
    """The container of each file by its first bytes, and its size."""
    files = spark.sql(_BYTES.format(", 'UTF-8'") + " AS content FROM {pages}", pages=table(spark, sf_dir, "pages"))
    return files.select("page_id", v.magic_of(F.col("content")).alias("container"), F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT event_id, event_type IN ('view', 'click', 'purchase') AS valid FROM events")
def option_check(spark, sf_dir):
    """An enumerated option against its allowed values."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("view", "click", "purchase").alias("valid"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, 'hwp_extract:json:' || sha256(text) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ':' || substr(md5('{\"lang\":\"' || lang || '\"}'), 1, 8) END AS key FROM documents")
def cache_key(spark, sf_dir):
    options = F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", logs.cache_key(F.lit("json"), F.col("text"), options).alias("key"))


_SIZE = "(event_id * 7919) % 30000000"
_TTL0 = "CASE kind WHEN 'json' THEN 5400 WHEN 'text' THEN 2880 ELSE 3600 END"


@query(f"SELECT event_id, least(CASE WHEN {_SIZE} > 10485760 THEN {_TTL0} * 2 WHEN {_SIZE} > 1048576 THEN floor({_TTL0} * 1.5) ELSE {_TTL0} END, 86400)::BIGINT AS ttl, {_SIZE} <= 104857600 AS admitted, {_SIZE} > 1024 AS compressed FROM {cte(TASKS)}")
def cache_ttl(spark, sf_dir):
    size = F.expr(_SIZE)
    return made(spark, sf_dir, TASKS).select("event_id", logs.cache_ttl(F.col("kind"), size).alias("ttl"), (size <= 100 * 1024 * 1024).alias("admitted"), (size > 1024).alias("compressed"))


@query("SELECT doc_id FROM documents WHERE 'src' || (doc_id % 7) <> source AND source NOT LIKE 'src1%'")
def cache_invalidate(spark, sf_dir):
    """What stays after one key and one glob were deleted."""
    d = table(spark, sf_dir, "documents")
    return d.where((F.concat(F.lit("src"), F.col("doc_id") % 7) != F.col("source")) & ~F.col("source").like("src1%")).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 0 AND sha256(c.text) = sha256(d.text))")
def memoised_new(spark, sf_dir):
    """Inputs that the cache (here the documents of even number) does not hold."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.where("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@query("SELECT event_type, user_id % 3 AS file_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def extraction_counter(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("file_type")).agg(F.count("*").alias("n"))


@query(f"SELECT event_type, le::DOUBLE AS le, count_if(value / 20 <= le)::BIGINT AS cumulative, count(*)::BIGINT AS total FROM events, (SELECT unnest({list(logs.BUCKETS)}) AS le) GROUP BY ALL")
def duration_histogram(spark, sf_dir):
    return logs.histogram(table(spark, sf_dir, "events").withColumn("s", F.col("value") / 20), "s", "event_type").select("event_type", "le", "cumulative", "total")


@query("SELECT event_type, arg_max(value, event_id) AS latest FROM events GROUP BY event_type")
def latest_gauge(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("value", "event_id").alias("latest"))


@query("SELECT user_id % 10 AS cache, count_if(event_type = 'view')::BIGINT AS hits, count_if(event_type = 'click')::BIGINT AS misses, coalesce(round(count_if(event_type = 'view') * 100.0 / nullif(count_if(event_type IN ('view', 'click')), 0), 2), 0)::DOUBLE AS hit_rate FROM events GROUP BY ALL")
def cache_stats(spark, sf_dir):
    hits, misses = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    rate = F.coalesce(F.round(hits * F.lit(100.0) / F.nullif(hits + misses, F.lit(0)), 2), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("cache")).agg(hits.alias("hits"), misses.alias("misses"), rate.alias("hit_rate"))


@query(f"SELECT count(*)::BIGINT AS scans, count_if({_SCAN} <> 'clean')::BIGINT AS threats, max(page_id) AS last_scan FROM {cte(FILES)}")
def scan_stats(spark, sf_dir):
    bad = v.scan_verdict(F.col("content")) != "clean"
    return made(spark, sf_dir, FILES).agg(F.count("*").alias("scans"), F.count_if(bad).alias("threats"), F.max("page_id").alias("last_scan"))


@query(f"SELECT id, username, is_active FROM {cte(USERS)} WHERE username = 'Customer#000000007'")
def user_by_name(spark, sf_dir):
    return made(spark, sf_dir, USERS).where("username = 'Customer#000000007'").limit(1)


@query(f"SELECT user_id, id, substr(key, 1, 8) || '...' AS preview, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id)::BIGINT AS place FROM {cte(KEYS)} WHERE is_active")
def api_keys_listing(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    keys = made(spark, sf_dir, KEYS).where("is_active")
    return keys.select("user_id", "id", F.concat(F.substring("key", 1, 8), F.lit("...")).alias("preview"), F.row_number().over(w).cast("long").alias("place"))


@query(f"SELECT id, key, is_active FROM {cte(KEYS)} WHERE id % 97 = 1 AND user_id % 2 = 0")
def compound_filter(spark, sf_dir):
    return made(spark, sf_dir, KEYS).where("id % 97 = 1 AND user_id % 2 = 0").select("id", "key", "is_active")


@query(f"SELECT k.id, u.username, k.is_active AND u.is_active AND created_at + INTERVAL 365 DAY >= {NOW} AS valid FROM {cte(KEYS)} k JOIN {cte(USERS)} u ON k.user_id = u.id")
def key_user_join(spark, sf_dir):
    """Keys with their users; valid if both are active and the key has not run out."""
    users = made(spark, sf_dir, USERS).select(F.col("id").alias("user_id"), "username", F.col("is_active").alias("u_active"))
    valid = F.col("is_active") & F.col("u_active") & F.expr(f"created_at + make_dt_interval(365) >= CAST({NOW} AS TIMESTAMP_NTZ)")
    return made(spark, sf_dir, KEYS).join(users, "user_id").select("id", "username", valid.alias("valid"))


@query(f"SELECT id, strftime(created_at + INTERVAL 30 DAY, '%Y-%m-%d') AS expires, created_at + INTERVAL 30 DAY < {NOW} AS expired FROM {cte(KEYS)}")
def expired_keys(spark, sf_dir):
    end = F.expr("created_at + make_dt_interval(30)")
    return made(spark, sf_dir, KEYS).select("id", F.date_format(end, "yyyy-MM-dd").alias("expires"), F.expr(f"created_at + make_dt_interval(30) < CAST({NOW} AS TIMESTAMP_NTZ)").alias("expired"))


_DAY = "BETWEEN TIMESTAMP '{0} 00:00:00' AND TIMESTAMP '{0} 23:59:59.999999'"


@query(f"SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders WHERE o_orderdate {_DAY.format('1996-01-02')} UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate {_DAY.format('1996-01-02')} UNION ALL SELECT 'total', (SELECT count(*) FROM orders WHERE o_orderdate {_DAY.format('1996-01-02')}) + (SELECT count(*) FROM lineitem WHERE l_shipdate {_DAY.format('1996-01-02')})")
def cleanup_counts(spark, sf_dir):
    """Rows of one day by table and in all; the bounds reach the scan."""
    def of(name, column):
        day = _DAY.format("1996-01-02").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
        return table(spark, sf_dir, name).where(f"{column} {day}").select(F.lit(name).alias("name"))

    rows = of("orders", "o_orderdate").union(of("lineitem", "l_shipdate"))
    kinds = spark.createDataFrame([("orders",), ("lineitem",)], "name string")
    counts = kinds.join(rows.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.union(counts.agg(F.lit("total"), F.sum("n")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -r_regionkey - 1, 'NEW' FROM region")
def row_mutations(spark, sf_dir):
    """Update, delete and insert as projection, anti-filter and union."""
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    kept = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select("o_orderkey", status.alias("status"))
    return kept.union(table(spark, sf_dir, "region").select((-F.col("r_regionkey") - 1).cast("long"), F.lit("NEW")))


@query(f"SELECT u.id, count(k.id)::BIGINT AS n_keys FROM {cte(USERS)} u LEFT JOIN {cte(KEYS)} k ON k.user_id = u.id GROUP BY u.id")
def user_keys(spark, sf_dir):
    counts = made(spark, sf_dir, KEYS).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_keys"))
    return made(spark, sf_dir, USERS).join(counts, "id", "left").select("id", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate < {NOW} - INTERVAL 24 HOUR")
def old_files(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(f"o_orderdate < CAST({NOW} AS TIMESTAMP_NTZ) - INTERVAL 24 HOUR").select("o_orderkey")


@query(f"SELECT task_id, arg_max(status, (ts, event_id)) AS status, CASE WHEN arg_max(status, (ts, event_id)) = 'SUCCESS' THEN 100 ELSE 0 END::BIGINT AS progress FROM {cte(TASKS)} GROUP BY task_id")
def latest_task_state(spark, sf_dir):
    last = made(spark, sf_dir, TASKS).groupBy("task_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return last.withColumn("progress", F.when(F.col("status") == "SUCCESS", 100).otherwise(0).cast("long"))


ROUTES = (("view", "extract", 5), ("click", "extract", 5), ("purchase", "priority", 9), ("error", "maintenance", 1))


@query("SELECT event_id, coalesce(q, 'default') AS queue, coalesce(p, 3)::BIGINT AS priority FROM events LEFT JOIN (VALUES " + ", ".join(map(str, ROUTES)) + ") r(event_type, q, p) USING (event_type)")
def queue_route(spark, sf_dir):
    routes = spark.createDataFrame(ROUTES, "event_type string, q string, p long")  # four rows, broadcast
    out = table(spark, sf_dir, "events").join(F.broadcast(routes), "event_type", "left")
    return out.select("event_id", F.coalesce("q", F.lit("default")).alias("queue"), F.coalesce("p", F.lit(3)).alias("priority"))


_REQUESTS = "SELECT event_id, user_id AS client, epoch_us(ts) / 1e6 AS t FROM events"


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, event_id) AS n FROM ({_REQUESTS})),
r AS (SELECT client, event_id, n, [t] AS log, true AS accepted FROM e WHERE n = 1 UNION ALL
SELECT e.client, e.event_id, e.n, CASE WHEN len(list_filter(r.log, lambda x: x > e.t - 86400)) < 2 THEN list_append(list_filter(r.log, lambda x: x > e.t - 86400), e.t) ELSE list_filter(r.log, lambda x: x > e.t - 86400) END,
len(list_filter(r.log, lambda x: x > e.t - 86400)) < 2 FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1)
SELECT event_id, accepted FROM r""")
def rate_limit_accept(spark, sf_dir):
    """Sliding log of 2 requests a day and client; rejected requests do not count."""
    return logs.rate_limited(_requests(spark, sf_dir), 2, 86400).select("event_id", "accepted")


@query(f"SELECT event_id, count(*) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM ({_REQUESTS})")
def trailing_request_count(spark, sf_dir):
    w = W.partitionBy("client").orderBy("t").rangeBetween(-3600, 0)
    return _requests(spark, sf_dir).select("event_id", F.count("*").over(w).alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ip:' || coalesce(NULLIF(event_id % 4, 0)::VARCHAR, 'unknown') ELSE 'user:' || substr(props, 1, 13) END AS client FROM events")
def client_id(spark, sf_dir):
    token = F.when(F.col("event_type") != "error", F.col("props"))
    address = F.nullif(F.col("event_id") % 4, F.lit(0)).cast("string")
    return table(spark, sf_dir, "events").select("event_id", logs.client_id(token, address).alias("client"))


@query("SELECT user_id, t, sum(sum(d)) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS active FROM (SELECT user_id, epoch_us(ts) // 1000000 AS t, 1 AS d FROM events UNION ALL SELECT user_id, epoch_us(ts) // 1000000 + 7200, -1 FROM events) GROUP BY user_id, t")
def concurrency_gate(spark, sf_dir):
    """Requests under way at each start or end, each taking two hours."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    marks = F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct((start + 7200).alias("t"), F.lit(-1).alias("d")))).alias("m")
    net = table(spark, sf_dir, "events").select("user_id", marks).groupBy("user_id", F.col("m.t").alias("t")).agg(F.sum("m.d").alias("d"))
    return net.select("user_id", "t", F.sum("d").over(W.partitionBy("user_id").orderBy("t")).alias("active"))


@query("SELECT event_id, CASE WHEN n < 10485760 THEN 'small' WHEN n < 104857600 THEN 'medium' ELSE 'large' END AS class, CASE WHEN m > 400 THEN 'critical' WHEN m > 300 THEN 'warning' ELSE 'ok' END AS memory, round((n - least(n, 10485760)) / n * 100, 2) AS saved_pct FROM (SELECT event_id, (event_id + 1) * 16384 AS n, event_id % 500 AS m FROM events)")
def size_class(spark, sf_dir):
    """Size class, memory status and what streaming would save."""
    n, m = (F.col("event_id") + 1) * 16384, F.col("event_id") % 500
    saved = F.round((n - F.least(n, F.lit(10 * 1024 * 1024))) / n * 100, 2)
    return table(spark, sf_dir, "events").select("event_id", logs.size_class(n).alias("class"), logs.memory_status(m).alias("memory"), saved.alias("saved_pct"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN props ELSE event_type END AS content FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def chunk_projection(spark, sf_dir):
    """Content of text chunks and pages, and the text of a final chunk, by the chunk's type."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return e.select("event_id", F.coalesce(F.when(F.col("event_type").isin("view", "click"), F.col("props")), F.col("event_type")).alias("content"))


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, event_id) AS n FROM ({_REQUESTS})),
r AS (SELECT client, event_id, n, t, true AS accepted, 1.0::DOUBLE AS level FROM e WHERE n = 1 UNION ALL
SELECT client, event_id, n, t, left_over <= 1, left_over + (left_over <= 1)::INT::DOUBLE FROM (
  SELECT e.client, e.event_id, e.n, e.t, greatest(0.0::DOUBLE, r.level - (e.t - r.t) * (1.0::DOUBLE / 21600)) AS left_over FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1))
SELECT event_id, accepted FROM r""")
def leaky_bucket(spark, sf_dir):
    """A bucket that leaks one request in six hours and holds one, by user."""
    return logs.leaky(_requests(spark, sf_dir), 1 / 21600, 1).select("event_id", "accepted")
