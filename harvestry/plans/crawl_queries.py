"""Queries on traversal, pacing, aggregates and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import frontier, pacing, pages
from ..streaming import events as S
from . import tables as T
from .page_queries import links_sql
from .url_queries import _NORM

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _site(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A site whose pages are the customers: page i links to 2i+1, 2i+2, itself, 2i+1 again and another host."""
    k = F.col("c_custkey")
    u = lambda x: F.concat(F.lit("https://site.test/p/"), x.cast("string"))
    t = T.read(spark, d, "customer")
    m = t.agg(F.max("c_custkey")).first()[0]
    e = t.select(u(k).alias("source"), F.posexplode(F.array(k * 2 + 1, k * 2 + 2, k, k * 2 + 1, F.lit(-1).cast("long"))).alias("ord", "to"))
    e = e.where(F.col("to") <= m).select("source", "ord", F.when(F.col("to") < 0, "https://other.test/").otherwise(u(F.col("to"))).alias("url"))
    return spark.createDataFrame([("https://site.test/p/0",)], "url string"), e


_BFS = """WITH RECURSIVE n AS (SELECT max(c_custkey) AS m FROM customer), t AS (SELECT 0::BIGINT AS k, 0 AS depth, NULL::BIGINT AS parent
UNION ALL SELECT c.k, t.depth + 1, t.k FROM t, n, LATERAL (SELECT unnest([t.k * 2 + 1, t.k * 2 + 2]) AS k) c WHERE c.k <= n.m AND t.depth < 6)
"""


@query(_BFS + "SELECT 'https://site.test/p/' || k AS url, depth, CASE WHEN parent IS NULL THEN NULL ELSE 'https://site.test/p/' || parent END AS parent FROM t")
def bfs_crawl(spark: SparkSession, d: str) -> DataFrame:
    seeds, links = _site(spark, d)
    return frontier.crawl(seeds, links, 6, F.col("url").startswith("https://site.test/")).visited


@query(_BFS + "SELECT depth, count(*) AS pages FROM t GROUP BY depth")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return bfs_crawl(spark, d).groupBy("depth").agg(F.count("*").alias("pages"))


@query(
    """WITH RECURSIVE n AS (SELECT max(c_custkey) AS m FROM customer), t AS (SELECT 0::BIGINT AS k, 0 AS depth, NULL::BIGINT AS parent, [0]::BIGINT[] AS path
UNION ALL SELECT c.k, t.depth + 1, t.k, list_append(t.path, c.k) FROM t, n, LATERAL (SELECT unnest([t.k * 2 + 1, t.k * 2 + 2]) AS k) c WHERE c.k <= n.m AND t.depth < 4)
SELECT 'https://site.test/p/0' AS seed, 'https://site.test/p/' || k AS url, CASE WHEN parent IS NULL THEN NULL ELSE 'https://site.test/p/' || parent END AS parent_url, depth, (row_number() OVER (ORDER BY path) - 1)::INTEGER AS dfs_order FROM t"""
)
def site_map(spark: SparkSession, d: str) -> DataFrame:
    seeds, links = _site(spark, d)
    return frontier.site_tree(seeds, links.where(F.col("url").startswith("https://site.test/")), max_depth=4, max_pages=500)


_CORPUS = f"(SELECT {_NORM} AS url, min(body) AS body FROM {T.RESPONSES} WHERE body IS NOT NULL GROUP BY 1)"
_LEVEL = "SELECT url, {0} AS depth, min_by(parent, (parent, ord)) AS parent FROM (SELECT l.own AS parent, l.ord, l.url FROM l JOIN {1} ON l.own = {1}.url WHERE l.url <> '') WHERE url NOT IN (SELECT url FROM {2}) GROUP BY url"


@query(
    f"""WITH l AS ({links_sql("body", _CORPUS)}), r AS (SELECT url FROM {_CORPUS}),
l0 AS (SELECT url, 0 AS depth, NULL::VARCHAR AS parent FROM r WHERE url NOT IN (SELECT url FROM l)),
l1 AS ({_LEVEL.format(1, "l0", "l0")}), k AS (SELECT url FROM l0 UNION SELECT url FROM l1), l2 AS ({_LEVEL.format(2, "l1", "k")})
SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2"""
)
def corpus_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A crawl over the stored answers from the root of each host."""
    r = T.responses(spark, d).where("body is not null").select(U.normalize("url", keep_fragment=False).alias("source"), "body").where("source is not null")
    r = r.groupBy("source").agg(F.min("body").alias("body"))
    facts = pages.page_facts(r, ["source"], parts=("links",))
    links = frontier.saved(pages.link_rows(facts, ["source"], "source"))
    # links meet the corpus; a page without links in is a seed
    inside = links.join(r.select(F.col("source").alias("url")), "url", "left_semi")
    seeds = r.select(F.col("source").alias("url")).join(inside.select("url"), "url", "left_anti")
    return frontier.crawl(seeds, links.select("source", "ord", "url"), 2).visited


_E = "(SELECT event_id, epoch_us(ts) / 1000.0 AS t, event_type, user_id, user_id % 8 AS host FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events")
    return e.select("event_id", "event_type", "user_id", (F.col("user_id") % 8).alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t"))


@query(f"SELECT event_id, round((i * 250 + max(t - i * 250) OVER (PARTITION BY host ORDER BY t, event_id)) / 1000, 3) AS start FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, event_id) - 1 AS i FROM {_E})")
def host_schedule(spark: SparkSession, d: str) -> DataFrame:
    return pacing.schedule(_events(spark, d), "t", ["event_id"], 250.0, ["host"]).select("event_id", F.round(F.col("start_ms") / 1000, 3).alias("start"))


@query(
    f"""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) OVER (PARTITION BY host ORDER BY t, event_id) AS s FROM {_E}),
c AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY host ORDER BY t, event_id)))::BIGINT AS throttle FROM s)
SELECT event_id, throttle, CASE WHEN throttle > 0 THEN least(pow(2, throttle - 1), 30)::DOUBLE ELSE 0::DOUBLE END AS delay_s FROM c"""
)
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return pacing.backoff(_events(spark, d), F.col("event_type") == "error", "t", ["event_id"], ["host"]).select("event_id", "throttle", "delay_s")


@query(
    f"""WITH g AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY t, event_id) AS g FROM {_E}),
r AS (SELECT *, (sum(f) OVER (PARTITION BY host, g ORDER BY t, event_id))::BIGINT AS run FROM g)
SELECT event_id, run, max(CASE WHEN run >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY t, event_id) = 1 AS stopped FROM r"""
)
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return pacing.failure_runs(_events(spark, d), F.col("event_type") == "error", "t", ["event_id"], ["host"], 3).select("event_id", "run", "stopped")


@query(f"SELECT event_id, (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY t, event_id))::BIGINT AS failed, (sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY t, event_id))::BIGINT AS fetched FROM {_E}")
def progress(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("event_type")
    return frontier.progress(_events(spark, d), ["t", "event_id"], {"failed": c == "error", "fetched": c != "error"}, ["host"]).select("event_id", "failed", "fetched")


@query(f"SELECT disposition, count(*) AS rows FROM (SELECT CASE WHEN status_code >= 400 THEN 'failed' WHEN status_code BETWEEN 300 AND 399 THEN 'redirect' WHEN coalesce(body, '') = '' THEN 'skipped' ELSE 'result' END AS disposition FROM {T.RESPONSES}) GROUP BY disposition")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    r = T.responses(spark, d)
    what = F.when(F.col("status_code") >= 400, "failed").when(U.is_redirect("status_code"), "redirect").when(U.text("body") == "", "skipped").otherwise("result")
    return frontier.summary(T.once(r.select("response_id", what.alias("disposition"))))


@query(f"SELECT root_hostname, count(*) AS pages, count(DISTINCT url) AS urls FROM {T.PAGES} GROUP BY root_hostname")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.once(T.pages(spark, d).select("page_id", "root_hostname", "url")).groupBy("root_hostname").agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = T.read(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream run to the end of what is there, as files in the shared folder; nothing of it is kept on the driver."""
    frontier.saved(spark.range(1))  # makes sure of a checkpoint folder
    where = f"{spark.sparkContext.getCheckpointDir()}/stream_{uuid.uuid4().hex}"
    out = f"{where}/rows"

    def write(batch: DataFrame, n: int) -> None:
        # a complete result replaces the one before; a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


@query("SELECT event_type AS type, count(*) AS rows FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    return _finish(spark, S.counts(_stream(spark, d).withColumnRenamed("event_type", "type")), "complete")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS rows FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = _finish(spark, S.windowed(_stream(spark, d), "ts", "1 hour", late="3650 days", by=["event_type"]), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_unique(spark: SparkSession, d: str) -> DataFrame:
    return _finish(spark, S.unique(_stream(spark, d).select("user_id", "event_type"), ["user_id", "event_type"]), "append")


@query(
    f"""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) OVER (PARTITION BY host ORDER BY t, event_id) AS s FROM {_E}),
c AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY host ORDER BY t, event_id)))::INTEGER AS n FROM s), l AS (SELECT host, arg_max(n, (t, event_id)) AS n FROM c GROUP BY host)
SELECT host::VARCHAR AS host, n AS throttle, CASE WHEN n > 0 THEN least(pow(2, n - 1), 30)::DOUBLE ELSE 0::DOUBLE END AS delay_s FROM l"""
)
def stream_throttle(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).select((F.col("user_id") % 8).cast("string").alias("host"), (F.col("event_type") == "error").alias("hit"), "ts")
    return _finish(spark, S.throttle(s, "host", "hit", "ts"), "update")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS rows FROM s GROUP BY user_id, s"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _finish(spark, S.sessions(_stream(spark, d), "ts", "30 minutes", ["user_id"], late="3650 days"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
