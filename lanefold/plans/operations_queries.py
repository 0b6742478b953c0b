"""Ledger, preconditions, inventories and small string operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanefold.functions import identifiers as I
from lanefold.functions.json_leaves import string_leaves
from lanefold.operators import ledger as L, profiling as R
from lanefold.plans.inputs import table
from lanefold.plans.registry import query
from lanefold.streaming.upsert import replay

TAIL = 100
PREFIXES = ("http://th", "https://m.", "ftp://", "http://th", "https://")


def _ledger(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("job_name"),
        F.col("ts").cast("timestamp").alias("started_at"),
    )


_LEDGER_SQL = "SELECT event_id AS run_id, event_type AS job_name, strftime(ts, '%Y%m%dT%H%M%SZ') AS started FROM events"


def _stamped(df):
    return df.select("run_id", "job_name", I.compact_utc(F.col("started_at")).alias("started"))


@query("ledger_tail", f"{_LEDGER_SQL} ORDER BY ts DESC, event_id DESC LIMIT {TAIL}")
def ledger_tail(spark, sf):
    return _stamped(L.tail(_ledger(spark, sf), TAIL))


@query("ledger_tail_of_job", f"{_LEDGER_SQL} WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT {TAIL}")
def ledger_tail_of_job(spark, sf):
    return _stamped(L.tail(_ledger(spark, sf), TAIL, job="error"))


@query(
    "ledger_tail_by_job",
    """SELECT event_id AS run_id, event_type AS job_name, strftime(ts, '%Y%m%dT%H%M%SZ') AS started FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20""",
)
def ledger_tail_by_job(spark, sf):
    return _stamped(L.tail_per_job(_ledger(spark, sf), 20))


_DISTINCT = list(dict.fromkeys(PREFIXES))


@query(
    "prefix_preflight",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS ord, '{p}' AS prefix, (SELECT count(*) FROM pages WHERE starts_with(url, '{p}')) AS n_found"
        for i, p in enumerate(_DISTINCT)
    ),
)
def prefix_preflight(spark, sf):
    counts = L.prefix_counts(table(spark, sf, "pages"), PREFIXES, "url")
    return counts.select(F.col("ord").cast("long").alias("ord"), "prefix", "n_found")


@query(
    "prefix_missing",
    "SELECT bool_and(n > 0) AS ok, string_agg(p, ',' ORDER BY i) FILTER (n = 0) AS missing FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, '{p}' AS p, (SELECT count(*) FROM pages WHERE starts_with(url, '{p}')) AS n"
        for i, p in enumerate(_DISTINCT)
    )
    + ")",
)
def prefix_missing(spark, sf):
    return L.preflight(table(spark, sf, "pages"), PREFIXES, "url").select(
        "ok", F.array_join("missing", ",").alias("missing")
    )


@query(
    "first_key_with_suffix",
    "SELECT min(url) AS url FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, '#top')",
)
def first_key_with_suffix(spark, sf):
    return L.first_with_suffix(table(spark, sf, "pages"), "https://", "#top", "url")


_HOST = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)/+[^/?#]', 1)"
_ENDPOINT = f"CASE WHEN {_HOST} = '' THEN url ELSE {_HOST} END"


@query("endpoint_normalize", f"SELECT page_id, {_ENDPOINT} AS endpoint FROM pages")
def endpoint_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.endpoint_of(F.col("url")).alias("endpoint"))


@query(
    "profile_counts_topn",
    f"SELECT {_ENDPOINT} AS endpoint, count(*) AS n, min(page_id) AS first_seen FROM pages GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20",
)
def profile_counts_topn(spark, sf):
    hosts = table(spark, sf, "pages").select("page_id", I.endpoint_of(F.col("url")).alias("endpoint"))
    return R.most_common(hosts, "endpoint", 20, "page_id")


@query(
    "profile_sizes",
    """SELECT lang, count(*) AS n, sum(s)::BIGINT AS total, floor(avg(s))::BIGINT AS mean, min(s) AS min, max(s) AS max,
        floor(quantile_cont(s, 0.5))::BIGINT AS median,
        CASE WHEN sum(s) < 1048576 THEN printf('%.1fKB', sum(s) / 1024.0::DOUBLE) ELSE printf('%.1fMB', sum(s) / 1048576.0::DOUBLE) END AS total_human
      FROM (SELECT lang, octet_length(encode(text))::BIGINT AS s FROM documents) GROUP BY lang""",
)
def profile_sizes(spark, sf):
    sizes = table(spark, sf, "documents").select("lang", F.octet_length("text").cast("long").alias("s"))
    stats = R.size_stats(sizes, ["lang"], "s")
    return stats.select("*", I.human_bytes(F.col("total")).alias("total_human"))


@query(
    "stride_sample",
    """SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS pos,
        greatest(1, (SELECT count(*) FROM pages) // 40) AS stride FROM pages) WHERE pos % stride = 0 AND pos < stride * 40""",
)
def stride_sample(spark, sf):
    return R.stride_sample(table(spark, sf, "pages").select("page_id", "url"), ["url", "page_id"], 40)


@query(
    "modulo_shard",
    "SELECT page_id, ((row_number() OVER (ORDER BY url, page_id) - 1) % 4)::BIGINT AS shard FROM pages",
)
def modulo_shard(spark, sf):
    shards = R.shard_of(table(spark, sf, "pages").select("page_id", "url"), ["url", "page_id"], 4)
    return shards.select("page_id", F.col("shard").cast("long").alias("shard"))


@query(
    "leaf_directories",
    "SELECT regexp_replace(url, '/[^/]*$', '') AS directory, count(*) AS n FROM pages GROUP BY 1",
)
def leaf_directories(spark, sf):
    return table(spark, sf, "pages").groupBy(I.parent_dir(F.col("url")).alias("directory")).agg(F.count(F.lit(1)).alias("n"))


_PATH = "'root/' || source || '/l' || (n_chars % 1000) || '/' || doc_id || '.jpg'"


@query(
    "collection_inventory",
    f"""SELECT CASE WHEN t = '' THEN '?' ELSE t END AS collection, count(*) AS n, sum(n_chars)::BIGINT AS total FROM (
        SELECT upper(regexp_extract({_PATH}, '(?i)(L\\d{{1,3}})', 1)) AS t, n_chars FROM documents) GROUP BY 1""",
)
def collection_inventory(spark, sf):
    """Files per collection token of their path."""
    path = F.concat(F.lit("root/"), "source", F.lit("/l"), F.col("n_chars") % 1000, F.lit("/"), "doc_id", F.lit(".jpg"))
    return (
        table(spark, sf, "documents")
        .groupBy(I.collection_of(path).alias("collection"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))
    )


@query(
    "frame_ids_of_paths",
    """SELECT doc_id, source || '_' || doc_id AS frame_id FROM documents""",
)
def frame_ids_of_paths(spark, sf):
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "doc_id", F.lit(".jpg"))
    return table(spark, sf, "documents").select("doc_id", I.frame_id_of_path(path).alias("frame_id"))


@query(
    "run_ids",
    """SELECT event_id, substr(sha256(event_id::VARCHAR), 1, 7) || '-' || event_type || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id,
        true AS valid FROM events""",
)
def run_ids(spark, sf):
    made = I.run_id(F.sha2(F.col("event_id").cast("string"), 256), F.col("event_type"), F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", made.alias("run_id"), I.is_run_id(made).alias("valid"))


@query(
    "key_value_config",
    """SELECT event_id, event_type || '=x' AS a, (value > 10)::VARCHAR AS b, 2::BIGINT AS n FROM events""",
)
def key_value_config(spark, sf):
    """key=value items: split on the first =, the last value of a key wins."""
    items = F.array(
        F.concat(F.lit("b="), "event_id"),
        F.concat(F.lit("a="), "event_type", F.lit("=x")),
        F.concat(F.lit("b="), (F.col("value") > 10).cast("string")),
    )
    parsed = table(spark, sf, "events").select("event_id", I.key_values(items).alias("m"))
    return parsed.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").cast("long").alias("n"))


@query(
    "json_string_leaves",
    """SELECT conv_id, turn, pos - 1 AS pos, md5(leaf) AS leaf_md5 FROM (
        SELECT conv_id, turn, unnest(leaves) AS leaf, generate_subscripts(leaves, 1) AS pos FROM (
          SELECT conv_id, turn, list_filter([role, text, 'abc"\\d', role, 'tags', text], lambda s: length(s) >= 4) AS leaves FROM conversations))""",
)
def json_string_leaves(spark, sf):
    """String leaves, nested and escaped, of a JSON document per row."""
    doc = F.to_json(
        F.struct(
            "conv_id",
            "role",
            F.struct("text", F.lit('abc"\\d').alias("quoted"), F.array(F.col("role"), F.lit("tags")).alias("tags")).alias("inner"),
            F.array(F.struct("text")).alias("list"),
        )
    )
    leaves = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(string_leaves(doc)).alias("pos", "leaf"))
    return leaves.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5("leaf").alias("leaf_md5"))


@query(
    "query_history",
    """SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC) AS n
        FROM events GROUP BY event_type, user_id) WHERE n <= 10""",
)
def query_history(spark, sf):
    """The last ten distinct users of each kind of event, most recent first."""
    from pyspark.sql import Window

    recent = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("last"))
    order = Window.partitionBy("event_type").orderBy(F.desc("last"))
    return recent.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 10).select("event_type", "user_id")


@query(
    "streaming_upsert",
    """SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back = 1""",
)
def streaming_upsert(spark, sf):
    """The event file as a stream into a keyed table; the last row of a key is what is read back."""
    rows = replay(spark, f"{sf}/[e]vents.parquet", keys=["user_id"], order="event_id")
    return rows.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
