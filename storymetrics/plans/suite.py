"""The queries of the driver, each with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, replies
from ..operators import attempts, frames, jobs, metrics
from ..sources import media

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


AGGS = "max(value) AS max, min(value) AS min, round(avg(value), 6) AS avg, arg_max(value, event_id) AS last"


@query(f"SELECT event_type, {AGGS} FROM events GROUP BY event_type")
def metric_summary(t):
    return metrics.summarize(t("events"), ["event_type"], "value", c("event_id"))


@query(f"SELECT user_id, event_type, {AGGS} FROM events GROUP BY user_id, event_type")
def metric_summary_by_job(t):
    return metrics.summarize(t("events"), ["user_id", "event_type"], "value", c("event_id"))


@query("SELECT name AS metric, max(value) AS max, min(value) AS min, round(avg(value), 6) AS avg FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value) GROUP BY name")
def metric_summary_wide(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = t("lineitem").select(*cols).unpivot([], cols, "metric", "value")
    return metrics.summarize(rows, ["metric"], "value", c("value")).drop("last")


@query("SELECT arg_max(text, row(conv_id, turn)) AS last_text, count(*) AS turns, role FROM conversations GROUP BY role")
def conversation_last(t):
    return metrics.last_of(t("conversations"), ["role"], "text", ["conv_id", "turn"], "last_text", "turns")


KINDS = ("click", "view", "purchase", "signup", "error")


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS max_{k}" for k in KINDS) + " FROM events GROUP BY user_id")
def export_pivot(t):
    wide = metrics.pivoted(t("events"), "user_id", "event_type", "value", list(KINDS))
    return wide.select("user_id", *(c(k).alias(f"max_{k}") for k in KINDS))


@query("SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def job_left_metrics(t):
    return jobs.with_metrics(t("documents"), t("labels"), "doc_id", "doc_id", "quality", "toxic").select("doc_id", "lang", "source", "quality", "toxic")


@query("SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id = 42")
def job_detail(t):
    return jobs.with_metrics(t("documents").where("doc_id = 42"), t("labels"), "doc_id", "doc_id", "quality", "toxic").select("doc_id", "lang", "n_chars", "quality", "toxic")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 20")
def job_page(t):
    return jobs.page(t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", "o_orderkey", "F", 100, 20, "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100")
def job_page_all(t):
    return jobs.page(t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", "o_orderkey", "")


@query("SELECT o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY o_orderstatus")
def status_counts(t):
    return jobs.by_status(t("orders"), "o_orderstatus")


@query("SELECT count(*) AS users FROM customer")
def user_count(t):
    return jobs.counted(t("customer"), "users")


@query("SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007' AND sha256('salt' || c_name) = sha256('saltCustomer#000000007')")
def user_verify(t):
    held = t("customer").withColumn("password_hash", names.digest(c("c_name"), "salt"))
    return jobs.users_matching(held, "Customer#000000007", names.digest(F.lit("Customer#000000007"), "salt"), "c_name").select("c_custkey")


@query("SELECT c_custkey, sha256('salt' || c_name) AS digest FROM customer")
def password_digest(t):
    return t("customer").select("c_custkey", names.digest(c("c_name"), "salt").alias("digest"))


@query("SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS total, o_orderdate AS created FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 10 = 0")
def metrics_upsert(t):
    o = t("orders").select("o_orderkey", c("o_totalprice").alias("total"), c("o_orderdate").alias("created"))
    new = o.where("o_orderkey % 10 = 0").withColumn("total", c("total") * 2)
    return jobs.upsert(o.where("o_orderkey % 3 <> 0"), new, "o_orderkey", "created")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def job_insert_guard(t):
    new = t("orders").where("o_orderkey % 2 = 1")
    known = jobs.with_parent(new, t("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey")
    return jobs.add(t("lineitem").where("l_quantity > 45").select(c("l_orderkey").alias("o_orderkey")), known, "o_orderkey").select("o_orderkey")


@query("SELECT count(*) AS parents FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def fk_exists(t):
    return jobs.with_parent(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey").agg(F.count("*").alias("parents"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'completed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS completed_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS error_message FROM orders")
def status_update(t):
    held = t("orders").select("o_orderkey", c("o_orderstatus").alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), c("o_orderpriority").alias("error_message"), "o_orderdate")
    return jobs.set_status(held, c("o_orderkey") % 5 == 0, "completed", c("o_orderdate")).drop("o_orderdate")


@query("SELECT event_id, printf('frame_%06d.jpg', event_id) AS filename FROM events WHERE event_id % 3 = 0")
def frame_sampling(t):
    return frames.sample(t("events"), "event_id").select("event_id", names.frame_name(c("event_id")).alias("filename"))


@query("SELECT user_id, batch_id, count(*) AS frames, min(event_id) AS first, max(event_id) AS last FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch_id FROM events) GROUP BY user_id, batch_id")
def frame_batches(t):
    return frames.batched(t("events"), "user_id", ["event_id"]).groupBy("user_id", "batch_id").agg(F.count("*").alias("frames"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT doc_id, doc_id > m AS is_duplicate, CASE WHEN doc_id > m THEN m END AS duplicate_of_frame FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents)")
def duplicate_flags(t):
    return frames.copies(t("documents"), [], c("text"), "doc_id").select("doc_id", "is_duplicate", "duplicate_of_frame")


@query("SELECT batch_id, count(*) AS total_frames, count(*) FILTER (doc_id = m) AS unique_frames FROM (SELECT doc_id // 50 AS batch_id, doc_id, min(doc_id) OVER (PARTITION BY doc_id // 50, text) AS m FROM documents) GROUP BY batch_id")
def duplicates_in_batch(t):
    rows = frames.copies(t("documents").withColumn("batch_id", F.floor(c("doc_id") / 50)), ["batch_id"], c("text"), "doc_id")
    return rows.groupBy("batch_id").agg(F.count("*").alias("total_frames"), F.count_if(~c("is_duplicate")).alias("unique_frames"))


@query("SELECT max(doc_id) AS doc_id, sha256(text) AS name FROM documents GROUP BY text")
def basename_last_wins(t):
    return jobs.last_wins(t("documents").select("doc_id", F.sha2("text", 256).alias("name")), ["name"], ["doc_id"])


@query("SELECT lang, count(*) AS total_frames, count(*) FILTER (quality = 1) AS good_frames, count(*) FILTER (quality = 0) AS bad_frames, count(*) FILTER (quality IS NULL) AS failed_frames FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def frame_counts(t):
    rows = jobs.with_metrics(t("documents"), t("labels"), "doc_id", "doc_id", "quality").withColumn("label", frames.labelled(c("quality").cast("double")))
    return frames.counts(rows, "lang")


@query("SELECT vec_id, CASE WHEN 1 / (1 + exp(-list_sum(embedding::DOUBLE[]))) > 0.65 THEN 'GOOD' ELSE 'BAD' END AS label FROM embeddings")
def quality_threshold(t):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t("embeddings").select("vec_id", frames.labelled(1 / (1 + F.exp(-total))).alias("label"))


SLUG = "substr(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), 1, 15)"


@query(f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def job_slug(t):
    return t("documents").select("doc_id", names.slug(c("text")).alias("slug"))


@query(f"SELECT event_id, {SLUG.format('event_type')} || '_' || {SLUG.format('props')} || '_' || strftime(ts, '%Y%m%d%H%M%S') AS job_id FROM events")
def slug_timestamp(t):
    return t("events").select("event_id", names.job_id(c("event_type"), c("props"), c("ts")).alias("job_id"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events")
def iso_timestamp(t):
    return t("events").select("event_id", names.iso(c("ts")).alias("at"))


@query("SELECT event_id, coalesce(cast(try_cast(CASE WHEN event_id % 7 = 0 THEN 'garbage' WHEN event_id % 11 = 0 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS VARCHAR), '') AS day FROM events")
def date_parse(t):
    text = F.when(c("event_id") % 7 == 0, "garbage").when(c("event_id") % 11 == 0, "2024-02-30").otherwise(F.date_format("ts", "yyyy-M-d"))
    return t("events").select("event_id", F.coalesce(names.campaign_date(text).cast("string"), F.lit("")).alias("day"))


@query(r"SELECT page_id, lower(regexp_extract(url, '[^/](\.[^./?#]+)$', 1)) AS suffix FROM pages")
def file_suffix(t):
    return t("pages").select("page_id", names.url_suffix(c("url")).alias("suffix"))


@query(r"""SELECT page_id, regexp_replace(translate(trim(url, ' .'), '<>:"|?*', '_______'), '[\x00-\x1F]', '', 'g') AS name FROM pages""")
def filename_sanitize(t):
    return t("pages").select("page_id", names.sanitized(c("url")).alias("name"))


SUFFIXES = (".mp4", ".ZIP", ".jpg", ".txt", ".Mov")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'zip' WHEN 2 THEN 'image' WHEN 4 THEN 'video' END AS file_type FROM part")
def file_type_case(t):
    name = F.concat(c("p_name"), F.element_at(F.array(*map(F.lit, SUFFIXES)), (c("p_partkey") % 5 + 1).cast("int")))
    return t("part").select("p_partkey", names.file_type(names.suffix(name)).alias("file_type"))


@query("SELECT page_id FROM pages WHERE page_id % 4 IN (0, 1)")
def archive_members(t):
    name = F.element_at(F.array(*(F.concat(F.lit(a), c("page_id").cast("string"), F.lit(b)) for a, b in (("d/", ".mp4"), ("", ".MKV"), ("__MACOSX/", ".mp4"), ("", ".jpg")))), (c("page_id") % 4 + 1).cast("int"))
    return t("pages").where(media.is_member(name)).select("page_id")


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(t):
    return t("events").select("event_id", replies.field(c("props"), "k", "int").alias("k"))


@query("SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM conversations")
def fence_strip(t):
    fenced = F.concat(F.lit("before ```json\n"), c("text"), F.lit("\n``` after"))
    return t("conversations").select("conv_id", "turn", replies.unfenced(F.when(c("turn") % 2 == 0, fenced).otherwise(F.concat(F.lit("```\n"), c("text"), F.lit("\n```")))).alias("body"))


@query("SELECT user_id AS job_id, 'views' AS metric, max(v) AS max, min(v) AS min, round(avg(v), 6) AS avg, arg_max(v, event_id) AS last FROM (SELECT user_id, event_id, cast(event_id % 97 AS DOUBLE) AS v FROM events WHERE event_id % 10 <> 0) GROUP BY user_id")
def response_roundtrip(t):
    batch = frames.batched(t("events"), "user_id", ["event_id"])
    one = F.to_json(F.struct(c("frame_index"), (c("event_id") % 10 == 0).alias("is_duplicate"), F.struct((c("event_id") % 97).cast("string").alias("views")).alias("metrics")))
    rows = batch.groupBy(c("user_id").alias("job_id"), "batch_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", one.alias("j")))).alias("all"))
    reply = F.concat(F.lit("```json\n["), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]\n```"))
    spread = rows.select("job_id", "batch_id", reply.alias("reply"))
    tasks = max(1, min(65_536, t("events").count() // 4000))  # replies take longer to parse than their bytes tell
    return metrics.summary(replies.parse(spread.repartition(tasks, "job_id", "batch_id")))


@query("SELECT event_id, cast(trunc(value) AS INTEGER) AS shown FROM events")
def display_int(t):
    return t("events").select("event_id", names.whole(c("value")).alias("shown"))


@query("SELECT event_type, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS title, count(*) AS n FROM events GROUP BY event_type")
def metric_title(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", names.title(c("event_type")).alias("title"), "n")


@query("SELECT event_id, cast(event_id AS VARCHAR) AS digits FROM events")
def digits_normalize(t):
    return t("events").select("event_id", names.western_digits(F.translate(c("event_id").cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹")).alias("digits"))


@query("SELECT item_id, chr(10) || 'Frame ' || (item_id % 50) || ': frame_' || lpad(cast(item_id AS VARCHAR), 6, '0') || '.jpg' AS caption, 'data:image/jpeg;base64,' || base64(encode(text)) AS url FROM benchmark")
def frame_captions(t):
    return t("benchmark").select("item_id", names.caption(c("item_id") % frames.BATCH, names.frame_name(c("item_id"))).alias("caption"), names.data_url(c("text").cast("binary")).alias("url"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS created, CASE WHEN o_custkey % 5 > 0 THEN (o_orderkey % 3) || '/' || (o_custkey % 5) ELSE '-' END AS good, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'warning' ELSE 'secondary' END AS badge FROM orders")
def job_rows_shown(t):
    status = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "P", "processing").otherwise("pending")
    return t("orders").select("o_orderkey", names.minute(c("o_orderdate")).alias("created"), names.share(c("o_orderkey") % 3, c("o_custkey") % 5).alias("good"), names.badge(status).alias("badge"))


@query("SELECT o_orderkey, o_custkey > 720 AS tall FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def tall_existing(t):
    """Orders as frames, customers as files: what is there, and what is taller than 720 lines."""
    held = frames.existing(t("orders").withColumnRenamed("o_custkey", "path"), t("customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "path"))
    return held.select("o_orderkey", frames.tall(c("path")).alias("tall"))


@query(f"SELECT vec_id, list_avg(px) AS luminance, list_avg(px) < {frames.DARK} AS dark FROM (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, round(128 + 64 * x::DOUBLE)))) AS px FROM embeddings)")
def picture_luminance(t):
    """Every embedding as a grey picture of 8 x 8 values."""
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + 64 * x.cast("double")).cast("int"))))
    return t("embeddings").select("vec_id", frames.grey_luminance(grey).alias("luminance")).withColumn("dark", c("luminance") < frames.DARK)


@query("SELECT item_id, base64(encode(text)) AS content FROM benchmark")
def content_base64(t):
    return t("benchmark").select("item_id", names.base64(c("text").cast("binary")).alias("content"))


@query("SELECT o_orderpriority AS path, count(*) AS members, count(*) FILTER (o_orderstatus = 'F') AS successes, coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS frames FROM orders GROUP BY o_orderpriority")
def archive_rollup(t):
    return media.roll_up(t("orders").select(c("o_orderpriority").alias("path"), F.when(c("o_orderstatus") == "F", "success").otherwise("error").alias("status"), c("o_custkey").alias("frames")))


@query("""SELECT user_id, '{"total_frames":' || count(*) || ',"frames":[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']}' AS document FROM events GROUP BY user_id""")
def document_json(t):
    return metrics.document(t("events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("""SELECT user_id, n AS place, CASE WHEN n = 0 THEN '{"total_frames":' || total || ',"frames":[' ELSE ',' END || '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' || CASE WHEN n = total - 1 THEN ']}' ELSE '' END AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)""")
def document_pieces(t):
    return metrics.pieces(t("events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


RECORD = "(conv_id * 7 + turn * 5) % 8"


@query(f"""
WITH r AS (SELECT conv_id, turn AS attempt, CASE {RECORD} WHEN 0 THEN 'usable' WHEN 1 THEN 'empty' WHEN 2 THEN 'broken' WHEN 4 THEN 'status' WHEN 5 THEN 'timeout' WHEN 6 THEN 'connection' ELSE 'limited' END AS outcome FROM conversations WHERE turn < 5),
f AS (SELECT conv_id, coalesce(min(attempt) FILTER (outcome = 'usable'), 4) AS last FROM r GROUP BY conv_id)
SELECT conv_id, attempt::INTEGER AS attempt, outcome, (CASE WHEN outcome = 'limited' THEN (attempt + 1) * 10 WHEN outcome IN ('timeout', 'connection') AND attempt < 4 THEN 5 ELSE 0 END)::INTEGER AS wait FROM r JOIN f USING (conv_id) WHERE attempt <= last
""")
def reply_retries(t):
    """Every conversation as a batch, its turns as what was recorded of the attempts: the log that the rule of asking anew makes of them."""
    kind = F.expr(RECORD)
    body = F.when(kind == 0, F.concat(F.lit("```json\n["), c("conv_id").cast("string"), F.lit("]\n```"))).when(kind == 1, "[]").otherwise(c("text"))
    status = F.when(kind < 3, attempts.ANSWERED).when(kind == 4, 500).when(kind.isin(3, 7), attempts.TOO_MANY)
    recorded = t("conversations").select("conv_id", c("turn").alias("attempt"), status.alias("status"), body.alias("body"), F.when(kind == 5, "timeout").when(kind == 6, "connection").alias("fault"))
    return attempts.replayed(recorded, ["conv_id"]).drop("body")
