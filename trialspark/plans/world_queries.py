"""Queries over file changes, folders, workers, shops, logs and layered configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as X
from ..operators import fleet, layers, replay, summaries
from . import bindings as B
from .joins import join_one
from .registry import query

W = B.with_views
MARKER = "/de/"
GUARDED = ("/en", "/fr")

# -- file changes -----------------------------------------------------------------

LEAF_SQL = """SELECT c.* FROM changes c WHERE NOT starts_with(c.path, '/de/') AND NOT (c.kind = 'C' AND EXISTS (
    SELECT 1 FROM changes q WHERE q.trial_id = c.trial_id AND starts_with(q.path, rtrim(c.path, '/') || '/')))"""


@query("path_under", W("page_files changes", """
  SELECT trial_id, ord, path = '/en' OR starts_with(path, '/en/') AS below, starts_with(path, '/') AS below_root FROM changes"""))
def path_under(spark, sf):
    return B.changes(spark, sf).select("trial_id", "ord", X.path_under(F.col("path"), F.lit("/en/")).alias("below"),
                                       X.path_under(F.col("path"), F.lit("/")).alias("below_root"))


@query("harness_file_filter", W("page_files changes", "SELECT trial_id, ord, kind, path FROM changes WHERE NOT starts_with(path, '/de/')"))
def harness_file_filter(spark, sf):
    return X.without_harness_files(B.changes(spark, sf), MARKER).select("trial_id", "ord", "kind", "path")


@query("leaf_changes", W("page_files changes", f"SELECT trial_id, ord, kind, path FROM ({LEAF_SQL})"))
def leaf_changes(spark, sf):
    return X.leaf_changes(B.changes(spark, sf), MARKER).select("trial_id", "ord", "kind", "path")


@query("tamper_filter", W("page_files changes", f"""
  SELECT trial_id, ord, kind || ' ' || path AS entry FROM ({LEAF_SQL}) f
  WHERE (path = '/en' OR starts_with(path, '/en/') OR path = '/fr' OR starts_with(path, '/fr/'))
    AND NOT contains(path, '__pycache__') AND NOT ends_with(path, '.pyc')
    AND NOT EXISTS (SELECT 1 FROM page_files a WHERE a.trial_id = f.trial_id AND a.plain
      AND (f.path = rtrim(a.path, '/') OR starts_with(f.path, rtrim(a.path, '/') || '/')))"""))
def tamper_filter(spark, sf):
    changed = B.changes(spark, sf)
    pages = B.page_files(spark, sf)
    allowed = pages.where("plain").select("trial_id", F.col("path").alias("prefix"))
    return X.tampering(changed, MARKER, GUARDED, allowed).select("trial_id", "ord", "entry")


@query("baseline_diff", W("page_files changes", """
  SELECT trial_id, ord, kind, path FROM changes c WHERE NOT EXISTS (SELECT 1 FROM changes b
    WHERE b.plain AND b.trial_id = c.trial_id AND b.kind = c.kind AND b.path = c.path)"""))
def baseline_diff(spark, sf):
    changed = B.changes(spark, sf)
    return X.minus_baseline(changed, changed.where("plain")).select("trial_id", "ord", "kind", "path")


@query("changes_cap", W("page_files changes", f"""
  SELECT trial_id, ord, kind, path FROM ({LEAF_SQL}) QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY ord) <= 3"""))
def changes_cap(spark, sf):
    return X.recorded_changes(X.leaf_changes(B.changes(spark, sf), MARKER), 3).select("trial_id", "ord", "kind", "path")


@query("diff_line_parse", W("page_files changes", """
  SELECT ord, kind, path || CASE WHEN plain THEN ' copy' ELSE '' END AS path FROM changes WHERE NOT (plain AND kind = 'D')"""))
def diff_line_parse(spark, sf):
    odd = F.col("plain") & (F.col("kind") == "D")
    line = F.concat(F.when(odd, "X").otherwise(F.col("kind")), F.lit(" "), "path", F.when(F.col("plain"), " copy").otherwise(""))
    return X.parse_lines(B.changes(spark, sf).select("ord", line.alias("value"))).select("ord", "kind", "path")


@query("glob_listing", W("page_files", """
  SELECT trial_id AS folder, string_split(path, '/')[-1] AS name, count(*) AS copies FROM page_files
  WHERE path LIKE '/en/%.html' AND NOT contains(substr(path, 5), '/') GROUP BY ALL"""))
def glob_listing(spark, sf):
    """Files named *.html directly in the folder /en of each host."""
    listed = B.page_files(spark, sf).where(X.directly_in(F.col("path"), "/en", "*.html"))
    return (listed.groupBy(F.col("trial_id").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
            .agg(F.count(F.lit(1)).alias("copies")))


# -- task folders -----------------------------------------------------------------

TASK_FILES_SQL = """
  WITH d AS (SELECT *, source || '-' || doc_id AS task FROM documents),
  t AS (SELECT task, doc_id, lang, text, concat_ws(', ', CASE WHEN n_chars < 300 THEN 'solution.sh' END,
      CASE WHEN lang = 'es' THEN 'environment/Dockerfile' END, CASE WHEN lang = 'de' THEN 'tests/run_tests.sh' END) AS missing
    FROM d WHERE lang <> 'fr')"""


def _task_files(spark, sf):
    """Task folders made of documents; French ones have no instruction and are no tasks."""
    lang, n = F.col("lang"), F.col("n_chars")
    def file(name, content, there=F.lit(True)):
        return F.when(there, F.struct(F.lit(name).alias("relpath"), content.alias("content")))
    config = F.when(F.col("doc_id") % 9 == 0, F.lit("{oops")).otherwise(F.lit('{"allowed_paths": ["/usr/local/bin", "/opt"]}'))
    files = F.array_compact(F.array(
        file("instruction.md", F.col("text"), lang != "fr"), file("solution.sh", F.lit("true"), n >= 300),
        file("environment/Dockerfile", F.lit("FROM scratch"), lang != "es"),
        file("tests/run_tests.sh", F.lit("exit 0"), lang != "de"), file("notes.txt", F.col("text")),
        file("task.json", config, F.col("doc_id") % 3 == 0)))
    return (B.table(spark, sf, "documents")
            .select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("task"), F.explode(files).alias("f"))
            .select("task", "f.*"))


@query("task_catalog", TASK_FILES_SQL + """
  SELECT task, text AS instruction, CASE WHEN missing <> '' THEN 'task ''' || task || ''' is missing: ' || missing
    WHEN doc_id % 9 = 0 THEN 'task ''' || task || ''' has invalid task.json' END AS problem FROM t""")
def task_catalog(spark, sf):
    return fleet.task_catalogue(_task_files(spark, sf)).select("task", "instruction", "problem")


@query("task_allowed_paths", TASK_FILES_SQL + """
  SELECT task, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN '/usr/local/bin,/opt' ELSE '' END AS allowed FROM t""")
def task_allowed_paths(spark, sf):
    return fleet.task_catalogue(_task_files(spark, sf)).select("task", F.array_join("allowed_paths", ",").alias("allowed"))


# -- permissions, logs of changes ---------------------------------------------------

def _inventory(spark, sf):
    size = F.col("p_size")
    return B.table(spark, sf, "part").select(
        F.concat(F.lit("/srv/app/"), F.col("p_partkey")).alias("path"), (size % 3 == 0).alias("is_dir"),
        F.when(F.col("p_type") == "SMALL", "root").otherwise("deploy").alias("owner"), F.lit("web").alias("group"),
        F.when(size % 4 == 0, 640).otherwise(750).alias("mode"), "p_type", "p_brand")


@query("perm_inventory_scan", """
  SELECT '/srv/app/' || p_partkey AS path, p_size % 3 = 0 AS is_dir, CASE WHEN p_type = 'SMALL' THEN 'root' ELSE 'deploy' END AS owner,
    CASE WHEN p_size % 4 = 0 THEN 640 ELSE 750 END AS mode FROM part""")
def perm_inventory_scan(spark, sf):
    return _inventory(spark, sf).select("path", "is_dir", "owner", "mode")


@query("perm_audit", """
  SELECT path, owner || ':web ' || mode AS actual, 'deploy:web ' || want AS expected FROM (
    SELECT '/srv/app/' || p_partkey AS path, CASE WHEN p_type = 'SMALL' THEN 'root' ELSE 'deploy' END AS owner,
      CASE WHEN p_size % 4 = 0 THEN 640 ELSE 750 END AS mode,
      CASE WHEN p_brand = 'Brand#7' THEN 750 WHEN p_size % 3 = 0 THEN 750 ELSE 640 END AS want FROM part)
  WHERE owner <> 'deploy' OR mode <> want""")
def perm_audit(spark, sf):
    inventory = _inventory(spark, sf)
    exceptions = inventory.where("p_brand = 'Brand#7'").select("path", F.lit(750).alias("expected_mode"))
    return fleet.permission_audit(inventory, exceptions, "deploy", "web", 750, 640)


def _log(spark, sf):
    return B.clicks(spark, sf).select(
        F.col("trial_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("subject"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("content"))


LOG_SQL = """SELECT user_id AS path, event_id AS seq, event_type AS subject,
    CASE WHEN event_type <> 'error' THEN props END AS content FROM events"""


@query("changelog_scan", f"SELECT path, seq, subject, content, content IS NULL AS deleted FROM ({LOG_SQL})")
def changelog_scan(spark, sf):
    return _log(spark, sf).withColumn("deleted", F.col("content").isNull())


@query("restore_before_delete", f"""
  SELECT path, seq, rs AS restored_seq, rc AS restored FROM (
    SELECT *, last_value(CASE WHEN content IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS rs,
      last_value(content IGNORE NULLS) OVER w AS rc FROM ({LOG_SQL})
    WINDOW w AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE content IS NULL""")
def restore_before_delete(spark, sf):
    return replay.content_before_delete(_log(spark, sf), F.col("seq"))


@query("latest_content", f"""
  SELECT path, seq, content FROM (SELECT * FROM ({LOG_SQL}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)
  WHERE content IS NOT NULL""")
def latest_content(spark, sf):
    return replay.latest_content(_log(spark, sf))


HALVES_SQL = """
  e AS (SELECT user_id AS owner, event_type || ' ' || (CAST(props ->> '$.k' AS INT) // 25) AS item,
          ts < TIMESTAMP '2024-01-16' AS early FROM events),
  b AS (SELECT DISTINCT owner, item FROM e WHERE early), a AS (SELECT DISTINCT owner, item FROM e WHERE NOT early)"""


def _halves(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    items = B.clicks(spark, sf).select(
        F.col("trial_id").alias("owner"), F.concat_ws(" ", "event_type", F.floor(k / 25).cast("string")).alias("item"),
        (F.col("us") < 1705363200000000).alias("early"))
    return items.where("early").drop("early"), items.where("NOT early").drop("early")


@query("dir_set_equal", f"""
  WITH {HALVES_SQL}
  SELECT owner, item, 'left' AS only_in FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
  UNION ALL SELECT owner, item, 'right' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def dir_set_equal(spark, sf):
    before, after = _halves(spark, sf)
    return fleet.set_difference(before, after, ["owner", "item"])


@query("history_kept", f"""
  WITH {HALVES_SQL}
  SELECT owner, count(*) FILTER (WHERE side = 'l') AS lost, count(*) FILTER (WHERE side = 'r') AS added,
    count(*) FILTER (WHERE side = 'l') = 0 AND count(*) FILTER (WHERE side = 'r') > 0 AS kept
  FROM (SELECT owner, 'k' AS side FROM e UNION ALL
        SELECT owner, 'l' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL
        SELECT owner, 'r' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY owner""")
def history_kept(spark, sf):
    before, after = _halves(spark, sf)
    return fleet.history_kept(before, after, "owner", "item")


@query("log_growth", """
  SELECT source, CAST(sum(CASE WHEN size > prior THEN size - prior ELSE 0 END) AS BIGINT) AS grown,
    count(*) FILTER (WHERE us - before > 1000000) AS restarts, count(*) AS samples
  FROM (SELECT *, lag(size) OVER w AS prior, lag(us) OVER w AS before FROM (
      SELECT user_id AS source, epoch_us(ts) AS us, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS size FROM events)
    WINDOW w AS (PARTITION BY source ORDER BY us, seq)) GROUP BY source""")
def log_growth(spark, sf):
    sizes = B.clicks(spark, sf).select(F.col("trial_id").alias("source"), "us", F.col("event_id").alias("seq"),
                                       F.round(F.col("value") * 100).cast("bigint").alias("size"))
    return summaries.file_growth(sizes).orderBy(F.col("grown").desc(), "source")


# -- workers ----------------------------------------------------------------------

TTL = 21600
DEAD_SQL = """dead AS (SELECT l.worker, l.held, h.last_beat FROM
    (SELECT worker, count(*) AS held FROM leases GROUP BY worker) l
    LEFT JOIN (SELECT worker, max(us) AS last_beat FROM heartbeats GROUP BY worker) h ON l.worker = h.worker
    WHERE coalesce(h.last_beat <= (SELECT epoch_us(max(ts)) FROM events) - 21600000000, true))"""


def _dead(spark, sf):
    now = B.clicks(spark, sf).agg(F.max("us")).scalar()
    return fleet.dead_workers(B.leases(spark, sf), B.heartbeats(spark, sf), now, TTL)


@query("dead_workers", W("leases heartbeats", f", {DEAD_SQL} SELECT * FROM dead"))
def dead_workers(spark, sf):
    return _dead(spark, sf)


@query("orphan_jobs", W("leases heartbeats", f""", {DEAD_SQL}, jobs AS (
    SELECT 0 AS stage, worker, trial_id, seq FROM leases WHERE worker IN (SELECT worker FROM dead)
    UNION ALL SELECT 1, NULL, event_id, epoch_us(ts) FROM events WHERE event_type = 'signup')
  SELECT stage, worker, trial_id, row_number() OVER (ORDER BY stage, worker DESC,
    CASE WHEN stage = 0 THEN -seq ELSE seq END, trial_id) AS position FROM jobs"""))
def orphan_jobs(spark, sf):
    held = join_one(B.leases(spark, sf), _dead(spark, sf).select("worker"), ["worker"], "left_semi")
    queue = (B.clicks(spark, sf).where("event_type = 'signup'")
             .select(F.col("event_id").alias("trial_id"), F.col("us").alias("seq")))
    return fleet.rerun_order(held, queue).select("stage", "worker", "trial_id", "position")


# -- shop -------------------------------------------------------------------------

def _shop(spark, sf):
    customers = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    state = F.col("o_orderstatus")
    orders = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("placed_at"),
        F.when(state == "F", "paid").when(state == "O", "refunded").otherwise("cancelled").alias("status"))
    items = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"),
        F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_linenumber").alias("line"))
    return customers, orders, items


B.SQL["shop"] = """
  SELECT c_custkey AS id, c_name AS name, o_orderkey AS order_id, l_linenumber AS line, o_orderdate AS placed_at,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'refunded' ELSE 'cancelled' END AS status,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, CAST(l_quantity AS BIGINT) AS quantity
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"""


@query("shop_scan", """
  SELECT 'customers' AS tbl, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer
  UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
  UNION ALL SELECT 'items', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem""")
def shop_scan(spark, sf):
    customers, orders, items = _shop(spark, sf)
    def size(name, df, key):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).withColumn("tbl", F.lit(name))
    return (size("customers", customers, "id").unionByName(size("orders", orders, "id"))
            .unionByName(size("items", items, "order_id")))


@query("shop_join", W("shop", "SELECT order_id, line, name, status, price_cents * quantity AS cents FROM shop"))
def shop_join(spark, sf):
    customers, orders, items = _shop(spark, sf)
    sold = items.join(orders, items["order_id"] == orders["id"]).drop("id")
    return (sold.join(customers, sold["customer_id"] == customers["id"])
            .select("order_id", "line", "name", "status", (F.col("price_cents") * F.col("quantity")).alias("cents")))


@query("top_spender", W("shop", """
  SELECT id, name, CAST(sum(price_cents * quantity) AS BIGINT) AS total FROM shop
  WHERE status = 'paid' AND placed_at >= '1997-01-01' AND placed_at < '1998-01-01'
  GROUP BY id, name ORDER BY total DESC, id LIMIT 1"""))
def top_spender(spark, sf):
    return summaries.top_spender(*_shop(spark, sf), year=1997)


def sales(spark, sf):
    """Revenue of each supplier, then its region: the large table shrinks before it is joined."""
    per_supplier = (B.table(spark, sf, "lineitem").groupBy("l_suppkey")
                    .agg(F.sum(summaries.amount("l_quantity", "l_extendedprice")).alias("amount")))
    region = (B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", F.col("r_name").alias("region")))
    where = (B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
             .join(region, F.col("s_nationkey") == F.col("n_nationkey")))
    return per_supplier.join(where, F.col("l_suppkey") == F.col("s_suppkey")).select("region", "amount")


REVENUE_SQL = """
  SELECT region, CAST(revenue AS DOUBLE) AS revenue, region || ': ' || CAST(revenue AS VARCHAR) AS line FROM (
    SELECT r_name AS region, CAST(sum(CAST(l_quantity AS DECIMAL(18,4)) * CAST(l_extendedprice AS DECIMAL(18,6))) AS DECIMAL(30,2)) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) ORDER BY region"""


@query("region_revenue", REVENUE_SQL)
def region_revenue(spark, sf):
    return summaries.region_revenue(sales(spark, sf)).withColumn("revenue", F.col("revenue").cast("double"))


# -- layered configuration ----------------------------------------------------------

def _layers(spark, sf):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    doc = (F.when(kind == "view", F.concat(F.lit('{"view": {"k": '), k, F.lit(', "tags": ["a", '), k, F.lit("]}}")))
           .when(kind == "click", F.concat(F.lit('{"view": {"k": '), k, F.lit('}, "shared/key": '), k, F.lit("}")))
           .when(kind == "error", F.concat(F.lit('{"view": '), k, F.lit("}")))
           .when(kind == "signup", F.concat(F.lit('{"view": {"sub": {"n": '), k, F.lit('}}, "view2": {}}')))
           .otherwise(F.concat(F.lit('{"view": {}, "total": null, "sum": {"n": '), k, F.lit("}}"))))
    return B.clicks(spark, sf).select(F.col("trial_id").alias("config_id"), F.col("event_id").alias("layer"), doc.alias("doc"))


@query("config_merge", """
  WITH e AS (SELECT user_id AS config_id, event_id AS layer, event_type AS kind, props ->> '$.k' AS k FROM events),
  said AS (
    SELECT config_id, layer, 'view' AS path, true AS obj, NULL AS value FROM e WHERE kind IN ('view', 'click', 'signup', 'purchase')
    UNION ALL SELECT config_id, layer, 'view', false, k FROM e WHERE kind = 'error'
    UNION ALL SELECT config_id, layer, 'view|k', false, k FROM e WHERE kind IN ('view', 'click')
    UNION ALL SELECT config_id, layer, 'view|tags', false, '["a", ' || k || ']' FROM e WHERE kind = 'view'
    UNION ALL SELECT config_id, layer, 'shared/key', false, k FROM e WHERE kind = 'click'
    UNION ALL SELECT config_id, layer, 'view|sub', true, NULL FROM e WHERE kind = 'signup'
    UNION ALL SELECT config_id, layer, 'view|sub|n', false, k FROM e WHERE kind = 'signup'
    UNION ALL SELECT config_id, layer, 'view2', true, NULL FROM e WHERE kind = 'signup'
    UNION ALL SELECT config_id, layer, 'total', false, 'null' FROM e WHERE kind = 'purchase'
    UNION ALL SELECT config_id, layer, 'sum', true, NULL FROM e WHERE kind = 'purchase'
    UNION ALL SELECT config_id, layer, 'sum|n', false, k FROM e WHERE kind = 'purchase'),
  last AS (SELECT config_id, path, max(layer) AS layer, arg_max(obj, layer) AS obj, arg_max(value, layer) AS value,
             max(layer) FILTER (WHERE NOT obj) AS leaf FROM said GROUP BY 1, 2),
  alive AS (SELECT * FROM last l WHERE NOT EXISTS (SELECT 1 FROM last a WHERE a.config_id = l.config_id
             AND a.leaf > l.layer AND starts_with(l.path, a.path || '|')))
  SELECT config_id, path, CASE WHEN obj THEN '{}' ELSE value END AS value FROM alive l
  WHERE NOT obj OR NOT EXISTS (SELECT 1 FROM alive c WHERE c.config_id = l.config_id AND starts_with(c.path, l.path || '|'))""")
def config_merge(spark, sf):
    return layers.config_merge(_layers(spark, sf)).withColumn("path", F.array_join("path", "|"))
