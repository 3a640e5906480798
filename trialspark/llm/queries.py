"""Queries of the corpus operators: each applies one operator to its whole table and derives the agreed digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decontamination
from . import extract, lexical, mixing, quality, secrets, sharding, simhash, substrings, topk, toxicity, urls, whitening
from .common import prepare, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(prepare(spark), sf)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark, sf):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SUBSTRING_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35),
named AS (SELECT r, p, md5(array_to_string(ws[p:p + 34], ' ')) AS h FROM win),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM named) WHERE n > 1),
pos AS (SELECT r, doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
gone AS (SELECT DISTINCT r, p + o AS p FROM twice, range(0, 35) t(o)),
kept AS (SELECT pos.r, string_agg(word, ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (r, p) GROUP BY pos.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark, sf):
    """Every document without the words of 35-word windows that also start elsewhere."""
    found = substrings.deduplicated(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_quality_rules")
def quality_rules(spark, sf):
    """Counts and verdict of every document."""
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
  regexp_extract_all(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ps FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
starts AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0),
runs AS (SELECT DISTINCT item_id, CAST(least(len(ws), 10) AS BIGINT) AS n, array_to_string(ws[p:p + 9], ' ') AS s FROM starts),
places AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
met AS (SELECT r, p, n, array_to_string(ws[p:p + n - 1], ' ') AS s FROM places JOIN (SELECT DISTINCT n FROM runs) ON p + n - 1 <= len(ws)),
hit AS (SELECT r, p, n, item_id FROM met JOIN runs USING (n, s)),
words AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS w FROM hit) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY r),
inside AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS w FROM hit),
stretch AS (SELECT r, min(w) AS first, max(w) AS last FROM (SELECT r, w, w - row_number() OVER (PARTITION BY r ORDER BY w) AS k FROM inside) GROUP BY r, k),
spans AS (SELECT r, string_agg((list_sum(list_transform(ps[1:first], lambda x: length(x))) - length(ws[first])) || ':' || list_sum(list_transform(ps[1:last], lambda x: length(x))), ','
  ORDER BY first) AS spans FROM stretch JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN spans USING (r)"""


@query("op8_decontaminate", CONTAMINATION_SQL)
def decontaminate(spark, sf):
    """Words of every document that lie inside benchmark windows, where they stand in the text, and the items they come from."""
    found = decontamination.contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    place = F.transform(F.coalesce("spans", F.array()), lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.array_join(place, ",").alias("spans"))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5(concat_ws(chr(31), 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, coalesce(sum(s) OVER (ORDER BY s / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_s,
  coalesce(sum(w) OVER (ORDER BY s / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_w,
  sum(s) OVER () AS all_s, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, CAST(all_s - 3 * before_s AS DOUBLE) / CAST(all_w - before_w AS DOUBLE) AS level FROM o),
f AS (SELECT min_by(level, before_w) AS level FROM l WHERE level * w <= 3 * s),
t AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), w * f.level) AS target FROM w, f),
r AS (SELECT doc_id, size, s, target, u, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


@query("op3_mix_sources", MIXING_SQL)
def mix_sources(spark, sf):
    """What the mix takes of every document."""
    return mixing.mixed(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_secret_scan")
def secret_scan(spark, sf):
    """Secrets of every document, and digests of where they are."""
    found = secrets.scanned(table(spark, sf, "documents").select("doc_id", "text"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


@query("op6_shard")
def shard(spark, sf):
    """Shard and slot of every document."""
    found = sharding.sharded(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_toxicity")
def toxicity_scores(spark, sf):
    """Toxicity of every document, learnt from labels that are not held out."""
    found = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",").alias("offending"))


@query("op9_main_text")
def page_text(spark, sf):
    """Main text of every page."""
    found = extract.extracted(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


URL_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (SELECT DISTINCT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
o AS (SELECT host, count(*) AS n, sum(q) AS k FROM p JOIN lab ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) AS BIGINT) GROUP BY host),
h AS (SELECT host, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS domain, list_slice(string_split(host, '.'), -1, -1)[1] AS suffix, n, k FROM o),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix), s1 AS (SELECT *, (SELECT sum(k) / sum(n) FROM s0) AS prior FROM s0),
ss AS (SELECT 1 / least(greatest(coalesce((sum((k - n * m) * (k - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 AS st
  FROM (SELECT *, least(greatest(prior, 1e-6), 1 - 1e-6) AS m FROM s1)),
s AS (SELECT suffix, k + st * prior AS a, n - k + st * (1 - prior) AS b FROM s1, ss),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix), d1 AS (SELECT d0.*, a / (a + b) AS prior FROM d0 JOIN s USING (suffix)),
ds AS (SELECT 1 / least(greatest(coalesce((sum((k - n * m) * (k - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 AS st
  FROM (SELECT *, least(greatest(prior, 1e-6), 1 - 1e-6) AS m FROM d1)),
d AS (SELECT domain, k + st * prior AS a, n - k + st * (1 - prior) AS b FROM d1, ds),
h1 AS (SELECT h.*, a / (a + b) AS prior FROM h JOIN d USING (domain)),
hs AS (SELECT 1 / least(greatest(coalesce((sum((k - n * m) * (k - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 AS st
  FROM (SELECT *, least(greatest(prior, 1e-6), 1 - 1e-6) AS m FROM h1)),
hp AS (SELECT host, k + st * prior AS a, n - k + st * (1 - prior) AS b FROM h1, hs),
names AS (SELECT DISTINCT host, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS domain, list_slice(string_split(host, '.'), -1, -1)[1] AS suffix FROM p),
ab AS (SELECT host, coalesce(hp.a, d.a, s.a) AS a, coalesce(hp.b, d.b, s.b) AS b FROM names LEFT JOIN hp USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix)),
v AS (SELECT host, CASE WHEN host <> '' AND a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ab)
SELECT page_id, p.host, p.path, rule, coalesce(hit.verdict, v.verdict) AS verdict FROM p LEFT JOIN hit USING (host, path) JOIN v ON v.host = p.host"""


@query("op10_url_filter", URL_SQL)
def url_filter(spark, sf):
    """Verdict on every page's url. The document that a page shows is named in its path; its quality label is the page's outcome."""
    pages, labels = table(spark, sf, "pages"), table(spark, sf, "labels")
    shown = pages.select(urls.host_of(F.col("url")).alias("host"), F.regexp_extract(urls.path_of(F.col("url")), "^/[^/]+/([0-9]+)", 1).try_cast("long").alias("_doc"))
    outcome = (labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("good"), F.max("quality").alias("_most"))
               .where("good = _most").select("_doc", "good"))
    outcome = written(outcome, "page-outcomes")  # so that the join can be split where very many pages show one document
    found = urls.judged(pages.select("page_id", "url"), shown.join(outcome, "_doc").select("host", "good"))
    return found.select("page_id", "host", "path", "rule", "verdict")


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), c),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ws)::BIGINT * n_docs) // n_terms AS m FROM d, c WHERE len(ws) > 0),
s AS (SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM b JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, item_id, doc_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 20"""


@query("op11_lexical_search", SEARCH_SQL)
def lexical_search(spark, sf):
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


TOP_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
o AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s)
SELECT * FROM o WHERE rank <= 10"""


@query("op12_exact_top_k", TOP_SQL)
def exact_top_k(spark, sf):
    """The 10 vectors of highest inner product with every hundredth one."""
    return topk.top_k(table(spark, sf, "embeddings"))


@query("op13_whiten_embeddings")
def whiten_embeddings(spark, sf):
    """Whitened components of every vector, one row per component."""
    found = whitening.whitened(table(spark, sf, "embeddings"))
    return found.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value"), "n", "deviation", "identity_error").select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "value.whitened", "value.explained", "identity_error")
