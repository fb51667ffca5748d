"""Queries: the jobs of jobs/, each run twice over the whole tables into a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import service_days, text_ledger
from railyard.fixpoint import shared_folder
from railyard.registry import Registry

Q = Registry()


def _folder(spark, name: str) -> str:
    """A new folder below the shared one; what is written there stays."""
    return f"{shared_folder(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


SERVICE_DAYS = """
WITH v AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS trip, event_type AS stop, date_trunc('second', ts) AS ts, CAST(value AS DOUBLE) AS dist, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
t AS (SELECT *, date_diff('second', CAST(day AS TIMESTAMP), ts)::DOUBLE AS dep_s FROM v),
g AS (SELECT day, CAST(floor(dep_s / 3600) AS INTEGER) AS hour, stop, trip, dep_s - lag(dep_s) OVER (PARTITION BY day, floor(dep_s / 3600), stop ORDER BY dep_s) AS gap FROM t),
h AS (SELECT day, hour, stop, count(*) AS n, count(DISTINCT trip) AS trips, avg(gap) AS mean_gap, CASE WHEN count(*) < 3 OR avg(gap) = 0 THEN 1.0 ELSE var_pop(gap) / (avg(gap) * avg(gap)) END AS cv2 FROM g GROUP BY ALL),
p AS (SELECT day, stop AS i, lead(stop) OVER w AS j, greatest(lead(dep_s) OVER w - dep_s, 0) AS tau, greatest(lead(dist) OVER w - dist, 0) AS step FROM t WINDOW w AS (PARTITION BY day, trip ORDER BY dep_s, id, stop))
SELECT 'hour' AS part, CAST(day AS VARCHAR) AS day, hour, stop AS i, NULL AS j, n, trips, round(mean_gap, 4) AS mean_gap, round(cv2, 6) AS cv2, round(2 * (n / 3600.0::DOUBLE) / (1 + cv2), 9) AS rate, NULL::DOUBLE AS tau_s, NULL::DOUBLE AS dist_m FROM h
UNION ALL SELECT 'edge', CAST(day AS VARCHAR), NULL, i, j, count(*), NULL, NULL, NULL, NULL, round(median(tau), 6), round(median(step), 6) FROM p WHERE j IS NOT NULL AND i <> j GROUP BY day, i, j"""


@Q.add(SERVICE_DAYS)
def job1_service_days(spark, sf_dir):
    out = _folder(spark, "service-days")
    for _ in range(2):
        service_days.run(spark, f"{sf_dir}/events.parquet", out)
    hours, edges = service_days.result(spark, out)
    day = F.col("day").cast("string").alias("day")
    hourly = hours.select(F.lit("hour").alias("part"), day, "hour", F.col("stop").alias("i"), F.lit(None).cast("string").alias("j"), F.col("departures").alias("n"), "trips", F.round("mean_gap", 4).alias("mean_gap"), F.round("cv2", 6).alias("cv2"), F.round("rate", 9).alias("rate"))
    daily = edges.select(F.lit("edge").alias("part"), day, "i", "j", "n", F.round("tau_s", 6).alias("tau_s"), F.round("dist_m", 6).alias("dist_m"))
    return hourly.unionByName(daily, allowMissingColumns=True)


TEXT_LEDGER = """
WITH a AS (SELECT 'documents' AS name, coalesce(lang, '') AS grp, CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'pages', 'html', CAST(page_id AS VARCHAR), coalesce(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), ''), coalesce(html, '') FROM pages),
l AS (SELECT name, grp, id, sha256(text) AS sha256, min(source) AS source, max(length(text)) AS n_chars, max(len(string_split(text, chr(10)))) AS n_lines FROM a GROUP BY ALL),
s AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY name, grp, sha256) AS sources FROM l),
r AS (SELECT name, grp, source, count(*) AS n_texts, count(DISTINCT sha256) AS n_different, count(*) FILTER (sources > 1) AS n_elsewhere, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM s GROUP BY ALL)
SELECT 'text' AS part, name, grp, source, id, sha256, n_chars, n_lines, NULL AS n_texts, NULL AS n_different, NULL AS n_elsewhere, NULL AS share FROM l
UNION ALL SELECT 'source', name, grp, source, NULL, NULL, n_chars, NULL, n_texts, n_different, n_elsewhere, round(coalesce(n_chars / nullif(sum(n_chars) OVER (PARTITION BY name, grp), 0), 0), 9) FROM r"""


@Q.add(TEXT_LEDGER)
def job2_text_ledger(spark, sf_dir):
    out = _folder(spark, "text-ledger")
    for _ in range(2):
        text_ledger.run(spark, {name: f"{sf_dir}/{name}.parquet" for name in ("documents", "pages")}, out)
    ledger, sources = text_ledger.result(spark, out)
    texts = ledger.select(F.lit("text").alias("part"), "name", "grp", "source", "id", "sha256", "n_chars", "n_lines")
    groups = sources.select(F.lit("source").alias("part"), "name", "grp", "source", "n_texts", "n_different", "n_elsewhere", "n_chars", F.round("share", 9).alias("share"))
    return texts.unionByName(groups, allowMissingColumns=True)
