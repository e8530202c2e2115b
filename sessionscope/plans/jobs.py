"""Operational histories: Q15 ingestion jobs page, Q16 e-mail jobs page, Q17 e-mail
send history page, Q19 stuck-job detection, Q20 branch recipient list, R10 e-mail
job roll-up, A15 per-type record totals, S15 durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.text import duration_label
from sessionscope.operators.filters import date_range_filter, optional_eq, status_in_and_older, tenant_filter
from sessionscope.operators.paging import paged_with_total
from sessionscope.sources.fixtures import Tables

TS_FMT = "yyyy-MM-dd HH:mm:ss"

# Retry budget and failure messages of the job monitor.
MAX_RETRIGGERS = 3
STUCK_MINUTES = 15
MSG_RETRIES_EXHAUSTED = "Job failed after {n} re-trigger attempts — worker never picked it up successfully"
MSG_WORKER_KILLED = "Worker was killed (OOM or crash) while processing '{step}' after {m} minutes"
MSG_EMAIL_NOT_PICKED = "Email job was never picked up by worker after {m} minutes"
MSG_EMAIL_KILLED = "Email worker was killed (OOM or crash) after {m} minutes"


def _ts(c: str):
    return F.date_format(F.col(c), TS_FMT).alias(c)


def _day(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


def ingestion_jobs_page(t: Tables, tenant_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q15 (L3 + W1): newest first, ties by job_id."""
    j = tenant_filter(t.processing_jobs, tenant_id)
    p = paged_with_total(j, [F.col("created_at").desc(), F.col("job_id").asc()], None, limit, offset=offset, single_group=tenant_id is not None)
    return p.select("id", "tenant_id", "job_id", "status", "data_types", _day("start_date"), _day("end_date"),
                    "progress", "records_processed", "error_message", _ts("created_at"), _ts("started_at"),
                    _ts("completed_at"), "total_count", "row_num")


def email_jobs_page(t: Tables, tenant_id=None, limit: int = 50, offset: int = 0,
                    status: str | None = None) -> DataFrame:
    """Q16: optional status filter; has_more = offset + limit < total."""
    j = optional_eq(tenant_filter(t.email_sending_jobs, tenant_id), "status", status)
    p = paged_with_total(j, [F.col("created_at").desc(), F.col("job_id").asc()], None, limit, offset=offset, single_group=tenant_id is not None)
    return p.select("tenant_id", "job_id", "status", _day("report_date"),
                    F.array_join("target_branches", ",").alias("target_branches"),
                    "total_emails", "emails_sent", "emails_failed", "error_message",
                    _ts("created_at"), _ts("started_at"), _ts("completed_at"), "total_count",
                    (F.lit(offset + limit) < F.col("total_count")).alias("has_more"), "row_num")


def email_history_page(t: Tables, tenant_id=None, limit: int = 50, offset: int = 0, branch_code=None,
                       status=None, start=None, end=None) -> DataFrame:
    """Q17 (P10): optional branch / status / report-date filters, newest sent first."""
    h = tenant_filter(t.email_send_history, tenant_id)
    h = optional_eq(optional_eq(h, "branch_code", branch_code), "status", status)
    h = date_range_filter(h, start, end, col="report_date")
    p = paged_with_total(h, [F.col("sent_at").desc(), F.col("id").asc()], None, limit, offset=offset, single_group=tenant_id is not None)
    return p.select("tenant_id", "id", "job_id", "branch_code", "sales_rep_email", "sales_rep_name", "subject",
                    _day("report_date"), "status", "smtp_response", "error_message", _ts("sent_at"),
                    "total_count", "row_num")


def stuck_jobs(t: Tables, as_of: str, minutes: int = STUCK_MINUTES, tenant_id=None) -> DataFrame:
    """Q19 (P11): jobs queued/processing for longer than ``minutes`` before ``as_of`` and
    the monitor's decision: re-trigger a queued ingestion job while its retrigger
    count is below the budget, else mark failed; e-mail jobs are always failed."""
    active = ("queued", "processing")
    ing = status_in_and_older(tenant_filter(t.processing_jobs, tenant_id), active, as_of, minutes)
    rc = F.coalesce(F.get_json_object("progress", "$.retrigger_count").cast("int"), F.lit(0))
    step = F.coalesce(F.get_json_object("progress", "$.current"), F.lit("unknown step"))
    queued = F.col("status") == "queued"
    retrigger = queued & (rc < MAX_RETRIGGERS)
    ing_out = ing.select(
        F.lit("ingestion").alias("job_type"), "tenant_id", "job_id", "status",
        rc.alias("retrigger_count"),
        F.when(retrigger, "retrigger").otherwise("fail").alias("action"),
        F.when(retrigger, None)
         .when(queued, F.lit(MSG_RETRIES_EXHAUSTED.format(n=MAX_RETRIGGERS)))
         .otherwise(F.replace(F.lit(MSG_WORKER_KILLED.format(step="{step}", m=minutes)), F.lit("{step}"), step))
         .alias("error_message"))
    em = status_in_and_older(tenant_filter(t.email_sending_jobs, tenant_id), active, as_of, minutes)
    em_out = em.select(
        F.lit("email").alias("job_type"), "tenant_id", "job_id", "status",
        F.lit(None).cast("int").alias("retrigger_count"), F.lit("fail").alias("action"),
        F.when(F.col("status") == "queued", F.lit(MSG_EMAIL_NOT_PICKED.format(m=minutes)))
         .otherwise(F.lit(MSG_EMAIL_KILLED.format(m=minutes))).alias("error_message"))
    return ing_out.unionByName(em_out)


def branch_mappings_list(t: Tables, tenant_id=None, branch_code=None) -> DataFrame:
    """Q20: recipients of a tenant, optionally one branch, ordered by (branch, email)."""
    m = optional_eq(tenant_filter(t.branch_email_mappings, tenant_id), "branch_code", branch_code)
    return m.select("tenant_id", "branch_code", "branch_name", "sales_rep_email", "sales_rep_name",
                    "is_enabled").orderBy("tenant_id", "branch_code", "sales_rep_email")


def email_job_rollup(t: Tables, tenant_id=None) -> DataFrame:
    """Per e-mail job total / sent / failed and the final status."""
    h = tenant_filter(t.email_send_history, tenant_id)
    g = h.groupBy("tenant_id", "job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("status") == "sent", 1).otherwise(0)).cast("bigint").alias("sent"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("bigint").alias("failed"))
    return g.withColumn("status", F.when(F.col("failed") == 0, "completed")
                        .when(F.col("sent") > 0, "completed_with_errors").otherwise("failed"))


def records_processed_total(t: Tables, tenant_id=None) -> DataFrame:
    """Total of the per-type record-count map of each ingestion job, with S15 duration."""
    j = tenant_filter(t.processing_jobs, tenant_id)
    m = F.from_json("records_processed", "map<string,bigint>")
    return j.select("tenant_id", "job_id",
                    F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
                    .alias("total_records"),
                    duration_label(F.col("started_at"), F.col("completed_at")).alias("duration"))
