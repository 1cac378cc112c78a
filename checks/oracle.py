"""DuckDB SQL for the registered queries, written straight over the test tables."""

from __future__ import annotations

from checks.extracts import CATEGORIES, NO_SUCH_CUSTOMER, OPENINGS, PRODUCTS
from tallyhouse.functions.text import BLANKS, EMAIL, STOP_WORDS, UK_PHONE
from tallyhouse.plans.metrics import KPI_LABELS
from tallyhouse.plans.questions import INTENTS, PASSAGE_CHARS
from tallyhouse.sources.config import load_rules


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


# --- Raw extracts and marts -------------------------------------------------

CRM = """dim_customer AS (
  SELECT printf('C-%04d', c_custkey) AS customer_id, c_name AS company_name,
         upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS sector,
         'Town ' || c_nationkey AS town, n_name AS account_manager,
         DATE '1995-01-01' + CAST(c_custkey % 2200 AS INT) AS customer_since,
         CAST(5 + c_custkey % 396 AS INT) AS seats,
         printf('contact%d@mail.example', c_custkey) AS contact_email
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORDERS = f"""billing AS (
  SELECT *, CASE WHEN o_orderkey % 89 = 0 THEN '{NO_SUCH_CUSTOMER}'
                 WHEN o_orderkey % 151 = 0 THEN 'BAD-' || o_orderkey
                 ELSE printf('CUST%04d', o_custkey) END AS dirty_ref,
         'INV' || o_orderkey AS invoice_id,
         {_list(PRODUCTS)}[o_orderkey % {len(PRODUCTS)} + 1] AS product,
         CAST(floor(o_totalprice) AS BIGINT) AS pence, pence / 100 AS amount_gbp,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS issued_date,
         CASE WHEN o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-07-01' THEN NULL
              ELSE CAST(date_trunc('quarter', o_orderdate) AS DATE)
                   + CAST(5 + o_orderkey % 60 AS INT) END AS paid_date
  FROM orders)"""

ERRORS = f"""desk AS (
  SELECT event_id AS ticket_id, user_id, 'P' || (event_id % 4 + 1) AS priority,
         {_list(CATEGORIES)}[event_id % {len(CATEGORIES)} + 1] AS category,
         printf('Reported by contact%d@mail.example', user_id) AS summary,
         date_trunc('second', ts)
           - to_days(CAST(event_id % (60 + 40 * (user_id % 4)) AS INT)) AS opened_at,
         CASE WHEN event_id % 12 <> 0 THEN date_trunc('second', ts)
           - to_days(CAST(event_id % (60 + 40 * (user_id % 4)) AS INT))
           + to_seconds(CAST(floor(value * 1200) AS BIGINT)) END AS resolved_at,
         CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 5 + 1 AS INT) END AS csat_score
  FROM events WHERE event_type = 'error')"""

USAGE = """fact_usage AS (
  SELECT printf('C-%04d', user_id) AS customer_id,
         CAST(DATE '2023-02-01' + to_months(CAST(event_id % 12 AS INT)) AS DATE) AS month,
         CAST(count(*) AS INT) AS voice_minutes, round(sum(value), 2) AS data_gb,
         CAST(sum(CASE WHEN event_type <> 'error' THEN 0 WHEN user_id % 4 = 0 THEN 60 ELSE 6 END) AS INT)
           AS outage_minutes
  FROM events GROUP BY 1, 2)"""

INVOICES = f"""{ORDERS}, fact_invoice AS (
  SELECT invoice_id, printf('C-%04d', o_custkey) AS customer_id, product, pence, amount_gbp,
         issued_date, paid_date, date_diff('day', issued_date, paid_date) AS days_to_pay,
         CASE WHEN paid_date IS NULL THEN date_diff('day', issued_date,
           (SELECT max(issued_date) + 30 FROM billing)) END AS days_outstanding
  FROM billing)"""

TICKETS = f"""{ERRORS}, timed AS (
  SELECT *, date_diff('minute', opened_at, resolved_at) / 60.0 AS resolution_hours,
         CASE priority WHEN 'P1' THEN 4 WHEN 'P2' THEN 8 WHEN 'P3' THEN 24 WHEN 'P4' THEN 72 END AS sla_hours
  FROM desk), fact_ticket AS (
  SELECT ticket_id, printf('C-%04d', user_id) AS customer_id, priority, category, opened_at, resolved_at,
         resolution_hours, sla_hours, coalesce(resolution_hours > sla_hours, FALSE) AS sla_breached, csat_score
  FROM timed)"""

# Money is counted in whole pence, so no sum depends on the order of its rows.
REVENUE = """revenue AS (
  SELECT customer_id, sum(pence) AS revenue_pence, count(DISTINCT product) AS product_count
  FROM (FROM fact_invoice QUALIFY dense_rank() OVER (ORDER BY issued_date DESC) = 1) GROUP BY ALL)"""
DEBT = """debt AS (
  SELECT customer_id, sum(pence) AS overdue_pence FROM fact_invoice WHERE days_outstanding > 45 GROUP BY ALL)"""
NEWEST = """in_window AS (
  SELECT t.* FROM fact_ticket t
  JOIN (SELECT max(opened_at) - INTERVAL 90 DAY AS since FROM fact_ticket) ON opened_at >= since)"""
RECENT_TICKETS = f"""{NEWEST}, recent AS (
  SELECT customer_id, count(*) AS tickets_90d, count(*) FILTER (sla_breached) AS sla_breaches_90d,
         avg(csat_score) AS avg_csat
  FROM in_window GROUP BY ALL)"""
TREND = """trend AS (
  SELECT customer_id,
         CAST(coalesce(sum(outage_minutes) FILTER (month > last - INTERVAL 3 MONTH), 0) AS BIGINT)
           AS outage_minutes_3m,
         100.0 * (avg(data_gb) FILTER (month > last - INTERVAL 3 MONTH)
           / nullif(avg(data_gb) FILTER (month <= last - INTERVAL 9 MONTH), 0) - 1) AS data_growth_pct
  FROM fact_usage, (SELECT max(month) AS last FROM fact_usage) GROUP BY 1)"""

MARTS = f"{CRM}, {INVOICES}, {TICKETS}, {USAGE}, {REVENUE}, {DEBT}, {RECENT_TICKETS}, {TREND}"
DIM_COLUMNS = "customer_id, company_name, sector, town, account_manager, customer_since, seats"
WIDE = f"""{MARTS}, points AS (
  SELECT {DIM_COLUMNS},
         coalesce(r.revenue_pence, 0) AS revenue_pence, coalesce(r.revenue_pence, 0) / 100 AS monthly_revenue_gbp,
         coalesce(product_count, 0) AS product_count,
         coalesce(d.overdue_pence, 0) AS overdue_pence, coalesce(d.overdue_pence, 0) / 100 AS overdue_gbp, coalesce(tickets_90d, 0) AS tickets_90d,
         coalesce(sla_breaches_90d, 0) AS sla_breaches_90d, avg_csat,
         coalesce(outage_minutes_3m, 0) AS outage_minutes_3m, coalesce(data_growth_pct, 0) AS data_growth_pct,
         CAST(6 * coalesce(sla_breaches_90d, 0) AS DOUBLE) AS breach_points,
         least(20.0, coalesce(d.overdue_pence, 0) / 100 / 250) AS debt_points,
         CAST(least(20.0, coalesce(outage_minutes_3m, 0) / 20) AS DOUBLE) AS outage_points,
         coalesce((5 - avg_csat) * 6, 0) AS csat_points,
         least(10.0, greatest(-15.0, coalesce(data_growth_pct, 0) / 3)) AS growth_points
  FROM dim_customer LEFT JOIN revenue r USING (customer_id) LEFT JOIN debt d USING (customer_id)
       LEFT JOIN recent USING (customer_id) LEFT JOIN trend USING (customer_id)),
customer_360 AS (
  SELECT *, greatest(0.0, least(100.0, 100 - breach_points - debt_points - outage_points - csat_points
                                       + growth_points)) AS health_score
  FROM points),
at_risk AS (FROM customer_360 WHERE health_score < 40)"""

DIRTY = f"""{CRM}, {ORDERS}, {ERRORS}, {USAGE}, dirty_invoice AS (
  SELECT *, regexp_extract(dirty_ref, '^CUST(\\d+)$', 1) AS number,
         CASE WHEN number <> '' THEN printf('C-%04d', CAST(number AS BIGINT)) END AS customer_id,
         CASE WHEN o_orderkey % 97 <> 0 THEN amount_gbp END AS amount
  FROM billing), dirty_ticket AS (
  SELECT *, CASE WHEN ticket_id % 113 <> 0 THEN printf('C-%04d', user_id) END AS customer_id FROM desk)"""
KNOWN = "customer_id IN (SELECT customer_id FROM dim_customer)"

ISSUES = f"""{DIRTY}, issues AS (
  SELECT 'billing' AS source, invoice_id AS row, 'cust_ref' AS field, 'unrecognised customer key' AS problem
  FROM dirty_invoice WHERE customer_id IS NULL
  UNION ALL SELECT 'billing', invoice_id, 'amount_gbp', 'could not parse as currency'
  FROM dirty_invoice WHERE amount IS NULL
  UNION ALL SELECT 'servicedesk', CAST(ticket_id AS VARCHAR), 'client', 'unrecognised customer key'
  FROM dirty_ticket WHERE customer_id IS NULL
  UNION ALL SELECT 'invoice', invoice_id, 'customer_id', 'no matching CRM account (quarantined)'
  FROM dirty_invoice WHERE customer_id IS NOT NULL AND NOT {KNOWN}
  UNION ALL SELECT 'ticket', CAST(ticket_id AS VARCHAR), 'customer_id', 'no matching CRM account (quarantined)'
  FROM dirty_ticket WHERE customer_id IS NOT NULL AND NOT {KNOWN}
  UNION ALL SELECT 'usage', 'NB/' || substr(customer_id, 3) || '|' || strftime(month, '%Y-%m'), 'customer_id',
         'no matching CRM account (quarantined)'
  FROM fact_usage WHERE NOT {KNOWN})"""

LINEAGE = f"""{DIRTY}, lineage AS (
  SELECT 'customer' AS entity, 'crm' AS source_system, 'crm_accounts.csv' AS file, count(*) AS rows_in,
         count(*) AS rows_loaded, 'contact_email' AS pii_fields FROM dim_customer
  UNION ALL SELECT 'invoice', 'billing', 'billing_invoices.csv', count(*), count(*) FILTER ({KNOWN}), ''
  FROM dirty_invoice
  UNION ALL SELECT 'ticket', 'servicedesk', 'servicedesk_tickets.json', count(*), count(*) FILTER ({KNOWN}),
         'summary' FROM dirty_ticket
  UNION ALL SELECT 'usage', 'network', 'network_usage.csv', count(*), count(*) FILTER ({KNOWN}), ''
  FROM fact_usage)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _ingest_sql() -> dict[str, str]:
    return {
        "canonical_key": _with(
            DIRTY,
            """SELECT 'crm' AS source, customer_id AS raw_key, customer_id, count(*) AS records
            FROM dim_customer GROUP BY ALL
            UNION ALL SELECT 'billing', dirty_ref, customer_id, count(*) FROM dirty_invoice GROUP BY ALL
            UNION ALL SELECT 'servicedesk',
              CASE WHEN customer_id IS NULL THEN 'unknown' ELSE CAST(user_id AS VARCHAR) END,
              customer_id, count(*) FROM dirty_ticket GROUP BY ALL
            UNION ALL SELECT 'network', 'NB/' || substr(customer_id, 3), customer_id, count(*)
            FROM fact_usage GROUP BY ALL""",
        ),
        "parse_currency": _with(
            DIRTY,
            """SELECT invoice_id AS invoice_no, amount AS amount_gbp,
              CASE WHEN amount IS NULL THEN '£1,2O4.00' ELSE format('£{:,.2f}', amount) END AS net_amount
            FROM dirty_invoice""",
        ),
        "parse_types": """
            SELECT o_orderkey,
              CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS as_date,
              CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS VARCHAR) END AS as_datetime,
              CASE WHEN o_orderkey % 13 NOT IN (0, 1, 4) THEN CAST(o_orderkey AS DOUBLE) END AS as_int,
              CASE WHEN o_orderkey % 13 = 4 THEN o_orderkey + 0.5::DOUBLE
                   WHEN o_orderkey % 13 NOT IN (0, 1) THEN CAST(o_orderkey AS DOUBLE) END AS as_float
            FROM orders""",
        "title_case": """
            SELECT p_partkey, array_to_string([upper(left(w, 1)) || lower(substr(w, 2))
              FOR w IN string_split(p_name, ' ')], ' ')
              || '-' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title
            FROM part""",
        "ingest_customer": _with(
            CRM,
            """SELECT * REPLACE (CAST(customer_since AS VARCHAR) AS customer_since, CAST(seats AS BIGINT) AS seats)
            FROM dim_customer""",
        ),
        "ingest_invoice": _with(
            DIRTY,
            f"""SELECT invoice_id, customer_id, product, round(amount, 4) AS amount_gbp,
              CAST(issued_date AS VARCHAR) AS issued_date, CAST(paid_date AS VARCHAR) AS paid_date
            FROM dirty_invoice WHERE {KNOWN}""",
        ),
        "ingest_ticket": _with(
            DIRTY,
            f"""SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, customer_id, priority, category, summary,
              CAST(opened_at AS VARCHAR) AS opened_at, CAST(resolved_at AS VARCHAR) AS resolved_at,
              CAST(csat_score AS DOUBLE) AS csat_score
            FROM dirty_ticket WHERE {KNOWN}""",
        ),
        "ingest_usage": _with(
            DIRTY,
            f"""SELECT customer_id, CAST(month AS VARCHAR) AS month, CAST(voice_minutes AS BIGINT) AS voice_minutes,
              round(data_gb, 4) AS data_gb, CAST(outage_minutes AS BIGINT) AS outage_minutes
            FROM fact_usage WHERE {KNOWN}""",
        ),
        "orphan_records": _with(
            DIRTY,
            f"""SELECT invoice_id, customer_id, product, round(amount, 4) AS amount_gbp,
              CAST(issued_date AS VARCHAR) AS issued_date, CAST(paid_date AS VARCHAR) AS paid_date
            FROM dirty_invoice WHERE customer_id IS NOT NULL AND NOT {KNOWN}""",
        ),
        "files_invoice": _with(
            DIRTY,
            f"""SELECT invoice_id, customer_id, product, round(amount, 4) AS amount_gbp,
              CAST(issued_date AS VARCHAR) AS issued_date, CAST(paid_date AS VARCHAR) AS paid_date
            FROM dirty_invoice WHERE {KNOWN}""",
        ),
        "files_ticket": _with(
            DIRTY,
            f"""SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, customer_id, priority, category,
              CAST(opened_at AS VARCHAR) AS opened_at, CAST(resolved_at AS VARCHAR) AS resolved_at,
              CAST(csat_score AS DOUBLE) AS csat_score
            FROM dirty_ticket WHERE {KNOWN}""",
        ),
        "files_quality_report": _with(ISSUES, "SELECT * FROM issues"),
        "files_orphans": _with(
            DIRTY,
            f"""SELECT entity, customer_id, count(*) AS records FROM (
              SELECT 'invoice' AS entity, customer_id FROM dirty_invoice
              UNION ALL SELECT 'ticket', customer_id FROM dirty_ticket UNION ALL SELECT 'usage', customer_id FROM fact_usage)
            WHERE customer_id IS NOT NULL AND NOT {KNOWN} GROUP BY ALL""",
        ),
        "quarantine_replay": _with(
            DIRTY,
            f"""SELECT invoice_id, customer_id, product, round(amount, 4) AS amount_gbp,
              CAST(issued_date AS VARCHAR) AS issued_date, CAST(paid_date AS VARCHAR) AS paid_date
            FROM dirty_invoice WHERE {KNOWN}""",
        ),
        "quarantine_held": _with(
            DIRTY,
            f"""SELECT source, reason, count(*) AS records FROM (
              SELECT 'billing' AS source, customer_id FROM dirty_invoice
              UNION ALL SELECT 'servicedesk', customer_id FROM dirty_ticket
              UNION ALL SELECT 'network', customer_id FROM fact_usage),
              LATERAL (SELECT CASE WHEN customer_id IS NULL THEN 'unrecognised customer key'
                ELSE 'no matching CRM account (quarantined)' END AS reason)
            WHERE customer_id IS NULL OR NOT {KNOWN} GROUP BY ALL""",
        ),
        "quarantine_report": _with(
            DIRTY,
            f"""SELECT CAST(run AS BIGINT) AS run, 'billing' AS source, CASE WHEN run = 1 THEN n ELSE 0 END AS delivered,
              CASE WHEN run = 1 THEN 0 ELSE n - early END AS taken_up, CAST(0 AS BIGINT) AS replaced,
              CASE WHEN run = 1 THEN early ELSE late END AS loaded, CASE WHEN run = 1 THEN 0 ELSE n - early END AS held_before,
              CASE WHEN run = 1 THEN n - early ELSE n - early - late END AS held_now
            FROM (SELECT count(*) AS n, count(*) FILTER ({KNOWN} AND CAST(substr(customer_id, 3) AS BIGINT) % 3 <> 0) AS early,
                    count(*) FILTER ({KNOWN} AND CAST(substr(customer_id, 3) AS BIGINT) % 3 = 0) AS late
                  FROM dirty_invoice), (VALUES (1), (2)) runs(run)""",
        ),
        "quality_report": _with(ISSUES, "SELECT * FROM issues"),
        "quality_summary": _with(
            ISSUES, "SELECT source, field, problem, count(*) AS issues FROM issues GROUP BY ALL"
        ),
        "lineage": _with(LINEAGE, "SELECT * FROM lineage"),
    }


_WIDE_PLAIN = """round(monthly_revenue_gbp, 4) AS monthly_revenue_gbp, product_count,
  round(overdue_gbp, 4) AS overdue_gbp, tickets_90d, sla_breaches_90d, round(avg_csat, 4) AS avg_csat,
  outage_minutes_3m, round(data_growth_pct, 4) AS data_growth_pct, round(health_score, 4) AS health_score"""


def _profile(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({c}) AS filled FROM {table}"
        for c in columns
    )


def _mart_sql() -> dict[str, str]:
    columns = {
        "dim_customer": DIM_COLUMNS,
        "fact_invoice": "invoice_id, customer_id, product, amount_gbp, issued_date, paid_date, days_to_pay, "
        "days_outstanding",
        "fact_ticket": "ticket_id, customer_id, priority, category, opened_at, resolved_at, resolution_hours, "
        "sla_hours, sla_breached, csat_score",
        "fact_usage": "customer_id, month, voice_minutes, data_gb, outage_minutes",
        "customer_360": f"{DIM_COLUMNS}, monthly_revenue_gbp, product_count, overdue_gbp, tickets_90d, "
        "sla_breaches_90d, avg_csat, outage_minutes_3m, data_growth_pct, health_score",
    }
    profile = " UNION ALL ".join(_profile(table, names.split(", ")) for table, names in columns.items())
    since = "CAST(customer_since AS VARCHAR) AS customer_since"
    return {
        "dim_customer": _with(
            CRM,
            f"SELECT * EXCLUDE (contact_email) REPLACE ({since}) FROM dim_customer",
        ),
        "fact_invoice": _with(
            INVOICES,
            """SELECT * EXCLUDE (pence) REPLACE (CAST(issued_date AS VARCHAR) AS issued_date,
              CAST(paid_date AS VARCHAR) AS paid_date, round(amount_gbp, 4) AS amount_gbp,
              CAST(days_to_pay AS DOUBLE) AS days_to_pay, CAST(days_outstanding AS DOUBLE) AS days_outstanding)
            FROM fact_invoice""",
        ),
        "fact_ticket": _with(
            TICKETS,
            """SELECT * REPLACE (CAST(opened_at AS VARCHAR) AS opened_at,
              CAST(resolved_at AS VARCHAR) AS resolved_at, round(resolution_hours, 4) AS resolution_hours,
              CAST(csat_score AS DOUBLE) AS csat_score)
            FROM fact_ticket""",
        ),
        "fact_usage": _with(
            USAGE,
            """SELECT * REPLACE (CAST(month AS VARCHAR) AS month, round(data_gb, 4) AS data_gb)
            FROM fact_usage""",
        ),
        "pii_minimised_schema": _with(WIDE, profile),
        "revenue_rollup": _with(
            f"{INVOICES}, {REVENUE}",
            "SELECT customer_id, revenue_pence / 100 AS monthly_revenue_gbp, product_count FROM revenue",
        ),
        "overdue_debt_by_customer": _with(
            f"{INVOICES}, {DEBT}", "SELECT customer_id, overdue_pence / 100 AS overdue_gbp FROM debt"
        ),
        "ticket_rollup_90d": _with(
            f"{TICKETS}, {RECENT_TICKETS}",
            "SELECT * REPLACE (round(avg_csat, 4) AS avg_csat) FROM recent",
        ),
        "usage_trend": _with(
            f"{USAGE}, {TREND}",
            "SELECT * REPLACE (round(data_growth_pct, 4) AS data_growth_pct) FROM trend",
        ),
        "customer_360": _with(
            WIDE,
            f"""SELECT customer_id, company_name, sector, town, account_manager, {since}, seats, {_WIDE_PLAIN}
            FROM customer_360 ORDER BY health_score, customer_id""",
        ),
        "customer_360_by_month": _with(
            WIDE,
            f"""SELECT customer_id, company_name, sector, town, account_manager, {since}, seats, {_WIDE_PLAIN}
            FROM customer_360 ORDER BY health_score, customer_id""",
        ),
        "fact_invoice_by_month": _with(
            INVOICES,
            """SELECT * EXCLUDE (pence) REPLACE (CAST(issued_date AS VARCHAR) AS issued_date,
              CAST(paid_date AS VARCHAR) AS paid_date, round(amount_gbp, 4) AS amount_gbp,
              CAST(days_to_pay AS DOUBLE) AS days_to_pay, CAST(days_outstanding AS DOUBLE) AS days_outstanding)
            FROM fact_invoice""",
        ),
        "fact_ticket_by_month": _with(
            TICKETS,
            """SELECT * REPLACE (CAST(opened_at AS VARCHAR) AS opened_at,
              CAST(resolved_at AS VARCHAR) AS resolved_at, round(resolution_hours, 4) AS resolution_hours,
              CAST(csat_score AS DOUBLE) AS csat_score)
            FROM fact_ticket""",
        ),
        "revenue_of_a_year": _with(
            INVOICES,
            """SELECT CAST(issued_date AS VARCHAR) AS issued_date, product, count(*) AS invoices, sum(pence) / 100 AS amount_gbp
            FROM fact_invoice WHERE year(issued_date) = 2000 GROUP BY ALL""",
        ),
        "health_bands": _with(
            WIDE,
            """SELECT customer_id, company_name, round(health_score, 4) AS health_score,
              CASE WHEN health_score < 40 THEN 'high risk' WHEN health_score < 70 THEN 'watch' ELSE 'healthy' END AS band
            FROM customer_360""",
        ),
        "overdue_stages": _with(
            INVOICES,
            """SELECT invoice_id, customer_id, round(amount_gbp, 4) AS amount_gbp, days_outstanding,
              CASE WHEN days_outstanding < 31 THEN 'not due' WHEN days_outstanding < 45 THEN 'reminder'
                   WHEN days_outstanding < 60 THEN 'phone call' WHEN days_outstanding < 90 THEN 'formal letter'
                   ELSE 'finance director' END AS stage
            FROM fact_invoice WHERE paid_date IS NULL""",
        ),
        "credit_holds": _with(
            WIDE,
            """SELECT customer_id, company_name, account_manager, round(overdue_gbp, 4) AS overdue_gbp,
              overdue_gbp > 5000 AS on_hold
            FROM customer_360 WHERE overdue_gbp > 0""",
        ),
        "service_credits": _with(
            WIDE,
            """SELECT customer_id, company_name, sla_breaches_90d, round(monthly_revenue_gbp, 4) AS monthly_revenue_gbp,
              CASE WHEN sla_breaches_90d >= 5 THEN 10 ELSE 5 END AS credit_percent,
              round(monthly_revenue_gbp * CASE WHEN sla_breaches_90d >= 5 THEN 10 ELSE 5 END / 100, 4) AS credit_gbp
            FROM customer_360 WHERE sla_breaches_90d >= 3""",
        ),
        "upsell_without_breaches": _with(
            WIDE,
            """SELECT customer_id, company_name, round(data_growth_pct, 4) AS data_growth_pct, coalesce(n, 0) AS open_breaches,
              n IS NULL AS offer
            FROM customer_360 LEFT JOIN (
              SELECT customer_id, count(*) AS n FROM fact_ticket, (SELECT max(opened_at) AS newest FROM fact_ticket)
              WHERE resolved_at IS NULL AND epoch_us(newest) - epoch_us(opened_at) > sla_hours * 3600000000 GROUP BY 1) USING (customer_id)
            WHERE health_score >= 70 AND data_growth_pct > 0""",
        ),
        "health_score_components": _with(
            WIDE,
            """SELECT customer_id, round(breach_points, 4) AS breach_points, round(debt_points, 4) AS debt_points,
              round(outage_points, 4) AS outage_points, round(csat_points, 4) AS csat_points,
              round(growth_points, 4) AS growth_points, round(health_score, 4) AS health_score
            FROM customer_360""",
        ),
    }


def _pounds(pence: str) -> str:
    """Whole pounds; fifty pence go up."""
    return f"CAST(({pence} + 50) // 100 AS DOUBLE)"


def _share(condition: str) -> str:
    return f"round(100.0 * count(*) FILTER ({condition}) / count(*), 1)"


SLA_KPI = f"SELECT {_share('NOT sla_breached')} AS sla_compliance FROM in_window"
KPI_ROWS = f"""SELECT kpi, label, value
  FROM (VALUES {", ".join(f"({_quoted(kpi)}, {_quoted(label)})" for kpi, label in KPI_LABELS.items())}) names(kpi, label)
  JOIN (UNPIVOT (
    SELECT {_pounds("(SELECT sum(revenue_pence) FROM customer_360)")} AS monthly_recurring_revenue,
           {_pounds("(SELECT sum(overdue_pence) FROM customer_360)")} AS overdue_debt,
           CAST(({SLA_KPI}) AS DOUBLE) AS sla_compliance,
           CAST(count(*) AS DOUBLE) AS at_risk_accounts,
           {_pounds("sum(revenue_pence)")} AS revenue_at_risk,
           (SELECT round(avg(avg_csat), 2) FROM customer_360) AS avg_csat
    FROM at_risk) ON COLUMNS(*) INTO NAME kpi VALUE value) USING (kpi)"""
BY_CATEGORY = f"""SELECT category, count(*) AS tickets, {_share("sla_breached")} AS {{}}
  FROM fact_ticket GROUP BY ALL"""


_AT_RISK_FIGURES = f"round(health_score) AS health, {_pounds('revenue_pence')} AS mrr_gbp"


def _metric_sql() -> dict[str, str]:
    return {
        "kpis": _with(WIDE, KPI_ROWS),
        "kpi_display": _with(
            f"{WIDE}, kpi_rows AS ({KPI_ROWS})",
            """SELECT kpi, replace(replace(label, ' (£)', ''), ' (£ / month)', ' / month') AS label,
              CASE WHEN value IS NULL THEN '–' WHEN contains(label, '£') THEN '£' || format('{:,.0f}', value)
                   WHEN kpi = 'at_risk_accounts' THEN format('{:,.0f}', value)
                   ELSE format('{:,.1f}', value) END AS shown
            FROM kpi_rows""",
        ),
        "sla_compliance": _with(f"{TICKETS}, {NEWEST}", SLA_KPI),
        "revenue_trend": _with(
            INVOICES,
            f"""SELECT strftime(issued_date, '%Y-%m-%d') AS month, product, {_pounds("sum(pence)")} AS revenue_gbp
            FROM fact_invoice GROUP BY ALL""",
        ),
        "tickets_by_category": _with(TICKETS, BY_CATEGORY.format("breach_rate_pct")),
        "health_by_sector": _with(
            WIDE,
            f"""SELECT sector, count(*) AS accounts, round(avg(health_score), 1) AS avg_health,
              {_pounds("sum(revenue_pence)")} AS mrr_gbp
            FROM customer_360 GROUP BY ALL""",
        ),
        "account_manager_portfolio": _with(
            WIDE,
            f"""SELECT account_manager, count(*) AS accounts, {_pounds("sum(revenue_pence)")} AS mrr_gbp,
              count(*) FILTER (health_score < 40) AS at_risk
            FROM customer_360 GROUP BY ALL""",
        ),
        "at_risk_accounts": _with(
            WIDE,
            f"""FROM at_risk SELECT customer_id, company_name, sector, account_manager, {_AT_RISK_FIGURES},
              sla_breaches_90d, {_pounds("overdue_pence")} AS overdue_gbp, outage_minutes_3m""",
        ),
        "top_at_risk": _with(
            WIDE,
            f"""FROM at_risk SELECT company_name, account_manager, {_AT_RISK_FIGURES}
            QUALIFY row_number() OVER (ORDER BY revenue_pence DESC, customer_id) <= 10""",
        ),
        "top_debtors": _with(
            WIDE,
            f"""FROM debt JOIN dim_customer USING (customer_id)
            SELECT company_name, account_manager, {_pounds("overdue_pence")} AS overdue_gbp WHERE overdue_pence > 0
            QUALIFY row_number() OVER (ORDER BY overdue_pence DESC, customer_id) <= 10""",
        ),
        "breach_rate_by_category": _with(TICKETS, BY_CATEGORY.format("breach_pct")),
        "mrr_by_product": _with(
            INVOICES,
            f"""SELECT product, {_pounds("arg_max(pence, issued_date)")} AS mrr_gbp FROM (
              SELECT product, issued_date, sum(pence) AS pence FROM fact_invoice GROUP BY product, issued_date
              QUALIFY dense_rank() OVER (ORDER BY issued_date DESC) = 1) GROUP BY ALL""",
        ),
    }


# --- Rules and actions ------------------------------------------------------

_ACCOUNT = "customer_id, company_name, account_manager"
RULE_SQL = {
    "churn_risk_review": f"""FROM at_risk SELECT {_ACCOUNT},
      printf('Health score %d/100', CAST(round(health_score) AS INT)) AS reason""",
    "sla_breach_escalation": f"""FROM recent JOIN dim_customer USING (customer_id)
      SELECT {_ACCOUNT}, printf('%d SLA breaches in 90 days', sla_breaches_90d) AS reason
      WHERE sla_breaches_90d >= 3""",
    "overdue_debt_chase": f"""FROM debt JOIN dim_customer USING (customer_id)
      SELECT {_ACCOUNT}, printf('£%d overdue', CAST((debt.overdue_pence + 50) // 100 AS BIGINT)) AS reason""",
    "upsell_growth": f"""FROM customer_360
      SELECT {_ACCOUNT}, printf('Data usage up %d%% with %d product line(s)',
        CAST(round(data_growth_pct) AS BIGINT), product_count) AS reason
      WHERE health_score >= 70 AND data_growth_pct > 5 AND product_count = 1""",
}
HITS = " UNION ALL ".join(
    f"""SELECT '{r["id"]}:' || customer_id AS action_key, '{r["id"]}' AS rule_id,
      {_quoted(r["name"])} AS rule_name, '{r["priority"]}' AS priority,
      {"account_manager" if r["owner"] == "account_manager" else _quoted(r["owner"])} AS owner,
      customer_id, company_name, account_manager, reason, {_quoted(r["action"])} AS action
      FROM ({RULE_SQL[r["id"]]})"""
    for r in load_rules()
)
ACTIONS = f"{WIDE}, hits AS ({HITS})"
FIRST, AGAIN = "2024-02-01 09:00:00", "2024-02-02 09:00:00"
EVERY_THIRD = "CAST(substr(customer_id, 3) AS BIGINT) % 3 = 0"


def _action_sql() -> dict[str, str]:
    rules = {f"rule_{name}": _with(WIDE, sql) for name, sql in RULE_SQL.items()}
    ids = _list(RULE_SQL)
    return rules | {
        "open_actions": _with(
            ACTIONS,
            f"""SELECT rule_name, priority, owner, customer_id, company_name, reason, action,
              'open' AS status, '{FIRST}' AS raised_at
            FROM hits
            ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule_name,
              company_name, customer_id""",
        ),
        "actions_by_rule": _with(
            ACTIONS, "SELECT rule_name, count(*) AS actions FROM hits GROUP BY 1"
        ),
        "actions_by_owner": _with(
            ACTIONS, "SELECT owner, count(*) AS actions FROM hits GROUP BY 1 ORDER BY 1"
        ),
        "action_metrics": _with(
            ACTIONS,
            """SELECT count(*) AS open_actions, count(*) FILTER (priority = 'high') AS high_priority,
              count(DISTINCT owner) AS owners FROM hits""",
        ),
        "actions_second_run": _with(
            ACTIONS,
            f"""SELECT *, 'open' AS status, '{FIRST}' AS raised_at, CAST(1 AS BIGINT) AS run FROM hits""",
        ),
        "actions_reopen": _with(
            ACTIONS,
            f"""SELECT *, 'open' AS status, CASE WHEN {EVERY_THIRD} THEN '{AGAIN}' ELSE '{FIRST}' END AS raised_at,
              CAST(CASE WHEN {EVERY_THIRD} THEN 3 ELSE 1 END AS BIGINT) AS run FROM hits""",
        ),
        "actions_compacted": _with(
            ACTIONS,
            f"""SELECT *, 'open' AS status, CASE WHEN {EVERY_THIRD} THEN '{AGAIN}' ELSE '{FIRST}' END AS raised_at,
              CAST(CASE WHEN {EVERY_THIRD} THEN 3 ELSE 1 END AS BIGINT) AS run FROM hits""",
        ),
        "rule_audit": _with(f"{ACTIONS}, {_rule_counts(ids)}", "SELECT * FROM rule_counts"),
        "audit_log": _with(AUDIT, "SELECT * FROM audit"),
        "audit_of_a_day": _with(AUDIT, "SELECT * FROM audit WHERE starts_with(ts, '2024-02-02')"),
        "audit_tail": _with(
            AUDIT, "SELECT * FROM audit ORDER BY ts DESC, seq DESC, layer DESC, event DESC LIMIT 5"
        ),
    }


def _rule_counts(ids: str) -> str:
    return f"""rule_counts AS (
      SELECT r.rule_id, count(hits.rule_id) AS matches,
             count(hits.rule_id) FILTER ({EVERY_THIRD}) AS new_actions
      FROM (SELECT unnest({ids}) AS rule_id) r LEFT JOIN hits ON hits.rule_id = r.rule_id GROUP BY 1)"""


def _audit_ctes() -> str:
    # The clean and the dirty invoices have CTEs of the same name; keep them apart by nesting.
    return f"""loads AS ({_with(LINEAGE, "SELECT * FROM lineage")}),
    rule_totals AS ({_with(f"{ACTIONS}, {_rule_counts(_list(RULE_SQL))}", "SELECT * FROM rule_counts")}),
    audit AS (
      SELECT '2024-02-01T09:00:00' AS ts, CAST(1 AS BIGINT) AS seq, 'ingestion' AS layer,
             'load:' || entity AS event,
             '{{"rows_in":"' || rows_in || '","rows_loaded":"' || rows_loaded || '"}}' AS detail
      FROM loads
      UNION ALL SELECT '2024-02-02T09:00:00', CAST(2 AS BIGINT), 'automation', rule_id,
             '{{"matches":"' || matches || '","new_actions":"' || new_actions || '"}}' FROM rule_totals)"""


AUDIT = _audit_ctes()

# --- Text and search --------------------------------------------------------

STEM = """CASE WHEN t LIKE '%ss' THEN t
  WHEN t LIKE '%ing' AND length(t) >= 7 THEN left(t, length(t) - 3)
  WHEN t LIKE '%es' AND length(t) >= 6 THEN left(t, length(t) - 2)
  WHEN t LIKE '%s' AND length(t) >= 5 THEN left(t, length(t) - 1) ELSE t END"""


def _terms(name: str, key: str, text: str, source: str) -> str:
    """A CTE with one row per kept, stemmed token."""
    stop = ", ".join(_quoted(w) for w in STOP_WORDS)
    return f"""{name} AS (
      SELECT {key}, {STEM} AS term
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9£]+')) AS t FROM {source})
      WHERE t NOT IN ({stop}))"""


def _bm25(chunks: str, queries: str, k: int) -> str:
    """CTEs up to ``best`` over chunks(chunk_id, heading, text) and queries(query_id, query)."""
    return f"""chunks AS ({chunks}), queries AS ({queries}),
    {_terms("ct", "chunk_id", "heading || ' ' || heading || ' ' || text", "chunks")},
    {_terms("qt", "query_id", "query", "queries")},
    tf AS (SELECT chunk_id, term, count(*) AS tf FROM ct GROUP BY ALL),
    dl AS (SELECT chunk_id, count(*) AS dl FROM ct GROUP BY ALL),
    totals AS (SELECT n, tokens / n AS avgdl
      FROM (SELECT count(*) AS n FROM chunks), (SELECT sum(dl) AS tokens FROM dl)),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    stats AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM df, totals),
    asked AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
    scores AS (
      SELECT query_id, chunk_id,
             sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM asked JOIN tf USING (term) JOIN dl USING (chunk_id) JOIN stats USING (term)
      GROUP BY ALL HAVING score > 0),
    best AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id)
             AS INT) AS rank, chunk_id, score
      FROM scores QUALIFY rank <= {k})"""


DOCUMENTS = "SELECT doc_id AS chunk_id, source AS heading, text FROM documents"
BENCHMARK = "SELECT item_id AS query_id, text AS query FROM benchmark"
REDACTED = "regexp_replace(regexp_replace({0}, {1}, '[EMAIL]', 'g'), {2}, '[PHONE]', 'g')"


def _redacted(column: str) -> str:
    return REDACTED.format(column, _quoted(EMAIL), _quoted(UK_PHONE))


def _intent(column: str, result) -> str:
    cases = " ".join(
        "WHEN "
        + " OR ".join(f"contains(lower({column}), {_quoted(w)})" for w in intent.keywords)
        + f" THEN {_quoted(result(intent))}"
        for intent in INTENTS
    )
    return f"CASE {cases} END"


QUESTIONS = f"""redacted AS (
  SELECT conv_id || '/' || turn AS question_id,
         {_redacted(f"{_list(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || text")} AS question
  FROM conversations WHERE role = 'user'), classified AS (
  SELECT question_id, {_intent("question", lambda i: i.name)} AS intent,
         coalesce({_intent("question", lambda i: i.policy)}, question) AS search
  FROM redacted)"""
POLICIES = "SELECT item_id AS chunk_id, 'Policy ' || item_id AS heading, text FROM benchmark"

_BLANKS = "'" + BLANKS + "'"
SECTIONS = rf"""pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents), md AS (
  SELECT doc_id AS doc, '# ' || any_value(source) || chr(10) || string_agg(
           CASE WHEN i > 1 AND contains(x, '@') THEN '# ' WHEN i > 1 THEN '## ' ELSE '' END
             || replace(x, '. ', '.' || chr(10)), chr(10) ORDER BY i) AS text
  FROM pieces GROUP BY doc_id), split AS (
  SELECT doc, string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]',
                                          chr(10), 'g'), chr(10)) AS lines
  FROM md), lines AS (
  SELECT doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split), marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER w AS position,
         last_value(CASE WHEN starts_with(line, '# ') THEN trim(substr(line, 3), {_BLANKS}) END IGNORE NULLS)
           OVER w AS title
  FROM lines WINDOW w AS (PARTITION BY doc ORDER BY i)), sections AS (
  SELECT doc, CAST(position AS INT) AS position, max_by(title, i) AS title,
         coalesce(max_by(title, i) FILTER (starts_with(line, '# ')),
                  trim(substr(max(line) FILTER (starts_with(line, '## ')), 4), {_BLANKS})) AS heading,
         trim(string_agg(line, chr(10) ORDER BY i)
           FILTER (NOT starts_with(line, '# ') AND NOT starts_with(line, '## ')), {_BLANKS}) AS text
  FROM marked GROUP BY doc, position)"""


def _text_sql() -> dict[str, str]:
    clean = _redacted("text")
    return {
        "redact_documents": f"""
            SELECT doc_id, md5({clean}) AS redacted_md5, CAST(length({clean}) AS INT) AS redacted_chars FROM documents""",
        "token_counts": _with(
            _terms("kept", "doc_id", "text", "documents"),
            """SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9£]+')) AS INT) AS tokens,
              CAST(coalesce(n, 0) AS INT) AS search_tokens
            FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY 1) USING (doc_id)""",
        ),
        "term_frequencies": _with(
            _terms("kept", "doc_id", "text", "documents"),
            "SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM kept GROUP BY ALL",
        ),
        "bm25_term_stats": _with(
            _bm25(DOCUMENTS, BENCHMARK, 3),
            "SELECT term, df, round(idf, 4) AS idf, round(avgdl, 4) AS avgdl FROM stats",
        ),
        "bm25_search": _with(
            _bm25(DOCUMENTS, BENCHMARK, 3),
            "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM best",
        ),
        "passage_search": _with(
            _bm25(DOCUMENTS, BENCHMARK, 3),
            "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM best",
        ),
        "passage_search_after_deletion": _with(
            _bm25(f"{DOCUMENTS} WHERE doc_id % 4 <> 1", BENCHMARK, 3),
            "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM best",
        ),
        "passage_term_stats": _with(
            _bm25(DOCUMENTS, BENCHMARK, 3),
            "SELECT term, df, round(idf, 4) AS idf, round(avgdl, 4) AS avgdl FROM stats",
        ),
        "chunk_documents": _with(
            SECTIONS,
            """SELECT CAST(doc AS VARCHAR) AS doc, position, title, heading, md5(text) AS text_md5
            FROM sections WHERE text <> ''""",
        ),
        "files_chunks": _with(
            SECTIONS,
            """SELECT CAST(doc AS VARCHAR) AS doc, position, title, heading, md5(text) AS text_md5
            FROM sections WHERE text <> ''""",
        ),
        "intent_classify": _with(
            QUESTIONS, "SELECT question_id, intent, md5(search) AS search_md5 FROM classified"
        ),
        "question_policy": _with(
            QUESTIONS
            + ", "
            + _bm25(POLICIES, "SELECT DISTINCT search AS query_id, search AS query FROM classified", 1),
            f"""SELECT question_id, intent, CAST(chunk_id AS DOUBLE) AS chunk_id,
              'Handbook ' || (chunk_id % 7) AS title, heading AS section, left(text, {PASSAGE_CHARS}) AS passage
            FROM classified LEFT JOIN best ON query_id = search LEFT JOIN chunks USING (chunk_id)""",
        ),
    }


def _governed_sql() -> dict[str, str]:
    return {
        "governed_query": _with(
            WIDE,
            """SELECT customer_id, company_name, round(health_score, 4) AS health_score, tickets
            FROM customer_360 JOIN (SELECT customer_id, count(*) AS tickets FROM fact_ticket GROUP BY 1)
              USING (customer_id)
            ORDER BY customer_360.health_score, customer_id LIMIT 500""",
        ),
        "governed_query_json": _with(
            WIDE,
            """SELECT CAST(to_json({customer_id: customer_id,
              customer_since: strftime(customer_since, '%Y-%m-%dT00:00:00.000'), seats: seats,
              health: round(health_score, 1), quiet: avg_csat IS NULL}) AS VARCHAR) AS record
            FROM (SELECT * FROM customer_360 ORDER BY health_score, customer_id LIMIT 50)""",
        ),
        "governed_query_setops": _with(
            WIDE,
            """SELECT * FROM (
              (SELECT customer_id FROM fact_invoice WHERE days_outstanding > 45
               UNION SELECT customer_id FROM fact_ticket WHERE sla_breached)
              INTERSECT SELECT customer_id FROM fact_usage
              EXCEPT SELECT customer_id FROM customer_360 WHERE health_score >= 95)
            ORDER BY customer_id LIMIT 500""",
        ),
    }


def oracle_sql() -> dict[str, str]:
    return (
        _ingest_sql() | _mart_sql() | _metric_sql() | _action_sql() | _text_sql() | _governed_sql()
    )
