"""ANSI-style SQL for the named queries, to check their results in another engine.

The view text is the one in ``sources.views``; the statements below are written on
their own, in plain windows and joins, and not derived from the DataFrame plans.
"""

from __future__ import annotations

from ledgerlane.sources import dims
from ledgerlane.sources.views import AS_OF, BUSINESS, PROJECTIONS

VIEWS = {
    name: f"SELECT {', '.join(columns)} FROM {table}" + (f" WHERE {where}" if where else "")
    for name, (table, columns, where) in PROJECTIONS.items()
}
VIEWS["credit_scores"] = f"""
SELECT o_orderkey AS id, o_custkey AS customer_id,
  CAST(300 + (o_orderkey * 7919 + o_custkey) % 551 AS INT) AS score,
  CAST(o_orderdate AS DATE) AS score_date
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE NOT ({BUSINESS})"""
VIEWS["bank_statements"] = """
SELECT o_custkey AS customer_id,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS statement_date,
  CAST(MAX(c_acctbal) AS DOUBLE) AS balance,
  CAST(SUM(CASE WHEN o_custkey % 13 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS monthly_income,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(45 + o_orderkey % 60 AS INT)) AS DOUBLE) / 100 AS monthly_expenses,
  COUNT(*) AS transaction_count,
  concat('{"transactions": [{"date": "', CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING),
    '", "description": "Salary", "amount": ', CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS STRING),
    '}, {"date": "', CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING),
    '", "description": "Rent", "amount": -1200}]}') AS statement_data,
  concat('{"overdrafts": ', CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS STRING),
    ', "returned_payments": ', CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS STRING),
    ', "gambling_transactions": ', CASE WHEN MIN(o_orderkey % 10) = 0 THEN 'true' ELSE 'false' END,
    ', "irregular_income": ', CASE WHEN MAX(o_orderkey % 4) = 3 THEN 'true' ELSE 'false' END, '}') AS risk_indicators
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_custkey % 11 <> 0
GROUP BY o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE)"""

NAME = "coalesce(c.company_name, concat_ws(' ', c.first_name, c.last_name))"

LATEST_SCORE = """
latest_scores AS (
  SELECT customer_id, id, score, score_date FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score_date DESC, id DESC) AS rn FROM credit_scores)
  WHERE rn = 1)"""
LATEST_STATEMENT = """
latest_statements AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY statement_date DESC) AS rn FROM bank_statements)
  WHERE rn = 1)"""


def _features(fallback: bool = False) -> str:
    age = "35" if fallback else (
        f"coalesce(datesub('year', c.date_of_birth, DATE '{AS_OF}'), 35)"
    )
    business = "0" if fallback else "CASE WHEN c.customer_type = 'business' THEN 1 ELSE 0 END"
    country = "0.1" if fallback else (
        "CASE c.country WHEN 'Germany' THEN 0.1 WHEN 'France' THEN 0.15 WHEN 'Italy' THEN 0.2 WHEN 'Spain' THEN 0.25"
        " WHEN 'Poland' THEN 0.3 WHEN 'Netherlands' THEN 0.05 ELSE 0.2 END"
    )
    return f"""
features AS (
  SELECT c.id AS customer_id, {NAME} AS customer, c.email AS email,
    CAST({age} AS DOUBLE) AS age,
    CAST({business} AS DOUBLE) AS is_business,
    coalesce(s.monthly_income, 0.0e0) AS monthly_income,
    coalesce(s.monthly_expenses, 0.0e0) AS monthly_expenses,
    coalesce(s.balance, 0.0e0) AS current_balance,
    CASE WHEN s.monthly_income > 0 THEN s.monthly_expenses / s.monthly_income ELSE 1.0e0 END AS expense_to_income_ratio,
    CASE WHEN s.monthly_income > 0 THEN (s.monthly_income - s.monthly_expenses) / s.monthly_income ELSE 0.0e0 END AS savings_rate,
    CAST(coalesce(CAST(json_extract_string(s.risk_indicators, '$.overdrafts') AS INT), 0) AS DOUBLE) AS overdrafts,
    CAST(coalesce(CAST(json_extract_string(s.risk_indicators, '$.returned_payments') AS INT), 0) AS DOUBLE) AS returned_payments,
    CASE WHEN json_extract_string(s.risk_indicators, '$.gambling_transactions') = 'true' THEN 1.0e0 ELSE 0.0e0 END AS gambling_transactions,
    CASE WHEN json_extract_string(s.risk_indicators, '$.irregular_income') = 'true' THEN 1.0e0 ELSE 0.0e0 END AS irregular_income,
    CAST(coalesce(k.score, 650) AS DOUBLE) AS existing_credit_score,
    CAST({country} AS DOUBLE) AS country_risk
  FROM customers c
  LEFT JOIN latest_scores k ON k.customer_id = c.id
  LEFT JOIN latest_statements s ON s.customer_id = c.id)"""


FEATURE_NAMES = [
    "age", "is_business", "monthly_income", "monthly_expenses", "current_balance", "expense_to_income_ratio",
    "savings_rate", "overdrafts", "returned_payments", "gambling_transactions", "irregular_income",
    "existing_credit_score", "country_risk",
]

# The pinned scorecard once more, as a table: feature, coefficient, mean, deviation.
CARD = [
    ("age", 0.12, 32.0, 11.5),
    ("is_business", -0.05, 0.4, 0.49),
    ("monthly_income", 0.18, 230000.0, 150000.0),
    ("monthly_expenses", -0.14, 190000.0, 120000.0),
    ("current_balance", 0.21, 4500.0, 3200.0),
    ("expense_to_income_ratio", -0.46, 0.78, 0.18),
    ("savings_rate", 0.39, 0.24, 0.18),
    ("overdrafts", -0.27, 0.2, 0.42),
    ("returned_payments", -0.33, 0.35, 0.5),
    ("gambling_transactions", -0.24, 0.1, 0.3),
    ("irregular_income", -0.17, 0.27, 0.44),
    ("existing_credit_score", 0.52, 600.0, 140.0),
    ("country_risk", -0.11, 0.18, 0.08),
]


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def real(value: float) -> str:
    """A literal that is read as DOUBLE, not as a decimal."""
    return f"{value!r}e0" if "e" not in repr(value) else repr(value)


CARD_TABLE = (
    "card(feature, coefficient, mean, std) AS (VALUES "
    + ", ".join(f"({text(f)}, {real(c)}, {real(m)}, {real(s)})" for f, c, m, s in CARD)
    + ")"
)
LONG_FEATURES = (
    "long_features AS (UNPIVOT (SELECT customer_id, "
    + ", ".join(FEATURE_NAMES)
    + " FROM features) ON "
    + ", ".join(FEATURE_NAMES)
    + " INTO NAME feature VALUE value)"
)
SCORED = """
odds AS (
  SELECT customer_id, 0.85e0 + sum(coefficient * ((value - mean) / std)) AS z
  FROM long_features JOIN card USING (feature) GROUP BY customer_id),
probabilities AS (SELECT customer_id, 1.0e0 / (1.0e0 + exp(-z)) AS probability FROM odds),
scores AS (
  SELECT customer_id, probability, CAST(round_even(300.0e0 + probability * 550.0e0, 0) AS INT) AS credit_score
  FROM probabilities),
scored AS (
  SELECT *, CASE WHEN credit_score >= 740 THEN 'Low Risk' WHEN credit_score >= 670 THEN 'Medium-Low Risk'
    WHEN credit_score >= 580 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level FROM scores)"""

FEATURE_PARTS = (LATEST_SCORE, LATEST_STATEMENT, _features())
FEATURE_VIEWS = ("customers", "credit_scores", "bank_statements")
SCORE_PARTS = (*FEATURE_PARTS, CARD_TABLE, LONG_FEATURES, SCORED)


def title(column: str) -> str:
    words = f"string_split({column}, '_')"
    return f"array_to_string(list_transform({words}, lambda w: concat(upper(w[1:1]), w[2:])), ' ')"


def over(views: tuple[str, ...], body: str, *parts: str) -> str:
    """``body`` with the views it reads and further common table expressions in front."""
    named = [f"{v} AS ({VIEWS[v]})" for v in views] + [p.strip() for p in parts]
    return ("WITH " + ",\n".join(named) + "\n" if named else "") + body.strip()


def _latest(fact: str, columns: str, n: int) -> str:
    return over(
        ("customers", fact),
        f"""SELECT {columns} FROM {fact} f JOIN customers c ON f.customer_id = c.id
        ORDER BY f.created_at DESC NULLS LAST, f.id DESC LIMIT {n}""",
    )


def _account_queries() -> dict[str, str]:
    col, both = ("collections",), ("collections", "customers")
    join = "FROM collections f JOIN customers c ON f.customer_id = c.id"
    actions = ", ".join(
        f"({text(s)}, {text(name)}, {i}, {text(a)})"
        for s, (name, acts) in dims.STAGE_ACTIONS.items()
        for i, a in enumerate(acts, 1)
    )
    stage_prompt = " ".join(f"WHEN {text(s)} THEN {text(p)}" for s, p in dims.STAGE_PROMPTS.items())
    return {
        "collections_worklist": over(both, f"""
            SELECT f.id, {NAME} AS customer, c.email, outstanding_amount, days_overdue, collection_stage, loan_id
            {join} ORDER BY days_overdue DESC, f.id DESC"""),
        "collections_filtered": over(both, f"""
            SELECT f.id, {NAME} AS customer, loan_id, outstanding_amount,
              '€' || format('{{:,.2f}}', outstanding_amount) AS outstanding_text, days_overdue, collection_stage,
              CASE WHEN days_overdue > 90 THEN 'critical' WHEN days_overdue > 60 THEN 'high'
                WHEN days_overdue > 30 THEN 'elevated' ELSE 'normal' END AS band
            {join} WHERE collection_stage IN ('mid', 'late') AND outstanding_amount >= 100000 AND days_overdue >= 45"""),
        "high_risk_accounts": over(both, f"""
            SELECT f.id, {NAME} AS customer, loan_id, outstanding_amount, days_overdue {join} WHERE days_overdue > 60"""),
        "collections_risk": over(both, f"""
            SELECT f.id, {NAME} AS customer, outstanding_amount, days_overdue, collection_stage,
              days_overdue / 30.0e0 * (outstanding_amount / 1000.0e0) AS risk_score {join}"""),
        "collections_by_stage": over(col, """
            SELECT collection_stage, count(*) AS n,
              CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) / count(outstanding_amount) AS avg_outstanding
            FROM collections GROUP BY collection_stage"""),
        "collections_totals": over(both, f"""
            SELECT CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_outstanding,
              avg(days_overdue) AS avg_days_overdue, count(*) AS accounts,
              CAST(sum(CASE WHEN days_overdue > 60 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk {join}"""),
        "stage_value_counts": over(both, f"""
            SELECT collection_stage, count(*) AS n {join} WHERE collection_stage IS NOT NULL GROUP BY collection_stage"""),
        "outstanding_by_stage": over(both, f"""
            SELECT collection_stage, CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS outstanding
            {join} WHERE collection_stage IS NOT NULL GROUP BY collection_stage"""),
        "stage_counts_zero_filled": over(both, f"""
            SELECT s.collection_stage, count(k.id) AS n
            FROM (VALUES ('early'), ('mid'), ('late'), ('legal')) s(collection_stage)
            LEFT JOIN (SELECT f.id, f.collection_stage {join}) k USING (collection_stage) GROUP BY s.collection_stage"""),
        "overdue_heatmap": over(both, f"""
            SELECT CAST(floor(days_overdue / 30.0e0) AS INT) AS days_bin,
              CAST(floor(outstanding_amount / 1000.0e0) AS BIGINT) AS amount_bin, count(*) AS n,
              CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS outstanding {join} GROUP BY 1, 2"""),
        "overdue_bands": over(col, """
            SELECT id, days_overdue, collection_stage,
              CASE WHEN days_overdue < 30 THEN 'early' WHEN days_overdue < 60 THEN 'mid' ELSE 'late' END AS seed_stage,
              CASE WHEN days_overdue < 15 THEN 'current' WHEN days_overdue <= 30 THEN 'early'
                WHEN days_overdue <= 60 THEN 'mid' WHEN days_overdue <= 90 THEN 'late' ELSE 'legal' END AS workflow_stage,
              CASE WHEN days_overdue > 90 THEN 'critical' WHEN days_overdue > 60 THEN 'high'
                WHEN days_overdue > 30 THEN 'elevated' ELSE 'normal' END AS band FROM collections"""),
        "stage_actions": over(col, f"""
            SELECT id, collection_stage, stage_name, step, action FROM collections
            JOIN (VALUES {actions}) a(stage, stage_name, step, action) ON stage = collection_stage"""),
        "payment_plans": over(col, """
            SELECT id, concat('LOAN', CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 3, '0') ELSE CAST(id AS VARCHAR) END)
                AS loan_number,
              CAST(last_contact_date + INTERVAL 7 DAY AS DATE)::VARCHAR AS next_action_date,
              outstanding_amount / 12.0e0 AS monthly_payment, 12 AS duration_months, 0.05e0 AS interest_rate,
              CAST(last_contact_date + INTERVAL 7 DAY AS DATE)::VARCHAR AS start_date FROM collections"""),
        "apply_email_updates": over(col, f"""
            , updates AS (
              SELECT CASE WHEN collection_stage = 'legal' THEN -id - 1 ELSE id END AS id, version,
                CASE WHEN version = 1 OR collection_stage <> 'early'
                  THEN concat('Version ', version, ' for stage ', collection_stage) END AS email_content
              FROM collections, (VALUES (1), (2)) v(version)),
            last AS (
              SELECT id, email_content FROM (
                SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn
                FROM updates WHERE email_content IS NOT NULL) WHERE rn = 1)
            SELECT c.id, c.days_overdue,
              coalesce(email_content, CASE WHEN days_overdue > 60 THEN concat('Saved e-mail for ', c.id) END) AS ai_generated_email,
              CASE WHEN email_content IS NULL THEN '2001-01-01' ELSE '{AS_OF}' END AS updated_at
            FROM collections c LEFT JOIN last u ON u.id = c.id""").replace("\n, updates", ", updates"),
        "collection_email_prompts": over(both, f"""
            SELECT f.id, concat_ws(chr(10), 'You write for the collections desk of a European lender.',
                CASE collection_stage {stage_prompt} ELSE {text(dims.DEFAULT_STAGE_PROMPT)} END,
                'Be respectful, keep to EU debt collection rules, give next steps and a contact.',
                'Tone: ' || CASE WHEN days_overdue <= 30 THEN 'friendly' WHEN days_overdue <= 60 THEN 'professional'
                  WHEN days_overdue <= 90 THEN 'firm' ELSE 'urgent' END,
                CASE WHEN collection_stage <> 'legal' THEN 'Offer a payment plan.' END,
                'Customer: {{"name":"' || {NAME} || '","email":"' || c.email || '","loan_id":"' || loan_id || '"}}',
                'Outstanding: €' || CAST(CAST(outstanding_amount AS DECIMAL(18,2)) AS VARCHAR),
                'Days overdue: ' || CAST(days_overdue AS VARCHAR)) AS system_prompt,
              'Write the ' || collection_stage || ' stage e-mail' AS user_prompt,
              'gpt-4' AS model, 0.6e0 AS temperature, 600 AS max_tokens {join}"""),
    }


def _dashboard_queries() -> dict[str, str]:
    profile = []
    columns = {
        "customers": "id customer_type first_name last_name company_name email date_of_birth country registration_number",
        "kyc_kyb_data": "id customer_id verification_type verification_status risk_score created_at",
        "credit_scores": "id customer_id score score_date",
        "bank_statements": "customer_id statement_date balance monthly_income monthly_expenses transaction_count"
        " statement_data risk_indicators",
        "marketing_campaigns": "id campaign_name target_audience channel ai_generated_content start_date budget status"
        " created_at",
        "customer_service": "id customer_id interaction_type subject sentiment_score resolution_status priority created_at",
        "collections": "id customer_id loan_id outstanding_amount days_overdue collection_stage last_contact_date",
    }
    for table, names in columns.items():
        for c in names.split():
            profile.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS n_rows,"
                f" count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {table}"
            )
    return {
        "dashboard_kpis": over(
            ("customers", "kyc_kyb_data", "credit_scores", "collections", "marketing_campaigns"), """
            SELECT (SELECT count(*) FROM customers) AS total_customers,
              (SELECT count(*) FROM customers WHERE customer_type = 'individual') AS individual_customers,
              (SELECT count(*) FROM customers WHERE customer_type = 'business') AS business_customers,
              (SELECT count(*) FROM kyc_kyb_data WHERE verification_status = 'approved') AS approved_kyc,
              (SELECT avg(score) FROM credit_scores) AS avg_score,
              (SELECT CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) FROM collections) AS total_outstanding,
              (SELECT count(*) FROM marketing_campaigns WHERE status = 'active') AS active_campaigns"""),
        "customers_by_type": over(("customers",), "SELECT customer_type, count(*) AS n FROM customers GROUP BY 1"),
        "kyc_by_status": over(("kyc_kyb_data",), "SELECT verification_status, count(*) AS n FROM kyc_kyb_data GROUP BY 1"),
        "kyc_status_pivot": over(("kyc_kyb_data",), """
            SELECT count(*) FILTER (verification_status = 'pending') AS pending,
              count(*) FILTER (verification_status = 'approved') AS approved,
              count(*) FILTER (verification_status = 'rejected') AS rejected FROM kyc_kyb_data"""),
        "recent_verifications_5": _latest(
            "kyc_kyb_data", f"f.id, {NAME} AS customer, verification_status, CAST(f.created_at AS VARCHAR) AS created_at", 5),
        "recent_verifications_10": _latest(
            "kyc_kyb_data",
            f"f.id, {NAME} AS customer, verification_type, verification_status, risk_score,"
            " CAST(f.created_at AS VARCHAR) AS created_at", 10),
        "customer_directory": over(("customers",), f"""
            SELECT c.id, {NAME} AS customer, c.email, {NAME} || ' (' || c.email || ')' AS label FROM customers c"""),
        "table_row_counts": over(tuple(columns), " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in columns)),
        "column_profile": over(tuple(columns), " UNION ALL ".join(profile)),
        "sketched_profile": over(
            tuple(t for t in columns if t != "bank_statements"),
            "SELECT table_name, column_name, n_rows, n_null, true AS close FROM ("
            + " UNION ALL ".join(p for p in profile if not p.endswith("bank_statements")) + ")"),
        "adhoc_sql": over(("customers",), "SELECT id, customer_type, email, country FROM customers WHERE country = 'Germany'"),
    }


def _interaction_queries() -> dict[str, str]:
    service = ("customer_service",)
    category = (
        "CASE WHEN sentiment_score >= 0.5 THEN 'Positive' WHEN sentiment_score <= -0.5 THEN 'Negative'"
        " WHEN sentiment_score IS NOT NULL THEN 'Neutral' END"
    )
    alert = (
        "CASE WHEN sentiment_score > 0.5 THEN 'positive' WHEN sentiment_score < -0.5 THEN 'negative' ELSE 'neutral' END"
    )
    answers = ", ".join(
        f"({text(subject)}, {text(issue)}, {text(dims.CANNED_ANSWERS[issue])})"
        for subject, issue in dims.SUBJECT_ISSUE.items()
    )
    return {
        "service_kpis": over(service, """
            SELECT count(*) AS total_interactions,
              CAST(sum(CAST(sentiment_score AS DECIMAL(18,6))) AS DOUBLE) / count(sentiment_score) AS avg_sentiment,
              CAST(count(*) FILTER (resolution_status = 'resolved') AS BIGINT) AS resolved,
              count(DISTINCT customer_id) AS unique_customers,
              CASE WHEN count(*) > 0
                THEN CAST(count(*) FILTER (resolution_status = 'resolved') AS DOUBLE) / count(*) * 100.0e0
                ELSE 0.0e0 END AS resolution_rate FROM customer_service"""),
        "sentiment_distribution": over(service, f"""
            SELECT {category} AS sentiment_category, count(*) AS n FROM customer_service
            WHERE sentiment_score IS NOT NULL GROUP BY 1"""),
        "recent_interactions_5": _latest(
            "customer_service", f"f.id, {NAME} AS customer, subject, sentiment_score, {alert} AS alert", 5),
        "recent_interactions_10": _latest(
            "customer_service",
            f"f.id, {NAME} AS customer, subject, sentiment_score, {category} AS sentiment_category, resolution_status,"
            " CAST(f.created_at AS VARCHAR) AS created_at", 10),
        "sentiment_flags": over(service, f"""
            SELECT id, sentiment_score, {category} AS sentiment_category, {alert} AS alert,
              coalesce(sentiment_score < -0.5, false) AS escalate FROM customer_service"""),
        "escalations": over(service, """
            SELECT id, customer_id, subject, sentiment_score, priority FROM customer_service WHERE sentiment_score < -0.7"""),
        "canned_answers": over(service, f"""
            SELECT id, s.subject, issue, answer FROM customer_service s
            JOIN (VALUES {answers}) a(subject, issue, answer) ON a.subject = s.subject"""),
        "service_prompts": over(("customers", "kyc_kyb_data", "credit_scores", "bank_statements", "customer_service"), """
            SELECT f.id, concat('You answer customers of a European lender. Be polite and exact, respect GDPR,',
                ' and offer a human colleague when you cannot help.') AS system_prompt,
              concat(coalesce('Customer context: ' || CAST(context AS VARCHAR), ''), chr(10), chr(10), 'Customer message: ',
                subject) AS user_prompt,
              'gpt-4' AS model, 0.7e0 AS temperature, 500 AS max_tokens
            FROM customer_service f LEFT JOIN profiles p ON p.customer_id = f.customer_id""", LATEST_SCORE, LATEST_STATEMENT, """
            profiles AS (
              SELECT c.id AS customer_id, to_json({customer_id: c.id, customer_type: c.customer_type,
                first_name: c.first_name, last_name: c.last_name, company_name: c.company_name, email: c.email,
                date_of_birth: c.date_of_birth, country: c.country, registration_number: c.registration_number,
                kyc_count: n.kyc_count, kyc_approved: n.approved, kyc_pending: n.pending, kyc_rejected: n.rejected,
                latest_kyc: {id: k.id, verification_type: k.verification_type, verification_status: k.verification_status,
                  risk_score: k.risk_score, created_at: k.created_at},
                credit_score: CASE WHEN s.id IS NOT NULL THEN {id: s.id, score: s.score, score_date: s.score_date} END,
                bank_statement: CASE WHEN b.customer_id IS NOT NULL THEN {statement_date: b.statement_date,
                  balance: b.balance, monthly_income: b.monthly_income, monthly_expenses: b.monthly_expenses,
                  transaction_count: b.transaction_count, risk_indicators: b.risk_indicators} END}) AS context
              FROM customers c
              JOIN (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn
                FROM kyc_kyb_data) k ON k.customer_id = c.id AND k.rn = 1
              JOIN (SELECT customer_id, count(*) AS kyc_count, count(*) FILTER (verification_status = 'approved') AS approved,
                  count(*) FILTER (verification_status = 'pending') AS pending,
                  count(*) FILTER (verification_status = 'rejected') AS rejected
                FROM kyc_kyb_data GROUP BY customer_id) n ON n.customer_id = c.id
              LEFT JOIN latest_scores s ON s.customer_id = c.id
              LEFT JOIN latest_statements b ON b.customer_id = c.id)"""),
        "service_contexts": over(("customers", "kyc_kyb_data", "credit_scores", "bank_statements"), """
            SELECT c.id AS customer_id, k.piece, k.n AS n_records, CAST(to_json({
                customer: CASE WHEN k.piece = 1 THEN {id: c.id, customer_type: c.customer_type, first_name: c.first_name,
                  last_name: c.last_name, company_name: c.company_name, email: c.email, date_of_birth: c.date_of_birth,
                  country: c.country, registration_number: c.registration_number} END,
                kyc_data: k.records,
                credit_score: CASE WHEN k.piece = 1 AND s.id IS NOT NULL
                  THEN {id: s.id, score: s.score, score_date: s.score_date} END,
                bank_statement: CASE WHEN k.piece = 1 AND b.customer_id IS NOT NULL THEN {statement_date: b.statement_date,
                  balance: b.balance, monthly_income: b.monthly_income, monthly_expenses: b.monthly_expenses,
                  transaction_count: b.transaction_count, risk_indicators: b.risk_indicators} END}) AS VARCHAR) AS context
            FROM customers c
            JOIN (SELECT customer_id, (rn - 1) // 100 + 1 AS piece, count(*) AS n,
                list({id: id, verification_type: verification_type, verification_status: verification_status,
                  risk_score: risk_score, created_at: created_at} ORDER BY rn) AS records
              FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) AS rn FROM kyc_kyb_data)
              GROUP BY 1, 2) k ON k.customer_id = c.id
            LEFT JOIN latest_scores s ON s.customer_id = c.id
            LEFT JOIN latest_statements b ON b.customer_id = c.id""", LATEST_SCORE, LATEST_STATEMENT),
        "parsed_sentiment": over(service, """
            SELECT id,
              CASE WHEN priority IN ('low', 'urgent') OR (priority <> 'high' AND sentiment_score IS NULL) THEN 0.0e0
                WHEN priority = 'high' THEN 0.0e0 ELSE sentiment_score END AS score,
              CASE WHEN priority IN ('low', 'urgent') OR (priority <> 'high' AND sentiment_score IS NULL)
                THEN 'Error analyzing sentiment: reply is not a JSON object' ELSE subject END AS explanation
            FROM customer_service"""),
    }


def _conversation_queries() -> dict[str, str]:
    edge = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
    return {
        "conversation_context": """
            SELECT conv_id, turn, history_len, last_role FROM (
              SELECT *, row_number() OVER w - 1 AS history_len, lag(role) OVER w AS last_role FROM conversations
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
        "turn_numbering": """
            SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS question_no,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest_first
            FROM conversations WHERE role = 'user'""",
        "onboarding_history": """
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role, text AS content
            FROM conversations""",
        "onboarding_messages": """
            WITH placed AS (
              SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations)
            SELECT conv_id, turn, position, position + 1 AS n_messages,
              concat('You guide ', CASE WHEN conv_id % 3 = 0 THEN 'a business' ELSE 'an individual customer' END,
                ' through identity checks of a European lender. For people ask for name, birth date, address, document,',
                ' work and source of funds; for companies ask for registration, address, owners, activity and accounts.',
                ' Follow GDPR and AML rules, ask one question at a time and say why.') AS system_prompt,
              text AS user_message
            FROM placed WHERE role = 'user'""",
        "parsed_variations": f"""
            WITH replies AS (
              SELECT conv_id, turn, CASE WHEN turn % 4 = 1
                THEN concat('Here are the variations:', chr(10), ' ', chr(10), '1. ',
                  replace(text, chr(10), concat(chr(10), chr(9), '- ')), ' ', chr(10), '  and more')
                ELSE concat(text, chr(10), '2) ', text) END AS reply
              FROM conversations WHERE role = 'assistant'),
            lines AS (
              SELECT conv_id, turn, unnest(string_split(reply, chr(10))) AS raw_line,
                generate_subscripts(string_split(reply, chr(10)), 1) AS pos FROM replies),
            clean AS (
              SELECT conv_id, turn, pos, regexp_replace(raw_line, '^{edge}|{edge}$', '', 'g') AS line FROM lines),
            grouped AS (
              SELECT *, sum(CASE WHEN regexp_matches(line, '^[\\p{{Nd}}\\-]') THEN 1 ELSE 0 END)
                OVER (PARTITION BY conv_id, turn ORDER BY pos) AS item FROM clean WHERE line <> '')
            SELECT conv_id, turn, CAST(item AS INT) AS variation_no, string_agg(line, ' ' ORDER BY pos) AS variation
            FROM grouped WHERE item > 0 GROUP BY conv_id, turn, item""",
    }


# Order of the draws; every four share one digest of (seed, block, id).
PENALISED = """greatest(0.05e0, least(0.95e0, 0.8e0
    - CASE WHEN expense_to_income_ratio > 0.9e0 THEN 0.3e0 ELSE 0.0e0 END
    - CASE WHEN savings_rate < 0.1e0 THEN 0.2e0 ELSE 0.0e0 END
    - CASE WHEN overdrafts > 2 THEN 0.3e0 ELSE 0.0e0 END
    - CASE WHEN returned_payments > 1 THEN 0.4e0 ELSE 0.0e0 END
    - CASE WHEN gambling_transactions = 1 THEN 0.2e0 ELSE 0.0e0 END
    - CASE WHEN irregular_income = 1 THEN 0.15e0 ELSE 0.0e0 END
    - CASE WHEN existing_credit_score < 600 THEN 0.3e0 ELSE 0.0e0 END
    - CASE WHEN country_risk > 0.2e0 THEN 0.1e0 ELSE 0.0e0 END))"""

def _credit_queries() -> dict[str, str]:
    statements = ("bank_statements",)
    risk = (
        "overdrafts * 2 + returned_payments * 3 + CASE WHEN gambling_transactions THEN 5 ELSE 0 END"
        " + CASE WHEN irregular_income THEN 3 ELSE 0 END"
    )
    features = ", ".join(["customer_id", *FEATURE_NAMES])
    histogram = """
        SELECT CAST(least(floor(({score} - 300) / 27.5e0), 19) AS INT) AS bin,
          300 + least(floor(({score} - 300) / 27.5e0), 19) * 27.5e0 AS from_value,
          300 + (least(floor(({score} - 300) / 27.5e0), 19) + 1) * 27.5e0 AS to_value, count(*) AS n,
          '{source}' AS source FROM {table} GROUP BY 1, 2, 3"""
    impacts = """
        impacts AS (
          SELECT customer_id, feature, value, coefficient, coefficient * value AS impact_raw,
            coefficient * ((value - mean) / std) AS impact_scaled,
            CASE WHEN coefficient > 0 THEN 'Positive' ELSE 'Negative' END AS effect,
            CAST(row_number() OVER (PARTITION BY customer_id ORDER BY abs(coefficient * value) DESC, feature) AS INT)
              AS impact_rank
          FROM long_features JOIN card USING (feature))"""
    return {
        "score_history": over(("credit_scores", "customers"), f"""
            SELECT f.id, {NAME} AS customer, score, CAST(score_date AS VARCHAR) AS score_date
            FROM credit_scores f JOIN customers c ON f.customer_id = c.id ORDER BY f.score_date DESC, f.id DESC"""),
        "score_factors": over(("credit_scores",), """
            , said AS (
              SELECT id, (['excellent', 'good', 'fair'])[id % 3 + 1] AS payment_history, CAST(id % 31 + 10 AS INT) AS utilization,
                CAST(customer_id % 11 + 5 AS INT) AS years, (['diverse', 'limited', 'moderate'])[customer_id % 3 + 1] AS credit_mix
              FROM credit_scores)
            SELECT *, concat('{"payment_history":"', payment_history, '","credit_utilization":"', utilization,
              '%","length_of_credit":"', years, ' years","credit_mix":"', credit_mix, '"}') AS factors
            FROM said""").replace("\n, said", ", said"),
        "latest_score": over(("credit_scores",), """
            SELECT customer_id, id, score, CAST(score_date AS VARCHAR) AS score_date FROM latest_scores""", LATEST_SCORE),
        "latest_statement": over(statements, """
            SELECT customer_id, CAST(statement_date AS VARCHAR) AS statement_date, balance, monthly_income,
              monthly_expenses, transaction_count FROM latest_statements""", LATEST_STATEMENT),
        "score_risk_levels": over(("credit_scores",), """
            SELECT customer_id, score,
              CASE WHEN score >= 740 THEN 'Low Risk' WHEN score >= 670 THEN 'Medium-Low Risk' WHEN score >= 580
                THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level,
              CASE WHEN score BETWEEN 300 AND 579 THEN 'Poor' WHEN score BETWEEN 580 AND 669 THEN 'Fair'
                WHEN score BETWEEN 670 AND 739 THEN 'Good' ELSE 'Excellent' END AS rating,
              score - 650 AS delta FROM latest_scores""", LATEST_SCORE),
        "customer_360": over((*FEATURE_VIEWS, "kyc_kyb_data"), f"""
            SELECT c.id AS customer_id, {NAME} AS customer, c.customer_type, c.country,
              (SELECT count(*) FROM kyc_kyb_data k WHERE k.customer_id = c.id) AS kyc_count,
              (SELECT count(*) FROM kyc_kyb_data k WHERE k.customer_id = c.id AND verification_status = 'approved') AS kyc_approved,
              (SELECT max_by(verification_status, (k.created_at, k.id)) FROM kyc_kyb_data k WHERE k.customer_id = c.id)
                AS verification_status,
              CAST(s.score AS DOUBLE) AS score, CAST(s.score_date AS VARCHAR) AS score_date,
              CAST(b.statement_date AS VARCHAR) AS statement_date, b.monthly_income, b.monthly_expenses
            FROM customers c LEFT JOIN latest_scores s ON s.customer_id = c.id
            LEFT JOIN latest_statements b ON b.customer_id = c.id""", LATEST_SCORE, LATEST_STATEMENT),
        "customer_360_verifications": over((*FEATURE_VIEWS, "kyc_kyb_data"), """
            SELECT c.id AS customer_id, c.customer_type, k.id AS kyc_id, k.verification_type, k.verification_status,
              k.risk_score, CAST(k.created_at AS VARCHAR) AS kyc_created_at, s.score,
              CAST(s.score_date AS VARCHAR) AS score_date, CAST(b.statement_date AS VARCHAR) AS statement_date, b.monthly_income
            FROM customers c LEFT JOIN kyc_kyb_data k ON k.customer_id = c.id
            LEFT JOIN latest_scores s ON s.customer_id = c.id
            LEFT JOIN latest_statements b ON b.customer_id = c.id""", LATEST_SCORE, LATEST_STATEMENT),
        "country_risk": over(("customers",), """
            SELECT c.id, c.country, coalesce(r.risk, 0.2e0) AS country_risk FROM customers c
            LEFT JOIN (VALUES ('Germany', 0.1e0), ('France', 0.15e0), ('Italy', 0.2e0), ('Spain', 0.25e0),
              ('Poland', 0.3e0), ('Netherlands', 0.05e0)) r(country, risk) ON r.country = c.country"""),
        "statement_trends": over(statements, """
            , cents AS (
              SELECT *, CAST(monthly_income AS DECIMAL(18,4)) AS i, CAST(monthly_expenses AS DECIMAL(18,4)) AS e,
                CAST(round(monthly_income * 10000) AS HUGEINT) AS t
              FROM bank_statements)
            SELECT customer_id, CAST(statement_date AS VARCHAR) AS statement_date, CAST(i - e AS DOUBLE) AS net_flow,
              CAST((i - e) - lag(i - e) OVER (PARTITION BY customer_id ORDER BY statement_date) AS DOUBLE) AS net_change,
              count(*) OVER w AS months, CAST(sum(i) OVER w AS DOUBLE) / count(*) OVER w AS income_mean,
              round(sqrt(CAST(CAST(sum(t * t) OVER w AS HUGEINT) * count(*) OVER w
                - CAST(sum(t) OVER w AS HUGEINT) * CAST(sum(t) OVER w AS HUGEINT) AS DOUBLE)) / count(*) OVER w / 10000, 4)
                AS income_sd,
              round(CAST(sum(CAST(CASE WHEN monthly_income > 0 THEN monthly_expenses / monthly_income ELSE 1.0e0 END
                AS DECIMAL(20,12))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS expense_ratio_mean
            FROM cents WINDOW w AS (PARTITION BY customer_id)""").replace("\n, cents", ", cents"),
        "statement_risk": over(statements, f"""
            , flags AS (
              SELECT customer_id, CAST(statement_date AS VARCHAR) AS statement_date,
                CAST(json_extract_string(risk_indicators, '$.overdrafts') AS INT) AS overdrafts,
                CAST(json_extract_string(risk_indicators, '$.returned_payments') AS INT) AS returned_payments,
                CAST(json_extract_string(risk_indicators, '$.gambling_transactions') AS BOOLEAN) AS gambling_transactions,
                CAST(json_extract_string(risk_indicators, '$.irregular_income') AS BOOLEAN) AS irregular_income
              FROM bank_statements)
            SELECT *, {risk} AS risk,
              CASE WHEN {risk} <= 5 THEN 'low' WHEN {risk} <= 10 THEN 'medium' ELSE 'high' END AS risk_class
            FROM flags""").replace("\n, flags", ", flags"),
        "statement_transactions": over(statements, """
            SELECT customer_id, CAST(statement_date AS VARCHAR) AS statement_date, line_no,
              json_extract_string(statement_data, '$.transactions[' || (line_no - 1) || '].date') AS booked_on,
              json_extract_string(statement_data, '$.transactions[' || (line_no - 1) || '].description') AS description,
              CAST(json_extract_string(statement_data, '$.transactions[' || (line_no - 1) || '].amount') AS DOUBLE) AS amount
            FROM bank_statements, (VALUES (1), (2)) n(line_no)"""),
        "income_allocation": over(statements, """
            , net AS (
              SELECT customer_id, monthly_income, monthly_expenses,
                CAST(CAST(monthly_income AS DECIMAL(18,4)) - CAST(monthly_expenses AS DECIMAL(18,4)) AS DOUBLE) AS saved,
                CASE WHEN monthly_income > 0 THEN monthly_expenses / monthly_income END AS expense_ratio
              FROM latest_statements)
            SELECT customer_id, expense_ratio, 'Income' AS category, monthly_income AS amount, false AS allocated FROM net
            UNION ALL SELECT customer_id, expense_ratio, 'Expenses', monthly_expenses, monthly_income > 0 AND saved > 0 FROM net
            UNION ALL SELECT customer_id, expense_ratio, 'Net Savings', saved, monthly_income > 0 AND saved > 0 FROM net""",
            LATEST_STATEMENT).replace("\n, net", ", net"),
        "credit_features": over(FEATURE_VIEWS, f"SELECT {features} FROM features", *FEATURE_PARTS),
        "credit_features_fallback": over(
            FEATURE_VIEWS, f"SELECT {features} FROM features", LATEST_SCORE, LATEST_STATEMENT, _features(True)),
        "scorecard_scores": over(FEATURE_VIEWS, """
            SELECT customer_id, customer, email, round(probability, 6) AS probability, credit_score, risk_level
            FROM scored JOIN features USING (customer_id)""", *SCORE_PARTS),
        "feature_contributions": over(FEATURE_VIEWS, f"""
            SELECT customer_id, impact_rank, {title('feature')} AS feature, value, coefficient,
              impact_raw, impact_scaled, effect FROM impacts""",
            *FEATURE_PARTS, CARD_TABLE, LONG_FEATURES, impacts),
        "top_feature_impacts": over(FEATURE_VIEWS, f"""
            SELECT customer_id, impact_rank, {title('feature')} AS feature, round_even(value * 1000.0e0, 0) / 1000.0e0 AS value,
              round_even(impact_raw * 1000.0e0, 0) / 1000.0e0 AS impact, effect FROM impacts WHERE impact_rank <= 8""",
            *FEATURE_PARTS, CARD_TABLE, LONG_FEATURES, impacts),
        "model_feature_insights": over(FEATURE_VIEWS, f"""
            SELECT {title('f.feature')} AS feature, any_value(coefficient) AS coefficient,
              abs(any_value(coefficient)) AS importance,
              CASE WHEN any_value(coefficient) > 0 THEN 'Positive' ELSE 'Negative' END AS effect,
              round(sum(millionths)::DOUBLE / count(*) / 1e6, 4) AS mean,
              round(sqrt(greatest(sum(millionths * millionths)::DOUBLE / count(*)
                - sum(millionths)::DOUBLE / count(*) * (sum(millionths)::DOUBLE / count(*)), 0.0e0)) / 1e6, 4) AS std
            FROM (SELECT feature, round(value * 1e6)::HUGEINT AS millionths FROM long_features) f
            JOIN card k ON k.feature = f.feature GROUP BY f.feature
            ORDER BY importance DESC, f.feature LIMIT 10""", *FEATURE_PARTS, CARD_TABLE, LONG_FEATURES),
        "score_summary": over(FEATURE_VIEWS, """
            SELECT avg(credit_score) AS avg_score, count(*) FILTER (risk_level = 'High Risk') AS high_risk,
              count(*) FILTER (risk_level = 'Low Risk') AS low_risk, count(*) AS total_scored FROM scored""", *SCORE_PARTS),
        "risk_level_distribution": over(
            FEATURE_VIEWS, "SELECT risk_level, count(*) AS n FROM scored GROUP BY 1", *SCORE_PARTS),
        "score_histogram": over(
            FEATURE_VIEWS,
            histogram.format(score="credit_score", source="batch", table="scored")
            + " UNION ALL "
            + histogram.format(score="score", source="bureau", table="credit_scores"),
            *SCORE_PARTS),
        "training_data": over(FEATURE_VIEWS, f"""
            SELECT customer_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_NAMES)},
              CASE WHEN k.score >= 670 THEN 1 ELSE 0 END AS is_good_credit
            FROM features JOIN latest_scores k USING (customer_id)""", *FEATURE_PARTS),
        "label_probability": over(FEATURE_VIEWS, f"""
            SELECT customer_id, round({PENALISED}, 6) AS good_credit_probability FROM features""", *FEATURE_PARTS),
        "classification_report": over(FEATURE_VIEWS, """
            , rated AS (
              SELECT CASE WHEN k.score >= 670 THEN 1 ELSE 0 END AS y, CASE WHEN credit_score >= 670 THEN 1 ELSE 0 END AS g
              FROM scored JOIN latest_scores k USING (customer_id)),
            cells AS (
              SELECT k.label, count(*) FILTER (y = k.label AND g = k.label) AS hits,
                count(*) FILTER (g = k.label) AS predicted, count(*) FILTER (y = k.label) AS support
              FROM rated, (VALUES (0), (1)) k(label) GROUP BY k.label),
            rates AS (
              SELECT label, support, CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0 END AS precision,
                CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0 END AS recall FROM cells)
            SELECT label, precision, recall,
              CASE WHEN precision + recall > 0 THEN precision * recall * 2.0e0 / (precision + recall) ELSE 0 END AS f1,
              CAST(support AS BIGINT) AS support FROM rates""", *SCORE_PARTS).replace("\n, rated", ", rated"),
        "model_auc": over(FEATURE_VIEWS, """
            , rated AS (
              SELECT k.score >= 670 AS y, credit_score FROM scored JOIN latest_scores k USING (customer_id)),
            ranked AS (
              SELECT y, (rank() OVER (ORDER BY credit_score) + rank() OVER (ORDER BY credit_score)
                + count(*) OVER (PARTITION BY credit_score) - 1) AS twice FROM rated)
            SELECT count(*) FILTER (y) AS n_good, count(*) FILTER (NOT y) AS n_bad,
              round((CAST(sum(twice) FILTER (y) AS DOUBLE) / 2 - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2)
                / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auc
            FROM ranked""", *SCORE_PARTS).replace("\n, rated", ", rated"),
        "probability_auc": over(FEATURE_VIEWS, """
            , rated AS (
              SELECT k.score >= 670 AS y, probability FROM scored JOIN latest_scores k USING (customer_id)),
            ranked AS (
              SELECT y, rank() OVER (ORDER BY probability) * 2 + count(*) OVER (PARTITION BY probability) - 1 AS twice
              FROM rated)
            SELECT count(*) FILTER (y) AS n_good, count(*) FILTER (NOT y) AS n_bad,
              round((CAST(sum(twice) FILTER (y) AS DOUBLE) / 2 - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2)
                / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auc
            FROM ranked""", *SCORE_PARTS).replace("\n, rated", ", rated"),
        "split_counts": over(FEATURE_VIEWS, """
            SELECT CASE WHEN score >= 670 THEN 1 ELSE 0 END AS is_good_credit, count(*) AS n_rows,
              count(*) * 4 // 5 AS n_train, count(*) - count(*) * 4 // 5 AS n_test
            FROM latest_scores GROUP BY 1""", LATEST_SCORE),
        "fit_gradient": over(FEATURE_VIEWS, f"""
            SELECT feature, (SELECT count(*) FROM latest_scores) AS n_rows, 0.0e0 AS gradient
            FROM (VALUES ('intercept'), {', '.join(f"({text(f)})" for f in FEATURE_NAMES)}) f(feature)""", LATEST_SCORE),
    }


def _templates() -> str:
    rows, options = [], []
    for category, name, _, index, label, template, variables in dims.template_rows():
        rows.append(f"({text(category)}, {text(name)}, {index}, {text(label)}, {text(template)}, {len(variables)})")
        for variable, values in variables:
            for i, value in enumerate(values):
                options.append(f"({text(category)}, {index}, {text(variable)}, {i}, {text(value)})")
    return (
        f"templates(category, category_name, template_index, title, template, n_variables) AS (VALUES {', '.join(rows)}),"
        f" options(category, template_index, var, option_index, option) AS (VALUES {', '.join(options)})"
    )


REQUESTS = f"""
requests AS (
  SELECT id AS request_id, ([{', '.join(text(c) for c in [*dims.TEMPLATES, 'car_loans'])}])[1 + id % 6] AS category,
    CAST((id // 6) % 3 AS INT) AS template_index, status, target_audience, budget FROM marketing_campaigns)"""


def _campaign_queries() -> dict[str, str]:
    campaigns = ("marketing_campaigns",)
    listed = (
        "SELECT id, campaign_name, target_audience, channel, status, CAST(start_date AS VARCHAR) AS start_date, budget,"
        " CAST(created_at AS VARCHAR) AS created_at FROM marketing_campaigns"
    )

    def pick(values: list[str], step: int) -> str:
        return f"([{', '.join(map(text, values))}])[1 + (id // {step}) % {len(values)}]"

    def fill(template: str) -> str:
        filled = text(template)
        for name in ("loan", "audience", "goal"):
            filled = f"replace({filled}, '{{{name}}}', {name})"
        return filled

    suggested = [f"SELECT request_id, {i} AS position, {fill(t)} AS suggestion FROM asked"
                 for i, t in enumerate(dims.SUGGESTIONS, 1)]
    for word, items in dims.LOAN_SUGGESTIONS.items():
        suggested += [
            f"SELECT request_id, {i}, {fill(t)} FROM asked WHERE contains(lower(loan), '{word}')"
            for i, t in enumerate(items, len(dims.SUGGESTIONS) + 1)
        ]
    enhanced = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in dims.ENHANCEMENTS.items())
    return {
        "campaign_list": over(campaigns, listed),
        "campaigns_by_status": over(campaigns, """
            SELECT status, count(*) AS n FROM marketing_campaigns GROUP BY status
            UNION ALL SELECT 'total', count(*) FROM marketing_campaigns"""),
        "campaigns_by_channel": over(campaigns, "SELECT channel, count(*) AS n FROM marketing_campaigns GROUP BY 1"),
        "campaigns_filtered": over(campaigns, listed + """
            WHERE status IN ('active', 'draft') AND channel IN ('email', 'web')
              AND target_audience IN ('ECONOMY', 'SMALL', 'PROMO')"""),
        "filter_options": over(("marketing_campaigns", "collections"), """
            SELECT DISTINCT 'status' AS option_set, status AS value FROM marketing_campaigns
            UNION ALL SELECT DISTINCT 'channel', channel FROM marketing_campaigns
            UNION ALL SELECT DISTINCT 'target_audience', target_audience FROM marketing_campaigns
            UNION ALL SELECT DISTINCT 'collection_stage', collection_stage FROM collections"""),
        "campaign_content_lookup": over(campaigns, """
            SELECT id, campaign_name, ai_generated_content FROM marketing_campaigns
            WHERE status = 'active'"""),
        "campaign_drafts": over(campaigns, f"""
            SELECT concat(upper(target_audience[1:1]), lower(target_audience[2:]), ' - ', target_audience) AS campaign_name,
              target_audience, channel, 'AI Generated Content' AS content, ai_generated_content,
              '{AS_OF}' AS start_date, 'draft' AS status FROM marketing_campaigns"""),
        "rendered_prompts": over(campaigns, """
            , picks AS (
              SELECT r.request_id, o.var, any_value(CASE WHEN r.status = 'active' AND o.var = 'audience' THEN r.target_audience
                  WHEN r.status = 'active' AND o.var = 'tone' THEN '{audience}'
                  WHEN r.status = 'active' AND o.var = 'rate' THEN CAST(CAST(r.budget AS DECIMAL(18,2)) AS VARCHAR)
                  ELSE o.option END) AS value
              FROM requests r JOIN options o ON o.category = r.category AND o.template_index = r.template_index
              WHERE o.option_index = ('0x' || substr(md5(concat('42:', r.request_id, ':', o.var)), 1, 8))::BIGINT % 5
              GROUP BY r.request_id, o.var),
            tokens AS (
              SELECT r.request_id, unnest(regexp_extract_all(t.template, '[^{}]+|\\{\\w+\\}')) AS token,
                generate_subscripts(regexp_extract_all(t.template, '[^{}]+|\\{\\w+\\}'), 1) AS pos
              FROM requests r JOIN templates t ON t.category = r.category AND t.template_index = r.template_index),
            filled AS (
              SELECT k.request_id, string_agg(coalesce(p.value, k.token), '' ORDER BY pos) AS prompt
              FROM tokens k LEFT JOIN picks p ON p.request_id = k.request_id AND concat('{', p.var, '}') = k.token
              GROUP BY k.request_id)
            SELECT r.request_id, t.category_name, t.title, f.prompt,
              (SELECT string_agg(concat(p.var, '=', p.value), '; ' ORDER BY p.var) FROM picks p
                WHERE p.request_id = r.request_id) AS variables_used,
              CASE WHEN r.category NOT IN (SELECT category FROM templates) THEN 'Category not found'
                WHEN t.title IS NULL THEN 'Template not found' END AS error
            FROM requests r LEFT JOIN templates t ON t.category = r.category AND t.template_index = r.template_index
            LEFT JOIN filled f ON f.request_id = r.request_id""", REQUESTS, _templates()).replace("\n, picks", ", picks"),
        "template_options": over(campaigns, """
            SELECT o.category, o.template_index, o.var AS variable, o.option_index, o.option,
              (SELECT count(*) FROM requests r WHERE r.category = o.category AND r.template_index = o.template_index)
                AS n_requests FROM options o""", REQUESTS, _templates()),
        "template_combinations": over(campaigns, """
            SELECT category, template_index, title, n_variables, CAST(pow(5, n_variables) AS BIGINT) AS n_combinations,
              (SELECT count(*) FROM requests r WHERE r.category = t.category AND r.template_index = t.template_index)
                AS n_requests FROM templates t""", REQUESTS, _templates()),
        "missing_variables": over(campaigns, """
            SELECT id,
              CASE status WHEN 'draft' THEN 'channel,budget' WHEN 'paused' THEN 'channel' ELSE '' END AS missing,
              CASE WHEN status NOT IN ('draft', 'paused') THEN concat('Promote ', campaign_name, ' by ', channel, ' to ',
                lower(target_audience), ', {budget}: ', CAST(CAST(budget AS DECIMAL(18,2)) AS VARCHAR), '; again ', channel,
                ', code ', id) END AS prompt,
              CASE WHEN status IN ('draft', 'paused') THEN 'Missing variable: ''channel''' END AS error
            FROM marketing_campaigns"""),
        "prompt_suggestions": over(
            campaigns, " UNION ALL ".join(suggested), f"""
            asked AS (SELECT id AS request_id, {pick(dims.LOAN_TYPES, 1)} AS loan, {pick(dims.AUDIENCES, 5)} AS audience,
              {pick(dims.GOALS, 30)} AS goal FROM marketing_campaigns)"""),
        "marketing_prompts": over(("marketing_campaigns", "bank_statements"), f"""
            , asked AS (
              SELECT id, concat(upper(target_audience[1:1]), lower(target_audience[2:])) AS kind_of, lower(target_audience) AS people,
                channel, status, ai_generated_content AS prompt, {pick([*dims.ENHANCEMENTS, 'unheard-of'], 1)} AS enhancement
              FROM marketing_campaigns)
            SELECT id AS ref_id, 'marketing' AS kind, concat('You market a European lender. Write about ', kind_of, ' for ',
                people, ' on the ', channel, ' channel. Keep to EU advertising rules, state terms clearly and end with a',
                ' call to action.', chr(10), CASE WHEN status = 'draft' THEN 'Keep it short.' ELSE '' END) AS system_prompt,
              concat('Write marketing content for ', kind_of) AS user_prompt, 'gpt-4' AS model, 0.8e0 AS temperature,
              600 AS max_tokens FROM asked
            UNION ALL SELECT id, 'content', concat('You write ', CASE WHEN channel = 'email' THEN 'email campaign'
                ELSE 'marketing copy' END,
                ' for financial products: honest, persuasive, lawful in Europe, with any disclaimer needed.'),
              prompt, 'gpt-4', 0.7e0, 1000 FROM asked
            UNION ALL SELECT id, 'enhancement', concat('You improve marketing prompts. ',
                CASE enhancement {enhanced} ELSE {text(dims.ENHANCEMENTS['detailed'])} END, '. Return only the better prompt.'),
              prompt, 'gpt-4', 0.6e0, 500 FROM asked
            UNION ALL SELECT id, 'variation', concat('Write ', id % 3 + 1,
                ' variations of the prompt with the same aim and other angles, as a numbered list.'),
              concat('Base prompt: ', prompt), 'gpt-4', 0.8e0, 800 FROM asked
            UNION ALL SELECT customer_id, 'statement', concat('You analyse bank statements for lending. Judge income',
                ' stability, spending, risk signs and cash flow; give a risk score from 1 (lowest) to 10 and a recommendation.'),
              concat('Assess this statement: ', statement_data, chr(10), 'Indicators: ', risk_indicators),
              'gpt-4', 0.3e0, 800 FROM bank_statements""").replace("\n, asked", ", asked"),
    }


def _integrity_queries() -> dict[str, str]:
    def enum(table: str, view: str, column: str, allowed: str) -> str:
        return (
            f"SELECT '{table}' AS table_name, '{column}' AS column_name,"
            f" count(*) FILTER ({column} NOT IN ({allowed})) AS n_bad FROM {view}"
        )

    def null(table: str, view: str, column: str) -> str:
        return f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) - count({column}) AS n_null FROM {view}"

    children = ("kyc_kyb_data", "credit_scores", "bank_statements", "customer_service", "collections")
    return {
        "dq_enum_domain": over(
            ("customers_raw", "kyc_kyb_data_raw", "marketing_campaigns_raw", "customer_service_raw", "collections_raw"),
            " UNION ALL ".join([
                enum("customers", "customers_raw", "customer_type", "'individual', 'business'"),
                enum("kyc_kyb_data", "kyc_kyb_data_raw", "verification_type", "'kyc', 'kyb'"),
                enum("kyc_kyb_data", "kyc_kyb_data_raw", "verification_status", "'pending', 'approved', 'rejected'"),
                enum("marketing_campaigns", "marketing_campaigns_raw", "channel", "'email', 'sms', 'social_media', 'web'"),
                enum("marketing_campaigns", "marketing_campaigns_raw", "status", "'draft', 'active', 'paused', 'completed'"),
                enum("customer_service", "customer_service_raw", "interaction_type", "'chat', 'email', 'phone'"),
                enum("customer_service", "customer_service_raw", "resolution_status", "'open', 'in_progress', 'resolved', 'closed'"),
                enum("customer_service", "customer_service_raw", "priority", "'low', 'medium', 'high', 'urgent'"),
                enum("collections", "collections_raw", "collection_stage", "'early', 'mid', 'late', 'legal'"),
            ])),
        "dq_not_null": over(
            ("customers_raw", "kyc_kyb_data_raw", "marketing_campaigns_raw", "customer_service_raw"),
            " UNION ALL ".join([
                null("customers", "customers_raw", "customer_type"), null("customers", "customers_raw", "email"),
                null("kyc_kyb_data", "kyc_kyb_data_raw", "verification_type"),
                null("marketing_campaigns", "marketing_campaigns_raw", "campaign_name"),
                null("marketing_campaigns", "marketing_campaigns_raw", "channel"),
                null("customer_service", "customer_service_raw", "interaction_type"),
            ])),
        "dq_score_range": over(("credit_scores_raw",), """
            SELECT id, customer_id, score FROM credit_scores_raw WHERE score < 300 OR score > 850"""),
        "dq_unique_email": over(("customers_raw",), """
            SELECT email, count(*) AS n_rows FROM customers_raw WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1"""),
        "dq_fk_orphans": over((*[f"{t}_raw" for t in children if t != "bank_statements"], "customers"), " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(f.customer_id) FILTER (c.id IS NULL) AS n_orphans,"
            f" count(DISTINCT f.customer_id) FILTER (c.id IS NULL) AS n_orphan_keys"
            f" FROM {source} f LEFT JOIN customers c ON c.id = f.customer_id" for t, source in [
                *[(t, f"{t}_raw") for t in children if t != "bank_statements"],
                ("bank_statements", """(SELECT DISTINCT CASE WHEN o_custkey % 59 = 0 THEN -o_custkey ELSE o_custkey END
                  AS customer_id, date_trunc('month', o_orderdate) AS m FROM orders)"""),
            ])),
        "ingest_defaults": over(("kyc_kyb_data", "marketing_campaigns_raw", "customer_service", "collections"), """
            SELECT 'kyc_kyb_data' AS table_name, 'verification_status' AS column_name, 'pending' AS value,
              true AS stamped, count(*) AS n FROM kyc_kyb_data
            UNION ALL SELECT 'marketing_campaigns', 'status', status, true, count(*) FROM marketing_campaigns_raw GROUP BY status
            UNION ALL SELECT 'customer_service', 'resolution_status', 'open', false, count(*) FROM customer_service
            UNION ALL SELECT 'customer_service', 'priority', 'medium', false, count(*) FROM customer_service
            UNION ALL SELECT 'collections', 'collection_stage', 'early', true, count(*) FROM collections"""),
    }


def _question_queries() -> dict[str, str]:
    return {
        "q_total_customers": "SELECT count(*) AS n FROM customer",
        "q_avg_score": over(("credit_scores",), "SELECT avg(score) AS avg_score FROM credit_scores"),
        "q_customers_in_collections": over(("customers", "collections"), f"""
            SELECT c.id, {NAME} AS customer, c.email FROM customers c
            WHERE EXISTS (SELECT 1 FROM collections k WHERE k.customer_id = c.id AND outstanding_amount > 0)"""),
        "q_pending_kyc": over(("customers", "kyc_kyb_data"), f"""
            SELECT DISTINCT c.id, {NAME} AS customer, c.email FROM customers c
            JOIN kyc_kyb_data k ON k.customer_id = c.id WHERE verification_status = 'pending'"""),
        "q_total_outstanding": over(("collections",), """
            SELECT CAST(sum(CAST(outstanding_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_outstanding FROM collections"""),
        "q_customers_germany": over(("customers",), f"""
            SELECT c.id, {NAME} AS customer, c.email FROM customers c WHERE c.country = 'Germany'"""),
        "q_active_campaigns": over(("marketing_campaigns",), """
            SELECT id, campaign_name, channel, budget FROM marketing_campaigns WHERE status = 'active'"""),
        "q_common_issues": over(("customer_service",), "SELECT subject, count(*) AS n FROM customer_service GROUP BY 1"),
        "q_business_registrations": over(("customers",), """
            SELECT id, company_name, registration_number FROM customers WHERE customer_type = 'business'"""),
        "q_stage_distribution": over(("collections",), """
            SELECT collection_stage, count(*) AS n,
              CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM collections) AS share FROM collections GROUP BY 1"""),
        "q_scores_below_600": over(("credit_scores", "customers"), f"""
            SELECT s.customer_id, {NAME} AS customer, score, CAST(score_date AS VARCHAR) AS score_date
            FROM latest_scores s JOIN customers c ON c.id = s.customer_id WHERE score < 600""", LATEST_SCORE),
        "q_avg_days_by_stage": over(("collections",), """
            SELECT collection_stage, avg(days_overdue) AS avg_days_overdue FROM collections GROUP BY 1"""),
        "q_customers_by_country": over(("customers",), f"""
            SELECT c.country, c.id, {NAME} AS customer FROM customers c"""),
        "q_overdue_customers": over(("collections",), """
            SELECT count(DISTINCT customer_id) AS n FROM collections WHERE days_overdue > 0"""),
    }


def _stream_queries() -> dict[str, str]:
    service = ("customer_service",)
    category = (
        "CASE WHEN score >= 0.5 THEN 'Positive' WHEN score <= -0.5 THEN 'Negative' ELSE 'Neutral' END"
    )
    return {
        "streamed_interactions": over(service, """
            SELECT id, customer_id, 'chat' AS interaction_type, subject AS message,
              coalesce(sentiment_score, 0.0e0) AS sentiment_score, 'resolved' AS resolution_status, id % 3 AS batch
            FROM customer_service WHERE customer_id IS NOT NULL"""),
        "alert_windows": over(service, f"""
            , placed AS (
              SELECT id, created_at AS sent, coalesce(sentiment_score, 0.0e0) AS score, id % 50 = 7 AS late,
                epoch_us(created_at) AS us, min(epoch_us(created_at)) OVER () AS first_us,
                (max(epoch_us(created_at)) OVER () - min(epoch_us(created_at)) OVER ()) // 4 + 1 AS width
              FROM customer_service),
            marks AS (
              SELECT max(us) FILTER (NOT late AND (us - first_us) // width < 3) // 1000 - 600000 AS before_last,
                max(us) // 1000 - 600000 AS at_end
              FROM placed),
            counted AS (
              SELECT date_trunc('hour', sent) AS window_start, {category} AS sentiment_category, score < -0.5 AS escalated
              FROM placed, marks WHERE NOT late OR us > before_last * 1000)
            SELECT CAST(window_start AS VARCHAR) AS window_start, sentiment_category, count(*) AS n,
              CAST(count(*) FILTER (escalated) AS BIGINT) AS n_escalated
            FROM counted, marks WHERE epoch_ms(window_start) + 3600000 <= at_end GROUP BY 1, 2""").replace(
                "\n, placed", ", placed"),
        "append_ids": over(service, """
            , loads AS (
              SELECT 'load 1' AS load, resolution_status = 'resolved' AS resolved FROM customer_service WHERE id % 2 = 0
              UNION ALL SELECT 'load 2', true FROM customer_service WHERE id % 2 <> 0 AND customer_id IS NOT NULL),
            sizes AS (SELECT load, count(*) AS n, count(*) FILTER (resolved) AS n_resolved FROM loads GROUP BY load),
            ends AS (SELECT *, CAST(sum(n) OVER (ORDER BY load) AS BIGINT) AS last_id FROM sizes)
            SELECT load, n AS n_rows, n AS n_ids, last_id - n + 1 AS first_id, last_id, n_resolved FROM ends""").replace(
                "\n, loads", ", loads"),
        "append_unique": over(("customers",), """
            SELECT repeated, true AS refused, count(*) AS n_rows, count(DISTINCT email) AS n_emails
            FROM customers, (VALUES ('e-mail'), ('id')) r(repeated) GROUP BY repeated"""),
    }


def oracle_queries() -> dict[str, str]:
    """SQL per query name. The query that trains a model has none."""
    return {
        **_account_queries(),
        **_dashboard_queries(),
        **_interaction_queries(),
        **_conversation_queries(),
        **_credit_queries(),
        **_campaign_queries(),
        **_integrity_queries(),
        **_question_queries(),
        **_stream_queries(),
    }
