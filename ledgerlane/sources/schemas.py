"""Declared shape of the seven lending tables: types, domains, defaults, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column types, in declaration order.
DDL = {
    "customers": (
        "id bigint, customer_type string, first_name string, last_name string, company_name string, email string,"
        " phone string, date_of_birth date, nationality string, address string, city string, postal_code string,"
        " country string, registration_number string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "kyc_kyb_data": (
        "id bigint, customer_id bigint, verification_type string, document_type string, document_number string,"
        " verification_status string, risk_score double, verification_notes string, verified_at timestamp_ntz,"
        " created_at timestamp_ntz"
    ),
    "credit_scores": (
        "id bigint, customer_id bigint, score int, score_date date, bureau_name string, factors string,"
        " created_at timestamp_ntz"
    ),
    "bank_statements": (
        "id bigint, customer_id bigint, statement_date date, bank_name string, account_type string, balance double,"
        " monthly_income double, monthly_expenses double, transaction_count int, statement_data string,"
        " risk_indicators string, created_at timestamp_ntz"
    ),
    "marketing_campaigns": (
        "id bigint, campaign_name string, target_audience string, channel string, content string,"
        " ai_generated_content string, start_date date, end_date date, budget double, status string,"
        " created_at timestamp_ntz"
    ),
    "customer_service": (
        "id bigint, customer_id bigint, interaction_type string, subject string, message string, ai_response string,"
        " sentiment_score double, resolution_status string, priority string, created_at timestamp_ntz,"
        " resolved_at timestamp_ntz"
    ),
    "collections": (
        "id bigint, customer_id bigint, loan_id string, outstanding_amount double, days_overdue int,"
        " collection_stage string, last_contact_date date, next_action_date date, collection_notes string,"
        " ai_generated_email string, payment_plan string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
}

# Allowed values per constrained column.
DOMAINS = {
    "customers": {"customer_type": ["individual", "business"]},
    "kyc_kyb_data": {
        "verification_type": ["kyc", "kyb"],
        "verification_status": ["pending", "approved", "rejected"],
    },
    "marketing_campaigns": {
        "channel": ["email", "sms", "social_media", "web"],
        "status": ["draft", "active", "paused", "completed"],
    },
    "customer_service": {
        "interaction_type": ["chat", "email", "phone"],
        "resolution_status": ["open", "in_progress", "resolved", "closed"],
        "priority": ["low", "medium", "high", "urgent"],
    },
    "collections": {"collection_stage": ["early", "mid", "late", "legal"]},
}

REQUIRED = {
    "customers": ["customer_type", "email"],
    "kyc_kyb_data": ["verification_type"],
    "marketing_campaigns": ["campaign_name", "channel"],
    "customer_service": ["interaction_type"],
}

# Columns whose values may come once only, besides the id.
UNIQUE = {"customers": ["email"]}

# Defaults for columns that the input leaves out.
DEFAULTS = {
    "kyc_kyb_data": {"verification_status": "pending"},
    "marketing_campaigns": {"status": "draft"},
    "customer_service": {"resolution_status": "open", "priority": "medium"},
    "collections": {"collection_stage": "early"},
}

SCORE_RANGE = (300, 850)

CHILD_TABLES = ("kyc_kyb_data", "credit_scores", "bank_statements", "customer_service", "collections")

# Shapes of the JSON text columns.
FACTORS = "payment_history string, credit_utilization string, length_of_credit string, credit_mix string"
RISK_INDICATORS = (
    "overdrafts int, returned_payments int, gambling_transactions boolean, irregular_income boolean"
)
STATEMENT_DATA = "transactions array<struct<date: string, description: string, amount: double>>"
PAYMENT_PLAN = "monthly_payment double, duration_months int, interest_rate double, start_date string"
SENTIMENT_REPLY = "score double, explanation string"


def table_schema(table: str) -> T.StructType:
    """The declared columns; ``id`` and the NOT NULL columns are not nullable."""
    required = {"id", *REQUIRED.get(table, [])}
    return T.StructType(
        [T.StructField(f.name, f.dataType, f.name not in required) for f in T.StructType.fromDDL(DDL[table])]
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the declared types and order; columns the input lacks become NULL."""
    return df.select(
        [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(table)
        ]
    )
