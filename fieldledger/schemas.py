"""Table schemas as DDL text.

Dates carry a time of day but no zone, hence TIMESTAMP_NTZ. Money is exact.
"""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "person": (
        "person_id BIGINT, first_name STRING, last_name STRING, login_phone STRING, username STRING, "
        "role STRING, last_login TIMESTAMP_NTZ, nid STRING, gender STRING, village STRING, "
        "upazila STRING, district STRING"
    ),
    "phone": "person_id BIGINT, phone_number STRING, phone_type STRING, is_primary STRING",
    "field_agent": (
        "agent_code STRING, person_id BIGINT, center_code STRING, is_active STRING, join_date TIMESTAMP_NTZ"
    ),
    "center": "center_code STRING, center_name STRING",
    "farmer": (
        "farmer_code STRING, person_id BIGINT, agent_code STRING, center_code STRING, "
        "registration_date TIMESTAMP_NTZ, account_status STRING"
    ),
    "kyc": (
        "kyc_id BIGINT, farmer_code STRING, agent_code STRING, identity_verified STRING, "
        "verified_by STRING, verified_date TIMESTAMP_NTZ, remarks STRING, nid_front_ref STRING, "
        "nid_back_ref STRING, land_dolil_ref STRING, land_legal_status STRING"
    ),
    "loan": (
        "loan_no BIGINT, farmer_code STRING, amount DECIMAL(18,2), interest_rate DOUBLE, "
        "tenure_months INT, purpose STRING, loan_state STRING, application_date TIMESTAMP_NTZ, "
        "approval_date TIMESTAMP_NTZ, disbursement_date TIMESTAMP_NTZ"
    ),
    "repayment": (
        "loan_no BIGINT, installment_no INT, amount_paid DECIMAL(18,2), payment_date TIMESTAMP_NTZ, "
        "payment_method STRING, payment_state STRING, late_fee DECIMAL(18,2)"
    ),
    "purchase": (
        "purchase_id BIGINT, farmer_code STRING, agent_code STRING, purchase_date TIMESTAMP_NTZ, "
        "payment_method STRING, payment_status STRING, transaction_reference STRING"
    ),
    "ordered_item": "purchase_id BIGINT, item_id BIGINT, total_cost DECIMAL(18,2)",
    "inventory": (
        "item_id BIGINT, center_code STRING, name STRING, quantity INT, unit_price DECIMAL(12,2)"
    ),
    "community_post": "post_id BIGINT, content STRING, post_date TIMESTAMP_NTZ",
    "kyc_decision": (
        "decision_id BIGINT, farmer_code STRING, person_id BIGINT, decision STRING, "
        "decided_at TIMESTAMP_NTZ, remarks STRING, nid_front_ref STRING, nid_back_ref STRING, "
        "land_dolil_ref STRING, land_legal_status STRING"
    ),
    "login_event": "attempt_id BIGINT, identifier STRING, login_at TIMESTAMP_NTZ",
    "registration_application": (
        "application_id BIGINT, submitted_at TIMESTAMP_NTZ, role STRING, first_name STRING, "
        "last_name STRING, phone STRING, username STRING, password STRING, confirm_password STRING"
    ),
}
