"""The operators, by the object they are about."""

from fieldledger.operators.accounts import (
    apply_last_login,
    last_logins,
    register,
    registration_outcome,
    resolve_login_identity,
    validate_registrations,
)
from fieldledger.operators.agents import (
    agent_dashboard,
    agent_lookup,
    agent_page,
    agent_ranking,
    dashboard_defaults,
    ranking_position,
)
from fieldledger.operators.farmers import (
    community_posts,
    farmer_detail,
    farmer_loans,
    farmer_page,
    farmer_purchases,
    farmer_repayments,
    my_farmers,
    my_farmers_count,
    my_farmers_page,
    status_labels,
)
from fieldledger.operators.kyc import apply_kyc_decisions, fold_decisions, unmatched_decisions
from fieldledger.operators.queues import (
    inventory_page,
    inventory_status,
    outreach,
    pending_kyc,
    pending_kyc_count,
    pending_kyc_page,
    pending_loans,
    pending_purchases,
)

__all__ = [
    "agent_dashboard",
    "agent_lookup",
    "agent_page",
    "agent_ranking",
    "apply_kyc_decisions",
    "apply_last_login",
    "community_posts",
    "dashboard_defaults",
    "farmer_detail",
    "farmer_loans",
    "farmer_page",
    "farmer_purchases",
    "farmer_repayments",
    "fold_decisions",
    "inventory_page",
    "inventory_status",
    "last_logins",
    "my_farmers",
    "my_farmers_count",
    "my_farmers_page",
    "outreach",
    "pending_kyc",
    "pending_kyc_count",
    "pending_kyc_page",
    "pending_loans",
    "pending_purchases",
    "ranking_position",
    "register",
    "registration_outcome",
    "resolve_login_identity",
    "status_labels",
    "unmatched_decisions",
    "validate_registrations",
]
