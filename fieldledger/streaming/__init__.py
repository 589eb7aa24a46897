"""Decisions and logins as streams: running folds, tables read through them, and a table that decisions reach."""

from fieldledger.streaming.folds import (
    compact_folds,
    current_kyc,
    current_person,
    latest_folds,
    live_folders,
    start_decision_folds,
    start_login_folds,
)
from fieldledger.streaming.kyc_store import apply_to_store, create_kyc_store, start_kyc_store, stored_kyc

__all__ = [
    "apply_to_store",
    "compact_folds",
    "create_kyc_store",
    "current_kyc",
    "current_person",
    "latest_folds",
    "live_folders",
    "start_decision_folds",
    "start_kyc_store",
    "start_login_folds",
    "stored_kyc",
]
