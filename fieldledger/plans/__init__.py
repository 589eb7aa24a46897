"""Plan fragments that several operators share."""

from fieldledger.plans.components import components
from fieldledger.plans.fragments import (
    farmer_person,
    kyc_copies,
    kyc_rows,
    latest_loan,
    loans_per_farmer,
    lookup,
    needed,
    of_farmers,
    replicate,
    the_one,
    with_loan,
    without_loan,
)
from fieldledger.plans.ordering import numbered, present, ranked

__all__ = [
    "components",
    "farmer_person",
    "kyc_copies",
    "kyc_rows",
    "latest_loan",
    "loans_per_farmer",
    "lookup",
    "needed",
    "numbered",
    "of_farmers",
    "present",
    "ranked",
    "replicate",
    "the_one",
    "with_loan",
    "without_loan",
]
