"""Display labels for status codes, in English and Bengali."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain -> code -> (English label, Bengali label).
LABELS: dict[str, dict[str, tuple[str, str]]] = {
    "kyc_status": {
        "VERIFIED": ("Verified", "যাচাইকৃত"),
        "PENDING": ("Pending", "অপেক্ষমাণ"),
    },
    "loan_status": {
        "Paid": ("Paid", "পরিশোধিত"),
        "Active Loan": ("Active", "সক্রিয়"),
        "Loan Pending": ("Pending", "অপেক্ষমাণ"),
        "No Loan": ("No Loan", "কোনো ঋণ নেই"),
    },
    "dashboard_loan_status": {
        "Paid": ("Paid", "পরিশোধিত"),
        "Active Loan": ("Active", "চলমান"),
        "Loan Pending": ("Pending", "অপেক্ষমাণ"),
        "No Loan": ("No Loan", "কোনো ঋণ নেই"),
    },
    "pending_order": {
        "Yes": ("Yes", "হ্যাঁ"),
        "No": ("No", "না"),
    },
    "loan_state": {
        "CLOSED": ("Closed", "সমাপ্ত"),
        "ACTIVE": ("Active", "সক্রিয়"),
        "PENDING": ("Pending", "অপেক্ষমাণ"),
    },
    "payment_state": {
        "PAID": ("Paid", "পরিশোধিত"),
        "OVERDUE": ("Overdue", "মেয়াদোত্তীর্ণ"),
    },
    "payment_status": {
        "CONFIRMED": ("Confirmed", "নিশ্চিত"),
        "DELIVERED": ("Delivered", "ডেলিভারি সম্পন্ন"),
        "PENDING": ("Pending", "অপেক্ষমাণ"),
    },
    "stock_status": {
        "Out of Stock": ("Out of Stock", "স্টক শেষ"),
        "Low Stock": ("Low Stock", "স্বল্প মজুত"),
        "In Stock": ("In Stock", "মজুত আছে"),
    },
    "role": {
        "FARMER": ("Farmer", "কৃষক"),
        "AGENT": ("Agent", "এজেন্ট"),
        "ADMIN": ("Admin", "প্রশাসক"),
        "ADVISOR": ("Advisor", "উপদেষ্টা"),
    },
}

LANGUAGES = ("en", "bn")

# How the state of the latest loan is named in an agent's list; others keep their name.
LOAN_STATUS = {"CLOSED": "Paid", "ACTIVE": "Active Loan", "PENDING": "Loan Pending"}
NO_LOAN = "No Loan"

# Fixed value: a smaller quantity is low stock.
LOW_STOCK = 10


def _fallback(domain: str, language: str, code: Column) -> Column:
    """What a code outside the list shows as."""
    if domain == "kyc_status":
        return F.lit("-")
    if domain in ("loan_status", "dashboard_loan_status"):
        return F.coalesce(F.nullif(code, F.lit("")), F.lit("N/A"))
    if domain == "pending_order":
        return F.lit(LABELS[domain]["No"][LANGUAGES.index(language)])
    if domain == "stock_status":
        return F.lit(LABELS[domain]["In Stock"][LANGUAGES.index(language)])
    if domain == "role" and language == "en":
        return F.concat(F.upper(F.left(code, F.lit(1))), F.lower(F.substring(code, 2, 2**31 - 1)))
    return code


def loan_status(loan_no: Column, state: Column) -> Column:
    """The name of a farmer's latest loan; ``loan_no`` is NULL where there is none."""
    chain = F.when(loan_no.isNull(), NO_LOAN)
    for code, name in LOAN_STATUS.items():
        chain = chain.when(state == code, name)
    return chain.otherwise(state)


def stock_status(quantity: Column) -> Column:
    """Out at zero, low below ten; anything else, also an unknown quantity, is in stock."""
    low = F.when(quantity < LOW_STOCK, "Low Stock").otherwise("In Stock")
    return F.when(quantity == 0, "Out of Stock").otherwise(low)


def label(domain: str, code: Column, language: str = "bn") -> Column:
    """The label of ``code``; a CASE over the fixed list, so no join is needed."""
    place = LANGUAGES.index(language)
    pairs = iter(LABELS[domain].items())
    first_code, first_labels = next(pairs)
    chain = F.when(code == first_code, F.lit(first_labels[place]))
    for known, labels in pairs:
        chain = chain.when(code == known, F.lit(labels[place]))
    return chain.otherwise(_fallback(domain, language, code))
