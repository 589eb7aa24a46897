"""Column expressions; all stay in the JVM."""

from fieldledger.functions.dates import add_months_sticky, as_of_column, day_mon_year, days_since
from fieldledger.functions.labels import label, loan_status, stock_status
from fieldledger.functions.numbers import grouped_amount
from fieldledger.functions.text import blank_to_null, full_name, or_default, strip_space, word_caps

__all__ = [
    "add_months_sticky",
    "as_of_column",
    "blank_to_null",
    "day_mon_year",
    "days_since",
    "full_name",
    "grouped_amount",
    "label",
    "loan_status",
    "or_default",
    "stock_status",
    "strip_space",
    "word_caps",
]
