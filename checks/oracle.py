"""DuckDB SQL for every registered query."""

from __future__ import annotations

from checks.views import with_views

# The moment that the outreach list is computed for.
AS_OF = "2002-01-01 18:00:00"
# Whom the scoped queries ask for.
ONE_AGENT = 200_000_000_000_007
ONE_CENTER = "C003"

_WORD = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


# The labels that the pages show, English and Bengali.
EXPECTED_LABELS = {
    "kyc_status": {"VERIFIED": ("Verified", "যাচাইকৃত"), "PENDING": ("Pending", "অপেক্ষমাণ")},
    "loan_status": {
        "Paid": ("Paid", "পরিশোধিত"), "Active Loan": ("Active", "সক্রিয়"),
        "Loan Pending": ("Pending", "অপেক্ষমাণ"), "No Loan": ("No Loan", "কোনো ঋণ নেই"),
    },
    "dashboard_loan_status": {
        "Paid": ("Paid", "পরিশোধিত"), "Active Loan": ("Active", "চলমান"),
        "Loan Pending": ("Pending", "অপেক্ষমাণ"), "No Loan": ("No Loan", "কোনো ঋণ নেই"),
    },
    "pending_order": {"Yes": ("Yes", "হ্যাঁ"), "No": ("No", "না")},
    "loan_state": {
        "CLOSED": ("Closed", "সমাপ্ত"), "ACTIVE": ("Active", "সক্রিয়"), "PENDING": ("Pending", "অপেক্ষমাণ"),
    },
    "payment_state": {"PAID": ("Paid", "পরিশোধিত"), "OVERDUE": ("Overdue", "মেয়াদোত্তীর্ণ")},
    "payment_status": {
        "CONFIRMED": ("Confirmed", "নিশ্চিত"), "DELIVERED": ("Delivered", "ডেলিভারি সম্পন্ন"),
        "PENDING": ("Pending", "অপেক্ষমাণ"),
    },
    "stock_status": {
        "Out of Stock": ("Out of Stock", "স্টক শেষ"), "Low Stock": ("Low Stock", "স্বল্প মজুত"),
        "In Stock": ("In Stock", "মজুত আছে"),
    },
    "role": {
        "FARMER": ("Farmer", "কৃষক"), "AGENT": ("Agent", "এজেন্ট"), "ADMIN": ("Admin", "প্রশাসক"),
        "ADVISOR": ("Advisor", "উপদেষ্টা"),
    },
}


def caps(x: str) -> str:
    return (
        f"list_aggregate(list_transform(regexp_extract_all({x}, '{_WORD}'), "
        "lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')"
    )


def full_name(first: str, last: str) -> str:
    return f"coalesce({first}, '') || ' ' || coalesce({last}, '')"


def day(x: str) -> str:
    return f"strftime({x}, '%d-%b-%Y')"


# The width of an amount of so many digits, with commas and a sign.
AMOUNT_WIDTH = {9: 12, 6: 8}


def amount(x: str, digits: int = 9) -> str:
    """Whole units with commas; more than ``digits`` digits do not fit and show as signs."""
    shown = f"format('{{:,}}', cast(round({x}) as bigint))"
    return f"case when abs(round({x})) >= 1{'0' * digits} then repeat('#', {AMOUNT_WIDTH[digits]}) else {shown} end"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def labels(domain: str, language: int, x: str, other: str) -> str:
    cases = " ".join(f"when '{code}' then '{texts[language]}'" for code, texts in EXPECTED_LABELS[domain].items())
    return f"case {x} {cases} else {other} end"


_NAME = full_name(caps("first_name"), caps("last_name"))
# Fixed value: any other quantity below ten, also a negative one, is low.
_STOCK = """case when quantity = 0 then 'Out of Stock' when quantity < 10 then 'Low Stock' else 'In Stock' end"""

# Farmers with each of their KYC rows, or none.
_KYC_STATE = """
farmer_kyc as (
    select farmer.*, identity_verified from farmer left join kyc using (farmer_code)),
undecided as (
    select * from farmer_kyc where coalesce(identity_verified, 'PENDING') = 'PENDING')"""

_AGENT_COUNTS = """
farmer_loan as (
    select farmer.agent_code, loan_state from loan join farmer using (farmer_code)),
tally as (
    select agent_code, 'farmer' as what from farmer
    union all select agent_code, 'kyc' from kyc where identity_verified = 'VERIFIED'
    union all select agent_code, 'approved' from farmer_loan where loan_state in ('ACTIVE', 'CLOSED')
    union all select agent_code, 'pending' from farmer_loan where loan_state = 'PENDING'
    union all select agent_code, 'delivery' from purchase where payment_status = 'CONFIRMED'),
page as (
    select field_agent.person_id, field_agent.center_code, field_agent.agent_code,
           any_value(center_name) as center_name, any_value(upazila) as upazila, any_value(district) as district,
           any_value(is_active) as working_status, any_value(login_phone) as login_phone,
           any_value(join_date) as join_date,
           count(*) filter (where what = 'farmer') as total_farmers,
           count(*) filter (where what = 'kyc') as kyc_done,
           count(*) filter (where what = 'approved') as loans_approved,
           count(*) filter (where what = 'pending') as pending_loans,
           count(*) filter (where what = 'delivery') as pending_deliveries
    from field_agent join person using (person_id)
         left join center using (center_code) left join tally using (agent_code)
    group by 1, 2, 3)"""
_PAGE_VIEWS = ("center", "field_agent", "farmer", "person", "kyc", "loan", "purchase")

_AGENT_PAGE = f"""
, {_AGENT_COUNTS}, {_KYC_STATE},
badge as (select center_code, count(*) as pending_kyc from undecided group by 1),
full_page as (
    select page.*, coalesce(pending_kyc, 0) as pending_kyc from page left join badge using (center_code))"""

_LOAN_STATUS = """case loan_state when 'CLOSED' then 'Paid' when 'ACTIVE' then 'Active Loan'
                     when 'PENDING' then 'Loan Pending' else loan_state end"""
_MY_FARMERS = f"""
, ranked_loan as (
    select *, row_number() over (
        partition by farmer_code order by application_date desc nulls first, loan_no desc) as place
    from loan),
newest as (
    select *, cast(approval_date as date) as approved, approval_date + to_months(tenure_months) as moved
    from ranked_loan where place = 1),
due as (
    select farmer_code, loan_no, loan_state,
           case when approved = last_day(approved) then last_day(moved) else cast(moved as date) end as due_date
    from newest),
open_order as (
    select distinct farmer_code from purchase where payment_status not in ('DELIVERED', 'CANCELLED')),
list as (
    select field_agent.person_id, farmer.farmer_code as code, {_NAME} as name, login_phone as phone,
           coalesce(identity_verified, 'PENDING') as kyc_status,
           case when loan_no is null then 'No Loan' else {_LOAN_STATUS} end as loan_status,
           {day('due_date')} as due_date,
           case when open_order.farmer_code is null then 'No' else 'Yes' end as pending_order
    from farmer
    join field_agent using (agent_code)
    join person on person.person_id = farmer.person_id
    left join kyc on kyc.farmer_code = farmer.farmer_code
    left join due on due.farmer_code = farmer.farmer_code
    left join open_order on open_order.farmer_code = farmer.farmer_code)"""
_LIST_VIEWS = ("field_agent", "farmer", "person", "kyc", "loan", "purchase")

_SUCCESS = f"""
, totals as (
    select agent_code, count(kyc_id) as total_kyc,
           count(*) filter (where identity_verified = 'VERIFIED') as verified_kyc
    from kyc group by 1 having count(kyc_id) > 0),
success as (
    select agent_code, {full_name('first_name', 'last_name')} as agent_name, total_kyc, verified_kyc,
           cast(verified_kyc as double) * 100 / cast(total_kyc as double) as rate
    from field_agent join person using (person_id) join totals using (agent_code))"""
_SUCCESS_VIEWS = ("field_agent", "person", "kyc")

_PROFILE = f"""
    select farmer_code, {caps('first_name')} as first_name, {caps('last_name')} as last_name, login_phone, nid, gender,
           {caps('village')} as village, {caps('upazila')} as upazila, {caps('district')} as district,
           {day('registration_date')} as registration_date, account_status, cast(0 as integer) as total_points,
           cast(null as varchar) as referred_by, cast(null as varchar) as referral_date,
           cast(null as varchar) as referral_status
    from farmer join person using (person_id)"""
_LOANS = f"""
    select farmer_code, loan_no as loan_id, {amount('amount')} as amount, interest_rate, tenure_months,
           {caps('purpose')} as purpose, loan_state as status, {day('application_date')} as application_date,
           {day('approval_date')} as approval_date, {day('disbursement_date')} as disbursement_date
    from loan"""
_REPAYMENTS = f"""
    select farmer_code, loan_no, installment_no, {amount('amount_paid')} as amount_paid,
           {day('payment_date')} as payment_date, payment_method, payment_state, {amount('late_fee')} as late_fee
    from repayment join loan using (loan_no)"""
_PURCHASES = f"""
    select farmer_code, purchase_id, {day('purchase_date')} as purchase_date, payment_method,
           payment_status as status, transaction_reference
    from purchase"""

_FARMER_PAGE = f"""
, profile as ({_PROFILE}), loans as ({_LOANS}), repayments as ({_REPAYMENTS}), purchases as ({_PURCHASES})
select * replace ('N/A' as referred_by), 'profile' as section from profile
union all by name
select * replace ({labels('loan_state', 1, 'status', 'status')} as status), 'loan' as section
from loans where farmer_code in (select farmer_code from profile)
union all by name
select * replace ({labels('payment_state', 1, 'payment_state', 'payment_state')} as payment_state),
       'repayment' as section
from repayments where farmer_code in (select farmer_code from profile)
union all by name
select * replace ({labels('payment_status', 1, 'status', 'status')} as status,
                  coalesce(payment_method, 'N/A') as payment_method,
                  coalesce(transaction_reference, 'N/A') as transaction_reference),
       'purchase' as section
from purchases where farmer_code in (select farmer_code from profile)"""


def _labelled(domain: str, item: str, code: str, table: str, other: tuple[str, str], part: str = "null") -> str:
    return f"""
    select '{domain}' as domain, cast({item} as varchar) as item, cast({part} as bigint) as installment_no,
           {code} as code,
           {labels(domain, 0, code, other[0])} as label_en, {labels(domain, 1, code, other[1])} as label_bn
    from {table}"""


_STATUS_LABELS = " union all ".join(
    [
        _labelled("kyc_status", "kyc_id", "coalesce(identity_verified, 'PENDING')", "kyc", ("'-'", "'-'")),
        _labelled("loan_state", "loan_no", "loan_state", "loan", ("loan_state", "loan_state")),
        _labelled(
            "payment_state", "loan_no", "payment_state", "repayment", ("payment_state", "payment_state"), "installment_no"
        ),
        _labelled(
            "payment_status", "purchase_id", "payment_status", "purchase", ("payment_status", "payment_status")
        ),
        _labelled("stock_status", "item_id", _STOCK, "inventory", ("null", "null")),
        _labelled("role", "person_id", "role", "person", ("role", "role")),
    ]
)

_KYC_DECISIONS = """
, last_one as (
    select * from kyc_decision
    qualify row_number() over (partition by farmer_code order by decided_at desc, decision_id desc) = 1),
last_verified as (
    select * from kyc_decision where decision = 'VERIFIED'
    qualify row_number() over (partition by farmer_code order by decided_at desc, decision_id desc) = 1),
changed as (
    select farmer_code, l.decision, l.decided_at, a.agent_code as decided_by, v.decision_id is not null as documented,
           v.remarks, v.nid_front_ref, v.nid_back_ref, v.land_dolil_ref, v.land_legal_status
    from last_one l left join field_agent a using (person_id) left join last_verified v using (farmer_code))
select k.kyc_id, k.farmer_code, k.agent_code,
       case when c.decision is null then k.identity_verified else c.decision end as identity_verified,
       case when c.decision is null then k.verified_by else c.decided_by end as verified_by,
       case when c.decision is null then k.verified_date else c.decided_at end as verified_date,
       case when c.documented then c.remarks else k.remarks end as remarks,
       case when c.documented then c.nid_front_ref else k.nid_front_ref end as nid_front_ref,
       case when c.documented then c.nid_back_ref else k.nid_back_ref end as nid_back_ref,
       case when c.documented then c.land_dolil_ref else k.land_dolil_ref end as land_dolil_ref,
       case when c.documented then c.land_legal_status else k.land_legal_status end as land_legal_status
from kyc k left join changed c using (farmer_code)"""

_IDENTITY = f"""
, cleaned as (
    select * replace ({strip('identifier')} as identifier) from login_event),
attempt as (
    select *, case when regexp_matches(identifier, '^01[3-9][0-9]{{8}}$') then 'phone' else 'username' end as kind
    from cleaned where identifier <> ''),
resolved as (
    select attempt_id, identifier, login_at, kind,
           case kind when 'phone' then (select min(p.person_id) from person p where p.login_phone = identifier)
                     else (select min(p.person_id) from person p where p.username = identifier) end as person_id
    from attempt)"""

_LAST_LOGIN = f"""{_IDENTITY}
, latest as (select person_id, max(login_at) as login_at from resolved group by 1)
select person.* replace (greatest(person.last_login, latest.login_at) as last_login)
from person left join latest on latest.person_id = person.person_id"""

_CHECKED = f"""
, cleaned as (
    select application_id, submitted_at, upper({strip('role')}) as role, {strip('first_name')} as first_name,
           {strip('last_name')} as last_name, {strip('phone')} as phone, {strip('username')} as username,
           {strip('password')} as password, {strip('confirm_password')} as again
    from registration_application),
checked as (
    select application_id, submitted_at, role, first_name, last_name, phone, username,
           case when role not in ('FARMER', 'AGENT', 'ADMIN', 'ADVISOR') then 'ROLE'
                when '' in (first_name, phone, username, password, again) then 'REQUIRED'
                when password <> again then 'MISMATCH'
                when length(password) < 4 then 'SHORT'
                when not regexp_matches(phone, '^01[3-9][0-9]{{8}}$') then 'PHONE'
                when phone in (select login_phone from person) then 'DUP_PHONE'
                when username in (select p.username from person p) then 'DUP_USERNAME'
                else 'OK' end as outcome
    from cleaned)"""

# In these tables phone and username both follow from the user, so one round decides.
_REGISTERED = f"""{_CHECKED}
, placed as (
    select *, row_number() over (partition by phone, outcome = 'OK' order by submitted_at, application_id) as turn
    from checked),
judged as (
    select * exclude (turn, outcome),
           case when outcome = 'OK' and turn > 1 then 'DUP_PHONE' else outcome end as outcome
    from placed),
added as (
    select (select max(person_id) from person) + row_number() over (order by submitted_at, application_id) as person_id,
           first_name, nullif(last_name, '') as last_name, phone as login_phone, username, role
    from judged where outcome = 'OK')"""


def _list_page(loan_domain: str, language: int) -> str:
    return f"""{_MY_FARMERS}
        select person_id, coalesce(code, 'N/A') as code, coalesce(name, 'N/A') as name,
               coalesce(phone, 'N/A') as phone, {labels('kyc_status', language, 'kyc_status', "'-'")} as kyc_status,
               {labels(loan_domain, language, 'loan_status', "coalesce(loan_status, 'N/A')")} as loan_status,
               coalesce(due_date, '-') as due_date,
               {labels('pending_order', language, 'pending_order', 'null')} as pending_order
        from list"""


def _waiting(registered: str) -> str:
    return f""", {_KYC_STATE}
        select center_code, farmer_code as code, {_NAME} as name, login_phone as phone, upazila as village,
               {registered} as registered
        from undecided join person using (person_id)
        where farmer_code in (select farmer_code from loan)"""


def _stock(status: str) -> str:
    return f"""
        select center_code, {caps('name')} as item, quantity as stock, {amount('unit_price', 6)} as price,
               {status} as status
        from inventory"""


ORACLE: dict[str, str] = {
    "agent_dashboard": with_views(f", {_AGENT_COUNTS} select * exclude (center_code) from page", *_PAGE_VIEWS),
    "agent_page": with_views(f"{_AGENT_PAGE} select * exclude (center_code) from full_page", *_PAGE_VIEWS),
    "dashboard_defaults": with_views(
        f"""{_AGENT_PAGE}
        select person_id, agent_code, coalesce(center_name, 'Not Assigned') as center_name,
               coalesce(upazila, 'N/A') as upazila, coalesce(district, 'N/A') as district, working_status,
               coalesce(login_phone, 'N/A') as phone,
               coalesce(strftime(join_date, '%d %b %Y'), 'N/A') as join_date, total_farmers, kyc_done,
               loans_approved, pending_loans, pending_deliveries, pending_kyc
        from full_page""",
        *_PAGE_VIEWS,
    ),
    "agent_lookup": with_views("select person_id, agent_code, center_code from field_agent", "field_agent"),
    "my_farmers": with_views(f"{_MY_FARMERS} select * from list", *_LIST_VIEWS),
    "my_farmers_count": with_views(
        f"""{_MY_FARMERS}
        select person_id, agent_code, (select count(*) from list t where t.person_id = a.person_id) as farmers_shown
        from field_agent a""",
        *_LIST_VIEWS,
    ),
    "my_farmers_page": with_views(_list_page("loan_status", 1), *_LIST_VIEWS),
    "dashboard_farmers": with_views(_list_page("dashboard_loan_status", 0), *_LIST_VIEWS),
    "pending_kyc_count": with_views(
        f", {_KYC_STATE} select center_code, count(*) as pending_kyc from undecided group by 1", "farmer", "kyc"
    ),
    "pending_kyc": with_views(_waiting(day("registration_date")), "farmer", "kyc", "person", "loan"),
    "pending_kyc_page": with_views(
        _waiting(f"coalesce({day('registration_date')}, 'N/A')"), "farmer", "kyc", "person", "loan"
    ),
    "pending_loans": with_views(
        f"""
        select center_code, loan_no as loan_id, farmer_code as code, {_NAME} as name, {amount('amount')} as amount,
               {caps('purpose')} as purpose, {day('application_date')} as applied
        from farmer join person using (person_id) join loan using (farmer_code)
        where loan_state = 'PENDING'""",
        "farmer", "person", "loan",
    ),
    "inventory_status": with_views(_stock(_STOCK), "inventory"),
    "inventory_page": with_views(_stock(labels("stock_status", 1, _STOCK, "null")), "inventory"),
    "outreach": with_views(
        f""", {_KYC_STATE}
        select center_code, farmer_code as code, {_NAME} as name, login_phone as phone, {caps('upazila')} as village,
               cast(round(date_diff('second', registration_date, timestamp '{AS_OF}') / 86400.0) as integer)
                   as days_since_reg
        from undecided join person using (person_id)
        where not exists (from loan where loan.farmer_code = undecided.farmer_code)""",
        "farmer", "kyc", "person", "loan",
    ),
    "pending_purchases": with_views(
        f""", total as (select purchase_id, sum(total_cost) as cost from ordered_item group by 1)
        select center_code, purchase_id as order_id, farmer_code as code, {_NAME} as name,
               {day('purchase_date')} as ordered, {amount('coalesce(cost, 0)')} as total_amount,
               coalesce(payment_method, 'Not Specified') as payment
        from purchase left join total using (purchase_id) join farmer using (farmer_code)
             join person using (person_id)
        where payment_status = 'CONFIRMED'""",
        "purchase", "ordered_item", "farmer", "person",
    ),
    "community_posts": with_views(
        f"select post_id, content, {day('post_date')} as post_date from community_post", "community_post"
    ),
    "agent_ranking": with_views(
        f"""{_SUCCESS}
        select agent_code, agent_name, total_kyc, verified_kyc, round(rate, 2) as success_rate,
               cast(rank() over (order by rate desc) as integer) as rank
        from success""",
        *_SUCCESS_VIEWS,
    ),
    "ranking_position": with_views(
        f"""{_SUCCESS}
        select agent_code, agent_name, round(rate, 2) as success_rate,
               row_number() over (order by round(rate, 2) desc, agent_code) as position
        from success""",
        *_SUCCESS_VIEWS,
    ),
    "farmer_detail": with_views(_PROFILE, "farmer", "person"),
    "farmer_loans": with_views(_LOANS, "loan"),
    "farmer_repayments": with_views(_REPAYMENTS, "repayment", "loan"),
    "farmer_purchases": with_views(_PURCHASES, "purchase"),
    "farmer_page": with_views(_FARMER_PAGE, "farmer", "person", "loan", "repayment", "purchase"),
    "status_labels": with_views(
        _STATUS_LABELS, "kyc", "loan", "repayment", "purchase", "inventory", "person"
    ),
    "kyc_decisions": with_views(_KYC_DECISIONS, "kyc", "kyc_decision", "field_agent"),
    "kyc_unmatched_decisions": with_views(
        "select * from kyc_decision d where not exists (from kyc where kyc.farmer_code = d.farmer_code)", "kyc", "kyc_decision"
    ),
    "last_login": with_views(_LAST_LOGIN, "person", "login_event"),
    "login_identity": with_views(f"{_IDENTITY} select * from resolved", "person", "login_event"),
    "registration_check": with_views(
        f"{_CHECKED} select * from checked", "person", "registration_application"
    ),
    "registration": with_views(
        f"{_REGISTERED} select * from person union all by name select * from added",
        "person", "registration_application",
    ),
    "registration_phone": with_views(
        f"""{_REGISTERED}
        select * from phone
        union all select person_id, login_phone, 'PERSONAL', 'YES' from added""",
        "person", "phone", "registration_application",
    ),
    "registration_outcome": with_views(
        f"{_REGISTERED} select application_id, submitted_at, phone, username, outcome from judged",
        "person", "registration_application",
    ),
}

# The streams must end where the batches do.
ORACLE["kyc_decisions_stream"] = ORACLE["kyc_decisions"]
ORACLE["kyc_store_stream"] = ORACLE["kyc_decisions"]
ORACLE["last_login_stream"] = ORACLE["last_login"]
ORACLE["login_identity_stored"] = ORACLE["login_identity"]
ORACLE["registration_published"] = f"""
    select person_id, username, role, phone_number, phone_type
    from ({ORACLE["registration"]}) join ({ORACLE["registration_phone"]}) using (person_id)"""


def _scoped(name: str, key: str, value: str) -> str:
    return f"select * exclude ({key}) from ({ORACLE[name]}) where {key} = {value}"


ORACLE |= {
    "my_farmers_of_agent": _scoped("my_farmers", "person_id", str(ONE_AGENT)),
    "agent_page_of_agent": _scoped("agent_page", "person_id", str(ONE_AGENT)),
    "pending_kyc_of_center": _scoped("pending_kyc", "center_code", f"'{ONE_CENTER}'"),
    "outreach_of_center": _scoped("outreach", "center_code", f"'{ONE_CENTER}'"),
    "pending_purchases_of_center": _scoped("pending_purchases", "center_code", f"'{ONE_CENTER}'"),
}
