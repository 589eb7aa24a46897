"""The domain tables as DuckDB SQL over the star schema; the SQL twin of fieldledger/sources/star.py."""

from __future__ import annotations


def _digits(number: str, width: int, fill: str = "0") -> str:
    text = f"cast({number} as varchar)"
    return f"lpad({text}, cast(greatest({width}, length({text})) as integer), '{fill}')"


def _code(prefix: str, number: str, width: int) -> str:
    return f"'{prefix}' || {_digits(number, width)}"


_AGENTS = "(select count(*) from supplier)"
_PLACE = "join nation on {key} = n_nationkey join region on n_regionkey = r_regionkey"
_KYC_DECIDED = "identity_verified in ('VERIFIED', 'REJECTED')"

# Later views may use earlier ones.
VIEWS: dict[str, str] = {
    "center": f"select {_code('C', 'n_nationkey', 3)} as center_code, n_name as center_name from nation",
    "field_agent": f"""
        select {_code('A', 's_suppkey', 6)} as agent_code, 200000000000000 + s_suppkey as person_id,
               case when s_suppkey % 13 <> 12 then {_code('C', 's_nationkey', 3)} end as center_code,
               case when s_suppkey % 10 = 9 then 'NO' else 'YES' end as is_active,
               cast(date '1994-01-01' + cast(s_suppkey * 17 % 365 as integer) as timestamp) as join_date
        from supplier""",
    "farmer": f"""
        select {_code('F', 'c_custkey', 8)} as farmer_code, 100000000000000 + c_custkey as person_id,
               {_code('A', f'c_custkey % {_AGENTS}', 6)} as agent_code,
               {_code('C', 'c_nationkey', 3)} as center_code,
               cast(date '1995-01-01' + cast(c_custkey * 37 % 2000 as integer) as timestamp) as registration_date,
               case when c_custkey % 17 = 0 then 'INACTIVE' else 'ACTIVE' end as account_status
        from customer""",
    "person": f"""
        select 100000000000000 + c_custkey as person_id,
               case when c_custkey % 5 = 0 then 'md. abdul-' else '' end || lower(c_mktsegment) as first_name,
               case when c_custkey % 6 <> 0 then lower(c_name) end as last_name,
               '01' || cast(3 + c_custkey % 7 as varchar) || {_digits('c_custkey', 8)} as login_phone,
               'farmer_' || cast(c_custkey as varchar) as username, 'FARMER' as role,
               cast(null as timestamp) as last_login,
               case when c_custkey % 9 <> 0 then {_digits('c_custkey', 10, '1')} end as nid,
               case when c_custkey % 2 = 0 then 'M' else 'F' end as gender,
               'village ' || cast(c_custkey % 100 as varchar) as village,
               lower(n_name) as upazila, lower(r_name) as district
        from customer {_PLACE.format(key='c_nationkey')}
        union all
        select 200000000000000 + s_suppkey, 'agent', lower(s_name),
               '01' || cast(3 + s_suppkey % 7 as varchar) || {_digits('90000000 + s_suppkey', 8)},
               'agent_' || cast(s_suppkey as varchar), 'AGENT', null, {_digits('s_suppkey', 10, '2')}, 'F',
               'village 0', lower(n_name), lower(r_name)
        from supplier {_PLACE.format(key='s_nationkey')}""",
    "phone": """
        select person_id, login_phone as phone_number, 'PERSONAL' as phone_type, 'YES' as is_primary from person""",
    "kyc": f"""
        with base as (
            select c_custkey as kyc_id, {_code('F', 'c_custkey', 8)} as farmer_code,
                   case when c_custkey % 11 <> 0 then {_code('A', f'c_custkey % {_AGENTS}', 6)} end as agent_code,
                   case when c_custkey % 7 <= 2 then 'VERIFIED' when c_custkey % 7 = 3 then 'REJECTED'
                        when c_custkey % 7 <= 5 then 'PENDING' end as identity_verified
            from customer where c_custkey % 5 <> 4)
        select *, case when {_KYC_DECIDED} then agent_code end as verified_by,
               case when {_KYC_DECIDED}
                    then cast(date '1999-01-01' + cast(kyc_id % 300 as integer) as timestamp) end as verified_date,
               cast(null as varchar) as remarks,
               case when identity_verified = 'VERIFIED' then 'nf_' || cast(kyc_id as varchar) end as nid_front_ref,
               case when identity_verified = 'VERIFIED' then 'nb_' || cast(kyc_id as varchar) end as nid_back_ref,
               cast(null as varchar) as land_dolil_ref,
               case when identity_verified = 'VERIFIED' then 'PENDING' end as land_legal_status
        from base""",
    "loan": f"""
        with dated as (
            select *, cast(cast(o_orderdate as date) as timestamp) as day,
                   case when o_custkey % 4 = 0 then o_custkey + 1 else o_custkey end as borrower
            from orders where o_orderkey % 3 = 0)
        select o_orderkey as loan_no, {_code('F', 'borrower', 8)} as farmer_code,
               cast(o_totalprice as decimal(18,2)) as amount, cast(5 + o_orderkey % 10 as double) as interest_rate,
               cast(6 + o_orderkey % 31 as integer) as tenure_months, lower(o_orderpriority) as purpose,
               case when o_orderkey % 41 = 0 then 'DEFAULTED' when o_orderstatus = 'P' then 'PENDING'
                    when o_orderstatus = 'O' then 'ACTIVE' else 'CLOSED' end as loan_state,
               case when o_orderkey % 50 <> 0 then day end as application_date,
               case when o_orderstatus <> 'P' then day + to_days(7) end as approval_date,
               case when o_orderstatus <> 'P' then day + to_days(10) end as disbursement_date
        from dated""",
    "repayment": """
        select l_orderkey as loan_no, l_linenumber as installment_no,
               cast(l_extendedprice as decimal(18,2)) as amount_paid, l_shipdate as payment_date,
               case l_returnflag when 'A' then 'BKASH' when 'N' then 'CASH' else 'BANK' end as payment_method,
               case when l_linestatus = 'F' then 'PAID' when l_returnflag = 'R' then 'OVERDUE'
                    else 'DUE' end as payment_state,
               cast(l_quantity * 10 as decimal(18,2)) as late_fee
        from lineitem where l_orderkey % 3 = 0""",
    "purchase": f"""
        with bought as (
            select *, case when o_custkey % 3 = 2 then o_custkey - 1 else o_custkey end as buyer
            from orders where o_orderkey % 3 <> 0)
        select o_orderkey as purchase_id, {_code('F', 'buyer', 8)} as farmer_code,
               {_code('A', f'buyer % {_AGENTS}', 6)} as agent_code, o_orderdate as purchase_date,
               case when o_orderpriority <> '4-NOT SPECIFIED' then substr(o_orderpriority, 3) end as payment_method,
               case when o_orderkey % 43 = 0 then null when o_orderstatus = 'P' then 'CONFIRMED'
                    when o_orderstatus = 'F' then 'DELIVERED' when o_orderkey % 2 = 0 then 'CANCELLED'
                    else 'PENDING' end as payment_status,
               case when o_orderkey % 5 <> 0 then 'TX' || cast(o_orderkey as varchar) end as transaction_reference
        from bought""",
    "ordered_item": """
        select l_orderkey as purchase_id, l_partkey as item_id, cast(l_extendedprice as decimal(18,2)) as total_cost
        from lineitem where l_orderkey % 3 <> 0""",
    "inventory": f"""
        select p_partkey as item_id, {_code('C', 'p_partkey % 25', 3)} as center_code, p_name as name,
               p_size - 1 as quantity, cast(p_retailprice as decimal(12,2)) as unit_price
        from part""",
    "community_post": """
        select doc_id as post_id, text as content,
               cast(date '2024-01-01' + cast(doc_id % 400 as integer) as timestamp) as post_date
        from documents""",
    "kyc_decision": f"""
        select event_id as decision_id, {_code('F', 'user_id', 8)} as farmer_code,
               200000000000000 + event_id % {_AGENTS} as person_id,
               case event_type when 'signup' then 'VERIFIED' else 'REJECTED' end as decision, ts as decided_at,
               case when event_type = 'signup' and event_id % 3 <> 0
                    then 'remark ' || cast(event_id as varchar) end as remarks,
               case when event_type = 'signup' then 'front_' || cast(event_id as varchar) end as nid_front_ref,
               case when event_type = 'signup' and event_id % 2 = 0
                    then 'back_' || cast(event_id as varchar) end as nid_back_ref,
               case when event_type = 'signup' then 'land_' || cast(event_id as varchar) end as land_dolil_ref,
               case when event_type <> 'signup' then null when event_id % 3 = 0 then 'VERIFIED'
                    when event_id % 3 = 1 then 'PENDING' else 'NOT_APPLICABLE' end as land_legal_status
        from events where event_type in ('signup', 'error')""",
    "login_event": f"""
        select event_id as attempt_id,
               case when event_id % 2 = 0 then 'farmer_' || cast(user_id as varchar)
                    else '01' || cast(3 + user_id % 7 as varchar) || {_digits('user_id', 8)} end as identifier,
               ts as login_at
        from events where event_type in ('view', 'click')""",
    "registration_application": f"""
        select event_id as application_id, ts as submitted_at,
               case event_id % 6 when 0 then ' farmer ' when 1 then 'AGENT' when 2 then 'advisor'
                    when 3 then 'ADMIN' when 4 then 'guest' else 'FARMER' end as role,
               case when event_id % 8 = 0 then '  ' else 'rahim' end as first_name,
               case when event_id % 2 = 0 then '' else 'mia' end as last_name,
               case when user_id % 10 = 0 then '012' || {_digits('user_id', 8)}
                    when user_id % 3 = 0 then '01' || cast(3 + user_id % 7 as varchar) || {_digits('user_id', 8)}
                    else '019' || cast(10000000 + user_id as varchar) end as phone,
               case when user_id % 4 = 1 then 'farmer_' else 'new_' end || cast(user_id as varchar) as username,
               case when event_id % 7 = 0 then 'abc' else 'pass' end as password,
               case when event_id % 7 = 0 then 'abc' when event_id % 9 = 0 then 'word'
                    else 'pass' end as confirm_password
        from events where event_type = 'signup'""",
}

# The views that a view reads.
_READS = {"phone": ("person",)}


def with_views(query: str, *names: str) -> str:
    """``query`` with the named views as a WITH list in front; the query may go on with ``, x as (…)``."""
    needed = {n for name in names for n in (*_READS.get(name, ()), name)}
    views = ",\n".join(f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"with {views}\n{query.strip()}"
