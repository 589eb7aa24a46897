"""KYC decisions, logins and registrations against one-at-a-time Python versions of the rules."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from fieldledger import operators as op
from fieldledger.operators.kyc import DOCUMENTS
from fieldledger.sources.identities import add_identities, open_identities, save_identities

START = datetime(2024, 1, 1)


def as_dicts(df, *drop):
    return sorted(({k: v for k, v in r.asDict().items() if k not in drop} for r in df.collect()), key=repr)


def kyc_row(number, code, state=None, **other):
    return {"kyc_id": number, "farmer_code": code, "agent_code": "A1", "identity_verified": state, **other}


def decision(number, code, kind, minute, by=9, **documents):
    return {"decision_id": number, "farmer_code": code, "person_id": by, "decision": kind,
            "decided_at": START + timedelta(minutes=minute), **documents}


def one_at_a_time(kyc, decisions, agents):
    table = [{c: r.get(c) for c in ("kyc_id", "farmer_code", "agent_code", "identity_verified", "verified_by",
                                    "verified_date", *DOCUMENTS)} for r in kyc]
    for d in sorted(decisions, key=lambda d: (d["decided_at"], d["decision_id"])):
        for row in table:
            if row["farmer_code"] != d["farmer_code"] or d["farmer_code"] is None:
                continue
            row |= {"identity_verified": d["decision"], "verified_by": agents.get(d["person_id"]),
                    "verified_date": d["decided_at"]}
            if d["decision"] == "VERIFIED":
                row |= {c: d.get(c) for c in DOCUMENTS}
    return sorted(table, key=repr)


def random_case(seed):
    rng = random.Random(seed)
    kyc = [kyc_row(n, f"F{rng.randrange(12)}", rng.choice([None, "PENDING", "VERIFIED"]),
                   remarks=rng.choice([None, "old"]), nid_front_ref="old front") for n in range(15)]
    decisions = [
        decision(n, rng.choice([None, *(f"F{i}" for i in range(14))]), rng.choice(["VERIFIED", "REJECTED"]),
                 rng.randrange(8), rng.choice([8, 9, 10]), remarks=rng.choice([None, f"new {n}"]),
                 land_legal_status=rng.choice([None, "PENDING"]))
        for n in range(40)
    ]
    return kyc, decisions


AGENTS = {8: "A8", 9: "A9"}
FIELD_AGENTS = [{"agent_code": code, "person_id": number} for number, code in AGENTS.items()]


@pytest.mark.parametrize("seed", range(4))
def test_many_decisions_equal_one_at_a_time(made, seed):
    kyc, decisions = random_case(seed)
    t = made(kyc=kyc, kyc_decision=decisions, field_agent=FIELD_AGENTS)
    got = op.apply_kyc_decisions(t["kyc"], t["kyc_decision"], t["field_agent"])
    assert got.columns == t["kyc"].columns
    assert as_dicts(got) == one_at_a_time(kyc, decisions, AGENTS)
    known = {r["farmer_code"] for r in kyc}
    lost = op.unmatched_decisions(t["kyc"], t["kyc_decision"])
    assert {r.decision_id for r in lost.collect()} == {
        d["decision_id"] for d in decisions if d["farmer_code"] not in known
    }


def test_verifying_overwrites_with_null_and_rejecting_does_not(made):
    kyc = [kyc_row(n, f"F{n}", "PENDING", remarks="old", nid_back_ref="back") for n in (1, 2, 3)]
    t = made(kyc=kyc, field_agent=FIELD_AGENTS, kyc_decision=[decision(1, "F1", "VERIFIED", 1), decision(2, "F2", "REJECTED", 1)])
    got = {r.farmer_code: r for r in op.apply_kyc_decisions(t["kyc"], t["kyc_decision"], t["field_agent"]).collect()}
    assert (got["F1"].identity_verified, got["F1"].verified_by, got["F1"].remarks, got["F1"].nid_back_ref) == (
        "VERIFIED", "A9", None, None,
    )
    assert (got["F2"].identity_verified, got["F2"].remarks, got["F2"].nid_back_ref) == ("REJECTED", "old", "back")
    assert (got["F3"].identity_verified, got["F3"].verified_by) == ("PENDING", None)


def test_several_agent_codes_fail_only_when_used(made):
    agents = [*FIELD_AGENTS, {"agent_code": "A9b", "person_id": 9}]
    t = made(kyc=[kyc_row(1, "F1")], field_agent=agents, kyc_decision=[decision(1, "F1", "VERIFIED", 1, by=8)])
    assert op.apply_kyc_decisions(t["kyc"], t["kyc_decision"], t["field_agent"]).first().verified_by == "A8"
    t = made(kyc=[kyc_row(1, "F1")], field_agent=agents, kyc_decision=[decision(1, "F1", "VERIFIED", 1, by=9)])
    with pytest.raises(PySparkException, match="several agent codes"):
        op.apply_kyc_decisions(t["kyc"], t["kyc_decision"], t["field_agent"]).collect()


def person(number, phone=None, username=None, **other):
    return {"person_id": number, "login_phone": phone, "username": username, **other}


def attempt(number, identifier, minute=0):
    return {"attempt_id": number, "identifier": identifier, "login_at": START + timedelta(minutes=minute)}


def test_login_identity(made):
    t = made(
        person=[person(1, "01312345678", "rahim"), person(2, "01412345678", "01512345678"), person(3, "0121", "x:y"),
                person(5, None, "rahim"), person(6)],
        login_event=[attempt(1, " 01312345678\n"), attempt(2, "rahim "), attempt(3, "01512345678"), attempt(4, "0121"),
                     attempt(5, "  "), attempt(6, None), attempt(7, "RAHIM"), attempt(8, "x:y"),
                     attempt(9, "০১৩১২৩৪৫৬৭৮")],
    )
    got = op.resolve_login_identity(t["login_event"], t["person"])
    assert {r.attempt_id: (r.kind, r.person_id) for r in got.collect()} == {
        1: ("phone", 1), 2: ("username", 1), 3: ("phone", None), 4: ("username", None), 7: ("username", None),
        8: ("username", 3), 9: ("username", None),
    }


def test_last_login_moves_forward_only(made):
    late = START + timedelta(days=5)
    t = made(
        person=[person(1, "01312345678", "a", last_login=late), person(2, None, "b", role="FARMER"), person(3)],
        login_event=[attempt(1, "a", 5), attempt(2, "b", 9), attempt(3, "b", 7), attempt(4, "nobody", 99)],
    )
    got = op.last_logins(t["person"], t["login_event"])
    assert got.columns == t["person"].columns
    assert {r.person_id: r.last_login for r in got.collect()} == {1: late, 2: START + timedelta(minutes=9), 3: None}


GOOD = {"role": "farmer", "first_name": "Asha", "phone": "01712345678", "username": "asha", "password": "pass",
        "confirm_password": "pass"}


@pytest.mark.parametrize(
    ("change", "outcome"),
    [
        ({}, "OK"),
        ({"role": "\tAdvisor "}, "OK"),
        ({"role": "guest", "first_name": ""}, "ROLE"),
        ({"role": None}, "ROLE"),
        ({"first_name": "  "}, "REQUIRED"),
        ({"confirm_password": None}, "REQUIRED"),
        ({"password": "\n"}, "REQUIRED"),
        ({"last_name": None}, "OK"),
        ({"password": "abc"}, "MISMATCH"),
        ({"password": "abc", "confirm_password": " abc "}, "SHORT"),
        ({"password": "চারটা", "confirm_password": "চারটা"}, "OK"),
        ({"phone": "01212345678"}, "PHONE"),
        ({"phone": "017123456789"}, "PHONE"),
        ({"phone": "০১৭১২৩৪৫৬৭৮"}, "PHONE"),
        ({"phone": "01712345678\n"}, "OK"),
        ({"phone": " 01911111111 ", "username": "taken"}, "DUP_PHONE"),
        ({"username": "taken"}, "DUP_USERNAME"),
    ],
)
def test_first_broken_rule(made, change, outcome):
    t = made(
        person=[person(1, "01911111111", "taken"), person(2, "01911111111", "other")],
        registration_application=[{"application_id": 1, "submitted_at": START, **GOOD, **change}],
    )
    got = op.validate_registrations(t["registration_application"], t["person"])
    assert [r.outcome for r in got.collect()] == [outcome]
    assert not {"password", "confirm_password"} & set(got.columns)


def registered(made, applications, persons=()):
    t = made(person=list(persons), phone=[{"person_id": 1, "phone_number": "0"}], registration_application=applications)
    return op.register(t["registration_application"], t["person"], t["phone"])


def application(number, phone, username, minute=0, **other):
    return {**GOOD, "application_id": number, "submitted_at": START + timedelta(minutes=minute),
            "phone": f"017{phone:08d}", "username": f"u{username}", **other}


def first_come(applications, persons=()):
    phones = {p["login_phone"] for p in persons}
    names = {p["username"] for p in persons}
    outcome = {}
    for a in sorted(applications, key=lambda a: (a["submitted_at"], a["application_id"])):
        if a["phone"] in phones:
            outcome[a["application_id"]] = "DUP_PHONE"
        elif a["username"] in names:
            outcome[a["application_id"]] = "DUP_USERNAME"
        else:
            outcome[a["application_id"]] = "OK"
            phones.add(a["phone"])
            names.add(a["username"])
    return outcome


def test_a_rejected_application_does_not_hold_its_other_key(made):
    # 2 loses its username to 1, so 3 gets the phone of 2; 4 loses to 3, so 5 gets the username of 4.
    chain = [application(1, 1, 1), application(2, 2, 1), application(3, 2, 2), application(4, 3, 2),
             application(5, 3, 3), application(6, 4, 3), application(7, 4, 4)]
    got = registered(made, chain)
    assert {r.application_id: r.outcome for r in got.outcome.collect()} == first_come(chain)
    assert first_come(chain) == {1: "OK", 2: "DUP_USERNAME", 3: "OK", 4: "DUP_USERNAME", 5: "OK", 6: "DUP_USERNAME", 7: "OK"}


@pytest.mark.parametrize("seed", range(3))
def test_registration_equals_one_at_a_time(made, seed):
    rng = random.Random(seed)
    persons = [person(50, "01700000001", "u1", first_name="x"), person(1, "01700000002", "u9")]
    batch = [application(n, rng.randrange(25), rng.randrange(25), rng.randrange(20)) for n in range(80)]
    got = registered(made, batch, persons)
    wanted = first_come(batch, persons)
    assert {r.application_id: r.outcome for r in got.outcome.collect()} == wanted
    table = got.person.collect()
    assert len(table) == len(persons) + sum(o == "OK" for o in wanted.values())
    for key in ("person_id", "login_phone", "username"):
        assert len({r[key] for r in table}) == len(table)
    new = sorted(r for r in ((r.person_id, r.login_phone) for r in table) if r[0] > 50)
    order = sorted((a["submitted_at"], a["application_id"]) for a in batch if wanted[a["application_id"]] == "OK")
    phones = {(a["submitted_at"], a["application_id"]): a["phone"] for a in batch}
    assert new == [(51 + place, phones[moment]) for place, moment in enumerate(order)]
    numbers = {(r.person_id, r.phone_number, r.phone_type, r.is_primary) for r in got.phone.collect()}
    assert numbers == {(1, "0", None, None), *((i, p, "PERSONAL", "YES") for i, p in new)}


def a_chain(length):
    """Each application shares its phone with the one before and its username with the one after."""
    return [application(n, (n + 1) // 2, n // 2, n) for n in range(length)]


def jobs_of(spark, name, build):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_long_chain_takes_no_more_jobs_than_a_short_one(made, spark):
    counts = []
    for length in (20, 1000):
        batch = a_chain(length)
        t = made(registration_application=batch)
        got, jobs = jobs_of(spark, f"chain-{length}", lambda t=t: op.registration_outcome(t["registration_application"], t["person"]))
        assert {r.application_id: r.outcome for r in got.collect()} == first_come(batch)
        counts.append(jobs)
    assert counts[1] <= counts[0], counts


@pytest.mark.parametrize("seed", range(1))
def test_components_too_large_for_a_row(made, monkeypatch, seed):
    """With a limit of a few applications all ways are taken: rounds, folds, thinning and components again."""
    monkeypatch.setattr(op.accounts, "COMPONENT", 6)
    monkeypatch.setattr(op.accounts, "THINNING", 6)
    rng = random.Random(seed)
    batch = a_chain(24) + [application(100 + n, 200 + rng.randrange(30), 200 + rng.randrange(30), rng.randrange(90)) for n in range(60)]
    got = registered(made, batch)
    assert {r.application_id: r.outcome for r in got.outcome.collect()} == first_come(batch)


def test_components(spark):
    from fieldledger.plans import components

    links = [("b", "a"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", "q"), *((f"n{i:03}", f"n{i + 1:03}") for i in range(40))]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "q": "q"} | {f"n{i:03}": "n000" for i in range(41)}


def test_registration_of_nothing(made):
    got = registered(made, [application(1, 1, 1, role="guest")], [person(7, "1", "2")])
    assert (got.person.count(), got.phone.count()) == (1, 1)
    assert [r.outcome for r in got.outcome.collect()] == ["ROLE"]


def test_missing_last_name_is_stored_as_null(made):
    got = registered(made, [application(1, 1, 1, last_name="  ")])
    stored = got.person.first()
    assert (stored.last_name, stored.first_name, stored.role, stored.last_login) == (None, "Asha", "FARMER", None)
    assert stored.person_id == 1


@pytest.fixture
def identities(spark, tmp_path):
    """Makes a stored identity table of some persons."""
    names = []

    def build(person):
        names.append(f"identities_{tmp_path.name}_{len(names)}")
        return save_identities(person, names[-1], f"{tmp_path}/{names[-1]}", buckets=4), names[-1]

    yield build
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stored_identities_give_the_same(made, identities):
    rng = random.Random(9)
    persons = [person(n, f"017{rng.randrange(30):08d}" if n % 7 else None, f"u{rng.randrange(40)}") for n in range(40)]
    logins = [attempt(n, rng.choice([f"u{rng.randrange(60)}", f" 017{rng.randrange(60):08d} ", " "]), n) for n in range(200)]
    batch = [application(n, rng.randrange(60), rng.randrange(60), n) for n in range(60)]
    t = made(person=persons, login_event=logins, registration_application=batch)
    table, _ = identities(t["person"])
    ways = [(op.resolve_login_identity, t["login_event"], t["person"]), (op.last_logins, t["person"], t["login_event"]),
            (op.validate_registrations, t["registration_application"], t["person"]),
            (op.registration_outcome, t["registration_application"], t["person"])]
    for operator, *given in ways:
        assert as_dicts(operator(*given, identities=table)) == as_dicts(operator(*given)), operator


def test_identities_follow_registrations(made, identities):
    t = made(person=[person(1, "01911111111", "old")], registration_application=a_chain(9), phone=[])
    table, name = identities(t["person"])
    done = op.register(t["registration_application"], t["person"], t["phone"], table)
    for _ in range(2):
        # A repeated call adds nothing.
        table = add_identities(done.added.checkpoint(), name)
        assert as_dicts(table) == as_dicts(op.accounts.person_identities(done.person))
    again = op.registration_outcome(t["registration_application"], done.person, table)
    assert {r.outcome for r in again.collect()} <= {"DUP_PHONE", "DUP_USERNAME"}
    taken = open_identities(table.sparkSession, name, "unused", 4)
    assert as_dicts(taken) == as_dicts(table)


def test_stored_identities_are_not_shuffled(spark, made, identities, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    t = made(person=[person(n, f"017{n:08d}", f"u{n}") for n in range(50)], login_event=[attempt(1, "u1")])
    table, _ = identities(t["person"])
    text = op.accounts.persons_of_folds(op.accounts.fold_logins(t["login_event"]), t["person"], table)
    text = text._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "login_phone" not in text
