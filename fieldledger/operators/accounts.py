"""Logins and registrations, applied to the person and phone tables as batches."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions import blank_to_null, strip_space
from fieldledger.plans import components, lookup, needed, numbered
from fieldledger.session import cut, fresh_dir, stored

# The form of a phone number, the roles, and the shortest password.
PHONE_FORM = r"^01[3-9][0-9]{8}$"
ROLES = ("FARMER", "AGENT", "ADMIN", "ADVISOR")
SHORTEST_PASSWORD = 4


def _identity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), value)


def login_identities(attempts: DataFrame) -> DataFrame:
    """Attempts with a cleaned identifier, its kind (phone or username) and the key made of both."""
    identifier = strip_space("identifier")
    kind = F.when(F.col("identifier").rlike(PHONE_FORM), "phone").otherwise("username")
    return (
        attempts.withColumn("identifier", identifier)
        .where(F.col("identifier") != "")
        .withColumn("kind", kind)
        .withColumn("identity", _identity(F.col("kind"), F.col("identifier")))
    )


def person_identities(person: DataFrame) -> DataFrame:
    """The person behind each phone and username, as (identity, person_id); the lowest id where several share one."""
    keys = F.array(
        _identity(F.lit("phone"), F.col("login_phone")),
        _identity(F.lit("username"), F.col("username")),
    )
    return (
        person.select("person_id", F.explode(keys).alias("identity"))
        .where(F.col("identity").isNotNull())
        .groupBy("identity")
        .agg(F.min("person_id").alias("person_id"))
    )


def _known(person: DataFrame, identities: DataFrame | None) -> DataFrame:
    """The identities of ``person``, or a stored table of them: one row per identity either way."""
    if identities is None:
        return person_identities(person)
    # Grouped by what the table is bucketed by: no shuffle, and one row even where two writers added a key.
    return identities.groupBy("identity").agg(F.min("person_id").alias("person_id"))


def resolve_login_identity(
    attempts: DataFrame, person: DataFrame, identities: DataFrame | None = None
) -> DataFrame:
    """Attempts with the kind of identifier and the person it belongs to, NULL if unknown.

    Blank identifiers are dropped. One join on (kind, value) serves both kinds. ``identities`` is the stored table
    (:mod:`fieldledger.sources.identities`); ``person`` is not read then.
    """
    rows = login_identities(attempts)
    known = needed(_known(person, identities), rows, "identity")
    return lookup(rows, known, "identity").drop("identity")


def fold_logins(attempts: DataFrame) -> DataFrame:
    """The last login time per identity; a maximum, so it also works over a stream."""
    return login_identities(attempts).groupBy("identity").agg(F.max("login_at").alias("login_at"))


def persons_of_folds(folds: DataFrame, person: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Folded logins as (person_id, login_at); unknown identities drop out."""
    return folds.join(_known(person, identities), "identity").select("person_id", "login_at")


def apply_last_login(person: DataFrame, logins: DataFrame) -> DataFrame:
    """The person table with ``last_login`` moved forward to the last of each person's logins."""
    last = logins.groupBy("person_id").agg(F.max("login_at").alias("login_at"))
    return person.join(last, "person_id", "left").select(
        *(
            F.greatest("last_login", "login_at").alias(c) if c == "last_login" else F.col(c)
            for c in person.columns
        )
    )


def last_logins(person: DataFrame, attempts: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """``apply_last_login`` for raw attempts: they are folded before they are resolved."""
    return apply_last_login(person, persons_of_folds(fold_logins(attempts), person, identities))


def validate_registrations(
    applications: DataFrame, person: DataFrame, identities: DataFrame | None = None
) -> DataFrame:
    """Cleaned applications with the first rule each breaks, or OK. Passwords are not kept. With the stored table of
    ``identities``, ``person`` is not read."""
    cleaned = applications.select(
        "application_id",
        "submitted_at",
        F.upper(strip_space("role")).alias("role"),
        *(
            F.coalesce(strip_space(c), F.lit("")).alias(c)
            for c in ("first_name", "last_name", "phone", "username", "password", "confirm_password")
        ),
    )

    def taken(column: str, name: str, flag: str) -> DataFrame:
        if identities is not None:
            asked = cleaned.select(_identity(F.lit(name), F.col(name)).alias("identity"))
            held = needed(_known(person, identities), asked, "identity")
            value = F.substring("identity", len(name) + 2, 1 << 30)
            return held.select(value.alias(name), F.lit(True).alias(flag))
        held = person.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()
        return needed(held, cleaned, name).withColumn(flag, F.lit(True))

    flagged = lookup(cleaned, taken("login_phone", "phone", "phone_taken"), "phone")
    flagged = lookup(flagged, taken("username", "username", "username_taken"), "username")
    required = ("first_name", "phone", "username", "password", "confirm_password")
    blank = reduce(lambda a, b: a | b, (F.col(c) == "" for c in required))
    outcome = (
        F.when(~F.coalesce("role", F.lit("")).isin(*ROLES), "ROLE")
        .when(blank, "REQUIRED")
        .when(F.col("password") != F.col("confirm_password"), "MISMATCH")
        .when(F.length("password") < SHORTEST_PASSWORD, "SHORT")
        .when(~F.col("phone").rlike(PHONE_FORM), "PHONE")
        .when(F.col("phone_taken").isNotNull(), "DUP_PHONE")
        .when(F.col("username_taken").isNotNull(), "DUP_USERNAME")
        .otherwise("OK")
    )
    return flagged.select(
        "application_id",
        "submitted_at",
        "role",
        "first_name",
        "last_name",
        "phone",
        "username",
        outcome.alias("outcome"),
    )


class Registration(NamedTuple):
    """New versions of PERSON and PHONE, what became of each application, and the added persons by themselves."""

    person: DataFrame
    phone: DataFrame
    outcome: DataFrame
    added: DataFrame


# Rounds that settle what no chain of applications holds up, rounds that thin a component too large for one row,
# and the most applications that one row holds.
ROUNDS, THINNING, COMPONENT = 2, 16, 2_000


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is accepted for sure, and what is not settled by that.

    Applications first in both their phone's and their username's group are certain, what shares a key with them is out.
    """
    by_phone = left.groupBy("phone").agg(F.min("first").alias("first_of_phone"))
    by_username = left.groupBy("username").agg(F.min("first").alias("first_of_username"))
    certain = (F.col("first") == F.col("first_of_phone")) & (F.col("first") == F.col("first_of_username"))
    judged = lookup(lookup(left, by_phone, "phone"), by_username, "username")
    judged = stored(judged.select("phone", "username", "first", certain.alias("certain")), "judged")
    accepted = judged.where("certain").select("phone", "username", "first")
    rest = (
        judged.where("not certain")
        .join(accepted.select("phone"), "phone", "left_anti")
        .join(accepted.select("username"), "username", "left_anti")
        .select("phone", "username", "first")
    )
    return accepted, rest


def _one_after_another(left: DataFrame) -> DataFrame:
    """The accepted applications of each component, a row of them at a time in the order of submission."""
    rows = F.sort_array(F.collect_list(F.struct("first", "phone", "username")))
    whole = left.groupBy("component").agg(rows.alias("rows"))
    none = F.expr("slice(rows, 1, 0)")

    def step(accepted: Column, row: Column) -> Column:
        clash = F.exists(accepted, lambda a: (a["phone"] == row["phone"]) | (a["username"] == row["username"]))
        return F.when(clash, accepted).otherwise(F.array_append(accepted, row))

    taken = whole.select(F.explode(F.aggregate("rows", none, step)).alias("row"))
    return taken.select("row.phone", "row.username", "row.first")


def _first_come(valid: DataFrame) -> DataFrame:
    """The applications that get their phone and username, as (phone, username, first).

    ``first`` is the application's (submitted_at, application_id). One at a time, an application would be accepted if no
    accepted one before it holds its phone or username. Nearly all are settled in :data:`ROUNDS` rounds. The rest are
    chains, in which a loser holds up the next: phones and usernames linked by an application make components, and
    each is folded by itself, so the number of jobs does not follow the length of a chain. (What is left of a batch often
    fits in one row; it needs no components then.) A component of more than
    :data:`COMPONENT` applications goes through further rounds, each of which settles its earliest
    application at least, until it is done or has come apart into smaller ones.
    """
    spark = valid.sparkSession
    moment = F.struct("submitted_at", "application_id")
    left = valid.groupBy("phone", "username").agg(F.min(moment).alias("first"))
    schema, path = left.schema, fresh_dir(spark, "accepted")
    rounds = ROUNDS
    while True:
        for _ in range(rounds):
            accepted, left = _round(left)
            accepted.write.mode("append").parquet(path)
            left = stored(left, "left")
            many = left.count()
            if many <= COMPONENT:
                if many:
                    # All of them fit in one row, whatever their components are.
                    _one_after_another(left.withColumn("component", F.lit("all"))).write.mode("append").parquet(path)
                return spark.read.schema(schema).parquet(path)
        phone, username = F.concat(F.lit("p"), "phone"), F.concat(F.lit("u"), "username")
        found = components(left.select(phone.alias("a"), username.alias("b"))).withColumnRenamed("node", "_key")
        left = stored(lookup(left.withColumn("_key", phone), found, "_key").drop("_key"), "components")
        sizes = left.groupBy("component").count()
        small = left.join(sizes.where(F.col("count") <= COMPONENT).select("component"), "component", "left_semi")
        _one_after_another(small).write.mode("append").parquet(path)
        left = left.join(sizes.where(F.col("count") > COMPONENT).select("component"), "component", "left_semi")
        left, rounds = left.drop("component"), THINNING
        if left.isEmpty():
            return spark.read.schema(schema).parquet(path)


def _judged(applications: DataFrame, person: DataFrame, identities: DataFrame | None) -> DataFrame:
    checked = cut(validate_registrations(applications, person, identities))
    accepted = _first_come(checked.where("outcome = 'OK'"))
    winners = accepted.select("phone", F.col("first").alias("holder"))
    moment = F.struct("submitted_at", "application_id")
    # The phone is looked at before the username, also against applications accepted earlier.
    valid_phone = F.col("outcome").isin("OK", "DUP_USERNAME")
    return lookup(checked, winners, "phone").withColumn(
        "outcome",
        F.when(valid_phone & (F.col("holder") < moment), "DUP_PHONE")
        .when((F.col("outcome") == "OK") & ~F.col("holder").eqNullSafe(moment), "DUP_USERNAME")
        .otherwise(F.col("outcome")),
    )


def registration_outcome(
    applications: DataFrame, person: DataFrame, identities: DataFrame | None = None
) -> DataFrame:
    """What became of each application. Runs jobs while it is built: the checked applications, the accepted ones and what
    :func:`_first_come` settles them by are tables in the shared folder."""
    columns = ("application_id", "submitted_at", "phone", "username", "outcome")
    return _judged(applications, person, identities).select(*columns)


def register(
    applications: DataFrame, person: DataFrame, phone: DataFrame, identities: DataFrame | None = None
) -> Registration:
    """Accept applications first come, first served on phone and username.

    New ids count up from the highest id in use, in the order of submission. Runs jobs while it is built, as
    :func:`registration_outcome` and the numbering do.
    """
    judged = _judged(applications, person, identities)
    outcome = judged.select("application_id", "submitted_at", "phone", "username", "outcome")
    rows = judged.where("outcome = 'OK'").drop("outcome", "holder")
    highest = person.agg(F.coalesce(F.max("person_id"), F.lit(0).cast("bigint"))).scalar()
    rows = numbered(rows, [F.col("submitted_at"), F.col("application_id")], "place")
    added = rows.select(
        (highest + F.col("place")).alias("person_id"),
        "first_name",
        blank_to_null("last_name").alias("last_name"),
        F.col("phone").alias("login_phone"),
        "username",
        "role",
    )
    new_phones = added.select(
        "person_id",
        F.col("login_phone").alias("phone_number"),
        F.lit("PERSONAL").alias("phone_type"),
        F.lit("YES").alias("is_primary"),
    )
    return Registration(
        person=person.unionByName(added, allowMissingColumns=True),
        phone=phone.unionByName(new_phones),
        outcome=outcome,
        added=added,
    )
