"""Registry and debarment checks of bids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import normalize

from . import resolve

#: Provider outcomes and the common status that they stand for.
PROVIDER_STATUS = {
    "ACTIVE": "VERIFIED", "CANCELLED": "INACTIVE", "SUSPENDED": "INACTIVE", "NOT_FOUND": "NOT_FOUND", "INVALID_FORMAT": "UNVERIFIED", "QUOTA_EXCEEDED": "REVIEW",
    "AUTH_FAILED": "REVIEW", "OUTAGE": "REVIEW", "TIMEOUT": "REVIEW", "RATE_LIMITED": "REVIEW", "MALFORMED": "REVIEW",
}


#: Of each registry: the status that a record which is not active stands for.
INACTIVE_AS = {"GST": "INACTIVE", "PAN": "INACTIVE", "UDYAM": "REVIEW", "ITD": "REVIEW", "MCA21": "INACTIVE", "NSIC": "INACTIVE", "OEM": "INACTIVE", "MII": "INACTIVE", "EPFO": "INACTIVE", "ESIC": "INACTIVE", "DPIIT": "INACTIVE"}


def keys(identities: DataFrame) -> DataFrame:
    """(bid_id, registry, identifier, other, expected_name): what each registry is asked for.

    A registration is asked for by its number, and by ``other`` where the number is not found:
    the holder's name, manufacturer and bidder, or bidder and product.
    """
    c = F.col
    ask = lambda registry, identifier, other=None: F.struct(F.lit(registry).alias("registry"), identifier.alias("identifier"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    name = c("expected_name")
    asked = [
        ask("GST", c("gstin")), ask("PAN", c("pan")), ask("UDYAM", c("udyam"), name), ask("ITD", c("itr_pan")), ask("MCA21", name), ask("NSIC", name),
        ask("OEM", c("authorization"), F.concat(F.lit("ACME:"), name)), ask("MII", c("declaration"), F.concat(name, F.lit(":GOODS"))),
        ask("EPFO", c("epfo")), ask("ESIC", c("esic")), ask("DPIIT", c("dpiit")),
    ]
    return identities.select("bid_id", "expected_name", F.explode(F.array(*asked)).alias("x")).select("bid_id", "x.*", "expected_name").filter("identifier is not null or other is not null")


def check(asked: DataFrame, records: DataFrame) -> DataFrame:
    """(bid_id, registry, identifier, holder, details, status) of ``asked`` against ``records`` (registry, key, holder, status, details).

    Not found, not active, another name, verified.
    """
    known = records.groupBy("registry", normalize.lookup_key(F.col("key")).alias("k")).agg(F.min_by(F.struct("holder", F.col("status").alias("state"), "details"), F.struct("holder", "status")).alias("r"))
    second = known.select("registry", F.col("k").alias("k2"), F.col("r").alias("r2"))
    keyed = asked.withColumns({"k": normalize.lookup_key(F.col("identifier")), "k2": normalize.lookup_key(F.col("other"))})
    # What has one key meets the records once, by that key; so no join has rows without a key, which would all come to one task.
    both = F.col("k").isNotNull() & F.col("k2").isNotNull()
    once = keyed.filter(~both).withColumn("k", F.coalesce("k", "k2")).drop("k2").join(known, ["registry", "k"], "left").withColumn("x", F.col("r"))
    twice = keyed.filter(both).join(known, ["registry", "k"], "left").join(second, ["registry", "k2"], "left").withColumn("x", F.coalesce("r", "r2"))
    shown = ("bid_id", "registry", "identifier", "expected_name", "x")
    found = once.select(*shown).unionByName(twice.select(*shown))
    # Names are read in a step of their own, and only where they decide: inside the conditions they make a method that is too long for the JVM to compile.
    decides = (F.col("x.state") == "ACTIVE") & F.col("expected_name").isNotNull()
    found = found.withColumns({"_a": F.when(decides, normalize.registry_name(F.col("x.holder"))), "_b": F.when(decides, normalize.registry_name(F.col("expected_name")))})
    a, b = F.col("_a"), F.col("_b")
    agrees = (a == b) | F.contains(a, b) | F.contains(b, a)
    idle = F.lit("INACTIVE")
    for name, status in INACTIVE_AS.items():
        idle = F.when(F.col("registry") == name, status).otherwise(idle)
    status = F.when(F.col("x").isNull(), "NOT_FOUND").when(F.col("x.state") != "ACTIVE", idle).when(F.col("expected_name").isNotNull() & ~agrees, "IDENTITY_MISMATCH").otherwise("VERIFIED")
    return found.select("bid_id", "registry", "identifier", "expected_name", F.col("x.holder").alias("holder"), F.col("x.details").alias("details"), status.alias("status"))


def is_debarred(identities: DataFrame, debarred: DataFrame) -> DataFrame:
    """(bid_id, debarred): by PAN, else by GSTIN, else by name."""
    out = identities.select("bid_id", "pan", "gstin", "expected_name")
    for mark, (mine, theirs) in {"_pan": ("pan", "pan"), "_gstin": ("gstin", "gstin"), "_name": ("expected_name", "entity_name")}.items():
        listed = debarred.filter(F.col(theirs).isNotNull()).select(normalize.lookup_key(F.col(theirs)).alias("k"), F.lit(True).alias(mark)).distinct()
        out = out.withColumn("k", normalize.lookup_key(F.col(mine))).join(listed, "k", "left").drop("k")
    return out.select("bid_id", F.coalesce("_pan", "_gstin", "_name", F.lit(False)).alias("debarred"))


def facts_of(checks: DataFrame) -> DataFrame:
    """(bid_id, registry, field, value): what verified records tell; other outcomes give no facts."""
    return checks.filter("status = 'VERIFIED'").select("bid_id", "registry", F.explode("details").alias("field", "value")).filter("value is not null")


# Of each provider of certificates, the fact that its answer gives and that fact's canonical field.
CERTIFIED = {
    "PAN": ("pan", "PAN"), "UDYAM": ("udyam_registration_number", "UDYAM_REGISTRATION_NUMBER"), "DPIIT": ("dpiit_recognition_number", "DPIIT_RECOGNITION_NUMBER"),
    "EPFO": ("epfo_establishment", "EPFO_ESTABLISHMENT"), "ESIC": ("esic_employer", "ESIC_EMPLOYER"),
}


def certificates(checks: DataFrame) -> DataFrame:
    """(bid_id, registry, field, canonical, value, status, confidence): one fact for each answer of a provider of certificates, whatever it is: the number that was asked for."""
    known = F.create_map(*[x for k, (field, canonical) in CERTIFIED.items() for x in (F.lit(k), F.struct(F.lit(field).alias("field"), F.lit(canonical).alias("canonical")))])
    told = checks.filter(F.col("registry").isin(*CERTIFIED)).withColumn("x", known[F.col("registry")])
    return told.select("bid_id", "registry", "x.field", "x.canonical", F.col("identifier").alias("value"), "status", F.when(F.col("status") == "VERIFIED", "HIGH").otherwise("LOW").alias("confidence"))


def common_status(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (.., outcome) with the status it stands for; unknown outcomes are for review."""
    names = outcomes.sparkSession.createDataFrame(list(PROVIDER_STATUS.items()), "outcome string, status string")
    return outcomes.join(F.broadcast(names), "outcome", "left").withColumn("status", F.coalesce("status", F.lit("REVIEW")))


# Classes of declared identifiers: canonical fields and names of fields.
DECLARED = {
    "REGULATORY": (("GSTIN", "PAN", "UDYAM_REGISTRATION", "CIN"), ("gstin", "pan", "udyam_registration", "cin")),
    "AUTHORIZATION": (("OEM_AUTHORIZATION_CODE", "AUTHORIZATION_CODE"), ("oem_authorization_code", "authorization_code", "oem_auth_code", "maf_code", "oem_authorization")),
    "DECLARATION": (("MII_DECLARATION",), ("mii", "mii_declaration", "mii_declaration_number", "mii_certificate")),
    "RETURN": (("ITR_ACK",), ("itr", "itr_ack", "itr_acknowledgement_number", "itr_ack_number")),
}
ASKED_CLASS = {"OEM": "AUTHORIZATION", "MII": "DECLARATION", "ITD": "RETURN"}


def undeclared(facts: DataFrame, checks: DataFrame) -> DataFrame:
    """(side, bid_id, class, id): NOT_CHECKED, declared regulatory identifiers that no registry was asked for; NOT_DECLARED, what one was asked for that the bid, which declares others of its class, does not declare."""
    kind = F.lit(None).cast("string")
    for name, (canonical, fields) in reversed(DECLARED.items()):
        kind = F.when(F.coalesce("canonical", F.lit("")).isin(*canonical) | F.lower("field").isin(*fields), name).otherwise(kind)
    clean = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    declared = resolve.with_canonical(facts, "field").select("bid_id", kind.alias("class"), clean("value").alias("id")).filter("class is not null and id <> ''").distinct()
    of = F.lit("REGULATORY")
    for name, asked in ASKED_CLASS.items():
        of = F.when(F.col("registry") == name, asked).otherwise(of)
    captured = checks.select("bid_id", of.alias("class"), clean("identifier").alias("id")).filter("id <> ''").distinct()
    missing = declared.filter("class = 'REGULATORY'").join(captured.select("bid_id", "id").distinct(), ["bid_id", "id"], "left_anti")
    extra = captured.join(declared.select("bid_id", "class").distinct(), ["bid_id", "class"], "left_semi").join(declared, ["bid_id", "class", "id"], "left_anti")
    return missing.select(F.lit("NOT_CHECKED").alias("side"), "bid_id", "class", "id").unionByName(extra.select(F.lit("NOT_DECLARED").alias("side"), "bid_id", "class", "id"))
