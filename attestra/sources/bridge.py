"""Requirements, facts and registries derived from the order tables.

Orders stand for bids, their priorities for tenders, order lines for submitted documents,
suppliers for registered companies.  Every view is a DataFrame over the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

REFERENCE_DATE = "1995-06-17"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

#: By field: operator and expected value in each of the five tenders, category, whether mandatory.
_CLAUSES = {
    "turnover_cr": (((">=", "2 crore"), (">", "Rs. 2 crore"), ("<", "400 lakh"), ("==", "3 crore"), ("!=", "1 crore")), "FINANCIAL_CAPACITY", True),
    "warranty_years": (((">=", "2 years"), ("<=", "36 months"), ("==", "three years"), (">=", "18 months"), ("BETWEEN", "1 to 4")), "WARRANTY", True),
    "delivery_days": ((("<=", "60 days"), (">=", "20 days"), ("BETWEEN", "20-70"), ("<", "50"), ("<=", "45 days")), "DELIVERY", False),
    "valid_until": ((("VALID_ON", None), ("AFTER", "1994-01-01"), ("BEFORE", "01/01/1997"), (">=", "1995-06-01"), ("VALID_ON", None)), "CERTIFICATION", False),
    "iso_cert": ((("==", "Yes"), ("IN", "Yes, Exempt"), ("NOT_IN", "No"), ("EXISTS", None), ("!=", "No")), "CERTIFICATION", False),
    "is_mse": ((("EXISTS", None), ("==", "Y"), ("IN", "Y,N"), ("EXISTS", None), ("~~", "x")), "OTHER", False),
    "gstin": ((("MATCHES", "^[0-9]{2}abcde"), ("CONTAINS", "abcde00"), ("EXISTS", None), ("MATCHES", "F1Z[0-4]$"), ("NOT_IN", "08ABCDE0007F1Z7")), "STATUTORY", True),
    "company_name": ((("CONTAINS", "supplier"), ("EXISTS", None), ("MATCHES", "pvt|ltd"), ("CONTAINS", "0000"), ("MATCHES", "[unclosed")), "STATUTORY", False),
    "past_experience": ((("EXISTS", None), (">=", "3 years"), ("EXISTS", None), (">=", "1"), ("EXISTS", None)), "EXPERIENCE", True),
}
REQUIREMENT_SCHEMA = (
    "requirement_id string, tender_id string, category string, field string, operator string, expected_value string, mandatory boolean, source_type string, source_priority int, mse_exemption_allowed boolean, "
    "require_explicit_claim boolean, app_status string, startup_exemption_allowed boolean, tender_category string, applicable_categories string, applicable_roles string, mandate_for_all_sizes boolean"
)
SOURCE_PRIORITIES = {"GTC": 1, "STC": 2, "ATC": 3}
TENDER_CATEGORIES = ("GOODS", "SERVICES", "WORKS", "GOODS", "")


def requirement_rows() -> list[tuple]:
    """The clauses of the five tenders; lists of categories and roles are comma-joined."""
    rows = []

    def add(t: int, number: str, category: str, field: str, op: str, expected: str | None, mandatory: bool, *, source: str = "STC", priority: int = 2, mse: bool = False, startup: bool = False, status: str | None = None, categories: str | None = None, roles: str | None = None, all_sizes: bool = False) -> None:
        rows.append((f"T{t + 1}-{number}", PRIORITIES[t], category, field, op, expected, mandatory, source, priority, mse, t == 1 or (startup and t == 4), status, startup, TENDER_CATEGORIES[t], categories, roles, all_sizes))

    for t in range(len(PRIORITIES)):
        for k, (field, (clauses, category, mandatory)) in enumerate(_CLAUSES.items(), 1):
            op, expected = clauses[t]
            name = "annual_revenue" if field == "turnover_cr" and t == 4 else field  # another name of the same field
            add(t, f"R{k:02d}", category, name, op, expected, mandatory and (t + k) % 4 != 0, mse=field == "turnover_cr" and t < 3, startup=field in ("turnover_cr", "past_experience") and t > 2, status="UNKNOWN" if field == "company_name" and t == 3 else None)
        add(t, "R51", "FINANCIAL_CAPACITY", "turnover_cr", ">=", "1 crore", True, source="GTC", priority=0)
        add(t, "R52", "WARRANTY", "warranty_years", ">=", "1 year", True, source="GTC", priority=0)
        if t % 2:
            add(t, "R53", "DELIVERY", "delivery_days", "<=", "50 days", True, source="ATC", priority=0)
        if t == 4:
            add(t, "R54", "OEM_AUTHORIZATION", "oem_authorization", "EXISTS", None, False, status="NOT_APPLICABLE")
        else:
            add(t, "R54", "OEM_AUTHORIZATION", "oem_authorization", "EXISTS", None, False)
        add(t, "R55", "EPFO_COMPLIANCE", "epfo_registration", "EXISTS", None, t % 2 == 0, all_sizes=t == 3)
        add(t, "R56", "ESIC_COMPLIANCE", "esic_registration", "EXISTS", None, False)
        add(t, "R57", "OTHER", "local_content_percent", ">=", "50", False, categories="GOODS,WORKS")
        add(t, "R58", "OTHER", "local_support", "EXISTS", None, False, roles="RESELLER,DISTRIBUTOR")
        add(t, "R59", "STATUTORY", "pan", "MATCHES", "^[A-Z]{5}", False)
        add(t, "R60", "STATUTORY", "debarment_declaration", "EXISTS", None, False)
        add(t, "R61", "STATUTORY", "dpiit_number", "MATCHES", "^DIPP", False)
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(requirement_rows(), REQUIREMENT_SCHEMA)


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bid_id, tender_id, truth): orders that have lines; written once."""

    def build() -> DataFrame:
        truth = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("UNCERTAIN")
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bid_id"), F.col("o_orderpriority").alias("tender_id"), truth.alias("truth"))
        return orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bid_id")).hint("merge"), "bid_id", "left_semi")  # keys alone look small enough to be broadcast, and are not

    return tables.once(spark, sf_dir, "bids", build)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their position in the bid; suppliers are few and joined by broadcast if small."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bid_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    place = F.row_number().over(Window.partitionBy("bid_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))  # by the name that all later steps group by
    return items.join(names, "l_suppkey").withColumn("line_no", place)


def gstin_of(supplier):
    k = F.col(supplier) if isinstance(supplier, str) else supplier
    return F.concat(F.lpad((k % 37 + 1).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad(k.cast("string"), 4, "0"), F.lit("F1Z"), (k % 10).cast("string"))


def udyam_of(supplier: str) -> Column:
    return F.concat(F.lit("UDYAM-MH-12-"), F.lpad(F.col(supplier).cast("string"), 7, "0"))


def epfo_of(supplier: str) -> Column:
    return F.concat(F.lit("MHBAN"), F.lpad(F.col(supplier).cast("string"), 7, "0"))


def esic_of(supplier: str) -> Column:
    return F.concat(F.lit("31"), F.lpad(F.col(supplier).cast("string"), 8, "0"))


def pan_of(supplier: str) -> Column:
    return F.substring(gstin_of(supplier), 3, 10)


#: What documents state; each is a column of ``pages``.
FIELDS = ("turnover_cr", "warranty_years", "delivery_days", "valid_until", "iso_cert", "is_mse", "gstin", "company_name", "pan", "employee_count", "bidder_role", "is_startup", "dpiit_number", "udyam_registration", "msme_number", "epfo_code", "esic_code", "annual_turnover")


def pages(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row a document: bid_id, source_document, page, extraction_confidence, fact_seq, and ``_<field>`` with what it states, null if nothing.

    Each line is a document with its own statements; the first also declares who the bidder is.
    Lines are dealt out by bid once and stay so, in order, so that what is made of a bid needs no other shuffle or sort.
    """
    n = lambda c: c.cast("string")
    q, years = F.col("l_quantity").cast("int") % 5 + 1, F.col("l_partkey") % 5 + 1
    odd, first = F.col("line_no") % 2 == 1, F.col("line_no") == 1
    ship, day = F.col("ship"), F.col("day")
    certificate = F.concat(F.lit('{"issue_date":"'), F.col("issued"), F.lit('","expiry_date":"'), day, F.lit('","valid":'), F.when(F.col("l_partkey") % 15 == 0, "false").otherwise("true"), F.lit("}"))
    role = F.col("l_partkey") % 4
    values = {
        "turnover_cr": F.when(odd, F.concat(n(q), F.lit(" crore"))).otherwise(F.concat(n(q * 100), F.lit(" lakh"))),
        "warranty_years": F.when(odd, F.concat(n(years), F.lit(" years"))).otherwise(F.concat(n(years * 12), F.lit(" months"))),
        "delivery_days": F.concat(n((F.col("l_partkey") + F.col("l_suppkey")) % 60 + 15), F.lit(" days")),
        "valid_until": F.when(F.col("l_partkey") % 5 == 0, certificate).when(odd, day).otherwise(F.date_format(ship, "dd-MM-yyyy")),
        "iso_cert": F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "No").otherwise("Not available"),
        "is_mse": F.when(F.col("l_linestatus") == "O", "Y").otherwise("N"),
        "gstin": F.col("own_gstin"),
        "company_name": F.concat("s_name", F.when(F.col("line_no") % 3 == 0, " Private Limited").when(F.col("line_no") % 3 == 1, " Pvt. Ltd.").otherwise("")),
        "pan": F.when(first, F.substring("own_gstin", 3, 10)).when(F.col("line_no") == 2, F.concat(F.lit("ZZZZZ"), F.substring("own_gstin", 8, 5))),
        "employee_count": F.when(first, F.when(F.col("l_partkey") % 23 == 0, "about 30").otherwise(n(F.col("l_quantity").cast("int") % 40))),
        "bidder_role": F.when(first, F.when(role == 0, "OEM").when(role == 1, "reseller").when(role == 2, "Trader").otherwise("")),
        "is_startup": F.when(first, F.when(F.col("l_suppkey") % 3 == 0, "Yes").when(F.col("l_suppkey") % 3 == 1, "No")),
        "dpiit_number": F.when(first & (F.col("l_suppkey") % 6 == 0), F.concat(F.lit("DIPP"), n(F.col("l_suppkey")))),
        "udyam_registration": F.when(first & (F.col("l_suppkey") % 4 != 0), udyam_of("l_suppkey")),
        "msme_number": F.when(first & (F.col("l_suppkey") % 12 == 0), udyam_of("l_suppkey")),
        "epfo_code": F.when(first & (F.col("l_suppkey") % 5 != 0), epfo_of("l_suppkey")),
        "esic_code": F.when(first & (F.col("l_suppkey") % 7 != 0), esic_of("l_suppkey")),
        "annual_turnover": F.when((F.col("line_no") == 2) & (F.col("l_partkey") % 9 == 0), F.concat(n(q + 1), F.lit(" crore"))),
    }
    shipped = F.to_date("l_shipdate")
    drawn = lines(spark, sf_dir).withColumn("ship", shipped).withColumns({"day": F.date_format("ship", "yyyy-MM-dd"), "issued": F.date_format(F.date_sub("ship", 200), "yyyy-MM-dd"), "own_gstin": gstin_of("l_suppkey")})
    where = {"bid_id": F.col("bid_id"), "source_document": F.concat(F.lit("D"), F.col("l_linenumber").cast("string")), "page": F.col("line_no"), "extraction_confidence": F.when(F.col("l_tax") > 0.07, "LOW").otherwise("HIGH")}
    return drawn.select(*[c.alias(k) for k, c in where.items()], F.col("line_no").alias("fact_seq"), *[values[f].alias(f"_{f}") for f in fields])


def facts(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Long facts: bid_id, field, value, source_document, page, extraction_confidence, fact_seq; of ``fields`` alone.

    Facts are not written: they are ten times the lines.
    """
    # Values are columns of a step of their own: worked out inside the array they make one method that is too long for the JVM to compile.
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value")) for f in fields]))
    where = ("bid_id", "source_document", "page", "extraction_confidence", "fact_seq")
    return pages(spark, sf_dir, fields).select(*where, each.alias("f")).filter("f.value is not null").select("bid_id", "f.field", "f.value", "source_document", "page", "extraction_confidence", "fact_seq")


#: The registries, each a part of the suppliers: its key, who is left out, and which statuses records have.
REGISTRIES = ("GST", "PAN", "UDYAM", "ITD", "MCA21", "NSIC", "OEM", "MII", "EPFO", "ESIC", "DPIIT")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(registry, key, holder, status, details): the records of all registries.

    ``details`` are what a verified record tells beside its key and holder.
    """
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    other = F.when(k % 13 == 0, F.concat(F.lit("Other "), text(k))).otherwise(F.col("s_name"))
    low = F.col("s_acctbal") < 0
    details = lambda **c: F.create_map(*[x for name, v in c.items() for x in (F.lit(name), v.cast("string"))])
    record = lambda name, key, status, facts, left_out: F.when(~left_out, F.struct(F.lit(name).alias("registry"), key.alias("key"), other.alias("holder"), status.alias("status"), facts.alias("details")))
    active = lambda bad, word: F.when(bad, word).otherwise("ACTIVE")
    records = [
        record("GST", gstin_of("s_suppkey"), active(low, "CANCELLED"), details(gstin=gstin_of("s_suppkey"), legal_name=F.col("s_name"), gst_status=F.lit("ACTIVE"), taxpayer_type=F.when(k % 2 == 0, "Regular").otherwise("Composition"), registration_date=F.when(k % 3 != 0, "2017-07-01"), pan=pan_of("s_suppkey"), gst_filing_compliance=F.concat(F.lit("TOTAL_FILED_"), text(k % 12))), k % 17 == 0),
        record("PAN", pan_of("s_suppkey"), active(k % 19 == 0, "INACTIVE"), details(pan=pan_of("s_suppkey")), k % 23 == 0),
        record("UDYAM", udyam_of("s_suppkey"), active(k % 11 == 0, "SUSPENDED"), details(udyam_registration=udyam_of("s_suppkey"), is_mse=F.lit(True)), k % 7 == 0),
        record("ITD", pan_of("s_suppkey"), active(k % 5 == 0, "NOT_FILED"), details(itr_filing_status=F.lit("FILED"), itr_ack_number=F.concat(F.lit("ACK"), text(k)), turnover_cr=k % 9 + 1), k % 10 == 0),
        record("MCA21", F.col("s_name"), active(k % 8 == 0, "STRUCK_OFF"), details(cin=F.concat(F.lit("U"), F.lpad(text(k), 5, "0"), F.lit("MH")), legal_name=other, mca_status=F.lit("ACTIVE")), k % 9 == 0),
        record("NSIC", F.col("s_name"), active(k % 6 == 0, "EXPIRED"), details(nsic_registration=F.concat(F.lit("NSIC"), text(k)), is_mse=F.lit(True)), k % 4 == 0),
        record("OEM", F.concat(F.lit("ACME:"), F.col("s_name")), active(k % 12 == 0, "EXPIRED"), details(oem_authorization=F.concat(F.lit("MAF"), text(k)), oem_authorized=F.lit(True)), k % 5 == 0),
        record("EPFO", epfo_of("s_suppkey"), active(k % 16 == 0, "INACTIVE"), details(epfo_establishment=epfo_of("s_suppkey")), k % 21 == 0),
        record("ESIC", esic_of("s_suppkey"), active(k % 22 == 0, "INACTIVE"), details(esic_employer=esic_of("s_suppkey")), k % 18 == 0),
        record("DPIIT", F.concat(F.lit("DIPP"), text(k)), active(k % 18 == 0, "EXPIRED"), details(dpiit_recognition_number=F.concat(F.lit("DIPP"), text(k)), is_startup=F.lit(True)), k % 12 == 0),
        record("MII", F.concat(F.col("s_name"), F.lit(":GOODS")), active(k % 14 == 0, "INVALID"), details(local_content_percent=k % 60 + 20, mii_declaration=F.concat(F.lit("MII"), text(k))), k % 3 == 0),
    ]
    return table(spark, sf_dir, "supplier").select(F.explode(F.array_compact(F.array(*records))).alias("r")).select("r.*")


def debarred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pan, gstin, entity_name): some entries name one of the three only."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(k % 29 == 0).select(F.when(k % 2 == 0, pan_of("s_suppkey")).alias("pan"), F.when(k % 3 == 0, gstin_of("s_suppkey")).alias("gstin"), F.when((k % 2 != 0) & (k % 3 != 0), F.col("s_name")).alias("entity_name"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of documents: doc_id, page_number, position, block_id, text."""
    flat = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    page = (F.col("position") / 10).cast("int") + 1
    return flat.select("doc_id", "lang", page.alias("page_number"), "position", F.format_string("%d-p%d-b%d", "doc_id", page, "position").alias("block_id"), "text")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of the bids' documents, one a line: doc_id (the bid), page_number, block_id, text; what they say is what the lines hold."""
    n = lambda c: c.cast("string")
    years, crore = F.col("l_partkey") % 5 + 1, F.col("l_quantity").cast("int") % 5 + 1
    said = F.concat(
        F.lit("Warranty period: "), n(years), F.lit(" years. Turnover: Rs. "), n(crore), F.lit(" crore. Delivery: "), n(F.col("l_partkey") % 60 + 15), F.lit(" days. GSTIN "), gstin_of("l_suppkey"), F.lit(", PAN "), pan_of("l_suppkey"),
        F.when(F.col("l_partkey") % 3 == 0, ". ISO 9001:2015 certified").otherwise(". Not certified"), F.when(F.col("l_partkey") % 4 == 0, "; local support available.").otherwise("."),
    )
    return lines(spark, sf_dir).select(F.col("bid_id").alias("doc_id"), F.col("line_no").alias("page_number"), F.concat(F.lit("s"), n(F.col("line_no"))).alias("block_id"), said.alias("text"), "l_partkey", "l_suppkey", "l_quantity", "s_name")
