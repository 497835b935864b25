"""Company-fact payloads (tag -> unit -> entries) to labelled fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac import dims, fixed
from almanac.functions import links, periods

# Tags and units are data, so both levels are maps and the schema is never inferred.
PAYLOAD = ("struct<facts: map<string, map<string, struct<units: map<string, array<struct<"
           "val: double, start: string, end: string, accn: string, form: string, filed: string>>>>>>>")


DAY = "yyyy-MM-dd"


def reported_entries(payloads: DataFrame) -> DataFrame:
    """One row per reported entry of (company_id, page, payload), its dates as the payload writes them.

    Entries without a value and units other than money, shares and money per share are left out. The
    three positions keep the arrival order for the first-wins append. The outer explode keeps Spark from
    testing below it that there is something to explode, for which every payload would be parsed again.
    """
    tags = (payloads
            .select("company_id", "page", F.from_json("payload", PAYLOAD)["facts"]["us-gaap"].alias("gaap"))
            .select("company_id", "page", F.posexplode_outer("gaap").alias("tag_no", "tag", "body"))
            .filter(F.col("tag_no").isNotNull()))
    units = (tags
             .select("company_id", "page", "tag_no", "tag",
                     F.posexplode("body.units").alias("unit_no", "unit", "entries"))
             .filter(F.col("unit").isin(fixed.ALLOWED_UNITS)))
    return (units
            .select("company_id", "page", "tag_no", "tag", "unit_no", "unit",
                    F.posexplode("entries").alias("entry_no", "entry"))
            .filter(F.col("entry.val").isNotNull())
            .select("company_id", "page", "tag_no", "unit_no", "entry_no", "tag", "unit",
                    F.col("entry.val").alias("value"),
                    F.col("entry.start").alias("start_date"), F.col("entry.end").alias("end_date"),
                    F.col("entry.accn").alias("accession_number"),
                    F.coalesce("entry.form", F.lit("")).alias("form"),
                    F.col("entry.filed").alias("filed_date")))


def _dated(entries: DataFrame) -> DataFrame:
    """Entries with their dates read; blank and unreadable ones are null."""
    written = [f.name for f in entries.schema if f.name.endswith("_date") and f.dataType.simpleString() == "string"]
    return entries.withColumns({c: F.try_to_date(c, DAY) for c in written}) if written else entries


def flatten_facts(payloads: DataFrame) -> DataFrame:
    """``reported_entries`` with dates; ``rejected_payloads`` tells what could not be read at all."""
    return _dated(reported_entries(payloads))


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """(company_id, page, reason) of payloads that give no facts, or whose entries have unreadable dates."""
    parsed = payloads.select("company_id", "page", "payload", F.from_json("payload", PAYLOAD)["facts"]["us-gaap"].alias("gaap"))
    broken = F.col("payload").isNull() | F.try_parse_json("payload").isNull()
    units = F.flatten(F.transform(F.map_values("gaap"), lambda tag: F.map_values(tag["units"])))
    entries = F.flatten(F.filter(units, lambda list_: list_.isNotNull()))

    def unreadable(day: Column) -> Column:
        return (F.coalesce(day, F.lit("")) != "") & F.try_to_date(day, DAY).isNull()

    bad = F.exists(entries, lambda e: unreadable(e["start"]) | unreadable(e["end"]) | unreadable(e["filed"]))
    reason = (F.when(broken, "not readable as JSON").when(F.col("gaap").isNull(), "no facts in it")
              .when(F.coalesce(bad, F.lit(False)), "unreadable date"))
    return parsed.select("company_id", "page", reason.alias("reason")).filter(F.col("reason").isNotNull())


def classify_tags(entries: DataFrame) -> DataFrame:
    """Adds canonical_concept, priority and is_flow; unmapped tags are dropped."""
    return entries.join(F.broadcast(dims.tags(entries.sparkSession)), "tag")


def label_facts(entries: DataFrame, companies: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Classified entries with fiscal labels and audit links, in the stored fact layout.

    ``companies`` gives cik and fye_month per id. ``documents`` (company_id, accession_number,
    document) deepens the links where a filing's document is known. Entries whose dates are still text
    are read after the tags have left out most of them.
    """
    calendar = companies.select(F.col("id").alias("company_id"), "cik", "fye_month")
    labelled = (_dated(classify_tags(entries))
                .join(calendar, "company_id")
                .withColumn("fiscal_period", periods.period_label(
                    F.col("start_date"), F.col("end_date"), F.col("is_flow"), F.col("fye_month")))
                .filter(F.col("fiscal_period").isNotNull())
                .withColumn("fiscal_year", periods.fiscal_year(F.col("end_date"), F.col("fye_month"))))
    if documents is None:
        labelled = labelled.withColumn("document", F.lit(None).cast("string"))
    else:
        labelled = labelled.join(documents, ["company_id", "accession_number"], "left")
    return labelled.select(
        "company_id", F.col("tag").alias("concept"), "canonical_concept", "unit", "value",
        "fiscal_year", "fiscal_period", "start_date", "end_date", "form", "accession_number",
        "filed_date",
        links.audit_url(F.col("cik"), F.col("accession_number"), F.col("document")).alias("source_url"),
        F.lit(False).alias("derived"),
        F.struct("page", "tag_no", "unit_no", "entry_no").alias("arrival"))
