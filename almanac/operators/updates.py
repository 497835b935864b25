"""Changes to the stored tables: only buckets that hold changed companies are read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators import coverage, identity, metrics, pointintime
from almanac.session import cut_lineage
from almanac.sources import statements, store
from almanac.sources.keyed import KeyedTable


def append_facts(table: KeyedTable, candidates: DataFrame) -> DataFrame:
    """Appends the new facts; running it again adds nothing. Gives the (company, concept, year) groups with
    new rows, from the rows as they were appended."""
    added = table.append(store.new_facts(candidates, table.read_keys(candidates)), laid=True)
    return table.read_added(added).select(*pointintime.YEAR_KEY).distinct()


def relink_sources(table: KeyedTable, companies: DataFrame, documents: DataFrame) -> None:
    """Deepens the audit links of the companies that have new documents; others have none to join, so that
    buckets are relinked whole."""
    table.rewrite(documents.select("company_id"), lambda rows: identity.relink_sources(rows, companies, documents))


def refresh_metrics(table: KeyedTable, facts: KeyedTable, touched: DataFrame) -> None:
    """Makes the metrics rows of the touched companies anew, from their facts alone."""
    ids = touched.select("company_id").distinct()
    table.replace(ids, metrics.stored_metrics(facts.read(ids).join(ids, "company_id", "left_semi")))


def replace_flags(table: KeyedTable, flagged: DataFrame, checked: DataFrame) -> None:
    """Companies in ``checked`` (company_id, checked) keep only the flags just found, and have a new date of
    their last check.

    A flag row carries the date of its check; a company without a flag has one row without a concept, so
    that the date of its check is known too.
    """
    dated = flagged.join(checked.select("company_id", "checked"), "company_id")
    clean = checked.select("company_id", "checked").join(flagged.select("company_id"), "company_id", "left_anti")
    table.replace(checked, dated.unionByName(clean, allowMissingColumns=True))


def complete_selection(facts: DataFrame) -> DataFrame:
    """The current fact of every period, derived fourth quarters included."""
    return pointintime.latest(pointintime.with_derived_q4(facts))


def refresh_selection(table: KeyedTable, facts: KeyedTable, groups: DataFrame) -> None:
    """Selects and derives again what the (company, concept, year) groups hold; other groups aren't read
    beyond their bucket, and keep their rows."""
    groups = groups.select(*pointintime.YEAR_KEY).distinct()
    own = facts.read_keys(groups).join(groups, pointintime.YEAR_KEY, "left_semi")
    table.replace(groups, complete_selection(own), on=pointintime.YEAR_KEY, laid=True)


def ingest_baseline(universe: DataFrame, ciks: DataFrame, payloads: DataFrame, companies: KeyedTable, facts: KeyedTable,
                    metrics_table: KeyedTable, new_id: Column, quarterly: bool = False) -> DataFrame:
    """The second source's companies, their facts and metrics in one job; gives the companies it touched.

    Companies of the ``universe`` that are listed filers (``ciks``) and have no facts yet are wanted. Of
    those whose statements (ticker, page, payload) hold facts, the ones without a company row (by cik) get
    one, with the id ``new_id`` made of their columns; the facts are appended, and the metrics of the
    companies made. A company without facts gets no row. Run again, it finds nothing wanted.
    """
    stored = companies.read()
    wanted = coverage.baseline_worklist(identity.universe_match(universe, ciks), stored, facts.read())
    known = stored.select("cik", F.col("id").alias("known_id"))
    wanted = cut_lineage(wanted.join(known, "cik", "left").withColumn("company_id", F.coalesce("known_id", new_id)))
    own = payloads.select(F.upper("ticker").alias("ticker"), "page", "payload").join(wanted.select("ticker", "company_id"), "ticker")
    rows = statements.baseline_facts(own.select("company_id", "page", "payload"), wanted.select("company_id", "cik"), quarterly)
    rows = cut_lineage(rows.select(*store.FACT_COLUMNS))
    filled = wanted.join(rows.select("company_id"), "company_id", "left_semi")
    fresh = filled.where("known_id is null").select(
        F.col("company_id").alias("id"), "cik", "ticker", F.substring("name", 1, 255).alias("name"), F.lit(None).cast("string").alias("sic"),
        F.substring("sector", 1, 64).alias("sector"))
    present = {f.name for f in companies.schema}
    companies.append(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).alias(c) for c in present]))
    append_facts(facts, rows.withColumn("arrival", F.lit(0)))
    touched = filled.select("company_id").distinct()
    refresh_metrics(metrics_table, facts, touched)
    return touched
