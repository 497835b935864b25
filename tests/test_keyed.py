"""Stored tables in buckets: changes touch only their buckets, and end in one step."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from almanac.operators import identity, metrics, pointintime, reconcile, templates, updates
from almanac.plans import domain
from almanac.sources import keyed, store
from tests.test_facts import FACT, random_facts

ROW = "company_id long, name string"


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "table"), ROW, ["company_id"], buckets=8, compact_at=3)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, ROW)


def read(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes(spark, table):
    assert read(table.read()) == [] and table.marks() == {}
    table.append(rows(spark, [(n, "a") for n in range(20)] + [(None, "none")]), mark=("w", 4))
    table.append(rows(spark, [(3, "b"), (50, "c")]))
    table.replace(rows(spark, [(3, ""), (4, ""), (99, ""), (None, "")]), rows(spark, [(4, "new"), (4, "newer"), (77, "extra")]))
    table.update(rows(spark, [(5, "")]), lambda df: df.withColumn("name", F.upper("name")))
    want = [(n, "a") for n in range(20) if n not in (3, 4, 5)] + [(50, "c"), (4, "new"), (4, "newer"), (77, "extra"), (5, "A")]
    assert read(table.read()) == sorted(want, key=repr)
    assert table.marks() == {"w": 4}
    table.append(rows(spark, []))
    assert read(table.read()) == sorted(want, key=repr)


def test_only_buckets_of_the_keys_are_read_and_written(spark, table):
    table.append(rows(spark, [(n, "a") for n in range(100)]))
    before = table._manifest()[1]["buckets"]
    keys = rows(spark, [(7, "")])
    own = {str(r[0]) for r in keys.select(table.bucket_of()).collect()}
    files = table.read(keys).inputFiles()
    assert files and all(f"_bucket={next(iter(own))}/" in f for f in files)
    table.replace(keys, rows(spark, [(7, "x")]))
    after = table._manifest()[1]["buckets"]
    assert {b for b in before if before[b] != after[b]} == own


def test_a_write_killed_half_way_changes_nothing(spark, table, monkeypatch):
    table.append(rows(spark, [(n, "a") for n in range(10)]))
    old = table.read()

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", killed)
        for change in (lambda: table.append(rows(spark, [(1, "lost")])), lambda: table.replace(rows(spark, [(1, "")]), rows(spark, []))):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert read(table.read()) == read(old) == [(n, "a") for n in range(10)]
    table.replace(rows(spark, [(1, "")]), rows(spark, [(1, "b")]))
    assert read(old) == [(n, "a") for n in range(10)]  # a reader of the old state is not disturbed
    table.vacuum(keep=1)
    assert len(table._versions()) == 1 and len(table._listed("data")) == 2
    assert read(table.read()) == sorted([(n, "a") for n in range(10) if n != 1] + [(1, "b")])


def test_the_second_of_two_changes_fails(spark, table, monkeypatch):
    table.append(rows(spark, [(1, "a")]))
    other = keyed.KeyedTable(spark, table.path, ROW, ["company_id"], buckets=8)
    whole = other._write

    def meanwhile(df):
        monkeypatch.setattr(other, "_write", whole)
        table.append(rows(spark, [(2, "b")]))
        return whole(df)

    monkeypatch.setattr(other, "_write", meanwhile)
    with pytest.raises(keyed.ConcurrentChange):
        other.append(rows(spark, [(3, "c")]))
    assert read(table.read()) == [(1, "a"), (2, "b")]
    other.append(rows(spark, [(3, "c")]))
    assert read(table.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_buckets_are_compacted(spark, table):
    for n in range(7):
        table.append(rows(spark, [(1, f"v{n}"), (n, "x")]))
    assert all(len(parts) < 3 for parts in table._manifest()[1]["buckets"].values())
    assert read(table.read()) == sorted([(1, f"v{n}") for n in range(7)] + [(n, "x") for n in range(7)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_append_and_refresh_equal_a_rebuild(spark, tmp_path, seed):
    facts = spark.createDataFrame(random_facts(seed), FACT)
    draw = random.Random(seed)
    stored = keyed.KeyedTable(spark, str(tmp_path / "facts"), facts.schema, ["company_id"], buckets=4)
    selected = keyed.KeyedTable(spark, str(tmp_path / "selected"), facts.schema, ["company_id"], buckets=4)
    all_rows = facts.collect()
    draw.shuffle(all_rows)
    for start in range(0, len(all_rows), 150):
        batch = spark.createDataFrame(all_rows[:20] + all_rows[start:start + 150], facts.schema).withColumn("arrival", F.monotonically_increasing_id())
        updates.refresh_selection(selected, stored, updates.append_facts(stored, batch))
    assert read(stored.read().select(*store.FACT_KEY)) == read(facts.select(*store.FACT_KEY).distinct())
    assert read(selected.read()) == read(updates.complete_selection(stored.read()))
    again = facts.withColumn("arrival", F.monotonically_increasing_id())
    assert updates.append_facts(stored, again).isEmpty()


@pytest.fixture
def written(spark, monkeypatch):
    """The plans of what is written to stored tables, where nothing is small enough to be broadcast by itself."""
    plans, write = [], keyed.KeyedTable._write

    def watched(table, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(table, rows)

    monkeypatch.setattr(keyed.KeyedTable, "_write", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield plans
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_laid_rows_are_written_without_an_exchange(spark, table, written):
    added = table.append(rows(spark, [(n, "a") for n in range(20)]).repartition(3), laid=True)
    table.append(rows(spark, [(1, "b")]))
    assert "REBALANCE" not in written[0] and "REBALANCE" in written[1]
    assert read(table.read_added(added)) == sorted([(n, "a") for n in range(20)], key=repr)
    assert read(table.read()) == sorted([(n, "a") for n in range(20)] + [(1, "b")], key=repr)


def test_relinked_facts_are_dealt_out_once(spark, tmp_path, written):
    """They were compared with the companies twice, and dealt to their buckets before each write."""
    facts = spark.createDataFrame(random_facts(6), FACT)
    facts = facts.unionByName(facts.limit(3).withColumn("company_id", F.lit(None).cast("long"))).cache()
    companies = facts.select(F.col("company_id").alias("id"), F.lpad(F.col("company_id").cast("string"), 10, "0").alias("cik")).distinct()
    documents = facts.where("company_id = 1 and accession_number <> 'simfin-baseline'").select("company_id", "accession_number").distinct() \
        .withColumn("document", F.lit("d.htm"))
    stored = keyed.KeyedTable(spark, str(tmp_path / "facts"), facts.schema, ["company_id"], buckets=4)
    stored.append(facts, laid=True)
    updates.relink_sources(stored, companies, documents)
    assert "LeftSemi" not in written[-1] and "LeftAnti" not in written[-1] and "REBALANCE" not in written[-1]
    got = stored.read()
    assert got.where("source_url like '%d.htm'").count() > 0
    assert read(got) == read(identity.relink_sources(facts, companies, documents))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_few_keys_go_to_the_rows(spark, tmp_path, monkeypatch, written, few):
    """All stored facts were dealt out anew to find those of the groups, and of the keys already stored."""
    monkeypatch.setattr(keyed, "FEW_KEYS", few)
    facts = spark.createDataFrame(random_facts(7), FACT)
    late = (F.col("company_id") == 1) & (F.col("fiscal_year") % 2 == 0)
    stored = keyed.KeyedTable(spark, str(tmp_path / "facts"), facts.schema, ["company_id"], buckets=4)
    selected = keyed.KeyedTable(spark, str(tmp_path / "selected"), facts.schema, ["company_id"], buckets=4)
    first = store.new_facts(facts.where(~late).withColumn("arrival", F.lit(0)), spark.createDataFrame([], facts.schema)).cache()
    stored.append(first)
    selected.append(updates.complete_selection(stored.read()))
    arrived = facts.where(late).withColumn("arrival", F.lit(0))
    groups = updates.append_facts(stored, arrived)
    assert read(groups) == read(facts.where(late).select(*pointintime.YEAR_KEY).distinct())
    updates.refresh_selection(selected, stored, groups)
    assert all(("BroadcastHashJoin" in plan) == bool(few) for plan in written[-2:])
    assert read(selected.read()) == read(updates.complete_selection(stored.read()))


def test_metrics_of_touched_companies(spark, tmp_path):
    facts = spark.createDataFrame(random_facts(5), FACT)
    stored = keyed.KeyedTable(spark, str(tmp_path / "facts"), facts.schema, ["company_id"])
    stored.append(facts)
    full = metrics.stored_metrics(facts)
    table = keyed.KeyedTable(spark, str(tmp_path / "metrics"), full.schema, ["company_id"])
    table.append(full.withColumn("revenue", F.when(F.col("company_id") == 1, -1.0).otherwise(F.col("revenue"))))
    updates.refresh_metrics(table, stored, spark.createDataFrame([(1,), (1,)], "company_id long"))
    assert read(table.read()) == read(full)


def test_flags_of_checked_companies(spark, tmp_path):
    flag = "company_id long, canonical_concept string, fiscal_year int, our_value double, reference_value double, variance double"
    table = keyed.KeyedTable(spark, str(tmp_path / "flags"), flag + ", checked date", ["company_id"])
    old, new = date(2024, 1, 1), date(2024, 2, 1)
    table.append(spark.createDataFrame([(c, "revenue", 2020, 1.0, 2.0, 1.0, old) for c in (1, 2, 3)], table.schema))
    found = spark.createDataFrame([(1, "capex", 2021, 1.0, 3.0, 2.0), (1, "revenue", 2021, 1.0, 3.0, 2.0)], flag)
    updates.replace_flags(table, found, spark.createDataFrame([(1, new), (2, new), (4, new)], "company_id long, checked date"))
    assert read(table.read()) == sorted([(1, "capex", 2021, 1.0, 3.0, 2.0, new), (1, "revenue", 2021, 1.0, 3.0, 2.0, new), (2, *(None,) * 5, new),
                                         (3, "revenue", 2020, 1.0, 2.0, 1.0, old), (4, *(None,) * 5, new)], key=repr)


# ---- facts clustered at rest


def exchanges(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


def test_selections_on_clustered_facts_need_no_exchange(spark, tmp_path):
    facts = spark.createDataFrame(random_facts(6), FACT)
    path = str(tmp_path / "facts")
    stored = store.write_clustered(facts, "clustered_facts_test", path, 4)
    again = store.open_clustered(spark, "clustered_facts_again", path, facts.schema, 4)
    reference = pointintime.annual_facts(facts).select("company_id", "canonical_concept", F.year("end_date").alias("end_year"), (F.col("value") + 1).alias("reference_value"))
    jobs = {"latest": pointintime.latest, "original": pointintime.original, "annual": pointintime.annual_values, "q4": pointintime.derive_q4,
            "flags": lambda rows: reconcile.flags(reconcile.compared_values(rows, F.broadcast(reference)))}
    for name, job in jobs.items():
        assert read(job(stored)) == read(job(again)) == read(job(facts)), name
        of_reference = exchanges(reference) if name == "flags" else 0
        assert exchanges(job(stored)) == of_reference, name
        assert exchanges(job(again)) == exchanges(job(stored)) < exchanges(job(facts)), name
    for name in ("clustered_facts_test", "clustered_facts_again"):
        spark.sql(f"DROP TABLE {name}")


def test_facts_reach_their_buckets_and_sheets_without_an_exchange(spark, tmp_path):
    """Rows dealt by company are written where they are, and a sheet's cells are gathered where they lie."""
    facts = spark.createDataFrame(random_facts(7), FACT)
    stored = store.write_clustered(facts, "clustered_sheets_test", str(tmp_path / "facts"), 4)
    sheet = templates.dense_columns(stored)
    assert read(sheet.select("company_id", "fiscal_year", F.size("cells"))) == read(templates.dense_columns(facts).select("company_id", "fiscal_year", F.size("cells")))
    assert exchanges(sheet) == 0
    spark.sql("DROP TABLE clustered_sheets_test")


def test_structs_beside_their_row(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "a int, b int")
    made = [F.when(F.col("b").isNotNull(), F.struct((F.col("b") + n).alias("x"))) for n in range(2)]
    assert read(domain.inlined(rows, made)) == sorted([(1, 5, 5), (1, 5, 6), (2, None, None), (2, None, None)], key=repr)
    assert read(domain.inlined(rows, made, "a").where("x is not null")) == [(1, 5), (1, 6)]
