"""Versioned tables and the data dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.common import catalog_cte, check, erd_cte, silver, star, stats_cte, table
from starloom.operators import dictionary, profile, versioned
from starloom.session import cut_lineage, scratch_path
from starloom.streaming.jobs import stream_versions

VERSIONED = "SELECT user_id, event_id AS version, event_type, round(value, 2) AS value FROM events"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", F.round("value", 2).alias("value"))


LATEST = f"(SELECT * FROM ({VERSIONED}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC) = 1)"
KEY = ["user_id"]


@check("L1_latest_by_key", f"SELECT * FROM {LATEST}")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.latest_by_key(rows(spark, sf_dir), KEY, "version")


@check(
    "L1_latest_by_key_with_sequence",
    "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id DESC) = 1",
)
def l1_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.latest_by_key(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), ["event_type"], "user_id", "event_id")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per user that ever had an error, and one new user per country key."""
    seen = rows(spark, sf_dir).where(F.col("event_type") == "error").groupBy("user_id").agg(F.max("value").alias("value"))
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000000).cast("bigint").alias("user_id"), F.lit(0.5).alias("value"))
    return seen.unionByName(new).withColumn("event_type", F.lit("changed"))


CHANGES = f"""(SELECT user_id, max(value) AS value FROM ({VERSIONED}) WHERE event_type = 'error' GROUP BY user_id
  UNION ALL SELECT n_nationkey + 1000000, 0.5 FROM nation)"""


@check(
    "L2_upsert",
    f"""SELECT coalesce(c.user_id, l.user_id) AS user_id, coalesce(l.version, 0) + CASE WHEN c.user_id IS NULL THEN 0 ELSE 1 END AS version,
        CASE WHEN c.user_id IS NULL THEN l.event_type ELSE 'changed' END AS event_type, coalesce(c.value, l.value) AS value
        FROM {LATEST} l FULL JOIN {CHANGES} c ON l.user_id = c.user_id""",
)
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.upsert(rows(spark, sf_dir), changes(spark, sf_dir), KEY)


@check(
    "L2_repeated_keys_in_a_batch",
    """SELECT user_id, event_id, (SELECT count(*) FROM nation WHERE n_nationkey = user_id) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version
       FROM events""",
)
def l2_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id"), F.lit(1).cast("bigint").alias("version"))
    many = table(spark, sf_dir, "events").select("user_id", "event_id")
    return versioned.number_changes(stored, many, KEY, sequence="event_id")


@check(
    "L2_stream_versions",
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, 1 AS rows FROM events",
)
def l2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").select("user_id", "event_id")
    target = scratch_path(spark, "versions")
    stream_versions(stream, KEY, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).groupBy("user_id", "version").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "L3_merge_partial",
    f"""SELECT l.user_id, version, CASE WHEN c.user_id IS NULL THEN event_type ELSE 'changed' END AS event_type, l.value
        FROM {LATEST} l LEFT JOIN {CHANGES} c ON l.user_id = c.user_id""",
)
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = changes(spark, sf_dir).withColumn("value", F.lit(None).cast("double"))
    return versioned.merge_partial(versioned.latest_by_key(rows(spark, sf_dir), KEY, "version"), patch, KEY)


def stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profile rows of the star tables."""
    found = profile.catalog_profile(star(spark, sf_dir))
    return found.select(
        F.col("table_name").alias("original_table_name"), F.col("column_name").alias("original_column_name"),
        F.col("table_name").alias("new_table_name"), F.col("column_name").alias("new_column_name"),
        F.lower("type_name").alias("inferred_type"), "classification", F.lit(1).cast("bigint").alias("version"),
    )


STORED = f"""{catalog_cte()}, stored AS (SELECT table_name AS original_table_name, column_name AS original_column_name,
  table_name AS new_table_name, column_name AS new_column_name, lower(type_name) AS inferred_type, classification, 1 AS version FROM catalog)"""


@check(
    "L4_bulk_rename_table",
    f"""WITH {STORED} SELECT original_table_name, original_column_name, 'client' AS new_table_name,
        CASE WHEN original_column_name = 'c_name' THEN 'client_name' ELSE new_column_name END AS new_column_name, inferred_type,
        CASE WHEN original_column_name = 'c_name' THEN 'fact' ELSE classification END AS classification, 2 AS version
        FROM stored WHERE original_table_name = 'customer'""",
)
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.rename_table(stored_profile(spark, sf_dir), "customer", "client", "c_name", "client_name", classification="fact")


@check(
    "L5_edit_column",
    f"""WITH {STORED} SELECT original_table_name, original_column_name, new_table_name, 'brand' AS new_column_name, inferred_type,
        'fact' AS classification, 2 AS version FROM stored WHERE original_column_name = 'p_brand'""",
)
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.edit_column(stored_profile(spark, sf_dir), "part", "p_brand", new_column_name="brand", classification="fact", inferred_type=None)


def two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = stored_profile(spark, sf_dir)
    return first.unionByName(first.withColumns({"new_column_name": F.concat(F.lit("second_"), "new_column_name"), "version": F.lit(2).cast("bigint")}))


@check(
    "L4_rename_of_second_version",
    f"""WITH {STORED} SELECT original_column_name, 'client' AS new_table_name,
        CASE WHEN original_column_name = 'c_name' THEN 'client_name' ELSE 'second_' || new_column_name END AS new_column_name, 3 AS version
        FROM stored WHERE original_table_name = 'customer'""",
)
def l4_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = versioned.rename_table(two_versions(spark, sf_dir), "customer", "client", "c_name", "client_name")
    return changed.select("original_column_name", "new_table_name", "new_column_name", "version")


@check(
    "L5_edit_of_second_version",
    f"""WITH {STORED} SELECT original_column_name, 'second_' || new_column_name AS new_column_name, 'fact' AS classification, 3 AS version
        FROM stored WHERE original_column_name = 'p_brand'""",
)
def l5_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = versioned.edit_column(two_versions(spark, sf_dir), "part", "p_brand", classification="fact")
    return changed.select("original_column_name", "new_column_name", "classification", "version")


@check(
    "L6_soft_delete",
    f"""SELECT user_id, version + CASE WHEN had_error THEN 1 ELSE 0 END AS version, CASE WHEN had_error THEN 0 ELSE 1 END AS enabled FROM
        (SELECT l.user_id, l.version, l.user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20) AS had_error FROM {LATEST} l)""",
)
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).select("user_id", "version", F.lit(1).alias("enabled"))
    doomed = rows(spark, sf_dir).where("event_type = 'error' AND value > 20").select("user_id").distinct()
    return versioned.latest_by_key(versioned.soft_delete(base, doomed, KEY), KEY, "version")


@check("L7_hard_delete", "SELECT * FROM (SELECT event_id, event_type FROM events) WHERE event_type <> 'error'")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.hard_delete(table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") == "error")


@check(
    "L8_assign_ids",
    """SELECT event_id, ts::VARCHAR AS ts, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY ts, event_id) AS id FROM events""",
)
def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).scalar()
    new = table(spark, sf_dir, "events").select("event_id", "ts")
    return versioned.assign_ids(new, ["ts", "event_id"], start).withColumn("ts", F.col("ts").cast("string"))


@check("L9_lookup", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY user_id, event_id LIMIT 25")
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return versioned.lookup(found, {"event_type": "click", "user_id": None}, ["user_id", "event_id"], 25)


FREQUENCY = """CASE left(o_orderpriority, 1) WHEN '1' THEN 'HOURLY' WHEN '2' THEN 'daily' WHEN '3' THEN 'Weekly' WHEN '4' THEN 'monthly'
 ELSE CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'yearly' ELSE 'on_demand' END END"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(FREQUENCY).alias("frequency"), ran.alias("last_run"))


@check(
    "L10_group_by_frequency",
    f"""SELECT lower(coalesce({FREQUENCY}, 'on_demand')) AS frequency, count(*) AS items FROM orders
        WHERE lower(coalesce({FREQUENCY}, 'on_demand')) <> 'yearly' GROUP BY 1""",
)
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.group_by_frequency(contracts(spark, sf_dir), "frequency")


@check(
    "L11_due_items",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, o_orderdate, lower({FREQUENCY}) AS f FROM orders) WHERE o_orderstatus = 'P'
        OR epoch(TIMESTAMP '2001-07-25 12:00:00') - epoch(o_orderdate) >= CASE f WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 WHEN 'monthly' THEN 2592000 END""",
)
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = contracts(spark, sf_dir).withColumn("frequency", F.lower("frequency"))
    return versioned.due_items(items, "frequency", "last_run", F.lit("2001-07-25 12:00:00").cast("timestamp")).select("o_orderkey")


@check(
    "L12_list_across_stages",
    "SELECT 'stage_' || event_type AS stage, user_id AS transformation_id, count(*) AS statements FROM events GROUP BY ALL",
)
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "transformation_id")
    kinds = ["view", "click", "error"]
    stages = {f"stage_{k}": events.where(F.col("event_type") == k).drop("value") for k in kinds}
    others = versioned.list_across_stages(stages)
    rest = events.where(~F.col("event_type").isin(kinds)).withColumn("stage", F.concat(F.lit("stage_"), "event_type"))
    return versioned.statements_by_transformation(others.unionByName(rest, allowMissingColumns=True))


# ---- data dictionary ---------------------------------------------------------------------------


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the designed star, limited to columns that hold any value."""
    tables = silver(spark, sf_dir)
    seeded = dictionary.seed_definitions(spark, {"gold": {n: df.schema for n, df in tables.items()}})
    filled = profile.column_statistics(tables).where(F.col("cardinality") > 0)
    return cut_lineage(seeded.join(filled, ["table_name", "column_name"], "left_semi"))


DEFS = stats_cte(renamed=True)


@check(
    "M1_seed_definitions",
    f"WITH {DEFS} SELECT 'gold' AS schema_name, count(DISTINCT table_name) AS tables, count(*) AS columns FROM stats WHERE cardinality > 0",
)
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.seed_counts(definitions(spark, sf_dir))


@check("M2_type_precision", "SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ', 2' AS column_precision, '' AS plain FROM orders")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.lit("Nullable(Decimal("), F.dayofmonth("o_orderdate").cast("string"), F.lit(", 2))"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dictionary.type_precision(F.regexp_replace(kind, r"^Nullable\((.*)\)$", "$1")).alias("column_precision"),
        dictionary.type_precision(F.col("o_orderstatus")).alias("plain"),
    )


def described_sql(fact_like: str, dim_like: str, listed: bool) -> str:
    """The description rules as SQL, over rows with is_pk and classification."""
    c, t = "lower(column_name)", "lower(table_name)"
    key = "is_pk" if listed else "false"
    fact = f"CASE WHEN classification = 'fact' THEN 'Fact measure' ELSE 'Dimension attribute' END" if listed else "NULL"
    money = f"regexp_matches({c}, 'amount|sales|revenue')"
    dated = f"regexp_matches({c}, 'date|time')"
    foreign = f"(({fact_like}) AND regexp_matches(column_name, '(_key|_id)$'))"
    first = f"""concat_ws('. ', CASE WHEN {key} THEN 'Primary key candidate' END, {fact},
      CASE WHEN {foreign} THEN 'Foreign key to ' || replace(replace(column_name, '_key', ''), '_id', '') || ' dimension' END,
      CASE WHEN {money} THEN 'Monetary measure' END, CASE WHEN {money} AND ({fact_like}) THEN 'Fact measure representing sales/amount data' END,
      CASE WHEN {dated} AND (({dim_like}) OR contains({t}, 'calendar')) THEN 'Date attribute for time dimension' WHEN {dated} THEN 'Date/timestamp field' END,
      CASE WHEN contains({c}, 'name') THEN 'Descriptive name attribute' END,
      CASE WHEN regexp_matches({c}, 'id|key') AND NOT ({key}) THEN 'Unique identifier' END)"""
    return f"""(SELECT *, concat_ws('. ', nullif(f3, ''),
       CASE WHEN regexp_matches({t}, 'geography|region') THEN CASE WHEN contains({c}, 'region') THEN 'Geographic region' WHEN contains({c}, 'state') THEN 'State/province'
         WHEN contains({c}, 'city') THEN 'City/location' WHEN contains({c}, 'country') THEN 'Country' END END,
       CASE WHEN contains({t}, 'product') THEN CASE WHEN contains({c}, 'product') THEN 'Product identifier or name' WHEN contains({c}, 'category') THEN 'Product category' END END) || '.' AS description
     FROM (SELECT *, concat_ws('. ', nullif(f2, ''), CASE WHEN contains(type_name, 'Date') AND NOT regexp_matches(lower(f2), 'date|time') THEN 'Date/timestamp value' END) AS f3
     FROM (SELECT *, CASE WHEN contains(type_name, 'String') AND f1 = '' THEN 'Text attribute' ELSE f1 END AS f2
     FROM (SELECT *, concat_ws('. ', nullif(f0, ''), CASE WHEN regexp_matches(type_name, 'Decimal|Float') AND NOT regexp_matches(lower(f0), 'monetary|measure') THEN 'Numeric measure' END) AS f1
     FROM (SELECT *, {first} AS f0 FROM src)))))"""


def described(sql: str) -> str:
    return f"CASE WHEN {sql} = '.' THEN type_name || ' column in ' || table_name || ' table.' ELSE {sql} END"


@check(
    "M3_describe_columns",
    f"""WITH {erd_cte(renamed=True)}, src AS (SELECT erd.*, table_type FROM erd JOIN typed USING (table_name))
        SELECT table_name, column_name, {described('description')} AS description FROM {described_sql("table_type = 'fact'", "table_type = 'dimension'", True)}""",
)
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.erd_profile(silver(spark, sf_dir))
    lists = _context(found)
    rows_ = found.withColumnRenamed("type_name", "column_type").select("table_name", "column_name", "column_type").join(lists, "table_name")
    return rows_.select("table_name", "column_name", dictionary.describe_columns(rows_).alias("description"))


def _context(found: DataFrame) -> DataFrame:
    def listed(condition: Column) -> Column:
        return F.collect_list(F.when(condition, F.col("column_name")))

    lists = found.groupBy("table_name").agg(
        listed(F.col("is_primary_key_candidate")).alias("primary_key_candidates"),
        listed(F.col("classification") == "fact").alias("fact_columns"),
        listed(F.col("classification") == "dimension").alias("dimension_columns"),
    )
    return lists.join(profile.table_types(found).select("table_name", "table_type"), "table_name")


@check(
    "M4_generate_missing",
    f"""WITH {erd_cte(renamed=True)}, src AS (SELECT erd.*, table_type FROM erd JOIN typed USING (table_name))
        SELECT table_name, column_name, {described('description')} AS column_description, 3 AS version
        FROM {described_sql("table_type = 'fact'", "table_type = 'dimension'", True)} WHERE cardinality > 0 AND table_name <> 'part'""",
)
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = definitions(spark, sf_dir)
    done = defs.where(F.col("table_name") == "part").select(*dictionary.KEYS, F.lit("known").alias("column_description"))
    cleared = defs.where(F.col("table_name") != "part").select(*dictionary.KEYS, F.lit(" ").alias("column_description"))
    current = dictionary.update_description(defs, done.unionByName(cleared))
    made = dictionary.generate_missing(current, _context(cut_lineage(profile.erd_profile(silver(spark, sf_dir)))))
    return made.select("table_name", "column_name", "column_description", "version")


@check(
    "M5_update_description",
    f"WITH {DEFS} SELECT table_name, column_name, CASE WHEN table_name = 'orders' THEN 'About ' || column_name ELSE '' END AS column_description, "
    "CASE WHEN table_name = 'orders' THEN 2 ELSE 1 END AS version FROM stats WHERE cardinality > 0",
)
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = definitions(spark, sf_dir)
    texts = defs.where(F.col("table_name") == "orders").select(
        *dictionary.KEYS, F.concat(F.lit("About "), "column_name").alias("column_description"))
    current = dictionary.get_definitions(dictionary.update_description(defs, texts))
    return current.select("table_name", "column_name", "column_description", "version")


@check(
    "M6_get_definitions",
    f"WITH {DEFS} SELECT table_name, column_name, type_name AS column_type FROM stats WHERE table_name = 'lineitem' AND cardinality > 0 ORDER BY column_name LIMIT 5",
)
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.get_definitions(definitions(spark, sf_dir), "gold", "lineitem", 5).select("table_name", "column_name", "column_type")
