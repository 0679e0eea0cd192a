"""Canonical views over the star-schema tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn

FACT_KEYS = ["entity_id", "effective_date", "concept", "fiscal_year", "fiscal_period"]

FACTS = """(select 'us-cik-'||lpad(cast(l_suppkey as varchar),10,'0') entity_id,
    last_day(cast(date_trunc('quarter',o_orderdate) as date)+interval 2 month) effective_date,
    cast(l_shipdate as date) availability_date, cast(null as date) restated_at, 'us-gaap:'||l_returnflag concept, l_extendedprice as value,
    cast(year(o_orderdate) as integer) fiscal_year, 'Q'||quarter(o_orderdate) fiscal_period,
    lpad(cast(l_orderkey as varchar),10,'0')||'-'||lpad(cast(l_linenumber as varchar),2,'0')||'-'||lpad(cast(l_partkey as varchar),8,'0')||'-'||strftime(l_shipdate,'%Y%m%d') source_ref
    from lineitem join orders on l_orderkey=o_orderkey where l_shipdate >= o_orderdate)"""

#: Each version is restated when the next of its fact appears.
CHAINED = f"""(select * replace (lead(availability_date) over (partition by entity_id, effective_date, concept, fiscal_year, fiscal_period order by availability_date, source_ref) as restated_at) from {FACTS})"""

BARS = """(select user_id, cast(ts as date) as day, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) as volume from events group by 1, 2)"""

STATEMENTS = """(select l_suppkey, cast(year(o_orderdate) as integer) fiscal_year, 'Q'||quarter(o_orderdate) fiscal_period,
    sum(l_extendedprice) assets, sum(l_extendedprice*(1-l_discount)) liabilities,
    sum(l_extendedprice*l_discount)*(case when l_suppkey%10=0 then 1.5 else 1 end) equity,
    sum(l_extendedprice)*(case when l_suppkey%25=0 then 1.02 else 1 end) liabilities_and_equity,
    sum(case when l_linestatus='O' then l_extendedprice end) assets_current,
    sum(case when l_linestatus='F' then l_extendedprice*(1+l_tax) end) liabilities_current
    from lineitem join orders on l_orderkey=o_orderkey group by 1,2,3)"""

FILINGS = """(select o_orderkey accession, o_custkey cik, max(cast(o_orderdate as date)) report_date, max(cast(l_shipdate as date)) filed from orders join lineitem on l_orderkey=o_orderkey group by 1, 2)"""

EDGES = """(select distinct 'us-cik-'||lpad(cast(l_suppkey as varchar),10,'0') entity_id, 'us-cik-'||lpad(cast(o_custkey as varchar),10,'0') target_entity_id, p_type relationship_type,
    cast(o_orderdate as date) availability_date, cast(date_trunc('quarter', o_orderdate) as date) effective_date, cast(o_orderkey as varchar) source_ref
    from lineitem join orders on l_orderkey=o_orderkey join part on p_partkey=l_partkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; zone-less timestamps become session (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def _cik(c: str) -> F.Column:
    return F.concat(F.lit("us-cik-"), F.lpad(F.col(c).cast("string"), 10, "0"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as filed facts: the quarter of the order is what they are about, the ship date when they are known.

    A line item may be shipped twice, so the reference has the ship date too: it is unique among the versions of a fact."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate >= o_orderdate")
    ref = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.date_format("l_shipdate", "yyyyMMdd"))
    return rows.select(_cik("l_suppkey").alias("entity_id"), fn.quarter_end(F.col("o_orderdate")).alias("effective_date"), F.to_date("l_shipdate").alias("availability_date"), F.lit(None).cast("date").alias("restated_at"), F.concat(F.lit("us-gaap:"), "l_returnflag").alias("concept"), F.col("l_extendedprice").alias("value"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("fiscal_period"), ref.alias("source_ref"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("volume"))


def statements_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly balance sheets of suppliers, a column for each concept."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    price, k = F.col("l_extendedprice"), F.col("l_suppkey")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("fiscal_period"))
    wide = rows.agg(F.sum(price).alias("assets"), F.sum(price * (1 - F.col("l_discount"))).alias("liabilities"), F.sum(price * F.col("l_discount")).alias("e"), F.sum(F.when(F.col("l_linestatus") == "O", price)).alias("assets_current"), F.sum(F.when(F.col("l_linestatus") == "F", price * (1 + F.col("l_tax")))).alias("liabilities_current"))
    wide = wide.withColumn("equity", F.col("e") * F.when(k % 10 == 0, 1.5).otherwise(1.0)).withColumn("liabilities_and_equity", F.col("assets") * F.when(k % 25 == 0, 1.02).otherwise(1.0))
    return wide


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly balance sheets of suppliers, in long form: (entity, year, period, concept, value)."""
    wide = statements_wide(spark, sf_dir)
    names = {"assets": "Assets", "liabilities": "Liabilities", "equity": "StockholdersEquity", "liabilities_and_equity": "LiabilitiesAndStockholdersEquity", "assets_current": "AssetsCurrent", "liabilities_current": "LiabilitiesCurrent"}
    pairs = F.explode(F.array(*(F.struct(F.lit(f"us-gaap:{c}").alias("concept"), F.col(n).alias("value")) for n, c in names.items()))).alias("p")
    return wide.select("l_suppkey", "fiscal_year", "fiscal_period", pairs).select("l_suppkey", "fiscal_year", "fiscal_period", "p.concept", "p.value").filter("value is not null")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    filed = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("filed"))
    return o.join(filed, "o_orderkey").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("report_date"), "filed")


def _once(rows: DataFrame, by: str) -> DataFrame:
    """The different rows, found beside each other in a sort of each `by`: it serves a join by that column too, and no table of rows is held in memory."""
    others = [c for c in rows.columns if c != by]
    repeat = F.struct(*others).eqNullSafe(F.lag(F.struct(*others)).over(Window.partitionBy(by).orderBy(*others)))
    return rows.withColumn("__repeat", repeat).filter("not __repeat").drop("__repeat")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to customer relations by quarter, the part's type being the relation.

    An order's number is part of a relation, so the different ones are found within each order, before customers and dates are joined."""
    l, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    lines = l.join(p, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", _cik("l_suppkey").alias("entity_id"), F.col("p_type").alias("relationship_type"))
    ordered = o.select("o_orderkey", _cik("o_custkey").alias("target_entity_id"), F.to_date("o_orderdate").alias("availability_date"))
    rows = _once(lines, "l_orderkey").join(_once(ordered, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("entity_id", "target_entity_id", "relationship_type", "availability_date", F.to_date(F.date_trunc("quarter", "availability_date")).alias("effective_date"), F.col("o_orderkey").cast("string").alias("source_ref"))
