"""Inputs derived from the given tables.

The SQL strings are plain enough to mean the same in Spark and in the checking engine;
they only render given columns as messy text. Every row of a table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import GRID_SCHEMA

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> str:
    return f"cast(cast({column} as decimal(18,2)) as string)"


def _commas(text: str) -> str:
    return (
        f"case when length({text}) > 6 then substr({text}, 1, length({text}) - 6) || ',' || "
        f"substr({text}, length({text}) - 5) else {text} end"
    )


# One date (parts y, m, d and month name mon) in seven spellings, chosen by w = 0 to 6.
DATES = (
    "case when w in (0, 3) then y when w = 2 then m when w = 5 then mon else d end"
    " || case when w in (0, 6) then '-' when w = 1 then '.' when w in (2, 3) then '/' else ' ' end"
    " || case when w in (0, 1, 3) then m when w in (2, 5) then d else mon end"
    " || case when w in (0, 6) then '-' when w = 1 then '.' when w in (2, 3) then '/' when w = 5 then ', ' else ' ' end"
    " || case when w in (0, 3) then d else y end"
)


CUSTOMER_TEXT = f"""
select 'customer' as table_key, c_custkey as row_index,
  cast(c_custkey as string) as v0,
  case when c_custkey % 7 = 0 then '  ' || c_name || ' ' else c_name end as v1,
  cast(c_nationkey as string) as v2,
  case when c_custkey % 11 = 0 then '' else '$' || {_money('c_acctbal')} end as v3,
  c_mktsegment as v4,
  case c_custkey % 4 when 0 then 'yes' when 1 then 'No' when 2 then 'T' else '' end as v5
from {{customer}}
"""

ORDERS_TEXT = f"""
select 'orders' as table_key, k as row_index,
  cast(k as string) as v0,
  status as v1,
  case when k % 97 = 0 then 'n/a' else
    case k % 5 when 0 then '$' when 2 then ' € ' when 3 then '+' else '' end
    || case when k % 5 in (0, 2) then spaced else price end
    || case when k % 5 = 1 then '%' else '' end end as v2,
  case when k % 89 = 0 then 'unknown' else {DATES} end as v3,
  priority as v4,
  case when k % 13 = 0 then ' ' else cust end as v5
from (
  select k, k % 7 as w, status, price, priority, cust, {_commas('price')} as spaced,
    substr(iso, 1, 4) as y, substr(iso, 6, 2) as m, substr(iso, 9, 2) as d,
    substr('{MONTHS}', cast(substr(iso, 6, 2) as int) * 3 - 2, 3) as mon
  from (
    select o_orderkey as k, o_orderstatus as status, {_money('o_totalprice')} as price,
      cast(cast(o_orderdate as date) as string) as iso, o_orderpriority as priority,
      cast(o_custkey as string) as cust
    from {{orders}}
  ) given
) t
"""

EVENTS_TEXT = f"""
select 'events' as table_key, event_id as row_index,
  cast(event_id as string) as v0,
  case when event_id % 5 = 3 then substr(s, 9, 2) || '.' || substr(s, 6, 2) || '.' || substr(s, 1, 4) else substr(s, 1, 10) end
    || case when event_id % 5 in (1, 2) then 'T' else ' ' end || substr(s, 12, 8)
    || case event_id % 5 when 2 then 'Z' when 4 then '.25' else '' end as v1,
  cast(user_id as string) as v2,
  event_type as v3,
  case when event_id % 50 = 0 then 'none' else {_money('value')} || case when event_id % 2 = 0 then ' %' else '' end end as v4,
  case event_id % 6 when 0 then 'TRUE' when 1 then 'false' when 2 then 'Y' when 3 then 'n' when 4 then 'yes' else 'F' end as v5
from (select event_id, user_id, event_type, value, substr(cast(ts as string), 1, 19) as s from {{events}}) t
"""

PART_TEXT = f"""
select 'part' as table_key, p_partkey as row_index,
  cast(p_partkey as string) as v0,
  p_name as v1,
  p_brand as v2,
  case when p_partkey % 9 = 0 then '' else p_type end as v3,
  case when p_partkey % 10 = 0 then cast(p_size as string) || ' cm' else cast(p_size as string) end as v4,
  {_money('p_retailprice')} as v5
from {{part}}
"""

HEADERS = {
    "customer": ["Customer ID", "Full Name", "Nation #", "Acct Bal ($)", "Segment", "Active?"],
    "orders": ["Order Key", "Status", "Total Price", "Order Date", "Priority", ""],
    "events": ["Event-ID", "When (UTC)", "User", "Type", "Value %", "Flag"],
    "part": ["Part", "Part", "Größe / Name", "  TYPE  ", "Size", "Retail__Price"],
}
TEXTS = {"customer": CUSTOMER_TEXT, "orders": ORDERS_TEXT, "events": EVENTS_TEXT, "part": PART_TEXT}
WIDTH = 6


def text_rows(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Rows ``(table_key, row_index, values)`` of one or more text tables."""
    out = None
    for name in names or TEXTS:
        part = spark.sql(TEXTS[name], **{name: table(spark, sf_dir, name)}).select(
            "table_key",
            F.col("row_index").cast("bigint").alias("row_index"),
            F.array(*[f"v{i}" for i in range(WIDTH)]).alias("values"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def text_tables(rows: DataFrame, *names: str) -> DataFrame:
    """Tables of ``text_rows``; row counts come from the rows."""
    chosen = names or tuple(TEXTS)
    headers = F.create_map(
        *[x for n in chosen for x in (F.lit(n), F.array(*[F.lit(h) for h in HEADERS[n]]))]
    )
    counts = rows.groupBy("table_key").agg((F.max("row_index") + 1).alias("row_count"))
    return counts.select(
        "table_key",
        F.concat(F.lit("file-"), "table_key").alias("file_id"),
        F.concat("table_key", F.lit(".csv")).alias("source_file"),
        F.lit("").alias("sheet"),
        F.lit(0).alias("table_index"),
        "row_count",
        headers[F.col("table_key")].alias("headers"),
    )


# Customers as many small tables of a hundred rows: sheet n of one workbook.
SHEET_ROWS = 100


def customer_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = text_rows(spark, sf_dir, "customer")
    number = F.floor(F.col("row_index") / SHEET_ROWS).cast("string")
    rows = rows.select(
        F.concat(F.lit("customer-"), number).alias("table_key"),
        F.pmod("row_index", F.lit(SHEET_ROWS)).alias("row_index"),
        "values",
    )
    counts = rows.groupBy("table_key").agg((F.max("row_index") + 1).alias("row_count"))
    tables = counts.select(
        "table_key",
        F.lit("book").alias("file_id"),
        F.lit("customers.xlsx").alias("source_file"),
        F.replace("table_key", F.lit("customer-"), F.lit("Sheet ")).alias("sheet"),
        F.lit(0).alias("table_index"),
        "row_count",
        F.array(*[F.lit(h) for h in HEADERS["customer"]]).alias("headers"),
    )
    return tables, rows


# Orders laid out on sheets: blocks of seven orders, eleven sheet rows apart, with titles,
# side tables, shorter neighbours and headers without data. The number of sheets grows
# with the data.
GRID = """
select file_id, 'orders.xlsx' as source_file, sheet, item.r as r,
  concat(array_repeat('', off), item.cells) as cells
from (
  select 'book' || fno as file_id, 'S' || sh as sheet, cast(fno % 3 as int) as off,
    explode(filter(array(
      case when i = 0 and b % 2 = 0 then
        named_struct('r', 11 * b, 'cells', array('Report ' || b)) end,
      case when i = 0 then named_struct('r', 11 * b + 1, 'cells', concat(
        array('Order Key', 'Status', 'Total ($)', 'Order Date', '', 'Priority', 'Cust Key'),
        if(b % 3 = 0, array('', 'Unused'), array()))) end,
      named_struct('r', 11 * b + 2 + i, 'cells', concat(
        array(cast(o_orderkey as string), o_orderstatus,
              '$' || cast(cast(o_totalprice as decimal(18,2)) as string),
              cast(cast(o_orderdate as date) as string)),
        if(i < 5, array('', o_orderpriority, cast(o_custkey as string)), array())))
    ), x -> x is not null)) as item
  from (
    select *, p div 7 as b, p % 7 as i from (
      select *, o_orderkey div 1000 as fno, o_orderkey % 2 as sh, (o_orderkey % 1000) div 2 as p
      from {orders}) o
  ) blocks
) laid
"""

GRID_MERGES = """
select 'book' || fno as file_id, 'S' || sh as sheet, cast(11 * b as int) as r0, cast(fno % 3 as int) as c0,
  cast(11 * b as int) as r1, cast(fno % 3 + 3 as int) as c1
from (
  select *, p div 7 as b, p % 7 as i from (
    select o_orderkey, o_orderkey div 1000 as fno, o_orderkey % 2 as sh, (o_orderkey % 1000) div 2 as p
    from {orders}) o
) blocks
where i = 0 and b % 4 = 0
"""


def order_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    grid = spark.sql(GRID, orders=orders).select(
        "file_id", "source_file", "sheet", F.col("r").cast("bigint").alias("r"), "cells"
    )
    assert [f.name for f in grid.schema] == [c.split()[0] for c in GRID_SCHEMA.split(", ")]
    return grid, spark.sql(GRID_MERGES, orders=orders)


# Numbers as people write them.
NUMBERS = f"""
select l_orderkey, l_linenumber,
  case (l_orderkey + l_linenumber) % 6
    when 0 then '$' || {_commas('t')}
    when 1 then ' ' || t || ' %'
    when 2 then '¥' || t
    when 3 then substr(t, 1, length(t) - 3) || ',000'
    when 4 then '£ ₹' || t || '%%'
    else t end as raw
from (select l_orderkey, l_linenumber, {_money('l_extendedprice')} as t from {{lineitem}}) x
"""

# Header texts: eight parts make the header row of one table.
HEADER_TEXTS = """
select 'h' || cast(floor(p_partkey / 8) as bigint) as table_key, cast(p_partkey % 8 as int) as col_index,
  case p_partkey % 8
    when 0 then '  ' || p_name || ' (' || p_type || ')'
    when 1 then p_type
    when 2 then '###'
    when 3 then p_type || '!'
    when 4 then upper(p_type) || '_2'
    when 5 then 'Größe: ' || cast(p_size as string)
    when 6 then 'ЦЕНА--' || p_brand || '__'
    else p_brand || ' ' || p_brand end as original_name
from {part}
"""

# Model replies and statements, written around part names.
STATEMENTS = """
select p_partkey, case p_partkey % 17
    when 0 then 'SELECT * FROM data WHERE name = ' || w
    when 1 then '  select ' || w || ', count(*) from data group by ' || w || '  '
    when 2 then 'DROP TABLE ' || w
    when 3 then 'SELECT last_update FROM data WHERE ' || w || ' > 1'
    when 4 then 'SELECT workload FROM data'
    when 5 then 'WITH t AS (SELECT 1) SELECT * FROM t'
    when 6 then 'SELECT * FROM read_parquet(' || w || ')'
    when 7 then '   '
    when 8 then 'SELECT ' || w || ' /* hidden */ FROM data'
    when 9 then 'SELECT ' || w || ' -- note' || chr(10) || 'FROM data'
    when 10 then 'select 1; DELETE FROM data'
    when 11 then 'UPDATE data SET x = ' || cast(p_size as string)
    when 12 then 'SELECT COPY FROM data'
    when 13 then 'SELECT copy FROM data; insert' || chr(10) || 'into data values (1)'
    when 14 then 'SELECT * FROM data WHERE url = s3://' || w
    when 15 then 'SELECT max(size) FROM data HAVING max(size) > ' || cast(p_size as string)
    else 'explain select 1' end as sql
from (select p_partkey, p_size, replace(p_name, ' ', '_') as w from {part}) t
"""

REPLIES = """
select p_partkey, case p_partkey % 9
    when 0 then '```sql' || chr(10) || q || chr(10) || '```'
    when 1 then '```' || chr(10) || q || ';' || chr(10) || '```  '
    when 2 then q || ';'
    when 3 then '  SKIP '
    when 4 then 'skip;'
    when 5 then q || ' ; '
    when 6 then '```sql ' || q || '```'
    when 7 then 'Skip the ' || q
    else chr(10) || q || ';;' end as reply
from (select p_partkey, 'SELECT ' || replace(p_name, ' ', '_') || ' FROM data' as q from {part}) t
"""


# Documents as records of delimited files, a thousand to a file: quoted texts with their line
# breaks, a ragged record, stray quotes, and blank lines after a record.
CSV_RECORDS = """
select part, doc_id, part || ',' || cast(doc_id as string) || ',' || case doc_id % 4
  when 1 then quoted || ',extra,'
  when 2 then 'x" y "z ,"a "b" c"'
  when 3 then quoted || chr(10) || chr(10)
  else quoted end as value
from (select source || '-' || cast(doc_id div 1000 as string) as part, doc_id,
  '"' || replace(replace(coalesce(text, ''), chr(13), ''), '"', '""') || '"' as quoted from {documents})
"""
