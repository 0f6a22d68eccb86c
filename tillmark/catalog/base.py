"""Registration of named queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, tuple[str, str]] = {}

# SQL twins of the logical tables in sources/tables.py.
LOGICAL = {
    "receipts": """SELECT o_orderkey AS receipt_id, o_custkey AS customer_id, o_orderdate AS purchased_at,
        CAST(o_orderkey % 4 AS BIGINT) AS store_code FROM orders""",
    "raw_receipts": """SELECT o_orderkey AS receipt_id,
        CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN -1 ELSE o_custkey END AS customer_id,
        o_orderdate AS purchased_at, CAST(o_orderkey % 4 AS BIGINT) AS store_code FROM orders""",
    "lines": """SELECT l_orderkey AS receipt_id, l_orderkey * 10 + l_linenumber AS receipt_line_id,
        l_partkey AS product_code, CAST(l_quantity AS BIGINT) AS qty,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS value FROM lineitem""",
    "dirty_lines": """SELECT l_orderkey AS receipt_id, l_orderkey * 10 + l_linenumber AS receipt_line_id,
        l_partkey AS product_code, CASE WHEN l_suppkey % 37 <> 0 THEN CAST(l_quantity AS BIGINT) END AS qty,
        CAST(CASE WHEN l_partkey % 97 = 0 AND l_linenumber = 1 THEN 9999999
             WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS value
        FROM lineitem""",
    "products": """SELECT p_partkey AS product_code, p_name AS product_details, p_type AS department_name,
        p_brand AS category_code FROM part""",
    "customers": """SELECT c_custkey AS customer_id, c_mktsegment AS "first",
        'L' || CAST(c_custkey % 1000 AS VARCHAR) AS "last",
        DATE '1940-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS dob FROM customer""",
    "stores": "SELECT r_regionkey AS store_code, r_name AS address FROM region",
    "regions": """SELECT * FROM (VALUES ('Nottingham', 329276, 15434, 184.66), ('Birmingham', 1166049, 16950, 157.34),
        ('London', 8945309, 32330, 153.12)) v(region, population, disposable_income, grocery_spending)""",
    "baskets": """SELECT user_id AS customer_number, event_id AS basket_id, ts AS purchase_time, event_type AS category,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS basket_quantity,
        CAST(value AS DECIMAL(18,2)) AS basket_spend,
        CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 AS basket_categories FROM events""",
    "bank": """SELECT c_custkey AS customer_id,
        CAST(floor(datediff('day', DATE '1940-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER), DATE '2001-08-01') / 365.25) AS BIGINT) AS age,
        c_acctbal AS balance, c_mktsegment AS job, COALESCE(campaign, 0) AS campaign,
        COALESCE(datediff('day', last_contact, DATE '2001-05-03'), -1) AS pdays,
        COALESCE(poutcome, 'unknown') AS poutcome, COALESCE(y, 0) AS y
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderdate < DATE '2001-05-03') AS campaign,
            max(CAST(o_orderdate AS DATE)) FILTER (o_orderdate < DATE '2001-05-03') AS last_contact,
            last(o_orderstatus ORDER BY o_orderdate, o_orderkey) FILTER (o_orderdate < DATE '2001-05-03') AS poutcome,
            max(CASE WHEN o_orderdate < DATE '2001-05-03' THEN 0 ELSE 1 END) AS y
            FROM orders GROUP BY o_custkey) h ON h.o_custkey = c_custkey""",
    "scored": """SELECT o_orderkey AS row_id, ((o_custkey * 7919 + o_orderkey * 13) % 1000) / 1000.0::DOUBLE AS score,
        CASE WHEN ((o_orderkey * 104729) % 1000) * 10 < 2000 + 6 * ((o_custkey * 7919 + o_orderkey * 13) % 1000)
        THEN 1 ELSE 0 END AS label FROM orders""",
    "bars": """SELECT user_id AS entity_id, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open,
        last(value ORDER BY ts, event_id) AS close, count(*) AS volume,
        'T' || CAST(user_id % 7 AS VARCHAR) AS ticker FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "periodic": """SELECT entity_id, DATE '2024-01-01' + CAST(block * 10 + 9 AS INTEGER) AS period_end, metric, value FROM (
        SELECT user_id AS entity_id, datediff('day', DATE '2024-01-01', ts) // 10 AS block,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum_value, CAST(count(*) AS DOUBLE) AS n_events
        FROM events GROUP BY 1, 2) UNPIVOT (value FOR metric IN (sum_value, n_events))""",
    "macro": """SELECT CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS spread
        FROM events WHERE event_type = 'error' AND datediff('day', DATE '2024-01-01', ts) % 3 <> 2 GROUP BY 1""",
    "company_metadata": """SELECT c_custkey AS SP_ENTITY_ID, c_name AS SP_ENTITY_NAME,
        'T' || CAST(c_custkey % 7 AS VARCHAR) AS SP_TICKER,
        (['AAA','AA+','AA','AA-','A+','A','A-','BBB+','BBB','BBB-','BB+','BB','BB-','B+','B','B-','CCC+','CCC','CCC-','CC','C','D','NR'])[CAST(c_custkey % 23 AS INTEGER) + 1] AS RD_CREDIT_RATING_GLOBAL,
        CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS SP_COMMON_DIV_DECLARED FROM customer""",
    "ratings": """SELECT * FROM (VALUES ('AAA',20),('AA+',19),('AA',18),('AA-',17),('A+',16),('A',15),('A-',14),
        ('BBB+',13),('BBB',12),('BBB-',11),('BB+',10),('BB',9),('BB-',8),('B+',7),('B',6),('B-',5),('CCC+',4),
        ('CCC',3),('CCC-',2),('CC',1),('C',1),('D',0)) v(rating, rating_rank)""",
    "lift_responses": """SELECT event_type AS campaign_name, 'M' || CAST(user_id % 4 AS VARCHAR) AS market,
        'C' || CAST(user_id % 3 AS VARCHAR) AS channel,
        CASE WHEN event_id % 2 = 0 THEN 'control' ELSE 'exposed' END AS arm,
        CASE WHEN value > CASE WHEN event_id % 2 = 0 THEN 45 ELSE 35 END THEN 1 ELSE 0 END AS considered FROM events""",
    "campaign_history": """SELECT event_type AS campaign_name, 'M' || CAST(user_id % 4 AS VARCHAR) AS market,
        'C' || CAST(user_id % 3 AS VARCHAR) AS channel, sum(CAST(value AS DECIMAL(18,2))) AS spend, count(*) AS reach,
        count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80) AS conversions
        FROM events GROUP BY 1, 2, 3""",
    "posts": """SELECT doc_id AS post_id, text, source AS brand, lang AS country,
        DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS created_on, n_chars % 101 AS engagement FROM documents""",
    "grid": """SELECT DATE '1998-01-01' + CAST(7 * k AS INTEGER) AS prediction_date FROM range(14) r(k)""",
}

# Which logical tables a logical table reads.
NEEDS: dict[str, tuple[str, ...]] = {}


def define(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Add a reusable named SQL step."""
    LOGICAL[name] = sql
    NEEDS[name] = needs


def check_sql(needs: str, body: str) -> str:
    """Prefix a SELECT with the logical tables it reads."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in NEEDS.get(name, ()):
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    body = body.strip()
    if not order:
        return body
    steps = ",\n".join(f"{name} AS ({LOGICAL[name]})" for name in order)
    if body.startswith("WITH "):
        return f"WITH {steps},\n{body[5:]}"
    return f"WITH {steps}\n{body}"


def as_report(df: DataFrame) -> DataFrame:
    """Plain column types for reports: amounts as double, dates as ISO text, counts as bigint."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.FloatType):
            col = col.cast("double")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, needs: str = "", sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with its check SQL where one exists."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return as_report(fn(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = (needs, sql)
        return fn

    return register
