"""The rating tables, as views over the given tables.

The text is valid in Spark SQL and DuckDB. Spark fills the braces with DataFrames, DuckDB with table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "ratings": """
        select cast(o.o_custkey as int) user_id, cast(l.l_partkey as int) item_id,
               cast(ceil(l.l_quantity / 10) as float) rating, l.l_shipdate rated_at
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "items": """
        select cast(p_partkey as int) item_id,
               concat(p_name, ' (', cast(1950 + p_partkey % 70 as string), ')') title,
               case when p_partkey % 50 = 0 then '(no genres listed)'
                    when p_partkey % 3 = 0 then concat(p_type, '|', p_brand) else p_type end genres
        from {part}""",
    "links": """
        select cast(p_partkey as int) item_id,
               case when p_partkey % 11 = 0 then null else cast(p_partkey * 4999 as string) end ext_id
        from {part}""",
    "users": """
        select cast(c_custkey as int) id, c_name name,
               case when c_custkey % 3 = 0 then null
                    else concat(cast(c_custkey * 7 % 200 as string), ',', cast((c_custkey * 13 + 1) % 200 as string), ',',
                                cast((c_custkey * 17 + 2) % 200 as string), ',',
                                cast((c_custkey * 19 + 3) % 200 as string), ',',
                                cast((c_custkey * 23 + 4) % 200 as string)) end item_ids,
               case when c_custkey % 5 = 0 then 'done' end job_status
        from {customer}""",
    "item_pages": """
        select cast(page_id as int) item_id, url, html, case when page_id % 10 = 9 then 404 else 200 end status
        from {pages}""",
    "item_factors": """
        select cast(vec_id as int) item_id, embedding features from {embeddings}""",
    "sign_ups": """
        select cast(s_suppkey as bigint) ordinal, s_name name from {supplier}
        union all select cast(s_suppkey + 1000000000 as bigint), s_name from {supplier}
        union all select cast(c_custkey + 2000000000 as bigint), c_name from {customer}""",
}


def _tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _tables(text)})


def with_views(*names: str) -> str:
    """``name as (...)`` clauses for DuckDB."""
    return ",\n".join(f"{n} as ({VIEWS[n].format(**{t: t for t in _tables(VIEWS[n])})})" for n in names)
