"""Registry of named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordkin.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_memo: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def shared(spark: SparkSession, sf: str, name: str, make):
    """Reuse a checkpointed intermediate between queries of one application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def forget() -> None:
    _memo.clear()


TOK = f"""tok AS (SELECT doc_id, lang AS language, unnest(string_split_regex(translate(
  replace(lower(text),'ß','ss'),'{views.ACCENTED}','{views.PLAIN}'),'[^a-z]+')) AS word FROM documents)"""
WL = (
    TOK
    + """, wl AS (SELECT regexp_replace(word,'[aeiou]+','','g') AS slot, language, word,
  regexp_replace(word,'[aeiou]+','a','g') AS gold_id, language || ':' || word AS obs_id
  FROM (SELECT DISTINCT language, word FROM tok WHERE word <> ''))"""
)


def _sql_value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def tree_values(rows: list[tuple]) -> str:
    return "lt(node_id, parent_id, label, branch_length, ordinal, depth) AS (VALUES " + ", ".join("(" + ", ".join(_sql_value(x) for x in row) + ")" for row in rows) + ")"


LT = tree_values(views.LANGUAGE_TREE)
LT_LEAF = "leaf AS (SELECT node_id, parent_id, label AS language FROM lt WHERE node_id NOT IN (SELECT parent_id FROM lt WHERE parent_id IS NOT NULL))"
LT_CLOSURE = """cl(ancestor, descendant, distance) AS (
  SELECT node_id, node_id, 0 FROM lt UNION ALL
  SELECT lt.parent_id, cl.descendant, cl.distance + 1 FROM cl JOIN lt ON lt.node_id = cl.ancestor WHERE lt.parent_id IS NOT NULL)"""
PT = """pt AS (
  SELECT 'ROOT' AS node_id, NULL::VARCHAR AS parent_id, 'world' AS label, 0.0::DOUBLE AS branch_length, 0::BIGINT AS ordinal, 0 AS depth
  UNION ALL SELECT 'R' || r_regionkey, 'ROOT', r_name, 1.0::DOUBLE, r_regionkey, 1 FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 1.0::DOUBLE + (n_nationkey % 3) * 0.5::DOUBLE, n_nationkey, 2 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_mktsegment, 0.5::DOUBLE + (c_custkey % 7) * 0.25::DOUBLE, c_custkey, 3 FROM customer)"""
PT_LEAF = "ptleaf AS (SELECT * FROM pt WHERE node_id NOT IN (SELECT parent_id FROM pt WHERE parent_id IS NOT NULL))"
PT_CLOSURE = """pc(ancestor, descendant, distance, length) AS (
  SELECT node_id, node_id, 0, 0.0::DOUBLE FROM pt UNION ALL
  SELECT p.parent_id, pc.descendant, pc.distance + 1, pc.length + p.branch_length
  FROM pc JOIN pt p ON p.node_id = pc.ancestor WHERE p.parent_id IS NOT NULL)"""
OT = """ot AS (SELECT l_orderkey::BIGINT AS tree_id, 'L' || l_linenumber AS leaf, min(l_returnflag) AS f, min(l_linestatus) AS s
  FROM lineitem GROUP BY 1, 2)"""
# every clade of every order tree, as a sorted label string
OT_CLADES = (
    OT
    + """, oc AS (
  SELECT tree_id, 'root' AS label, string_agg(leaf, ',' ORDER BY leaf) AS clade FROM ot GROUP BY tree_id
  UNION ALL SELECT tree_id, f, string_agg(leaf, ',' ORDER BY leaf) FROM ot GROUP BY tree_id, f
  UNION ALL SELECT tree_id, s, string_agg(leaf, ',' ORDER BY leaf) FROM ot GROUP BY tree_id, f, s
  UNION ALL SELECT tree_id, leaf, leaf FROM ot)"""
)


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
