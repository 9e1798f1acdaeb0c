"""Damaged answers of a model about orders, eight kinds of damage by order, with the SQL of what should come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses
from ..sources.tables import read
from .catalog import query

TOLD = "'order ' || o_orderkey || ' is ' || o_orderstatus"
OPEN = f"""'{{"detailed_description": "' || {TOLD}"""
INFO = """'", "entity_info": {"entity_name": "o' || o_orderkey || '", "entity_type": "' || o_orderpriority || '"'"""
LAST = """', "summary": "' || o_orderstatus || '"'"""
SAID = f"""CASE o_orderkey % 8
 WHEN 0 THEN {OPEN} || {INFO} || {LAST} || '}}}}'
 WHEN 1 THEN 'Of {{this}}: ```json ' || {OPEN} || {INFO} || {LAST} || '}}}} ``` so far'
 WHEN 2 THEN {OPEN} || {INFO} || {LAST} || ', }}, }}'
 WHEN 3 THEN {OPEN} || chr(92) || 'alpha' || {INFO} || {LAST} || '}}}}'
 WHEN 4 THEN {OPEN} || {INFO} || {LAST}
 WHEN 5 THEN 'Nothing but words: ' || {TOLD} || repeat(' again', CAST(o_orderkey % 40 AS INT))
 WHEN 6 THEN {OPEN} || {INFO} || '}}}}'
 ELSE 'First {{}}, then ' || {OPEN} || {INFO} || {LAST} || '}}}} and {{' END"""


@query(f"""WITH a AS (SELECT *, o_orderkey % 8 AS k, {SAID} AS said, {TOLD} AS told FROM orders)
SELECT o_orderkey, CASE WHEN k IN (5, 6) THEN said WHEN k = 3 THEN told || chr(92) || 'alpha' ELSE told END AS description,
 CASE WHEN k IN (5, 6) THEN 'table_' || md5(said) ELSE 'o' || o_orderkey || ' (' || o_orderpriority || ')' END AS entity_name,
 CASE WHEN k IN (5, 6) THEN 'table' ELSE o_orderpriority END AS entity_type,
 CASE WHEN k NOT IN (5, 6) THEN o_orderstatus WHEN length(said) > 100 THEN said[1:100] || '...' ELSE said END AS summary,
 CASE WHEN k IN (5, 6) THEN 'fallback' WHEN k = 4 THEN 'fields' ELSE 'parsed' END AS how FROM a""")
def described_by_responses(spark, d):
    said = F.expr(SAID)
    found = responses.described(said, F.lit("table"))
    return read(spark, d, "orders").select("o_orderkey", found.alias("d")).select("o_orderkey", "d.*")
