"""Inputs for the operators, derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ORDER = ['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']

_KG = """
WITH b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, year(o_orderdate) AS yr,
         cast(floor(l_partkey/2) AS bigint) AS pk, cast(floor(c_custkey/2) AS bigint) AS ck, l_suppkey*12 + l_partkey%12 AS sk,
         c_nationkey*12 + c_custkey%12 AS nk,
         @ordinal@ AS ordinal
  FROM @line@ AS lineitem JOIN @orders@ AS orders ON l_orderkey=o_orderkey JOIN @customer@ AS customer ON o_custkey=c_custkey
), e AS (
  SELECT *, (CASE pk%4 WHEN 0 THEN 'HeatStress' WHEN 1 THEN 'DroughtIndex' WHEN 2 THEN 'OceanWarming' ELSE 'UHIIntensity' END) || cast(pk AS string) AS p_,
    (CASE ck%4 WHEN 0 THEN 'CoralBleaching' WHEN 1 THEN 'CropYield' WHEN 2 THEN 'CardioMortality' ELSE 'SleepLoss' END) || cast(ck AS string) AS b_,
    (CASE nk%4 WHEN 0 THEN 'HousingPolicy' WHEN 1 THEN 'PopulationAging' WHEN 2 THEN 'GovernanceGap' ELSE 'NeighborhoodRisk' END) || cast(nk AS string) AS s_,
    (CASE sk%4 WHEN 0 THEN 'EnergyCost' WHEN 1 THEN 'LaborLoss' WHEN 2 THEN 'MarketShock' ELSE 'GridDamage' END) || cast(sk AS string) AS e_,
    (CASE (pk*7+3)%4 WHEN 0 THEN 'HeatStress' WHEN 1 THEN 'DroughtIndex' WHEN 2 THEN 'OceanWarming' ELSE 'UHIIntensity' END) || cast(pk*7+3 AS string) AS p2_
  FROM b
), k AS (
  SELECT ordinal, l_orderkey, yr, l_returnflag, l_linestatus,
   CASE l_linenumber WHEN 1 THEN p_ WHEN 2 THEN b_ WHEN 3 THEN p_ WHEN 4 THEN e_ WHEN 5 THEN s_ WHEN 6 THEN p_ ELSE b_ END AS start_node,
   CASE l_linenumber WHEN 1 THEN b_ WHEN 2 THEN e_ WHEN 3 THEN e_ WHEN 4 THEN s_ WHEN 5 THEN p_ WHEN 6 THEN (CASE WHEN l_orderkey%5=0 THEN p_ ELSE p2_ END) ELSE s_ END AS end_node,
   CASE l_linenumber WHEN 1 THEN 'physical' WHEN 2 THEN 'biological' WHEN 3 THEN 'physical' WHEN 4 THEN 'economic' WHEN 5 THEN 'social' WHEN 6 THEN 'physical' ELSE 'biological' END AS sl,
   CASE l_linenumber WHEN 1 THEN 'biological' WHEN 2 THEN 'economic' WHEN 3 THEN 'economic' WHEN 4 THEN 'social' WHEN 5 THEN 'physical' WHEN 6 THEN 'physical' ELSE 'social' END AS el
  FROM e)
SELECT ordinal, 'WOS:' || lpad(cast(l_orderkey AS string),9,'0') AS paper_id, yr AS year,
  CASE WHEN yr <= 2000 THEN 'kg' ELSE 'holdout' END AS split,
  start_node,
  CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'increases' WHEN 'RF' THEN 'causes' WHEN 'NO' THEN 'mitigates' WHEN 'NF' THEN 'reduces' WHEN 'AO' THEN 'Increases' ELSE 'affects' END AS relationship,
  end_node,
  start_node || ' affects ' || end_node || ' in study ' || cast(l_orderkey AS string) || '.' AS evidence_sentence,
  CASE WHEN l_orderkey%19=0 THEN NULL WHEN l_returnflag='R' THEN 'high' WHEN l_returnflag='A' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN l_orderkey%17=0 THEN 'unclassified' WHEN l_orderkey%13=0 THEN ' ' || upper(sl) || ' ' WHEN l_orderkey%11=0 THEN 'social' ELSE sl END AS start_layer,
  CASE WHEN l_orderkey%23=0 THEN 'biological' ELSE el END AS end_layer
FROM k
"""


def kg_sql(line: str, ordinal: str, orders: str, customer: str) -> str:
    """Triples of a layered causal graph, made from the lines of orders."""
    out = _KG
    for mark, text in (("@line@", line), ("@ordinal@", ordinal), ("@orders@", orders), ("@customer@", customer)):
        out = out.replace(mark, text)
    return out


#: Prefixes of node names by kind and by number % 4.
PREFIXES = (("HeatStress", "DroughtIndex", "OceanWarming", "UHIIntensity"), ("CoralBleaching", "CropYield", "CardioMortality", "SleepLoss"), ("HousingPolicy", "PopulationAging", "GovernanceGap", "NeighborhoodRisk"), ("EnergyCost", "LaborLoss", "MarketShock", "GridDamage"))


def name_sql(x: str) -> str:
    """Spark SQL: the name of a node by its id, 4 times the number in the name plus its kind (physical, biological, social, economic)."""
    of_kind = [f"CASE shiftright({x}, 2) % 4 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' WHEN 2 THEN '{c}' ELSE '{d}' END" for a, b, c, d in PREFIXES]
    return f"concat(CASE {x} & 3 WHEN 0 THEN {of_kind[0]} WHEN 1 THEN {of_kind[1]} WHEN 2 THEN {of_kind[2]} ELSE {of_kind[3]} END, cast(shiftright({x}, 2) AS string))"


def name_column(x: Column) -> Column:
    """The same as a column expression."""
    number = F.shiftright(x, 2)
    of_kind = [F.when(number % 4 == 0, a).when(number % 4 == 1, b).when(number % 4 == 2, c).otherwise(d) for a, b, c, d in PREFIXES]
    kind = x.bitwiseAND(3)
    return F.concat(F.when(kind == 0, of_kind[0]).when(kind == 1, of_kind[1]).when(kind == 2, of_kind[2]).otherwise(of_kind[3]), number.cast("string"))


#: The same rows in few bytes, for Spark: what a triple is made from, with its nodes' ids instead of their names.
CODED = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, yr,
  CASE l_linenumber WHEN 1 THEN p_ WHEN 2 THEN b_ WHEN 3 THEN p_ WHEN 4 THEN e_ WHEN 5 THEN s_ WHEN 6 THEN p_ ELSE b_ END AS src_id,
  CASE l_linenumber WHEN 1 THEN b_ WHEN 2 THEN e_ WHEN 3 THEN e_ WHEN 4 THEN s_ WHEN 5 THEN p_ WHEN 6 THEN (CASE WHEN l_orderkey%5=0 THEN p_ ELSE p2_ END) ELSE s_ END AS dst_id
FROM (
  SELECT *, 4*cast(floor(l_partkey/2) AS bigint) AS p_, 4*cast(floor(c_custkey/2) AS bigint) + 1 AS b_, 4*(c_nationkey*12 + c_custkey%12) + 2 AS s_,
    4*(l_suppkey*12 + l_partkey%12) + 3 AS e_, 4*(cast(floor(l_partkey/2) AS bigint)*7 + 3) AS p2_
  FROM {lines})
"""


def decoded_sql(*also: str) -> str:
    """Triples of coded rows that have an ordinal: _KG's own last part, with names from ids, and more columns of these rows."""
    last = _KG[_KG.index("SELECT ordinal, 'WOS:'") :].rstrip().removesuffix("FROM k").rstrip()
    layers = _KG.split("END AS end_node,")[1].split("FROM e)")[0]
    return f"{last}{''.join(', ' + c for c in also)} FROM (SELECT *, {name_sql('src_id')} AS start_node, {name_sql('dst_id')} AS end_node, {layers} FROM {{coded}})"


#: The confidence of a triple by a coded row.
CONFIDENCE = _KG.split(" AS confidence,")[0].rsplit("\n", 1)[1].strip()

#: doc_id, doc: a tagged bibliographic record for every document.
RECORDS = """
SELECT doc_id,
 'PT J' || chr(10) || 'AU Author' || cast(doc_id AS string) || chr(10) ||
 'TI ' || substr(replace(text, chr(10), ' '), 1, 60) || chr(10) || '   ' || substr(replace(text, chr(10), ' '), 61, 40) || chr(10) ||
 'SO Journal ' || source || chr(10) || 'AB ' || substr(replace(text, chr(10), ' '), 101) || chr(10) || 'SC Science' || chr(10) ||
 (CASE WHEN doc_id % 2 = 0 THEN 'DI 10.1000/' || cast(doc_id AS string) || chr(10) ELSE '' END) ||
 (CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 3 < 2 THEN 'PY ' || cast(2015 + doc_id % 12 AS string) || chr(10)
       WHEN doc_id % 2 = 0 THEN 'EA MAY ' || cast(2015 + doc_id % 12 AS string) || chr(10) ELSE 'PD JAN ' || cast(2015 + doc_id % 12 AS string) || chr(10) END) ||
 'UT WOS:' || lpad(cast(doc_id AS string), 9, '0') || chr(10) || 'ER ' || chr(10) AS doc
FROM documents
"""

#: Common table expressions for DuckDB: raw triples, clean triples, collapsed edges, layers and degrees of nodes.
CTES = f"""
kg AS ({kg_sql('lineitem', 'row_number() OVER (ORDER BY ' + ','.join(LINE_ORDER) + ')', 'orders', 'customer')}),
cl AS (
  SELECT ordinal, paper_id, year, split, trim(start_node) AS src, relationship AS rel, trim(end_node) AS dst, evidence_sentence AS ev,
    coalesce(confidence, 'medium') AS conf, lower(trim(start_layer)) AS sl, lower(trim(end_layer)) AS el,
    CAST(CASE coalesce(confidence, 'medium') WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.2 ELSE 0.5 END AS DOUBLE) AS cf
  FROM kg WHERE trim(start_node) <> '' AND trim(end_node) <> ''
),
ed AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY cf DESC, ordinal) AS rn FROM cl WHERE src <> dst) WHERE rn = 1),
valid(layer, idx) AS (VALUES ('physical', 0), ('biological', 1), ('social', 2), ('economic', 3)),
votes AS (SELECT src AS node, sl AS layer, 2 * ordinal AS pos FROM cl UNION ALL SELECT dst, el, 2 * ordinal + 1 FROM cl),
tally AS (SELECT node, layer, count(*) AS n, min(pos) AS first FROM votes WHERE layer IN (SELECT layer FROM valid) GROUP BY node, layer),
nl AS (SELECT node, layer FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, first) AS rn FROM tally) WHERE rn = 1),
ends AS (SELECT src AS node, 0 AS i, 1 AS o FROM ed UNION ALL SELECT dst, 1, 0 FROM ed),
deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS indeg, CAST(sum(o) AS BIGINT) AS outdeg, CAST(sum(i + o) AS BIGINT) AS degree FROM ends GROUP BY node),
rec AS ({RECORDS}),
pg AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS page_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
"""
