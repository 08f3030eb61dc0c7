"""Views over the driver's tables that stand for name lists and subscriptions, as SQL of both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem", "part")

SUBSCRIPTIONS = """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS row_ord,
  CAST(o_custkey AS STRING) AS person_id, concat(c_name, ' ', substring(p_brand, 7, 1)) AS normalized_name, p_brand AS book, p_type AS author,
  CAST(year(o_orderdate) - 1994 AS STRING) AS edition, CAST(year(o_orderdate) AS STRING) AS year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
"""


def _pick(values: str, index: str) -> str:
    return f"split_part('{values}', '|', CAST(({index}) % {values.count('|') + 1} + 1 AS INT))"


def _mix(k: int) -> str:
    """A number that looks random, another one for each ``k``, from the customer's key."""
    return f"CAST(floor(((c_custkey * {2 * k + 7919}) % 1000003) / 97) AS BIGINT)"


_BASE = f"""
SELECT c_custkey AS row_ord, concat('E', CAST(c_custkey AS STRING)) AS entry_id,
  {_pick("Mr.|Mrs.|Miss|Rev.||Dr.|Mr.|Capt.||Sir|Mr.|Rev. Mr.|Mr.", _mix(1))} AS parsed_title,
  {_pick("John|Mary|Thomas|J.|William|Ann||Joseph|Jon|T.|John|James|R. L.|Josef|R. L.", _mix(2))} AS parsed_first,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat({_pick("Ash|Bell|Cole|Howarth|Haworth|Smith|Smyth|Birch|Green|Greene|de la Tour|Tour|Low|Lowe|Mills", _mix(3))},
    {_pick("|son|ton|ley|by|er|wick|ham|ford|worth", "CAST(floor(c_custkey / 300) AS BIGINT)")}) END AS parsed_last,
  {_pick("||Esq.||||Jun.|Esq|M. D|", _mix(4))} AS parsed_postnominals,
  {_pick("|||bookseller|||printer and bookseller|||attorney at law|attorney|", _mix(5))} AS parsed_occupation,
  {_pick("||||Trinity Coll|||Trinity College||T. C. D|T.C.D|||", _mix(6))} AS parsed_affiliation,
  {_pick("|Leeds|||Hull||New-York|Newyork|||London|", _mix(7))} AS parsed_location,
  {_pick("Chronicle|Letters|Voyages and Reflections", _mix(8))} AS book,
  CAST({_mix(9)} % 5 + 1 AS STRING) AS edition,
  CAST(1780 + {_mix(9)} % 5 AS STRING) AS year
FROM customer
"""

NAMELIST = f"""
SELECT n.*, 'Author, An' AS author, concat('P', entry_id) AS person_id, 'personal' AS name_type, '' AS title_key,
  trim(concat(parsed_title, ' ', parsed_first, ' ', parsed_last)) AS normalized_name,
  concat({_pick("|The |His Grace the |the |||", "row_ord")}, {_pick("Mr|Mr.|Reverend|Captain|Miss.|Duke|Mrs.|Viscount|Lord and Lady|Mr. and Mrs.|Esquire", "row_ord")}, ' ',
    {_pick("Wm.|Tho. |J.C. |John & |Fran. |Saml|Mary |A B |--Robert. |Jn.", "row_ord * 3")}, {_pick("Birch|Wundham|McDonald| Oak|Green|ofHull|Wyndham", "row_ord * 11")},
    {_pick("|, Esquire|, Esq. Leeds|; printer| of Hull| of the Royal Navy|, M. D.|, New Town", "row_ord * 5")},
    {_pick("|, 2 copies|, 12 cop.| ditto|, do.|, 3 books| 2d regiment|[?]|:|.", "row_ord * 7")}) AS listed_as,
  CASE WHEN row_ord % 5 = 0 THEN '' WHEN row_ord % 97 = 0 THEN 'x' ELSE CAST(row_ord % 400 AS STRING) END AS no,
  CASE WHEN row_ord % 41 = 0 THEN ' ' ELSE {_pick("The Chronicle|A Letter|Voyages and Reflections", "row_ord")} END AS full_book,
  {_pick("Marlow, Edith|Peter Hollis|Anne Vale|", "row_ord * 3")} AS full_author
FROM ({_BASE}) n
"""

TITLED = f"""
SELECT row_ord, entry_id, concat('P', entry_id) AS person_id, 'titled' AS name_type,
  concat({_pick("duke|earl|countess|bishop", "row_ord")}, ' of ', {_pick("ashford|hull|bedford|leeds|york|kent|bath", "row_ord * 3")},
    {_pick("| one| two| three| four| five", "CAST(floor(row_ord / 7) AS BIGINT)")}) AS title_key, normalized_name, book, edition, year, listed_as
FROM ({NAMELIST}) t
"""

HOLDERS = """
SELECT concat(title, ' of ', place) AS title_key, concat('Holder ', CAST(n AS STRING)) AS person_name, '' AS wikidata_id,
  CASE WHEN n = 1 THEN '' ELSE '1782' END AS start_year, CASE WHEN n = 1 THEN '1781' WHEN n = 2 THEN '' ELSE '1783' END AS end_year
FROM (SELECT 'duke' AS title UNION ALL SELECT 'earl' UNION ALL SELECT 'bishop') a
  CROSS JOIN (SELECT 'hull' AS place UNION ALL SELECT 'leeds one' UNION ALL SELECT 'kent') b CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) c
WHERE n < 3 OR place = 'kent'
"""

#: Reviewed candidate groups: rows of one name and book in groups, with what a reviewer wrote.
REVIEWED = f"""
SELECT concat('g', CAST(CAST(floor(row_ord / 4) AS BIGINT) AS STRING)) AS group_id, row_ord, entry_id, normalized_name, book, edition,
  CASE WHEN row_ord % 4 = 0 THEN {_pick("y|n||y|y", "CAST(floor(row_ord / 4) AS BIGINT)")} WHEN row_ord % 7 = 3 THEN 'x' ELSE 'y' END AS "match",
  'exact_last' AS match_rule
FROM ({NAMELIST}) t
"""

LEDGER = f"""
SELECT concat('E', CAST(row_ord AS STRING)) AS a, concat('E', CAST(row_ord + 1 AS STRING)) AS b, {_pick("y|n|y", "row_ord")} AS verdict
FROM ({_BASE}) t WHERE row_ord % 3 = 1
"""
LEDGER = f"""
SELECT least(a, b) AS entry_a, greatest(a, b) AS entry_b, verdict, 'N' AS name_a, 'M' AS name_b, 'c|1' AS context_a, 'd|2' AS context_b, '' AS note FROM ({LEDGER}) t
"""

#: Matches as four files in order of precedence.
MATCHES = f"""
SELECT CAST(row_ord % 4 AS INT) AS file, concat('m', CAST(CAST(floor(row_ord / 6) AS BIGINT) AS STRING)) AS group_id, row_ord,
  concat('E', CAST(CAST(floor(row_ord / 2) AS BIGINT) AS STRING)) AS entry_id,
  CASE WHEN row_ord % 9 = 0 THEN '' WHEN row_ord % 13 = 0 THEN 'x' ELSE 'y' END AS "match"
FROM ({_BASE}) t
"""


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the views above; names in double quotes are Spark's in backticks."""
    tables(spark, sf_dir)
    return spark.sql(sql.replace('"', "`"))
