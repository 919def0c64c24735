"""Pair tables derived from the driver's tables.

The driver's data holds no pair tables, so an ER output and a truth table are
derived by SQL that Spark and DuckDB both run. Every order becomes a candidate
pair on either side, joined with one part; parts are taken in turn, so every
part is used. The CASE conditions below are what makes the two sides differ (changed
keys, columns and scores); all source tables are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pairlens.config import PAIR_COLUMNS

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")
BATCH_ID = "20240101000000"
EXCEPTION_SOURCES = ("S12", "S50", "S101")

BASE = """
SELECT o.o_orderkey AS k,
 'S'||cast(o.o_orderkey AS string) AS source_primary_key, 'T'||cast(o.o_custkey AS string) AS target_primary_key,
 p.p_name AS source_first_name, p.p_name AS target_first_name,
 lower(p.p_type)||'-'||substr(p.p_name,1,3) AS source_last_name, lower(p.p_type) AS target_last_name,
 c.c_mktsegment AS source_address_line, c.c_mktsegment AS target_address_line,
 n.n_name AS source_city, n.n_name AS target_city,
 substr(p.p_name,1,1) AS source_middle_name, substr(p.p_name,1,1) AS target_middle_name,
 cast(c.c_nationkey*100 AS string) AS source_postal_code, cast(c.c_nationkey*100 AS string) AS target_postal_code,
 r.r_name AS source_state, r.r_name AS target_state,
 CASE WHEN o.o_orderkey%5=0 THEN NULL ELSE 'jr' END AS source_suffix, 'jr' AS target_suffix,
 'E'||cast(o.o_custkey AS string) AS target_entity_id,
 cast((o.o_orderkey*37)%101 AS double)/100 AS er_score,
 CASE WHEN o.o_orderkey%4=3 THEN 2 ELSE 1 END AS er_rank,
 cast((o.o_orderkey*7)%31 AS double)/100 AS first_name_score, cast((o.o_orderkey*11)%37 AS double)/100 AS last_name_score,
 cast((o.o_orderkey*13)%17 AS double)/100 AS middle_name_score, cast((o.o_orderkey*17)%29 AS double)/100 AS city_score,
 cast((o.o_orderkey*19)%41 AS double)/100 AS address_line_score, cast((o.o_orderkey*23)%19 AS double)/100 AS state_score,
 cast((o.o_orderkey*29)%43 AS double)/100 AS postal_code_score,
 CASE WHEN o.o_orderkey%29=0 THEN NULL ELSE cast(o.o_orderkey%6 AS double)/100 END AS suffix_score
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS o_partkey FROM orders) o
 JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey
 JOIN region r ON n.n_regionkey=r.r_regionkey JOIN part p ON p.p_partkey=o.o_partkey
"""


def _columns(replaced: dict[str, str] | None = None, prefix: str = "") -> str:
    replaced = replaced or {}
    return ", ".join(f"{replaced[c]} AS {c}" if c in replaced else prefix + c for c in PAIR_COLUMNS)


# Both sides hold every order; a changed key makes a record one-sided.
ER_CHANGES = {"source_primary_key": "CASE WHEN k%13=0 THEN 'N'||source_primary_key ELSE source_primary_key END"}
ER_OUTPUT = f"SELECT {_columns(ER_CHANGES)} FROM base"

TRUTH_CHANGES = {
    "source_primary_key": "CASE WHEN k%11=0 THEN 'M'||source_primary_key ELSE source_primary_key END",
    "target_entity_id": "CASE WHEN k%7=0 THEN 'X'||target_entity_id ELSE target_entity_id END",
    "source_city": "CASE WHEN k%9=0 THEN lower(source_city) ELSE source_city END",
    "source_last_name": "CASE WHEN k%8=0 THEN target_last_name ELSE source_last_name END",
    "source_first_name": "CASE WHEN k%31=0 THEN 'zzz' ELSE source_first_name END",
    "source_suffix": "CASE WHEN k%3=0 THEN coalesce(source_suffix,'') ELSE source_suffix END",
    "er_score": "CASE WHEN k%12=1 THEN cast(0.95 AS double) WHEN k%12=5 THEN cast(0.10 AS double) ELSE er_score END",
}
TRUTH = (
    f"SELECT {_columns(TRUTH_CHANGES)}, CASE WHEN k%2=0 THEN 'Y' ELSE 'N' END AS human_review "
    "FROM base"
)

EXCEPTIONS = (
    "SELECT source_primary_key, target_primary_key FROM truth WHERE source_primary_key IN "
    f"({', '.join(repr(s) for s in EXCEPTION_SOURCES)})"
)

# Every pair the skewed ER output names, the hot one included.
LONG_EXCEPTIONS = "SELECT source_primary_key, target_primary_key FROM skewed_er"

# Several candidates per pair: every line of an order scores its pair anew.
ER_CANDIDATES = """
SELECT {cols} FROM base JOIN lineitem ON l_orderkey = k
""".format(
    cols=_columns(
        {
            "er_rank": "CASE WHEN l_returnflag='A' THEN NULL ELSE cast(l_linenumber AS int) END",
            "er_score": "CASE WHEN l_linestatus='O' THEN cast(floor(l_quantity) AS double)/100 ELSE er_score END",
            "source_city": "CASE WHEN l_returnflag='R' THEN lower(source_city) ELSE source_city END",
            "source_suffix": "CASE WHEN l_linestatus='F' THEN '' ELSE source_suffix END",
        }
    )
)

# One pair with a third of all truth rows (every returned line), some of them
# copies, next to a handful of rows for every other pair; NULL keys included.
SKEWED_TRUTH = """
SELECT {cols}, l_linestatus AS human_review FROM base JOIN lineitem ON l_orderkey = k
""".format(
    cols=_columns(
        {
            "source_primary_key": "CASE WHEN l_returnflag='R' THEN 'S7' WHEN l_linenumber=5 THEN NULL ELSE source_primary_key END",
            "target_primary_key": "CASE WHEN l_returnflag='R' THEN 'hot-T' WHEN l_linenumber=5 THEN 'none' ELSE target_primary_key END",
            "er_score": "CASE WHEN l_linestatus='O' THEN cast(floor(l_quantity) AS double)/100 ELSE er_score END",
            "source_city": "CASE WHEN l_linestatus='F' THEN lower(source_city) ELSE source_city END",
        }
    )
)

# Candidates that meet the hot pair, the NULL-keyed one and the ordinary ones.
SKEWED_ER = """
SELECT {cols} FROM base JOIN lineitem ON l_orderkey = k
""".format(
    cols=_columns(
        {
            "source_primary_key": "CASE WHEN l_returnflag='R' THEN 'S7' WHEN l_linenumber=5 THEN NULL ELSE source_primary_key END",
            "target_primary_key": "CASE WHEN l_returnflag='R' THEN 'hot-T' WHEN l_linenumber=5 THEN 'none' ELSE target_primary_key END",
            "er_rank": "cast(l_linenumber AS int)",
        }
    )
)

# A pair with many rows on both sides: one line of every 40th order, under the same keys in both tables; all other
# orders once.
_BOTH = """
SELECT {cols}{review} FROM base LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS l_quantity, min(l_linestatus) AS l_linestatus
 FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = k
"""
_BOTH_KEYS = {
    "source_primary_key": "CASE WHEN k%40=0 THEN 'S7' ELSE source_primary_key END",
    "target_primary_key": "CASE WHEN k%40=0 THEN 'hot-T' ELSE target_primary_key END",
}
HOT_ER = _BOTH.format(cols=_columns({**_BOTH_KEYS, "er_rank": "CASE WHEN k%3=0 THEN 1 ELSE 2 END"}), review="")
HOT_TRUTH = _BOTH.format(
    cols=_columns({**_BOTH_KEYS, "er_score": "cast(floor(coalesce(l_quantity, 0)) AS double)/50"}), review=", l_linestatus AS human_review"
)

# Both tables as CTEs, for DuckDB. Spark gets the same text as subqueries.
CTES = {
    "base": BASE,
    "er_output": ER_OUTPUT,
    "truth": TRUTH,
    "exceptions": EXCEPTIONS,
    "er_candidates": ER_CANDIDATES,
    "skewed_truth": SKEWED_TRUTH,
    "skewed_er": SKEWED_ER,
    "long_exceptions": LONG_EXCEPTIONS,
    "hot_er": HOT_ER,
    "hot_truth": HOT_TRUTH,
}
_NEEDS = {
    "base": (),
    "er_output": ("base",),
    "truth": ("base",),
    "exceptions": ("base", "truth"),
    "er_candidates": ("base",),
    "skewed_truth": ("base",),
    "skewed_er": ("base",),
    "long_exceptions": ("base", "skewed_er"),
    "hot_er": ("base",),
    "hot_truth": ("base",),
}


def with_clause(*names: str) -> str:
    """WITH clause (no trailing SELECT) defining ``names`` and what they need."""
    wanted = [c for c in CTES if c in names or any(c in _NEEDS[n] for n in names)]
    return "WITH " + ",\n".join(f"{c} AS ({CTES[c].strip()})" for c in wanted)


# Spark joins the source columns first and derives the pair columns last, so that no exchange carries the derived ones.
_DERIVED, _SOURCES = BASE.split("FROM", 1)
_READ = "o.o_orderkey, o.o_custkey, p.p_name, p.p_type, c.c_mktsegment, c.c_nationkey, n.n_name, r.r_name"
_RAW = f"SELECT {_READ} FROM {_SOURCES}"
_UNQUALIFIED = re.sub(r"\b[ocnrp]\.(?=[ocnrp]_)", "", _DERIVED)
_JOINED = re.compile(r"FROM base ((?:LEFT )?JOIN .*) ON l_orderkey = k\s*$", re.DOTALL)


def _late(select: str) -> str:
    """A SELECT from ``base``, its join with the lines of an order first, if it has one."""
    join = _JOINED.search(select)
    if join is None:
        return select.replace("FROM base", f"FROM ({_UNQUALIFIED} FROM raw) base")
    lines = f"{_UNQUALIFIED}, l.* FROM raw {_aliased(join[1])} ON l.l_orderkey = o_orderkey"
    return select[: join.start()] + f"FROM ({lines}) base"


def _aliased(join: str) -> str:
    return join if join.rstrip().endswith(" l") else f"{join.rstrip()} l"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a Spark DataFrame, the rows of ``CTES``."""
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    wanted = [c for c in CTES if c == name or c in _NEEDS[name]]
    ctes = ",\n".join(f"{c} AS ({_late('SELECT * FROM base' if c == 'base' else CTES[c].strip())})" for c in wanted)
    return spark.sql(f"WITH raw AS ({_RAW}),\n{ctes}\nSELECT * FROM {name}")
