"""The canonical property graph derived from the driver's tables, as SQL text that Spark and DuckDB both take."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TIER = "case {c} when 'InferredStrong' then 'Semantic' when 'InferredWeak' then 'Agentic' else 'Deterministic' end"

NODES = """
select concat('screen:r', cast(r_regionkey as string)) as id, 'Screen' as label, r_name as name, 'Confirmed' as conf, 'ts' as extractor, cast(r_regionkey as bigint) as k from region
union all select concat('sym:n', cast(n_nationkey as string)), 'Component', n_name, 'Confirmed', 'ts', cast(n_nationkey as bigint) from nation
union all select concat('ep:c', cast(c_custkey as string)), 'Endpoint', c_name, 'Confirmed', 'java', c_custkey from customer
union all select concat('sym:o', cast(o_orderkey as string)), 'Symbol', o_orderpriority, case when o_orderstatus = 'P' then 'InferredWeak' else 'Confirmed' end, 'go', o_orderkey from orders
union all select concat('sym:s', cast(s_suppkey as string)), 'Symbol', s_name, 'InferredStrong', 'python', s_suppkey from supplier
union all select concat('chan:p', cast(p_partkey as string)), 'Channel', p_name, 'Confirmed', 'events', p_partkey from part
union all select distinct concat('gap:o', cast(l_orderkey as string), '@', cast(l_linenumber as string)), 'Gap', 'unresolved', 'Gap', 'events', l_orderkey from lineitem where l_returnflag = 'R' and l_quantity < 5
"""

EDGES = """
select concat('screen:r', cast(n_regionkey as string)) as src, concat('sym:n', cast(n_nationkey as string)) as dst, 'RENDERS' as label, 'Confirmed' as conf from nation
union all select concat('sym:n', cast(c_nationkey as string)), concat('ep:c', cast(c_custkey as string)), 'FETCHES', 'Confirmed' from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
union all select concat('ep:c', cast(o_custkey as string)), concat('sym:o', cast(o_orderkey as string)), 'HANDLES', case when o_orderstatus = 'P' then 'InferredWeak' else 'Confirmed' end from orders
union all select concat('sym:o', cast(l_orderkey as string)), concat('chan:p', cast(l_partkey as string)), 'PUBLISHES', min(case when l_linestatus = 'O' then 'Confirmed' else 'InferredStrong' end) from lineitem where not (l_returnflag = 'R' and l_quantity < 5) group by l_orderkey, l_partkey
union all select distinct concat('sym:o', cast(l_orderkey as string)), concat('gap:o', cast(l_orderkey as string), '@', cast(l_linenumber as string)), 'PUBLISHES', 'Gap' from lineitem where l_returnflag = 'R' and l_quantity < 5
union all select distinct concat('sym:s', cast(l_suppkey as string)), concat('chan:p', cast(l_partkey as string)), 'SUBSCRIBES', 'Confirmed' from lineitem where l_linenumber = 1
"""

#: A graph with cycles: what users do leads to a user of the same hundred, or back; it grows with the users.
_OTHER = "(user_id - user_id % 100 + (user_id % 100 * 7 + 3) % 100)"
CYCLES = f"""
select distinct concat('u', cast(case when event_type = 'error' then {_OTHER} else user_id end as string)) as src,
 concat('u', cast(case when event_type = 'error' then user_id else {_OTHER} end as string)) as dst, event_type as label
from events where event_type in ('click', 'error')
"""

#: Facts of the domain layer with their properties, for artifacts and enrichment.
_ROWS = {
    "Capability": ("concat('cap:r', cast(r_regionkey as string))", """concat('{"title":"', r_name, '"}')""", "case when r_regionkey = 4 then 'Gap' else 'Confirmed' end", "from region"),
    "DataEntity": ("concat('data:shop@idb:n', cast(n_nationkey as string))", """concat('{"name":"', n_name, '"}')""", "case n_nationkey % 5 when 0 then 'InferredStrong' when 1 then 'InferredWeak' else 'Confirmed' end", "from nation"),
    "Resource": ("concat('res:shop@s', cast(s_suppkey as string))", """concat('{"type":"aws_sqs_queue","logical_id":"', s_name, '"', case when s_nationkey % 4 = 0 then ',"placeholder":true' else '' end, '}')""", "case when s_suppkey % 10 = 9 then 'Gap' else 'Confirmed' end", "from supplier"),
    "Channel": ("concat('chan:sqs-queue:p', cast(p_partkey as string))", """concat('{"kind":"sqs-queue","identity":"', p_name, '"}')""", "'Confirmed'", "from part"),
    "ADR": ("concat('adr:shop@docs/adr/', cast(p_partkey as string), '.md')", """concat('{"title":"', p_name, '","origin":"found","status":"accepted","forbids":["SUBSCRIBES"]}')""", "'Confirmed'", "from part where p_size = 7"),
    "Tool": ("concat('tool:shop@', p_brand)", """concat('{"display":"', p_brand, '","category":"build","settings":{"b":"x|y","a":"', cast(n as string), '"}', case when n % 2 = 0 then ',"settings_behind_code":true' else '' end, '}')""", "'Confirmed'", "from (select p_brand, count(*) as n from part group by p_brand) t_"),
    "Endpoint": ("concat('ep:shop@GET:/c/', cast(c_custkey as string))", """concat('{"method":"GET","path":"/c/', cast(c_custkey as string), '"', case c_mktsegment when 'BUILDING' then ',"authenticated":false' when 'MACHINERY' then ',"auth":"Protected"' else '' end, '}')""", "case when c_custkey % 6 = 5 then 'Gap' else 'Confirmed' end", "from customer"),
    "Drift": ("concat('drift:n', cast(n_nationkey as string))", """concat('{"title":"drift ', n_name, '","adr_id":"adr:', n_name, '","offending_edge":"a SUBSCRIBES b"', case when n_nationkey % 2 = 0 then ',"flow_triggers":["x","y"]' else '' end, '}')""", "'Confirmed'", "from nation where n_nationkey % 7 = 0"),
    "Finding": ("concat('finding:security:n', cast(n_nationkey as string))", """concat('{"kind":"security","title":"wide ', n_name, '","category":"iam","subject_id":"s | t","resource_scope":["*"],"actions":["s3:*","sqs:Get"]}')""", "'Confirmed'", "from nation where n_nationkey % 6 = 0"),
    "Gap": ("concat('gap:chan:s', cast(s_suppkey as string))", """concat('{"reason":"computed identity","kind":"sqs-queue","raw":"queue ', s_name, '"}')""", "'Gap'", "from supplier where s_suppkey % 3 = 0"),
}
FACT_NODES = " union all ".join(f"select {i} as id, '{label}' as label, {p} as props, {c} as conf {rest}" for label, (i, p, c, rest) in _ROWS.items())

_RES, _CHAN, _DATA = "concat('res:shop@s', cast({} as string))", "concat('chan:sqs-queue:p', cast({} as string))", "concat('data:shop@idb:n', cast({} as string))"
FACT_EDGES = f"""
select {_DATA.format('n_nationkey')} as src, concat('cap:r', cast(n_regionkey as string)) as dst, 'REALIZES' as label, '{{}}' as props, 'Confirmed' as conf from nation
union all select concat('ep:shop@GET:/c/', cast(c_custkey as string)), {_DATA.format('c_nationkey')}, case when c_custkey % 2 = 0 then 'READS' else 'WRITES' end, '{{}}', case c_custkey % 9 when 0 then 'Gap' when 1 then 'InferredWeak' else 'Confirmed' end from customer
union all select concat('adr:shop@docs/adr/', cast(p_partkey as string), '.md'), {_CHAN.format('p_partkey')}, 'DECIDES', '{{}}', 'Confirmed' from part where p_size = 7
union all select distinct {_RES.format('l_suppkey')}, {_CHAN.format('l_partkey')}, 'SUBSCRIBES', '{{}}', case (l_suppkey + l_partkey) % 5 when 0 then 'InferredWeak' when 1 then 'InferredStrong' else 'Confirmed' end from lineitem where l_linenumber = 1
union all select {_RES.format('s_suppkey')}, {_CHAN.format('s_suppkey')}, 'BACKS', '{{}}', 'Confirmed' from supplier
union all select {_RES.format('s_suppkey')}, {_RES.format('s_suppkey + 1')}, 'DEPENDS_ON', '{{}}', 'Confirmed' from supplier where s_suppkey % 3 = 0
union all select {_RES.format('s_suppkey')}, {_RES.format('s_suppkey + 2')}, 'GRANTS', case when s_suppkey % 4 = 0 then '{{"actions":["s3:*"]}}' else '{{"actions":["s3:Get"]}}' end, 'Confirmed' from supplier
union all select distinct concat('tool:shop@', p_brand), concat('file:shop@', p_type, '.json'), 'DEFINED_IN', '{{}}', 'Confirmed' from part
union all select {_RES.format('s_suppkey')}, concat('gap:chan:s', cast(s_suppkey as string)), 'PUBLISHES', '{{"reason":"computed identity"}}', 'Gap' from supplier where s_suppkey % 3 = 0
union all select concat('drift:n', cast(n_nationkey as string)), {_CHAN.format('n_nationkey')}, 'CONFLICTS', '{{}}', 'Confirmed' from nation where n_nationkey % 7 = 0
"""

def sql(text: str, dialect: str) -> str:
    """`sha(x)` in the text becomes the digest function of the dialect."""
    out, at = [], 0
    while (i := text.find("sha(", at)) >= 0:
        depth, j = 1, i + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        inner = sql(text[i + 4 : j - 1], dialect)
        out += [text[at:i], f"sha2({inner}, 256)" if dialect == "spark" else f"sha256({inner})"]
        at = j
    return "".join([*out, text[at:]])


def facts(dialect: str) -> dict[str, str]:
    nodes = f"select *, {_TIER.format(c='conf')} as tier, sha(concat('n ', id)) as hash from ({NODES}) n_"
    edges = f"select *, {_TIER.format(c='conf')} as tier, sha(concat(src, ' ', label, ' ', dst)) as hash from ({EDGES}) e_"
    stamp = f"{_TIER.format(c='conf')} as tier, 'x' as extractor, '' as evidence"
    fact_n = f"select *, {stamp}, sha(concat('n ', id)) as hash from ({FACT_NODES}) n_"
    fact_e = f"select *, {stamp}, sha(concat(src, ' ', label, ' ', dst)) as hash from ({FACT_EDGES}) e_"
    return {"nodes": sql(nodes, dialect), "edges": sql(edges, dialect), "cycles": CYCLES, "facts_n": sql(fact_n, dialect), "facts_e": sql(fact_e, dialect)}


def oracle(text: str, *names: str) -> str:
    """DuckDB text with the named derived tables before it."""
    have = facts("duckdb")
    used = names or [n for n in have if n in text]
    ctes = ", ".join(f"{n} as ({have[n]})" for n in used)
    text = sql(text.strip(), "duckdb")
    if not ctes:
        return text
    if text.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {text[len('with recursive'):]}"
    return f"with {ctes}, {text[4:]}" if text.lower().startswith("with") else f"with {ctes} {text}"


class Source:
    """Tables of one data directory, and the derived graph over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cache  # noqa: B019
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if t in text}
        return self.spark.sql(_braced(sql(text, "spark"), used), **used) if used else self.spark.sql(text)

    @property
    def nodes(self) -> DataFrame:
        return self.sql(facts("spark")["nodes"])

    @property
    def edges(self) -> DataFrame:
        return self.sql(facts("spark")["edges"])

    @property
    def fact_nodes(self) -> DataFrame:
        return self.sql(facts("spark")["facts_n"])

    @property
    def fact_edges(self) -> DataFrame:
        return self.sql(facts("spark")["facts_e"])

    @property
    def cycles(self) -> DataFrame:
        return self.sql(facts("spark")["cycles"])


def _braced(text: str, used: dict) -> str:
    """Table names after FROM or JOIN become parameters, so no temporary view is made."""
    import re

    text = text.replace("{", "{{").replace("}", "}}")
    return re.sub(r"\b(from|join)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", text)
