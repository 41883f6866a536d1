"""Queries from source files to graph and flows: systems of files are written out of the tables, so SQL knows the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.lineage import temporary
from ..sources import fact_cache
from .derived import Source, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(Source(spark, sf_dir))
        ORACLES[name] = oracle(sql)
        return run

    return register


_C, _N = "cast(c_custkey as string)", "cast(c_nationkey as string)"
_QUEUE = f"""case c_custkey % 3 when 0 then 'url(id)' when 1 then concat('process.env.Q', {_N}) else concat('"q', cast(c_nationkey % 4 as string), '"') end"""
#: A service of each customer, in the repository of its nation.
_SERVICES = f"""select concat('shop', {_N}) as repo, concat('svc/', {_C}, '.ts') as path, concat('import express from "express";
import {{ Db }} from "../store/db";
import {{ gone }} from "./gone";
import {{ SendMessageCommand }} from "@aws-sdk/client-sqs";
const app = express();
class Svc {{
  constructor(private db: Db) {{}}
  save(id: string) {{ this.db.put(id); tell(id);', case when c_custkey % 7 = 0 then ' gone();' else '' end, ' }}
}}
function tell(id: string) {{ new SendMessageCommand({{ QueueUrl: ', {_QUEUE}, ' }}); }}
function list() {{ const s = new Svc(); s.save("1"); }}
app.get("/c/', {_C}, '", list);
') as text, c_custkey, c_nationkey from customer"""
_FIRST = "(select c_nationkey, min(c_custkey) as k from customer group by c_nationkey)"
_SHOP = f"""select repo, path, text from ({_SERVICES}) s_
 union all select concat('shop', cast(n_nationkey as string)), 'store/db.ts', 'export class Db {{
  put(id: string) {{ write(id); }}
}}
function write(id: string) {{}}
' from nation
 union all select concat('shop', {_N}), 'web/page.tsx', concat('export function Page() {{ fetch("/c/', cast(k as string), '"); return <p/>; }}
const r = <Route path="/n', {_N}, '" element={{<Page />}} />;
') from {_FIRST} f_"""
_ENV = "select concat('Q', cast(n_nationkey as string)) as key, concat('e', cast(n_nationkey as string)) as value from nation where n_nationkey % 2 = 0"

#: What comes of it: each symbol and edge, said once more in SQL.
_OPEN = "c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_nationkey % 2 = 1)"
_EXPECTED = f"""svc as (select *, concat('sym:', repo, '@', path, '#') as s, concat('ep:', repo, '@GET:/c/', c_custkey) as ep, concat('sym:', repo, '@store/db.ts#') as db,
  concat('gap:call:', repo, '@', path, '@', strpos(text, 'gone();') - 1) as lost, concat('gap:chan:', repo, '@', path, '@', strpos(text, 'new SendMessageCommand') - 1, '@sqs-queue Produces') as silent from ({_SERVICES})),
 want as (select ep as src, 'HANDLES' as label, concat(s, 'list') as dst, 'Confirmed' as conf from svc
  union all select concat(s, 'list'), 'CALLS', concat(s, 'Svc.save'), 'Confirmed' from svc
  union all select concat(s, 'Svc.save'), 'CALLS', concat(db, 'Db.put'), 'Confirmed' from svc
  union all select concat(s, 'Svc.save'), 'CALLS', concat(s, 'tell'), 'Confirmed' from svc
  union all select concat(s, 'Svc.save'), 'CALLS', lost, 'Gap' from svc where c_custkey % 7 = 0
  union all select concat(s, 'tell'), 'PUBLISHES', case when {_OPEN} then silent when c_custkey % 3 = 1 then concat('chan:sqs-queue:e', c_nationkey) else concat('chan:sqs-queue:q', c_nationkey % 4) end, case when {_OPEN} then 'Gap' else 'Confirmed' end from svc
  union all select concat('sym:shop', n_nationkey, '@store/db.ts#Db.put'), 'CALLS', concat('sym:shop', n_nationkey, '@store/db.ts#write'), 'Confirmed' from nation
  union all select concat('screen:shop', c_nationkey, '@/n', c_nationkey), 'RENDERS', concat('sym:shop', c_nationkey, '@web/page.tsx#Page'), 'Confirmed' from {_FIRST}
  union all select concat('sym:shop', c_nationkey, '@web/page.tsx#Page'), 'FETCHES', concat('ep:shop', c_nationkey, '@GET:/c/', k), 'Confirmed' from {_FIRST}
  union all select concat(s, x), 'DEFINED_IN', concat('file:', repo, '@', path), 'Confirmed' from svc, (select unnest(['Svc', 'Svc.constructor', 'Svc.save', 'tell', 'list']) as x)
  union all select concat('sym:shop', n_nationkey, '@store/db.ts#', x), 'DEFINED_IN', concat('file:shop', n_nationkey, '@store/db.ts'), 'Confirmed' from nation, (select unnest(['Db', 'Db.put', 'write']) as x)
  union all select concat('sym:shop', c_nationkey, '@web/page.tsx#Page'), 'DEFINED_IN', concat('file:shop', c_nationkey, '@web/page.tsx'), 'Confirmed' from {_FIRST})"""


def _shop(s):
    return ingest.ingested(s.sql(_SHOP), s.sql(_ENV))


@query("op161_ingest_edges", f"with {_EXPECTED} select distinct src, label, dst, conf from want")
def _(s):
    return _shop(s)[1].select("src", "label", "dst", "conf")


@query(
    "op161_ingest_nodes",
    f"""with {_EXPECTED}, ids as (select src as id from want union select dst from want)
 select id, case when id like 'sym:%' then 'Symbol' when id like 'ep:%' then 'Endpoint' when id like 'file:%' then 'File' when id like 'chan:%' then 'Channel' when id like 'screen:%' then 'Screen' else 'Gap' end as label, case when id like 'gap:%' then 'Gap' else 'Confirmed' end as conf from ids""",
)
def _(s):
    return _shop(s)[0].select("id", "label", "conf")


@query(
    "op161_ingest_flows",
    f"""with svc as ({_SERVICES}), own as (select c_nationkey, c_custkey, concat('ep:', repo, '@GET:/c/', c_custkey) as id, 6 + case when c_custkey % 7 = 0 then 1 else 0 end as n, case when c_custkey % 7 = 0 then 1 else 0 end + case when {_OPEN} then 1 else 0 end as g from svc),
 t as (select id, n, g from own where c_custkey not in (select k from {_FIRST}) union all select concat('screen:shop', f.c_nationkey, '@/n', f.c_nationkey), n + 2, g from {_FIRST} f join own on own.c_custkey = f.k)
 select id as trigger_id, cast(n as bigint) as hops, round((n - g) / n, 9) as score, case when g > 0 then 'Partial' else 'Verified' end as status from t""",
)
def _(s):
    return ingest.ingested_flows(s.sql(_SHOP), s.sql(_ENV)).withColumn("score", F.round("score", 9))


_S, _K = "cast(s_suppkey as string)", "cast(s_nationkey as string)"
_CLIENTS = f"""select 'shop' as repo, concat('S', {_S}, '.java') as path, concat('package p', {_K}, ';
import q.Db', {_K}, ';
class S', {_S}, ' {{
  private Db', {_K}, ' db;
  void go(Near', {_S}, ' near, ext.Far far) {{ db.save(); near.run(); far.off(); stay(); }}
  void stay() {{}}
}}
') as text, s_suppkey, s_nationkey from supplier"""
_STORE = "package q;\nclass Db', cast(n_nationkey as string), ' { void ', case when n_nationkey % 4 = 3 then 'other' else 'save' end, '() {} }\n"
_JVM = f"""select repo, path, text from ({_CLIENTS}) c_
 union all select 'shop', concat('a/Db', cast(n_nationkey as string), '.java'), concat('{_STORE}') from nation
 union all select 'shop', concat('b/Db', cast(n_nationkey as string), '.java'), concat('{_STORE}') from nation where n_nationkey % 5 = 0
 union all select 'shop', concat('Near', {_S}, '.kt'), concat('package p', {_K}, '
class Near', {_S}, '(val db: q.Db', {_K}, ') {{
  fun run() = 1
}}
') from supplier where s_suppkey % 2 = 0"""


@query(
    "op083_calls_from_files",
    f"""with c as (select *, concat('sym:shop@', path, '#S', s_suppkey, '.') as me from ({_CLIENTS}))
 select concat(me, 'go') as src, case when s_nationkey % 5 = 0 or s_nationkey % 4 = 3 then concat('gap:call:shop@', path, '@', strpos(text, 'db.save(') - 1) else concat('sym:shop@a/Db', s_nationkey, '.java#Db', s_nationkey, '.save') end as dst, case when s_nationkey % 5 = 0 or s_nationkey % 4 = 3 then 'Gap' else 'Confirmed' end as conf from c
 union all select concat(me, 'go'), concat('sym:shop@Near', s_suppkey, '.kt#Near', s_suppkey, '.run'), 'Confirmed' from c where s_suppkey % 2 = 0
 union all select concat(me, 'go'), concat(me, 'stay'), 'Confirmed' from c""",
)
def _(s):
    return ingest.ingested(s.sql(_JVM))[1].where("label = 'CALLS'").select("src", "dst", "conf")


_GO = f"""select 'shop' as repo, 'go.mod' as path, 'module example.com/shop
' as text
 union all select 'shop', concat('cmd', {_S}, '/main.go'), concat('package main

import (
	"net/http"
	st "example.com/shop/store"
)

func main() {{
	http.HandleFunc("GET /s/', {_S}, '", list)
	http.HandleFunc("GET /t/', {_S}, '", st.Save', {_K}, ')
}}

func list() {{ st.Save', {_K}, '() }}
') from supplier
 union all select 'shop', concat('store/x', cast(n_nationkey as string), '.go'), concat('package store

func Save', cast(n_nationkey as string), '() {{}}
') from nation where n_nationkey % 4 < 3
 union all select 'shop', concat('store/y', cast(n_nationkey as string), '.go'), concat('package store

func Save', cast(n_nationkey as string), '() {{}}
') from nation where n_nationkey % 4 = 0"""


@query(
    "op082_calls_from_files",
    """with t as (select *, concat('sym:shop@store/', case when s_nationkey % 4 = 0 then 'y' else 'x' end, s_nationkey, '.go#Save', s_nationkey) as target from supplier)
 select concat('sym:shop@cmd', s_suppkey, '/main.go#list') as src, 'CALLS' as label, target as dst from t where s_nationkey % 4 < 3
 union all select concat('ep:shop@GET:/s/', s_suppkey), 'HANDLES', concat('sym:shop@cmd', s_suppkey, '/main.go#list') from t
 union all select concat('ep:shop@GET:/t/', s_suppkey), 'HANDLES', target from t where s_nationkey % 4 < 3""",
)
def _(s):
    return ingest.ingested(s.sql(_GO))[1].where("label <> 'DEFINED_IN'").select("src", "label", "dst")


@query(
    "op270_cached_facts",
    """with n as (select (select count(*) from customer) + (select count(*) from nation) + (select count(distinct c_nationkey) from customer) as files, (select count(*) from customer where c_custkey % 10 = 3) as more, (select count(*) from customer where c_custkey % 10 = 4) as gone)
 select 1 as run, files as parsed, 0 as reused, 0 as dropped from n union all select 2, 0, files, 0 from n union all select 3, more, files - more - gone, gone from n""",
)
def _(s):
    files = s.sql(_SHOP)
    cache = fact_cache.FactCache(s.spark, temporary(s.spark, "facts"))
    key = F.regexp_extract("path", r"^svc/\d*(\d)\.ts$", 1)
    changed = files.where(key != "4").withColumn("text", F.when(key == "3", F.concat("text", F.lit("// more\n"))).otherwise(F.col("text")))
    runs = [(k, cache.refresh(f)) for k, f in enumerate((files, files, changed), 1)]
    return s.spark.createDataFrame([(k, *[told[c] for c in ("parsed", "reused", "dropped")]) for k, told in runs], "run int, parsed long, reused long, dropped long")
