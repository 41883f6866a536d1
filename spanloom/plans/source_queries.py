"""Queries of readers and extractors: inputs are written out of the tables and read back, so SQL knows the answer."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..functions.exprs import redacted
from ..operators import guarded, plugins, resolve, semantic
from ..sources import extractors, observations
from .derived import Source, oracle

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run

    return register


def text(s, table: str, path: str, template: str):
    """``path, text`` with {column} in both filled from the rows."""

    def filled(t: str):
        out = [F.col(x).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(t.replace("[[", "\x01").replace("]]", "\x02").replace("{", "\x00").replace("}", "\x00").split("\x00"))]
        return F.translate(F.concat(*out), "\x01\x02", "{}")

    return s.table(table).select(filled(path).alias("path"), filled(template).alias("text"))


@query("op031_repo_name", "select c_custkey, concat('org', c_nationkey, '/', c_custkey) as repo from customer")
def _(s):
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://git.example.com/org"), n, F.lit("/"), k, F.lit(".git"))).otherwise(F.concat(F.lit("git@git.example.com:org"), n, F.lit("/"), k))
    return s.table("customer").select("c_custkey", observations.repo_name(url).alias("repo"))


@query("op033_env_entries", "select concat('f', n_regionkey) as file, n_nationkey as line, concat('K', n_nationkey) as key, n_name as value from nation where n_nationkey % 5 <> 4")
def _(s):
    k = F.col("n_nationkey").cast("string")
    m = F.col("n_nationkey") % 5
    # quotes go from both ends, paired or not
    line = F.when(m == 0, F.concat(F.lit("export K"), k, F.lit("=\""), "n_name", F.lit("\""))).when(m == 1, F.concat(F.lit("  K"), k, F.lit("= '"), "n_name")).when(m == 4, F.concat(F.lit("# K"), k, F.lit("=x"))).otherwise(F.concat(F.lit("K"), k, F.lit(" = "), "n_name"))
    return observations.env_entries(s.table("nation").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_nationkey").alias("line"), line.alias("text")))


@query("op034_terraform_state", "select concat('aws_sqs_queue.q', s_suppkey) as address, s_name as name, '[redacted]' as arn, cast(s_nationkey as varchar) as delay from supplier union all select concat('module.m.aws_sns_topic.t', s_suppkey), s_name, s_name, null from supplier")
def _(s):
    # square brackets of JSON arrays are written as < and > so as not to meet the braces' escapes
    doc = '[["values":[["root_module":[["resources":<[["address":"aws_sqs_queue.q{s_suppkey}","type":"aws_sqs_queue","name":"q","values":[["name":"{s_name}","arn":"x","delay":{s_nationkey},"tags":[["a":1]]]],"sensitive_values":[["arn":true]]]]>,"child_modules":<[["resources":<[["address":"module.m.aws_sns_topic.t{s_suppkey}","type":"aws_sns_topic","name":"t","values":[["name":"{s_name}","arn":"{s_name}"]]]]>]]>]]]]]]'
    docs = text(s, "supplier", "s{s_suppkey}.json", doc).withColumn("text", F.translate("text", "<>", "[]"))
    rows = observations.terraform_resources(docs)
    get = lambda k: F.get_json_object("values", f"$.{k}")
    return rows.select("address", get("name").alias("name"), get("arn").alias("arn"), get("delay").alias("delay"))


@query("op035_pulumi_stack", "select concat('urn:', s_suppkey) as urn, s_name as name, '[redacted]' as secret from supplier")
def _(s):
    doc = '[["deployment":[["resources":<[["urn":"urn:stack","type":"pulumi:pulumi:Stack"]],[["urn":"urn:{s_suppkey}","type":"aws:sqs/queue:Queue","inputs":[["name":"old"]]]],[["urn":"gone","type":"a","delete":true]],[["urn":"urn:{s_suppkey}","type":"aws:sqs/queue:Queue","inputs":[["name":"{s_name}","secret":[["ciphertext":"c"]]]]]]>]]]]'
    docs = text(s, "supplier", "p{s_suppkey}.json", doc).withColumn("text", F.translate("text", "<>", "[]"))
    return observations.pulumi_resources(docs).select("urn", F.get_json_object("inputs", "$.name").alias("name"), F.get_json_object("inputs", "$.secret").alias("secret"))


@query("op036_otlp_spans", "select cast(event_id as varchar) as span_id, event_type as name, cast(user_id as varchar) as user_id, 'svc' as service from events where event_id % 10 > 0")
def _(s):
    e = s.table("events")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"stringValue":"'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"intValue":"'), F.col("user_id").cast("string"), F.lit('"')))
    span = F.concat(F.lit('{"'), F.when(F.col("event_id") % 3 == 0, "span_id").otherwise("spanId"), F.lit('":"'), F.when(F.col("event_id") % 10 > 0, F.col("event_id").cast("string")).otherwise(""), F.lit('","traceId":"t","name":"'), "event_type", F.lit('","attributes":[{"key":"user","value":{'), value, F.lit("}}]}"))
    line = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service","value":{"stringValue":"svc"}}]},"scopeSpans":[{"spans":['), span, F.lit("]}]}]}"))
    return observations.otlp_spans(e.select(line.alias("text"))).select("span_id", "name", observations.attribute("user.id", "user").alias("user_id"), observations.attribute("service").alias("service"))


_MANIFEST = '[[repos]]\nurl = "https://example.com/a/b"\nlayers = ["server", "events"]\nstate_json = "s.json"\notel_jsonl = ["t1.jsonl", "t2.jsonl"]\n[[repos]]\nurl = "https://example.com/a/c"\npulumi_json = "p.json"\n[env]\nK3 = "v"\nN1 = "w"\n'


@query("op032_manifest", """select concat('m', s_suppkey, '.toml') as path, 0 as place, concat('https://example.com/a/', s_suppkey) as url, 'server,events' as layers, concat('s', s_nationkey, '.json') as state_json, null as pulumi_json, 2 as traces from supplier
 union all select concat('m', s_suppkey, '.toml'), 1, concat('https://example.com/b/', s_suppkey), '', null, 'p.json', 0 from supplier""")
def _(s):
    toml = '<<repos>>\nurl = "https://example.com/a/{s_suppkey}"\nlayers = <"server", "events">\nstate_json = "s{s_nationkey}.json"\notel_jsonl = <"a", "b">\n\n<<repos>>\nurl = "https://example.com/b/{s_suppkey}"\npulumi_json = "p.json"\n'
    docs = text(s, "supplier", "m{s_suppkey}.toml", toml).withColumn("text", F.translate("text", "<>", "[]"))
    return observations.manifests(docs).select("path", "place", "url", F.array_join("layers", ",").alias("layers"), "state_json", "pulumi_json", F.size("otel_jsonl").alias("traces"))


@query("op032_manifest_env", "select key, case key when 'K3' then 'v' when 'N1' then 'w' else value end as value from (select concat('K', n_nationkey) as key, n_name as value from nation union all select 'N1', null) c")
def _(s):
    config = s.table("nation").select(F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"), F.lit("f").alias("file"), F.col("n_nationkey").alias("line"))
    return resolve.first_definition(config, observations.manifest_env(s.spark, _MANIFEST))


@query("op046_loopback", "select c_custkey, c_custkey % 5 < 3 as here from customer")
def _(s):
    k = F.col("c_custkey") % 5
    url = F.when(k == 0, "http://LOCALHOST:8080/v1").when(k == 1, "http://127.0.0.1/x").when(k == 2, "https://[::1]:1/").when(k == 3, "http://127.0.0.1.example.com/").otherwise("http://localhost@evil.example/")
    return s.table("customer").select("c_custkey", plugins.loopback(url).alias("here"))


@query("op047_completions", "select n_nationkey as task, case n_nationkey % 3 when 0 then 'text' end as answer, case n_nationkey % 3 when 1 then 'ProviderRefusal: no' when 2 then 'ValueError: empty completion' end as error from nation")
def _(s):
    tasks = s.table("nation").select(F.col("n_nationkey").alias("task"), (F.col("n_nationkey") % 3).cast("string").alias("prompt"))
    answer = lambda prompt: '{"answer": "' + plugins.completion_text([{"text": " text "}, {"text": "no", "stop_reason": "refusal"}, {"text": " "}][int(prompt[0])]) + '"}'
    return plugins.answered(tasks, answer, {"answer"}).select("task", F.get_json_object("answer", "$.answer").alias("answer"), "error")


@query("op269_batch_outcomes", "select n_nationkey % 3 < 2 as ok, count(*) as n from nation group by 1")
def _(s):
    tasks = s.table("nation").select(F.col("n_nationkey").alias("task"), F.concat(F.lit("prompt "), (F.col("n_nationkey") % 3).cast("string")).alias("prompt"))
    return plugins.answered(tasks, _sample_provider, {"answer"}).groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n"))


@query("op037_tsconfig_paths", "select concat('r', n_nationkey) as dir, n_name as base_url, '@/*' as pattern from nation")
def _(s):
    docs = text(s, "nation", "r{n_nationkey}/tsconfig.json", '[[// "x"\n"compilerOptions":[["baseUrl":"{n_name}",/* , */"paths":[["@/*":<"src/*",>,]],]],]]').withColumn("text", F.translate("text", "<>", "[]"))
    return observations.tsconfig_paths(docs).select("dir", "base_url", "pattern")


_ADR = "# {n_name}\n\nStatus: accepted\nGoverns: `chan:p{n_nationkey}`, x\nForbids: SUBSCRIBES, no-label\n\nUses `sym:{n_nationkey}`.\n"


@query("op038_decision_discovery", "select concat(case n_nationkey % 4 when 0 then 'docs/adr/' when 1 then 'notes/adr-' when 2 then 'RFCs/' end, n_nationkey, '.md') as path from nation where n_nationkey % 4 < 3")
def _(s):
    docs = text(s, "nation", "AT{n_nationkey}.md", _ADR)
    k = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int") % 4
    at = F.when(k == 0, "docs/adr/").when(k == 1, "notes/adr-").when(k == 2, "RFCs/").otherwise("docs/")
    return observations.decision_records(docs.withColumn("path", F.concat(at, F.substring("path", F.lit(3), F.length("path"))))).select("path")


@query("op230_decision_fields", "select n_name as title, 'accepted' as status, concat('chan:p', n_nationkey, '|x') as governs, concat('chan:p', n_nationkey, '|sym:', n_nationkey) as mentions, 'SUBSCRIBES' as forbids from nation")
def _(s):
    rows = observations.decision_records(text(s, "nation", "docs/adr/{n_nationkey}.md", _ADR))
    return rows.select("title", "status", *[F.array_join(c, "|").alias(c) for c in ("governs", "mentions", "forbids")])


@query("op041_evidence_slice", "select o_orderkey as path, o_orderpriority as text, 2 as start_line from orders")
def _(s):
    o = s.table("orders").select(F.col("o_orderkey").alias("path"), F.concat(F.lit("é\n"), "o_orderpriority", F.lit("\nrest")).cast("binary").alias("content"), F.lit(3).alias("byte_start"), (F.octet_length("o_orderpriority") + 3).alias("byte_end"))
    return observations.evidence_slice(o)


_PY = "from fastapi import FastAPI\nimport os\n\napp = FastAPI()\n\n\n@app.get('/c/{c_custkey}')\ndef f{c_custkey}():\n    return helper()\n"


@query("op223_python", "select concat('app/', c_custkey, '.py') as path, 'endpoint' as kind, concat('GET /c/', c_custkey) as name, concat('f', c_custkey) as detail from customer")
def _(s):
    return extractors.extracted(text(s, "customer", "app/{c_custkey}.py", _PY)).where("kind = 'endpoint'").select("path", "kind", "name", "detail")


_TS = "import express from 'express';\nimport [[ SendMessageCommand ]] from '@aws-sdk/client-sqs';\nconst app = express();\n// app.get('/no', x)\napp.post('/c/{c_custkey}', handler{c_custkey});\nfetch('/api/{c_custkey}', [[ method: 'PUT' ]]);\nnew SendMessageCommand([[ QueueUrl: process.env.Q{c_custkey} ]]);\neval(code);\n"


def _ts(s):
    return extractors.extracted(text(s, "customer", "src/{c_custkey}.ts", _TS))


@query("op211_express", "select concat('src/', c_custkey, '.ts') as path, concat('POST /c/', c_custkey) as name, concat('handler', c_custkey) as detail from customer")
def _(s):
    return _ts(s).where("kind = 'endpoint'").select("path", "name", "detail")


@query("op213_event_sites", """select concat('src/', c_custkey, '.ts') as path, 'sqs-queue Produces' as name, concat('["EnvRef", "Q', c_custkey, '"]') as detail from customer""")
def _(s):
    return _ts(s).where("kind = 'event'").select("path", "name", "detail")


@query("op215_fetch_sites", """select concat('src/', c_custkey, '.ts') as path, 'PUT' as name, concat('["Literal", "/api/', c_custkey, '"]') as detail from customer""")
def _(s):
    return _ts(s).where("kind = 'fetch'").select("path", "name", "detail")


@query("op210_typescript", "select kind, count(*) as n from (select unnest(['import', 'import', 'endpoint', 'fetch', 'event', 'dynamic']) as kind from customer) group by kind")
def _(s):
    return _ts(s).groupBy("kind").agg(F.count("*").alias("n"))


@query("op217_next_pages", "select concat('web/pages/', n_name, '/[id].tsx') as path, concat('/', n_name, '/:id') as route from nation")
def _(s):
    files = text(s, "nation", "web/pages/{n_name}/[id].tsx", "x").unionAll(text(s, "nation", "web/pages/api/{n_name}.ts", "x"))
    return extractors.page_screens(files)


@query("op224_go", "select concat('m/', c_custkey, '.go') as path, concat('GET /c/', c_custkey) as name, 'h.List' as detail from customer")
def _(s):
    src = 'package m\n\nimport (\n\t"net/http"\n)\n\nfunc routes(mux *http.ServeMux) [[\n\tmux.HandleFunc("GET /c/{c_custkey}", h.List)\n]]\n'
    return extractors.extracted(text(s, "customer", "m/{c_custkey}.go", src)).where("kind = 'endpoint'").select("path", "name", "detail")


_JAVA = 'package p;\nimport org.springframework.web.bind.annotation.*;\n@RestController\n@RequestMapping("/c/{c_custkey}")\npublic class C{c_custkey} [[\n  @GetMapping("/all")\n  public List<String> list() [[ return null; ]]\n]]\n'


@query("op225_java", "select concat('C', c_custkey, '.java') as path, concat('GET /c/', c_custkey, '/all') as name, 'list' as detail from customer")
def _(s):
    return extractors.extracted(text(s, "customer", "C{c_custkey}.java", _JAVA)).where("kind = 'endpoint'").select("path", "name", "detail")


@query("op226_kotlin", "select concat('C', c_custkey, '.kt') as path, concat('POST /k/', c_custkey) as name, 'add' as detail from customer")
def _(s):
    src = 'package p\nimport org.springframework.web.bind.annotation.*\n@RequestMapping("/k")\nclass C [[\n  @PostMapping("/{c_custkey}")\n  fun add(): Int = 1\n]]\n'
    return extractors.extracted(text(s, "customer", "C{c_custkey}.kt", src)).where("kind = 'endpoint'").select("path", "name", "detail")


_TF = 'resource "aws_sqs_queue" "q{s_suppkey}" [[\n  name = "x.aws_not.ref"\n  depends_on = <aws_iam_role.r>\n  policy = google_kms_key.p.arn\n  statement [[\n    actions = <"sqs:SendMessage", "sqs:*">\n    NotAction = "iam:*"\n  ]]\n]]\nmodule "m{s_suppkey}" [[\n  source = "./sub"\n  queue = aws_sqs_queue.q{s_suppkey}.url\n]]\n'


def _tf(s):
    docs = text(s, "supplier", "i/{s_suppkey}.tf", _TF).withColumn("text", F.translate("text", "<>", "[]"))
    return extractors.extracted(docs).select("kind", "name", "detail")


@query("op227_terraform", "select unnest(['resource', 'depends_on', 'references', 'attribute', 'attribute']) as kind, concat('aws_sqs_queue.q', s_suppkey) as name, unnest(['aws_sqs_queue', 'aws_iam_role.r', 'google_kms_key.p', 'depends_on aws_iam_role.r', 'policy google_kms_key.p']) as detail from supplier union all select unnest(['module', 'references', 'attribute']), concat('module.m', s_suppkey), unnest(['./sub', concat('aws_sqs_queue.q', s_suppkey), concat('queue aws_sqs_queue.q', s_suppkey)]) from supplier")
def _(s):
    return _tf(s).where("kind <> 'action'")


_SERVED = """select concat('i/', s_suppkey, '.tf') as path, unnest(['sqs:SendMessage', 'sqs:*']) as name, true as inside from supplier"""


@query("op262_guarded_extractor", _SERVED)
def _(s):
    docs = text(s, "supplier", "i/{s_suppkey}.tf", _TF).withColumn("text", F.translate("text", "<>", "[]"))
    rows = guarded.guarded(docs, [sys.executable, "-m", "spanloom.sources.serve"], guarded.Limits(memory=8 << 30, seconds=60.0))
    block = F.expr("decode(substring(encode(text, 'utf-8'), cast(byte_start + 1 as int), cast(byte_end - byte_start as int)), 'utf-8')")
    found = rows.where("kind in ('action', 'failed')").join(docs.select("path", "text"), "path")
    return found.select("path", F.col("detail").alias("name"), F.contains(block, F.col("detail")).alias("inside"))


@query("op228_iam_actions", "select concat('aws_sqs_queue.q', s_suppkey) as name, unnest(['sqs:SendMessage', 'sqs:*']) as detail from supplier")
def _(s):
    return _tf(s).where("kind = 'action'").select("name", "detail")


@query("op222_web_extension", "select concat('e', n_nationkey, '/manifest.json') as path, unnest(['extension', 'context', 'context', 'context', 'permission', 'permission', 'command']) as kind, unnest([n_name, 'background', 'popup', 'content:0', 'storage', 'tabs', 'go']) as name, unnest(['3', 'bg.js', 'p.html', 'c.js', '', '', '']) as detail from nation")
def _(s):
    docs = text(s, "nation", "e{n_nationkey}/manifest.json", '[["manifest_version":3,"name":"{n_name}","background":[["service_worker":"bg.js"]],"action":[["default_popup":"p.html"]],"content_scripts":<[["js":<"c.js">]]>,"permissions":<"tabs","storage">,"commands":[["go":[[]]]]]]').withColumn("text", F.translate("text", "<>", "[]"))
    return extractors.extracted(docs).select("path", "kind", "name", "detail")


@query("op221_indexed_db", "select concat('db', n_nationkey, '.ts') as path, n_name as name, case when n_nationkey % 2 = 0 then 'READS' else 'WRITES' end as detail from nation")
def _(s):
    docs = text(s, "nation", "db{n_nationkey}.ts", "tx.objectStore('{n_name}').OP(1);")
    docs = docs.withColumn("text", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 2 == 0, F.replace("text", F.lit("OP"), F.lit("get"))).otherwise(F.replace("text", F.lit("OP"), F.lit("put"))))
    return extractors.extracted(docs).where("kind = 'data'").select("path", "name", "detail")


@query("op229_eval_findings", "select concat('src/', c_custkey, '.ts') as path, 8 as line, 'eval' as finding from customer")
def _(s):
    return extractors.eval_findings(text(s, "customer", "src/{c_custkey}.ts", _TS))


@query("op231_toolchain", """select concat('r', n_nationkey, '/package.json') as path, n_name as name, '{"category": "dependency", "version": "^1"}' as detail from nation union all select concat('r', n_nationkey, '/Cargo.toml'), unnest(['cargo', 'serde']), unnest(['{"category": "build", "edition": "2021"}', '{"category": "dependency", "version": "1"}']) from nation union all select concat('r', n_nationkey, '/Dockerfile'), 'node', concat('{"category": "container", "version": "', n_nationkey, '"}') from nation""")
def _(s):
    docs = text(s, "nation", "r{n_nationkey}/package.json", '[["dependencies":[["{n_name}":"^1"]]]]')
    docs = docs.unionAll(text(s, "nation", "r{n_nationkey}/Cargo.toml", '<package>\nedition = "2021"\n<dependencies>\nserde = "1"\n').withColumn("text", F.translate("text", "<>", "[]")))
    docs = docs.unionAll(text(s, "nation", "r{n_nationkey}/Dockerfile", "FROM node:{n_nationkey} AS build\nFROM build\n"))
    return extractors.extracted(docs).where("kind = 'tool'").select("path", "name", "detail")


@query("op039_tool_files", """select concat('r', n_nationkey, f) as path, n as name, case when f = '/.env.local' then 0 else b end as byte_end from nation, (select unnest(['/go.mod', '/yarn.lock', '/.env.local', '/.github/workflows/ci.yml', '/.github/workflows/ci.yml', '/compose.yaml']) as f, unnest(['go', 'yarn', 'TOKEN', 'github-actions', 'actions/checkout', 'redis']) as n, unnest([17, 2, 0, 35, 35, 28]) as b) t""")
def _(s):
    files = {"/go.mod": "module x\ngo 1.22\n", "/yarn.lock": "#\n", "/.env.local": "TOKEN=very-secret\n# X=1\n", "/.github/workflows/ci.yml": "steps:\n- uses: actions/checkout@v4\n", "/compose.yaml": "services:\n    image: redis:7"}
    docs = None
    for path, body in files.items():
        rows = s.table("nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string"), F.lit(path)).alias("path"), F.lit(body).alias("text"))
        docs = rows if docs is None else docs.unionAll(rows)
    return extractors.extracted(docs).select("path", "name", "byte_end")


_NEST = "import [[ Controller, Get, Post ]] from '@nestjs/common';\n@Controller('c{c_custkey}')\nexport class A [[\n  @Get('list')\n  async all() [[]]\n  @Post()\n  add() [[]]\n]]\n@Controller()\nexport class B [[\n  @Get('b')\n  b() [[]]\n]]\n"


@query("op212_nestjs", "select concat('n/', c_custkey, '.ts') as path, unnest([concat('GET /c', c_custkey, '/list'), concat('POST /c', c_custkey), 'GET /b']) as name, unnest(['all', 'add', 'b']) as detail from customer")
def _(s):
    return extractors.extracted(text(s, "customer", "n/{c_custkey}.ts", _NEST)).where("kind = 'endpoint'").select("path", "name", "detail")


@query("op211_mounted_routers", "select concat('r/', c_custkey, '.ts') as path, unnest([concat('GET /v', c_custkey, '/a'), 'PUT /chain', 'DELETE /chain']) as name, unnest(['h', 'x', 'y']) as detail from customer")
def _(s):
    src = "import express from 'express';\nconst app = express();\nconst router = express.Router();\napp.use('/v{c_custkey}', router);\nrouter.get('/a', guard(1, 2), h);\napp.route('/chain').put(x).delete(y);\nlost.get('/no', h);\n"
    return extractors.extracted(text(s, "customer", "r/{c_custkey}.ts", src)).where("kind = 'endpoint'").select("path", "name", "detail")


@query("op213_gated_events", """select concat('e/', c_custkey, '.ts') as path, unnest(['kafka-topic Produces', 'inproc-event Consumes']) as name, unnest([concat('["Literal", "t', c_custkey, '"]'), '["Computed", "name(1, 2)"]']) as detail from customer""")
def _(s):
    src = "import [[ Kafka ]] from 'kafkajs';\nimport EventEmitter from 'events';\nconst kafka = new Kafka([[]]);\nconst out = kafka.producer();\nout.send([[ messages: [1, 2], topic: 't{c_custkey}' ]]);\nother.send([[ topic: 'no' ]]);\nconst bus = new EventEmitter();\nbus.on(name(1, 2), f);\nsocket.on('no', f);\nnew PublishCommand([[ TopicArn: 'no' ]]);\n"
    return extractors.extracted(text(s, "customer", "e/{c_custkey}.ts", src)).where("kind = 'event'").select("path", "name", "detail")


@query("op214_identities", """select concat('i/', c_custkey, '.ts') as path, unnest([concat('["Literal", "/l', c_custkey, '"]'), concat('["Literal", "/k', c_custkey, '"]'), '["Literal", "/t"]', '["EnvRef", "URL"]', concat('["Computed", "', repeat('base + ', 20), 'c', c_custkey, '"]')]) as detail from customer""")
def _(s):
    src = "const K = '/k{c_custkey}';\nfetch('/l{c_custkey}');\nfetch(K);\nfetch(`/t`);\nfetch(process.env.URL);\nfetch(" + "base + " * 20 + "c{c_custkey});\n"
    return extractors.extracted(text(s, "customer", "i/{c_custkey}.ts", src)).where("kind = 'fetch'").select("path", "detail")


@query("op215_axios", """select concat('x/', c_custkey, '.ts') as path, unnest(['POST', 'DELETE', '?']) as name, unnest([concat('["Literal", "/o', c_custkey, '"]'), '["Literal", "/m"]', '["Literal", "/q"]']) as detail from customer""")
def _(s):
    src = "import http from 'axios';\nhttp([[ url: '/o{c_custkey}', method: 'post' ]]);\nhttp.delete('/m');\nhttp.request([[ url: '/q', method: how ]]);\naxios.get('/no');\n"
    return extractors.extracted(text(s, "customer", "x/{c_custkey}.ts", src)).where("kind = 'fetch'").select("path", "name", "detail")


@query("op216_react", "select concat('c/', c_custkey, '.tsx') as path, unnest(['renders', 'renders', 'screen']) as kind, unnest(['Page', 'Menu', concat('/s', c_custkey)]) as name, unnest(['Menu', 'Item', 'Page']) as detail from customer")
def _(s):
    src = "function Page() [[ return <div><Menu a=[[1]] /></div>; ]]\nconst Menu = () => <ul><Item/></ul>;\nexport const routes = (<Route path='/s{c_custkey}' element=[[<Page />]] />);\n"
    return extractors.extracted(text(s, "customer", "c/{c_custkey}.tsx", src)).where("kind in ('screen', 'renders') and not (name = 'Menu' and detail = 'Page')").select("path", "kind", "name", "detail")


@query("op218_eval_facts", """select concat('v/', c_custkey, '.ts') as path, unnest(['eval:fetch', 'eval:symbol']) as kind, unnest(['GET', concat('f', c_custkey)]) as name from customer""")
def _(s):
    src = "eval(`fetch(\"/e\")`);\nnew Function('a', 'function f{c_custkey}() [[]]');\neval(code);\n"
    return extractors.extracted(text(s, "customer", "v/{c_custkey}.ts", src)).where("kind like 'eval:%'").select("path", "kind", "name")


@query("op219_pulumi", "select unnest(['pulumi', 'pulumi', 'references', 'gap']) as kind, unnest([concat('q', s_suppkey), 'm', 'm', 'computed resource name']) as name, unnest(['aws:sqs/queue:Queue', 'aws:lambda/eventSourceMapping:EventSourceMapping', concat('q', s_suppkey), 'aws:sns/topic:Topic']) as detail from supplier")
def _(s):
    src = 'import * as aws from "@pulumi/aws";\nconst q = new aws.sqs.Queue("q{s_suppkey}", [[]]);\nnew aws.lambda.EventSourceMapping("m", [[ eventSourceArn: q.arn ]]);\nnew aws.sns.Topic(name, [[]]);\nnew gcp.sql.Instance("no");\n'
    return extractors.extracted(text(s, "supplier", "p/{s_suppkey}.ts", src)).where("kind in ('pulumi', 'references', 'gap')").select("kind", "name", "detail")


@query("op220_messages", """select concat('m/', n_nationkey, '.ts') as path, 'chrome-message Produces' as name, concat('["Literal", "', n_name, '"]') as detail from nation where n_nationkey % 2 = 0 union all select concat('l/', n_nationkey, '.ts'), 'chrome-message Consumes', unnest([concat('["Literal", "', n_name, '"]'), '["Literal", "b"]']) from nation where n_nationkey % 2 = 0""")
def _(s):
    sent = text(s, "nation", "m/{n_nationkey}.ts", "chrome.runtime.sendMessage([[ id: 1, type: '{n_name}' ]]);\n")
    heard = text(s, "nation", "l/{n_nationkey}.ts", "browser.runtime.onMessage.addListener((m) => [[ if (m.type === '{n_name}') [[]] switch (m.type) [[ case 'b': break; ]] ]]);\n")
    number = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    rows = extractors.extracted(sent.unionAll(heard.where(number % 2 == 0))).withColumn("repo", number)
    return extractors.heard_messages(rows).where("kind = 'event'").select("path", "name", "detail")


@query("op224_go_groups", "select concat('g/', c_custkey, '.go') as path, unnest([concat('GET /a/v', c_custkey, '/x'), 'POST /v1/in/c']) as name, unnest(['h.List', 'add']) as detail from customer")
def _(s):
    src = 'package m\nimport (\n\t"github.com/go-chi/chi"\n\t"github.com/gin-gonic/gin"\n)\nfunc f(r chi.Router, e *gin.Engine) [[\n\tr.Route("/a", func(r chi.Router) [[\n\t\tr.Route("/v{c_custkey}", func(r chi.Router) [[\n\t\t\tr.Get("/x", h.List)\n\t\t]])\n\t]])\n\tv1 := e.Group("/v1")\n\tin := v1.Group("/in")\n\tin.POST("/c", add)\n]]\n'
    files = text(s, "customer", "g/{c_custkey}.go", src).unionAll(text(s, "customer", "g/{c_custkey}_linux.go", src))
    return extractors.extracted(files).where("kind = 'endpoint'").select("path", "name", "detail")


@query("op225_java_types", "select concat('T', c_custkey, '.java') as path, unnest(['endpoint', 'endpoint', 'endpoint', 'gap']) as kind, unnest([concat('GET /a', c_custkey, '/x'), concat('GET /a', c_custkey, '/y'), 'PUT /z', 'computed path']) as name, unnest(['one', 'one', 'two', 'DELETE three']) as detail from customer")
def _(s):
    src = 'package p;\nimport org.springframework.web.bind.annotation.*;\n@RequestMapping(path = "/a{c_custkey}", produces = "x/y")\nclass A [[\n  @GetMapping(value = [["/x", "/y"]], params = "q")\n  public List<String> one() [[ return null; ]]\n]]\n@RestController\nclass B [[\n  @PutMapping("/z")\n  void two() [[]]\n  @DeleteMapping(BASE + "/w")\n  void three() [[]]\n]]\n'
    return extractors.extracted(text(s, "customer", "T{c_custkey}.java", src)).where("kind in ('endpoint', 'gap')").select("path", "kind", "name", "detail")


@query("op226_kotlin_dynamic", "select concat('K', c_custkey, '.kt') as path, unnest(['endpoint', 'gap']) as kind, unnest([concat('GET /k', c_custkey), 'computed path']) as name, unnest(['one', 'POST two']) as detail from customer")
def _(s):
    src = 'package p\nimport org.springframework.web.bind.annotation.*\nclass K [[\n  @GetMapping("/k{c_custkey}")\n  fun one() = 1\n  @PostMapping("$base/x")\n  fun two() = 2\n]]\n'
    return extractors.extracted(text(s, "customer", "K{c_custkey}.kt", src)).where("kind in ('endpoint', 'gap')").select("path", "kind", "name", "detail")


@query("op260_pinned_identity", "select id, 'p@2c26b46b68ff' as extractor, conf from nodes")
def _(s):
    return plugins.pinned(s.nodes.select("id", "conf", "extractor"), "p", b"foo").select("id", "extractor", "conf")


@query("op261_filled_provenance", "select id, case when k % 2 = 0 then 'Deterministic' else tier end as tier, case when k % 3 = 0 then 'Confirmed' else conf end as conf from nodes")
def _(s):
    claimed = s.nodes.select("id", "extractor", F.when(F.col("k") % 2 == 1, F.col("tier")).alias("tier"), F.when(F.col("k") % 3 > 0, F.col("conf")).alias("conf"))
    return plugins.pinned(claimed, "p", b"foo").select("id", "tier", "conf")


@query("op262_conformance", "select n_name as plugin, n_nationkey % 3 = 0 as passed from nation")
def _(s):
    return plugins.gated_plugins(s.table("nation").select(F.col("n_name").alias("plugin"), (F.col("n_nationkey") % 3).cast("int").alias("k")), _sample_plugin).select("plugin", "passed")


def _sample_plugin(row):
    """An extractor that is right, wrong, or fails, and its golden corpus."""
    rows = [("f", "symbol")]
    extract = (lambda path, source: rows, lambda path, source: [], lambda path, source: 1 / 0)[row["k"]]
    return extract, [{"path": "a.x", "source": "f", "rows": rows}]


@query("op265_embeddings", "select n_nationkey, cast(len(n_name) - len(replace(n_name, 'N', '')) as double) as n from nation")
def _(s):
    return s.table("nation").select("n_nationkey", semantic.letters(F.col("n_name"))[13].cast("double").alias("n"))


@query("op046_valid_vectors", "select vec_id, vec_id % 3 = 0 as ok from embeddings")
def _(s):
    k = F.col("vec_id") % 3
    odd = F.when(k == 1, F.slice("embedding", 1, 5)).when(k == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return s.table("embeddings").select("vec_id", plugins.valid_vector(odd, 64).alias("ok"))


_TASK = "case cast(event_id % 5 as int) when 0 then 'sent' when 1 then 'invented target' when 2 then 'unknown label' when 3 then 'citations outside the evidence' else 'no evidence or no candidate' end"


@query("op268_broker_verdicts", f"select event_id, {_TASK} as verdict from events")
def _(s):
    k = F.col("event_id") % 5
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    tasks = s.table("events").select(
        "event_id",
        F.when(k == 4, F.array().cast("array<string>")).otherwise(strings("span one", "span two")).alias("spans"),
        strings("chan:a", "chan:b").alias("candidates"),
        F.when(k == 1, "chan:z").otherwise("chan:a").alias("target"),
        F.when(k == 2, "HANDLES").otherwise("GOVERNS").alias("label"),
        F.when(k == 3, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1))).alias("citations"),
    )
    return plugins.verdicts(tasks).select("event_id", F.coalesce("verdict", F.lit("sent")).alias("verdict"))


@query("op266_egress", "select conv_id, turn, case when conv_id % 3 = 0 then 'no policy' when conv_id % 3 = 1 then 'consent does not match the payload' end as refused from conversations")
def _(s):
    c = s.table("conversations").where("text is not null")
    text_, _ = redacted(F.col("text"))
    provider = F.when(F.col("conv_id") % 3 == 0, "other").otherwise("cloud")
    consent = F.when(F.col("conv_id") % 3 == 2, F.sha2(text_, 256)).otherwise("stale")
    asked = c.select("conv_id", "turn", F.col("text").alias("payload"), provider.alias("provider"), consent.alias("consent"))
    return plugins.released(asked, ["cloud", "local"]).select("conv_id", "turn", "refused")


@query("op267_structured_output", "select n_nationkey as task, case when n_nationkey % 3 = 2 then null else 'ok' end as answer, case when n_nationkey % 3 = 2 then 'ZeroDivisionError: division by zero' end as error from nation")
def _(s):
    tasks = s.table("nation").select(F.col("n_nationkey").alias("task"), F.concat(F.lit("prompt "), (F.col("n_nationkey") % 3).cast("string")).alias("prompt"))
    return plugins.answered(tasks, _sample_provider, {"answer"}).select("task", F.get_json_object("answer", "$.answer").alias("answer"), "error")


def _sample_provider(prompt: str) -> str:
    """Answers at once, after being told what was wrong, or fails."""
    if prompt.startswith("prompt 2"):
        return str(1 / 0)
    if prompt.startswith("prompt 1") and "Missing" not in prompt:
        return 'well: {"other": 1}'
    return 'here it is {"answer": "ok"}'
