"""Files in, graph and flows out, against hand-made graphs; scopes, receivers and calls of each language."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import ingest
from spanloom.sources import extractors
from spanloom.sources.scopes import scope_rows

SHOP = {
    "web/App.tsx": "import { Cart } from './Cart';\nexport function App() { return <Routes><Route path=\"/cart\" element={<Cart />} /></Routes>; }\n",
    "web/Cart.tsx": "import { load } from './api';\nexport function Cart() { load(); fetch('/orders/7', { method: 'POST' }); fetch('/nowhere'); return <p/>; }\n",
    "web/api/index.ts": "export const load = async () => { fetch('/orders/7', { method: 'POST' }); };\n",
    "svc/main.ts": """import express from 'express';
import { Db } from '../store/db';
import { gone } from './gone';
import { SendMessageCommand } from '@aws-sdk/client-sqs';
const app = express();
class Svc {
  constructor(private db: Db) {}
  save(id: string) { this.db.put(id); this.tell(id); gone(); console.log(id); }
  tell(id: string) { new SendMessageCommand({ QueueUrl: process.env.QUEUE }); new SendMessageCommand({ QueueUrl: url(id) }); }
}
function create(fetch: any) { const s = new Svc(); s.save('1'); fetch('/shadowed'); }
app.post('/orders/:id', create);
""",
    "store/db.ts": "export class Db { put(id: string) { write(id); } }\nfunction write(id: string) {}\n",
}


def files(spark, tree, repo="shop"):
    return spark.createDataFrame([(repo, p, t) for p, t in tree.items()], "repo string, path string, text string")


def edges_of(spark, tree, env=()):
    nodes, edges = ingest.ingested(files(spark, tree), spark.createDataFrame(list(env), "key string, value string"))
    return nodes, {(r.src, r.label, r.dst) for r in edges.collect()}


def test_shop_equals_hand_made_graph(spark):
    nodes, got = edges_of(spark, SHOP, [("QUEUE", "orders")])
    sym = lambda p, n: f"sym:shop@{p}#{n}"
    at = lambda p, s: SHOP[p].index(s)
    main, cart = "svc/main.ts", "web/Cart.tsx"
    post, gap = "ep:shop@POST:/orders/:id", f"gap:call:shop@{main}@{at(main, 'gone();')}"
    fetch_gap = f"gap:fetch:shop@{cart}@{at(cart, chr(102) + 'etch(' + chr(39) + '/nowhere')}"
    chan_gap = f"gap:chan:shop@{main}@{at(main, 'new SendMessageCommand({ QueueUrl: url')}@sqs-queue Produces"
    want = {
        ("screen:shop@/cart", "RENDERS", sym(cart, "Cart")),
        (sym("web/App.tsx", "App"), "RENDERS", sym(cart, "Cart")),
        (sym(cart, "Cart"), "CALLS", sym("web/api/index.ts", "load")),
        (sym(cart, "Cart"), "FETCHES", post),
        (sym(cart, "Cart"), "FETCHES", fetch_gap),
        (sym("web/api/index.ts", "load"), "FETCHES", post),
        (post, "HANDLES", sym(main, "create")),
        (sym(main, "create"), "CALLS", sym(main, "Svc.save")),
        (sym(main, "Svc.save"), "CALLS", sym("store/db.ts", "Db.put")),
        (sym(main, "Svc.save"), "CALLS", sym(main, "Svc.tell")),
        (sym(main, "Svc.save"), "CALLS", gap),
        (sym("store/db.ts", "Db.put"), "CALLS", sym("store/db.ts", "write")),
        (sym(main, "Svc.tell"), "PUBLISHES", "chan:sqs-queue:orders"),
        (sym(main, "Svc.tell"), "PUBLISHES", chan_gap),
    }
    assert {e for e in got if e[1] != "DEFINED_IN"} == want
    assert {e for e in got if e[1] == "DEFINED_IN"} == {(s, "DEFINED_IN", s.replace("sym:", "file:").split("#")[0]) for s in [sym("web/App.tsx", "App"), sym(cart, "Cart"), sym("web/api/index.ts", "load"), *[sym(main, n) for n in ("Svc", "Svc.constructor", "Svc.save", "Svc.tell", "create")], *[sym("store/db.ts", n) for n in ("Db", "Db.put", "write")]]}
    labels = {r.id: (r.label, r.conf) for r in nodes.collect()}
    assert labels[post] == ("Endpoint", "Confirmed") and labels["chan:sqs-queue:orders"] == ("Channel", "Confirmed")
    assert {i for i, (label, _) in labels.items() if label == "Gap"} == {gap, fetch_gap, chan_gap}
    one = nodes.where(F.col("id") == sym(main, "Svc.tell")).first()
    assert [(e.path, e.byte_start) for e in one.evidence] == [(main, at(main, "tell(id: string) {"))] and json.loads(one.props)["kind"] == "method"
    ends = {i for e in got for i in (e[0], e[2])}
    assert ends <= set(labels)


def test_shop_flow_scores(spark):
    scores = {r.trigger_id: (r.hops, round(r.score, 9), r.status) for r in ingest.ingested_flows(files(spark, SHOP), spark.createDataFrame([("QUEUE", "orders")], "key string, value string")).collect()}
    # from the screen: 13 hops without the one of App, of them three into gaps
    assert scores["screen:shop@/cart"] == (13, round(10 / 13, 9), "Partial")
    assert "ep:shop@POST:/orders/:id" not in scores  # a screen's flow fetches it


def test_no_files_no_graph(spark):
    nodes, edges = ingest.ingested(files(spark, {}))
    assert nodes.count() == edges.count() == 0


def test_go_packages(spark):
    tree = {
        "go.mod": "module example.com/shop\n",
        "main.go": 'package main\n\nimport (\n\t"net/http"\n\tst "example.com/shop/store"\n\t"github.com/x/y"\n)\n\nfunc main() {\n\thttp.HandleFunc("GET /a", list)\n\thttp.HandleFunc("/b", st.Handle)\n\thelp()\n\ty.Go()\n}\n\nfunc list() { st.Save(); st.Missing() }\n',
        "util.go": "package main\n\nfunc help() {}\n",
        "store/a.go": "package store\n\nfunc Save() { inner() }\nfunc inner() {}\n",
        "store/b.go": "package store\n\nfunc Save() {}\nfunc Handle() {}\n",
        "store/c_windows.go": "package store\n\nfunc Save() {}\n",
    }
    _, got = edges_of(spark, tree)
    assert {e for e in got if e[1] != "DEFINED_IN"} == {
        ("sym:shop@main.go#main", "CALLS", "sym:shop@util.go#help"),
        ("sym:shop@main.go#list", "CALLS", "sym:shop@store/b.go#Save"),  # the last of equal names
        ("sym:shop@store/a.go#Save", "CALLS", "sym:shop@store/a.go#inner"),
        ("ep:shop@GET:/a", "HANDLES", "sym:shop@main.go#list"),
        ("ep:shop@ANY:/b", "HANDLES", "sym:shop@store/b.go#Handle"),
    }


def test_jvm_types(spark):
    tree = {
        "A.java": "package p;\nimport q.Db;\nimport q.Twice;\nimport q.None;\nimport ext.Other;\nimport static q.Help.aid;\nimport org.springframework.web.bind.annotation.*;\n@RestController\n@RequestMapping(\"/a/\")\npublic class A {\n  private final Db db;\n  @GetMapping(\"/b/\")\n  public String list(Twice two, None none, Other other, Near near) {\n    db.save(); two.x(); none.y(); other.z(); near.go(); aid(); return own();\n  }\n  String own() { return \"\"; }\n}\n",
        "Near.kt": "package p\nimport q.Db\nclass Near(val db: Db) {\n  fun go() = db.save()\n}\n",
        "q/Db.java": "package q;\npublic class Db { public void save() {} }\n",
        "q/Help.java": "package q;\npublic class Help { public static void aid() {} }\n",
        "q/T1.java": "package q;\nclass Twice { void x() {} }\n",
        "q/T2.java": "package q;\nclass Twice { void x() {} }\n",
    }
    _, got = edges_of(spark, tree)
    at = lambda s: f"gap:call:shop@A.java@{tree['A.java'].index(s)}"
    a = "sym:shop@A.java#A.list"
    assert {e for e in got if e[1] != "DEFINED_IN"} == {
        ("ep:shop@GET:/a/b/", "HANDLES", a),
        (a, "CALLS", "sym:shop@q/Db.java#Db.save"),
        (a, "CALLS", at("two.x(")),  # declared twice
        (a, "CALLS", at("none.y(")),  # a package of the system without it
        (a, "CALLS", "sym:shop@Near.kt#Near.go"),
        (a, "CALLS", "sym:shop@q/Help.java#Help.aid"),
        (a, "CALLS", "sym:shop@A.java#A.own"),
        ("sym:shop@Near.kt#Near.go", "CALLS", "sym:shop@q/Db.java#Db.save"),
    }


def test_python_imports(spark):
    tree = {
        "app/main.py": "from fastapi import FastAPI\nfrom .db import save as keep, gone\nfrom app.util import clean\nfrom lib import away\nimport app.util as u\napp = FastAPI()\n@app.get('/x')\ndef x(keep2):\n    keep(); gone(); clean(); away(); u.clean(); keep2(); A().m()\nclass A:\n    def m(self):\n        self.n()\n    def n(self): pass\n",
        "app/db.py": "def save(): pass\n",
        "app/util/__init__.py": "def clean(): pass\n",
    }
    _, got = edges_of(spark, tree)
    x = "sym:shop@app/main.py#x"
    assert {e for e in got if e[1] != "DEFINED_IN"} == {
        ("ep:shop@GET:/x", "HANDLES", x),
        (x, "CALLS", "sym:shop@app/db.py#save"),
        (x, "CALLS", f"gap:call:shop@app/main.py@{tree['app/main.py'].index('gone();')}"),
        (x, "CALLS", "sym:shop@app/util/__init__.py#clean"),
        (x, "CALLS", "sym:shop@app/main.py#A"),
        ("sym:shop@app/main.py#A.m", "CALLS", "sym:shop@app/main.py#A.n"),
    }


def calls(text, language):
    return [(r[1], r[2], r[5]) for r in scope_rows(text, language) if r[0] == "calls"]


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("function a(fetch) { fetch('/x'); }", "typescript", []),
        ("class S { constructor(private db: Db) {} go() { this.db.save(); helper(); } }", "typescript", [("Db", "save", "S.go"), ("helper", "", "S.go")]),
        ("class S { db = new Db(); a?: T; go() { this.db.save(); this.a.x(); this.u.y(); } }", "typescript", [("Db", "save", "S.go"), ("T", "x", "S.go")]),
        ("const f = (x: A | B, y: C[]) => { x.a(); y.b(); const z: Z<string> = g(); z.c() }", "typescript", [("g", "", "f"), ("Z", "c", "f")]),
        ("const r = /\"(/.test(a); const s = 'x(' + `y(${z()})`; // w()\nk();", "typescript", [("k", "", "")]),
        ("if (a) { b(); } else { while (c()) { d(); } }", "typescript", [("b", "", ""), ("c", "", ""), ("d", "", "")]),
        ("const {load, b: c} = x;\nfunction f() { const {load} = this; load(); for (const y of ys()) y.go(); }", "typescript", [("ys", "", "f")]),
        ("class A { String x = make(); void m(B b) { b.go(); for (C c : cs()) { c.run(); } new D().e(); } }", "java", [("A", "make", ""), ("B", "go", "A.m"), ("A", "cs", "A.m"), ("C", "run", "A.m")]),
        ("package m\nfunc (s *S) A(b, c *B) { b.X(); c.Y(); s.Z(); f := func() { q() }; f() }", "go", [("B", "X", "S.A"), ("B", "Y", "S.A"), ("S", "Z", "S.A"), ("q", "", "S.A")]),
        ("class K(val a: A) {\n  fun m(x: B?) {\n    a.p()\n    x.q()\n    val y = C()\n    y.r()\n  }\n}", "kotlin", [("A", "p", "K.m"), ("B", "q", "K.m"), ("K", "C", "K.m"), ("C", "r", "K.m")]),
    ],
)
def test_calls(text, language, want):
    assert calls(text, language) == want


def test_offsets_are_bytes():
    text = "const é = '中';\nfunction ü() { go(); }\n"
    row = next(r for r in scope_rows(text, "typescript") if r[0] == "calls")
    assert text.encode()[row[3] : row[4]] == b"go("


def test_broken_files_do_not_fail(spark):
    tree = {"a.ts": "}}}) function ( { class", "b.py": "def (", "c.java": "class {{{", "d.kt": "fun = = (", "e.go": "func (", "f.ts": "", "g.ts": "\x00 '"}
    rows = extractors.facts(files(spark, tree)).collect()
    assert [r.path for r in rows if r.kind == "gap"] == ["b.py"]
