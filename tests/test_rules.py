import json
import subprocess

import pytest

from lintel.plans import engine
from lintel.plans.rules import ConfigError, Rule, decode, lane, load, shard, up_to_cost
from lintel.sources import corpus, reports


def found(spark, files, kind, params, **more):
    rows = engine.evaluate(corpus.memory(spark, files), [Rule("r", kind, params, **more)]).collect()
    return [(r["path"], r["line"]) for r in rows]


EDGES = [("empty", ""), ("newline", "\n"), ("plain", "a\nb"), ("cr", "a\r\nb\r\n"), (".hid/x", "b"), ("_u", "é b"), ("bad", b"\xff b"), ("nul", b"x" * 8100 + b"\0"), ("last", "x\nx\nhit")]


def test_lines_and_edges(spark):
    assert found(spark, EDGES, "forbidden-pattern", {"pattern": "hit"}) == [("last", 3)]
    assert found(spark, EDGES, "forbidden-pattern", {"pattern": "^b"}) == [(".hid/x", 1), ("cr", 2), ("plain", 2)]
    assert found(spark, EDGES, "required-pattern", {"pattern": "b|x|hit"}) == [("empty", 0), ("newline", 0)]
    assert found(spark, EDGES, "binary-content", {"forbid_binary": True}) == []
    assert found(spark, [("n", b"a\0b")], "binary-content", {"forbid_binary": True}) == [("n", 0)]
    assert found(spark, EDGES, "file-size", {"cap": 2}) == [("last", 0)]


def test_forbidden_modes(spark):
    files = [("a", "q\nstart\nend\nuse q"), ("b", "do not use q\nq"), ("c", "start\nx\nx\nend")]
    assert found(spark, files, "forbidden-pattern", {"pattern": r"start\n.*end", "multiline": True}) == [("a", 2)]
    assert found(spark, files, "forbidden-pattern", {"all_of": ["start", "end"]}) == [("a", 1), ("c", 1)]
    assert found(spark, files, "forbidden-pattern", {"all_of": ["start", "end"], "window": 2}) == [("a", 2)]
    assert found(spark, files, "forbidden-pattern", {"pattern": "q", "denied_by": ["not"]}) == [("a", 1), ("a", 4), ("b", 2)]
    assert found(spark, files, "forbidden-pattern", {"pattern": "q", "evidence": {"pattern": "start", "within": 1}}) == [("a", 4), ("b", 1)]
    assert found(spark, files, "forbidden-pattern", {"pattern": "q", "require_present": ["start"]}) == [("a", 1)]


def test_scope_aggregates(spark):
    files = [("d/a", "t\nt\nc"), ("d/b", "t"), ("e/a", "c"), ("f/a", "t")]
    assert found(spark, files, "pattern-count", {"pattern": "t", "op": "exactly", "n": 4}) == []
    assert found(spark, files, "pattern-count", {"pattern": "t", "op": "at-least", "n": 5}) == [("", 0)]
    assert found(spark, [], "pattern-count", {"pattern": "t", "op": "at-least", "n": 1}) == [("", 0)]
    assert found(spark, [], "required-pattern", {"pattern": "t", "mode": "exists"}) == []
    assert found(spark, files, "required-pattern", {"pattern": "zz", "mode": "exists"}) == [("", 0)]
    assert found(spark, files, "ordering", {"before": "c", "after": "t"}) == [("d/a", 1)]
    assert found(spark, files, "pair-consistency", {"trigger": "t", "requires": "c"}) == [("d/b", 1), ("f/a", 1)]
    assert found(spark, files, "pair-consistency", {"trigger": "t", "requires": "c", "obligation": "countable"}) == [("d/a", 1), ("d/b", 1), ("f/a", 1)]
    assert found(spark, files, "pair-consistency", {"trigger": "t", "requires": "c", "where": "same-dir"}) == [("f/a", 1)]
    assert found(spark, files, "file-naming", {"forbid_ext": [".md"]}, include=("z/**",), min_files=1) == [("", 0)]


def test_sets(spark):
    files = [("a/1", "k=x k=y"), ("b/1", "k=y k=z")]
    side = lambda d: {"files": [f"{d}/**"], "pattern": r"k=(\w)"}
    rows = engine.evaluate(corpus.memory(spark, files), [Rule(f"r-{r}", "set-relation", {"a": side("a"), "b": side("b"), "relation": r}) for r in ("subset", "equal", "disjoint")]).collect()
    assert [r["message"] for r in rows] == ["not disjoint: y", "not equal: only in a: x; only in b: z", "not subset: x"]
    rows = engine.evaluate(corpus.memory(spark, files), [Rule("r", "baseline", {"pattern": r"k=(\w)", "baseline": ["# c", "x", "old"], "mode": "exact"})]).collect()
    assert [r["message"] for r in rows] == ["in the baseline only: old", "not in the baseline: y", "not in the baseline: z"]
    assert found(spark, [("doc", "see a/1 and b/2"), *files], "doc-path-exists", {"pattern": r"([ab]/\d)"}) == [("doc", 1)]


GO = 'package p\n\nfunc Save(x int) {\n\tcheck(x)\n\tdb.Exec("a }")\n}\n\nfunc Load() {\n\tdb.Exec("b") // check()\n\tv := get()\n\tcheck(v)\n}\n'


def test_go(spark):
    files = [("p.go", GO)]
    assert found(spark, files, "go/func-line-budget", {"max_lines": 3}) == [("p.go", 8)]
    assert found(spark, files, "go/call-confined-to-func-name", {"symbol": r"^db\.Exec$", "allowed_func": "^Save$"}) == [("p.go", 9)]
    assert found(spark, files, "go/guard-precedes-call", {"guard": "^check$", "sink": r"^db\."}) == [("p.go", 9)]
    assert found(spark, files, "go/call-order-in-func", {"sequence": ["^check$", r"^db\."]}) == [("p.go", 9)]
    assert found(spark, files, "go/per-func-count-relation", {"left": "get", "right": "check", "relation": "=="}) == [("p.go", 3)]
    assert found(spark, files, "pair-consistency", {"trigger": "Exec", "requires": "get", "where": "same-func"}) == [("p.go", 5)]
    homes = [("a.go", "// home:x\nfunc F() {}\n"), ("b.go", "// home:x\nfunc F() {}\n// home:x\n")]
    assert found(spark, homes, "go/marked-single-home", {"marker": "home:x"}) == [("b.go", 1), ("b.go", 3)]


def test_anchors(spark):
    """A scope without files has nothing to be anchored to; stages and symbols are looked for in every function."""
    order, count = "go/call-order-in-func", "go/per-func-count-relation"
    for kind, params in ((order, {"sequence": ["a", "b"]}), (order, {"sequence": ["a", "b"], "funcs": "F"}), (count, {"left": "a", "right": "b", "relation": "==", "funcs": "F", "require_symbol": "both"}), ("dart/method-delegates", {"method": "save", "must_call": "x"})):
        assert found(spark, [], kind, params) == [] and found(spark, [("notes.txt", "none")], kind, params) == []
    files = [("p.go", GO)]
    assert found(spark, files, order, {"sequence": ["^check$", r"^db\."], "funcs": "^Load$"}) == [("p.go", 9)]
    assert found(spark, files, order, {"sequence": ["^get$", "^none$"], "funcs": "^Gone$"}) == [("", 0), ("", 0)]
    assert found(spark, files, count, {"left": "^zip$", "right": "^none$", "relation": "<=", "require_symbol": "left"}) == [("", 0)]
    assert found(spark, files, count, {"left": "^get$", "right": "^none$", "relation": "<=", "require_symbol": "both"}) == [("", 0), ("p.go", 8)]
    assert found(spark, files, count, {"left": "^check$", "right": "^none$", "relation": "<=", "require_used": "left"}) == []
    for bad in ({"require_symbol": "check"}, {"require_used": True}):
        with pytest.raises(ConfigError):
            found(spark, files, count, {"left": "a", "right": "b", "relation": "<=", **bad})


def test_what_counts_where(spark):
    assert found(spark, [("a", "x\nb"), ("b", "x b")], "required-pattern", {"pattern": "zz", "when": "^b"}) == [("a", 0)]
    assert found(spark, [("a", "x\nb")], "required-pattern", {"pattern": "zz", "when": "x.b", "multiline": True}) == []
    assert found(spark, [("a", "q\n(one\ntwo)\nq\nq")], "forbidden-pattern", {"pattern": "^q", "evidence": {"pattern": r"one\ntwo", "within": 1}}) == [("a", 4)]
    assert found(spark, [("a", b""), ("b", b"x")], "binary-content", {"max_bytes": 0}) == [("b", 0)]
    go = "package p\nfunc A() {\n\tx()\n}\nfunc B() {\n\tx()\n\tmark()\n}\n"
    assert found(spark, [("p.go", go)], "pair-consistency", {"trigger": "x\\(", "requires": "close", "where": "same-func", "also_present": "mark"}) == [("p.go", 6)]
    for kind, params in (("binary-content", {}), ("binary-content", {"max_bytes": -1}), ("required-pattern", {"pattern": "x", "mode": "all"}), ("forbidden-pattern", {"pattern": "x", "denied_by": [" "]}), ("forbidden-pattern", {"pattern": "x", "denied_by": ["no."]}), ("pair-consistency", {"trigger": "a", "requires": "b", "where": "same-dir", "also_present": "c"}), ("pair-consistency", {"trigger": "a", "requires": "b", "where": "same-dir", "obligation": "countable"}), ("doc-path-exists", {"pattern": "x"})):
        with pytest.raises(ConfigError):
            found(spark, [("a", "x")], kind, params)
    side = lambda d, n: {"files": [f"{d}/**"], "pattern": r"k=(\w)", "min_count": n}
    rule = Rule("r", "set-relation", {"a": side("a", 3), "b": side("b", 2), "relation": "equal"})
    rows = engine.evaluate(corpus.memory(spark, [("a/1", "k=x k=y"), ("b/1", "k=y")]), [rule]).collect()
    assert [r["message"] for r in rows] == ["side a has 2 value(s), least are 3; side b has 1 value(s), least are 2"]
    files = [("docs/a.md", "see src/x.go, src, ./src/x.go, src/, src/y.go"), ("src/x.go", "x")]
    assert found(spark, files, "doc-path-exists", {"pattern": r"(\.?[a-z/.]*src[a-z/.]*)"}, include=("docs/**",)) == [("docs/a.md", 1)]


def test_one_pass_for_all_rules(spark):
    """However many rules read the files twice, whatever their transforms, and find what each finds alone."""
    files = corpus.memory(spark, [("a.go", "// todo 7\nx := 7\n"), ("b.md", "todo 7\nnine\n"), ("c.sh", "echo 3 # 7\n")])
    rules = [Rule(f"r-{i}", "forbidden-pattern", {"pattern": str(i)}, preprocess=("raw", "decomment-go", "decomment-sh")[i % 3]) for i in range(9)]
    rules += [Rule(f"q-{i}", "required-pattern", {"pattern": "todo", "when": ["7"]}, include=("*.md",) if i % 2 else ("**",)) for i in range(4)]
    rules += [Rule(f"s-{i}", "file-size", {"cap": i}) for i in range(1, 3)] + [Rule(f"n-{i}", "pattern-count", {"pattern": "7", "op": "at-most", "n": i}) for i in range(2)]
    rules += [Rule("floor", "file-naming", {"forbid_ext": [".md"]}, include=("**/*.go",), min_files=2)]
    files.createOrReplaceTempView("x")
    both = engine.evaluate(files, rules)
    assert [tuple(r) for r in both.collect()] == sorted(tuple(r) for rule in rules for r in engine.evaluate(files, [rule]).collect())
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + both._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 3


def test_dart_and_sql(spark):
    dart = "class A {\n  void save() async {\n    a();\n    await b();\n    context.x();\n    if (mounted)\n      context.y();\n  }\n}\n"
    assert found(spark, [("a.dart", dart)], "dart/ref-after-await", {"method": "save", "access": "context", "guard": "mounted"}) == [("a.dart", 5)]
    assert found(spark, [("a.dart", dart)], "dart/method-delegates", {"method": "save", "must_call": "zip"}) == [("a.dart", 2)]
    sql = "select ';' from t; -- x;\nselect a from u\nwhere b = 1;\nselect 1 from t for update; select 1 from t order by id for update; select 1 from t where id = $1 for update; select 1 from t for update skip locked"
    assert found(spark, [("a.sql", sql)], "sql/statement-predicate", {"table": "from u", "require": ["order by"]}) == [("a.sql", 2)]
    assert found(spark, [("a.sql", sql)], "sql/locking-select-order", {}) == [("a.sql", 4)]


def test_fused_and_changed(spark):
    files = corpus.memory(spark, [("a.txt", "x1\ny2"), ("b.txt", "x1")])
    rules = [Rule("one", "forbidden-pattern", {"pattern": "x1"}), Rule("two", "forbidden-pattern", {"pattern": "y2"}, severity="warn", include=("a*",))]
    rows = [(r["rule"], r["path"], r["line"]) for r in engine.evaluate(files, rules).collect()]
    assert rows == [("one", "a.txt", 1), ("one", "b.txt", 1), ("two", "a.txt", 2)]
    assert rows == sorted(x for r in rules for x in [(y["rule"], y["path"], y["line"]) for y in engine.evaluate(files, [r]).collect()])
    changed = files.where("path = 'b.txt'").select("path")
    part = engine.evaluate(files, [*rules, Rule("n", "pattern-count", {"pattern": "x1", "op": "exactly", "n": 1})], changed)
    assert [(r["rule"], r["path"]) for r in part.collect()] == [("n", ""), ("one", "b.txt")]
    assert engine.idle_rules(files, [*rules, Rule("idle", "file-size", {"cap": 1}, include=("z/**",))]) == ["idle"]
    assert engine.exit_code(part) == 1


def test_config(spark):
    rules = load("rules:\n- {id: a-b, type: file-size, params: {cap: 3}, tags: [x]}\n", ["rules:\n- {id: a-b, type: file-size, params: {cap: 9}}\n- {id: c, type: command, params: {cmd: [ls], root: ., allow: true}}\n"])
    assert [(r.id, dict(r.params).get("cap")) for r in rules] == [("a-b", 3), ("c", None)]
    assert [r.id for r in lane(rules, tags=["x"])] == ["a-b"] and [r.id for r in up_to_cost(rules, "tree")[1]] == ["c"]
    assert [[r.id for r in shard(rules, k, 2, {"c": 9.0})] for k in (1, 2)] == [["c"], ["a-b"]]
    for bad in ({"id": "A"}, {"id": "a", "type": "nope"}, {"id": "a", "type": "file-size"}, {"id": "a", "type": "file-size", "params": {"cap": 1, "zip": 2}}, {"id": "a", "type": "file-size", "params": {"cap": 1}, "zip": 1}):
        with pytest.raises(ConfigError):
            decode(bad)
    with pytest.raises(ConfigError):
        engine.evaluate(corpus.memory(spark, []), [])


def test_sources_and_reports(spark, tmp_path):
    for path, text in {"a/x.txt": "TODO\n", ".hid/y": "", "skip/z": "TODO", ".git/q": "TODO"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    files, pruned = corpus.tree(spark, str(tmp_path), {"skip": "vendored"})
    assert [r["path"] for r in files.orderBy("path").collect()] == [".hid/y", "a/x.txt"] and pruned.first()["path"] == "skip"
    rules = [Rule("no-todo", "forbidden-pattern", {"pattern": "TODO"}, cure="do it"), Rule("ok", "file-size", {"cap": 9})]
    got = reports.collected(engine.evaluate(files, rules))
    assert "[no-todo] FAIL — 1 finding(s)" in reports.human(rules, got) and "[ok] OK" in reports.human(rules, got)
    assert json.loads(reports.as_json(rules, got))["summary"] == {"rules_total": 2, "rules_passed": 1, "findings": 1}
    assert reports.github(rules, got).startswith("::error file=a/x.txt,line=1::")
    with pytest.raises(ConfigError):
        corpus.json_lines(spark, '{"path": "a"}')
    with pytest.raises(ConfigError):
        corpus.restrict(files, ["gone"])
    assert corpus.json_lines(spark, '{"path": "a", "content": "b"}\n').count() == 1


def test_external(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f").write_text("one\n")
    run("add", "f")
    run("commit", "-qm", "1")
    (tmp_path / "f").write_text("two\n")
    assert found(spark, [], "git-diff", {"root": str(tmp_path), "range": "HEAD", "forbid_added": "two", "forbid_removed": "three"}) == [("", 0)]
    assert found(spark, [], "command", {"cmd": ["false"], "root": str(tmp_path), "allow": True}) == [("", 0)]
    assert found(spark, [("f", "")], "command", {"cmd": ["echo", "f:3: bad"], "root": str(tmp_path), "allow": True, "output": "findings-v1"}) == [("f", 3)]
    with pytest.raises(ConfigError):
        found(spark, [], "command", {"cmd": ["true"], "root": str(tmp_path), "allow": False})


def test_stream(spark, tmp_path):
    from lintel.streaming.files import watch

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "TODO")], "path string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    from lintel.schema import files_of

    got = []
    stream = files_of(spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in")))
    watch(stream, [Rule("r", "forbidden-pattern", {"pattern": "TODO"})], lambda df, n: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert [(r["rule"], r["path"], r["line"]) for r in got] == [("r", "a", 1)]


@pytest.mark.parametrize(("sql", "params", "fires"), [
    ("SELECT * FROM shop.items AS i JOIN shop.tags t ON t.item = i.id FOR UPDATE OF i;", {}, True),
    ("SELECT * FROM shop.items AS i JOIN shop.tags t ON t.item = i.id FOR UPDATE OF t;", {}, False),
    ("SELECT * FROM shop.items AS i, shop.tags t WHERE t.item = i.id FOR UPDATE NOWAIT;", {}, True),
    ("SELECT * FROM shop.items FOR UPDATE OF items", {}, True),
    ("SELECT * FROM shop.items i FOR KEY SHARE OF i", {}, False),
    ("SELECT * FROM shop.items i FOR KEY SHARE OF i", {"strength": ["key-share"]}, True),
    ("SELECT * FROM shop.items i FOR NO KEY UPDATE", {"strength": ["no-key-update"]}, True),
    ("SELECT * FROM other.items i FOR UPDATE", {"schema": "^shop$"}, False),
    ("SELECT * FROM items i FOR UPDATE", {"schema": "^shop$"}, True),
    ("SELECT * FROM a WHERE x IN (SELECT id FROM items) FOR UPDATE", {}, False),
    ("SELECT * FROM a WHERE x IN (SELECT id FROM items ORDER BY id FOR UPDATE)", {}, True),
    ("WITH items AS (SELECT 1) SELECT * FROM items FOR UPDATE", {}, False),
    ("-- SELECT * FROM items FOR UPDATE\nSELECT 'FROM items FOR UPDATE'", {}, False),
])
def test_locking_target(spark, sql, params, fires):
    assert found(spark, [("q.sql", "\n" + sql)], "sql/locking-target", {"table": "^items$", "strength": ["update"], **params}) == ([("q.sql", sql.count("\n") + 2)] if fires else [])


def test_locking_target_refuses(spark):
    for bad in ({"table": "shop.items", "strength": ["update"]}, {"table": "items", "strength": []}, {"table": "items", "strength": ["all"]}):
        with pytest.raises(ConfigError):
            found(spark, [("q.sql", "")], "sql/locking-target", bad)


def test_generated_files(spark):
    files = [("made.go", "// by hand\n\n// Code generated by gen. DO NOT EDIT.\npackage x\nhit"), ("own.go", "package x\n// Code generated by gen. DO NOT EDIT.\nhit"), ("all", "# Code generated by gen. DO NOT EDIT."), ("text", 's = "Code generated by gen."\nhit')]
    run = lambda *rules: [(r["rule"], r["path"]) for r in engine.evaluate(corpus.memory(spark, files), rules, generated=["Code generated by gen."]).collect()]
    rule = lambda i, **more: Rule(i, "forbidden-pattern", {"pattern": "hit"}, **more)
    assert run(rule("a")) == [("a", "own.go"), ("a", "text")]
    assert run(rule("a"), rule("b"), rule("c", generated=True)) == [("a", "own.go"), ("a", "text"), ("b", "own.go"), ("b", "text"), ("c", "made.go"), ("c", "own.go"), ("c", "text")]
    assert run(Rule("n", "required-pattern", {"pattern": "hit"})) == [] and run(Rule("n", "required-pattern", {"pattern": "hit"}, generated=True)) == [("n", "all")]
    assert decode({"id": "a", "type": "forbidden-pattern", "params": {"pattern": "x"}, "scope": {"generated": True}}).generated


HOMES = 'package p\n\nimport "fmt"\n\nconst (\n\tA = "x"\n)\n\n// home\nfunc F(a int) (b int) {\n\tfmt.Println("}", `\n}`)\n\treturn q\n}\n\nvar q = 1 +\n\t2\nvar z, q2 = 1, q\n'


def test_declarations():
    from lintel.functions.declarations import Declarations, homes

    go = Declarations("a.go", HOMES)
    assert [go.extent(n) for n in (1, 5, 9, 10, 16, 18, 99)] == [(1, 18), (5, 7), (9, 9), (10, 14), (16, 17), (18, 18), (99, 99)]
    assert go.imports() == [(3, 3)]
    assert homes("a.go", HOMES, [10]) == [(3, 3), (10, 14)] and homes("a.go", HOMES, []) == []
    dart = Declarations("a.dart", "import 'x';\n\nclass A {\n  String s = '}';\n}\nfinal b = f({\n  'x': 1\n});\n")
    assert [dart.extent(n) for n in (3, 6)] == [(3, 5), (6, 8)] and dart.imports() == [(1, 1)]
    assert Declarations("a.proto", "message M {\n  // }\n  int32 x = 1;\n}\n").extent(1) == (1, 4)
    assert Declarations("a.md", "x\ny").extent(2) == (1, 2) and Declarations("a.go", "").extent(1) == (1, 1)


def test_homes(spark):
    files = [("a.go", HOMES), ("b.go", "package b\n\nvar q = 2\n"), ("c.md", "no home\nq\n"), ("d.go", "")]
    credential = lambda n: {"pattern": r"\bq\b", "require_absent": [{"credential": r"^func F\b", "holders": n}]}
    assert found(spark, files, "forbidden-pattern", credential(1)) == [("a.go", 16), ("b.go", 3), ("c.md", 2)]
    assert found(spark, files, "forbidden-pattern", credential(2)) == [("", 0), ("a.go", 16), ("b.go", 3), ("c.md", 2)]
    assert found(spark, files[1:], "forbidden-pattern", credential(2)) == [("b.go", 3), ("c.md", 2)]
    marked = {"not_declaring": (("func F", 1), ("no home", 1))}
    assert found(spark, files, "forbidden-pattern", {"pattern": r"\bq\b"}, **marked) == [("a.go", 16), ("a.go", 18), ("b.go", 3)]
    assert found(spark, files, "pattern-count", {"pattern": r"\bq\b", "op": "exactly", "n": 3}, preprocess="decomment-go", **marked) == []
    proof = {"pattern": r"\bq\b", "require_absent": [{"evidence": r"\+$", "within": 2}]}
    assert found(spark, files, "forbidden-pattern", proof) == [("a.go", 13), ("b.go", 3), ("c.md", 2)]
    both = {"all_of": ["package", r"\bq\b"], "none_of": [{"evidence": "import", "within": 2}]}
    assert found(spark, files, "forbidden-pattern", both) == [("b.go", 1)]
    for bad in ([{"credential": "func", "holders": 1}], [{"credential": "^f", "holders": 0}]):
        with pytest.raises(ConfigError):
            Rule("r", "forbidden-pattern", {"pattern": "q", "require_absent": bad})
    with pytest.raises(ConfigError):
        found(spark, files, "forbidden-pattern", {"pattern": "q", "require_absent": ["x"]})
    with pytest.raises(ConfigError):
        decode({"id": "r", "type": "forbidden-pattern", "params": {"pattern": "q"}, "scope": {"not_declaring": ["x"]}})
    assert decode({"id": "r", "type": "forbidden-pattern", "params": {"pattern": "q"}, "scope": {"not_declaring": [{"marker": "x", "holders": 2}]}}).whole
    census = {"census": {"cmd": ["sh", "-c", "echo c.md:2: bad"], "allow": True, "output": "findings-v1"}}
    assert found(spark, files, "forbidden-pattern", census) == [("c.md", 2)]


DART = """class A {
  bool get _ready => name.text.isNotEmpty && _more;
  bool get _more { return _ready || age.text == '1'; }
  build() => Column(children: [
    TextFormField(keyboardType: TextInputType.numberWithOptions(decimal: true), validator: rule.of(f(1))?.check),
    TextFormField(keyboardType: TextInputType.number, hint: 'validator: x'),
    w.Field<int>(
      keyboardType: TextInputType.number, // validator: x
      validator: (v) => null),
    Field(keyboardType: TextInputType.text),
    Other(keyboardType: TextInputType.number, validator: null),
    ListenableBuilder(listenable: Listenable.merge([name, w.other]), builder: (c, _) => Button(on: _ready, x: w.other.text, s: Style.text)),
    ListenableBuilder(listenable: age, builder: (c, _) => T(age.text, age.textStyle)),
    ListenableBuilder(builder: (c, _) => T(name.text)),
  ]);
}
"""


def test_dart_arguments(spark):
    files = [("a.dart", DART), ("a.go", DART), ("e.dart", "")]
    assert found(spark, files, "dart/numeric-field-validated", {"numeric_value": r"TextInputType\.number"}) == [("a.dart", 6), ("a.dart", 7), ("a.dart", 11)]
    assert found(spark, files, "dart/numeric-field-validated", {"numeric_value": r"TextInputType\.number", "validator_source": "^server"}) == [("a.dart", 5), ("a.dart", 6), ("a.dart", 7), ("a.dart", 11)]
    gate = {"builders": ["ListenableBuilder"], "listen_args": ["animation", "listenable"], "builder_arg": "builder", "read_suffixes": [".text"]}
    rows = engine.evaluate(corpus.memory(spark, files), [Rule("r", "dart/gate-reads-are-listened", gate)]).collect()
    assert [(r["line"], r["message"]) for r in rows] == [(12, "ListenableBuilder reads age, which animation doesn't hold")]
    assert found(spark, files, "dart/gate-reads-are-listened", {**gate, "ignore_readers": ["age"]}) == []
    with pytest.raises(Exception, match="isn't closed"):
        found(spark, [("b.dart", "X(keyboardType: 1")], "dart/numeric-field-validated", {"numeric_value": "1"})


def test_self_comparison(spark):
    from lintel.operators.flows import self_comparisons

    params = {"reader": r"^os\.ReadFile$", "loader": "^load[A-Z]", "compare": r"^bytes\.Equal$", "declare": "self-comparison:"}
    lines = lambda body: [n for n, _ in self_comparisons('package p\nimport o "os"\n' + body, params)]
    twice = "func T(t *T, dir string) {\n\tp := filepath.Join(root(), \"x\")\n\twant, _ := o.ReadFile(p)\n\tgot := render(loadX(p))\n\tif !bytes.Equal(want, got) {\n\t}\n}\n"
    assert lines(twice) == [7]
    assert lines(twice.replace("loadX(p)", "model")) == [] and lines(twice.replace("loadX(p)", "loadX(dir)")) == []
    assert lines("// self-comparison: round trip\n" + twice) == [] and lines(twice.replace("\tgot", "\t// self-comparison: y\n\tgot")) == []
    assert lines(twice.replace("o.ReadFile(p)", "o.ReadFile(dir)").replace("loadX(p)", "loadX(dir)")) == []
    assert lines("func T() {\n\ta := load()\n\tb, err := o.ReadFile(q)\n\tok := bytes.Equal(b, norm(b, a))\n}") == [6]
    assert found(spark, [("a.go", 'package p\nimport o "os"\n' + twice), ("b.go", "")], "go/expected-derives-from-actual", params) == [("a.go", 7)]
    assert found(spark, [("a.go", 'package p\nimport o "os"\n' + twice)], "go/call-confined-to-func-name", {"symbol": r"^os\.", "allowed_func": "^x"}) == [("a.go", 5)]


def test_content(spark):
    from lintel.plans import content

    rules = [
        Rule("no-q", "forbidden-pattern", {"pattern": "q"}, cure="drop it"), Rule("go-only", "file-size", {"cap": 1}, include=("**/*.go",)), Rule("count", "pattern-count", {"pattern": "q", "op": "at-most", "n": 0}),
        Rule("homes", "ordering", {"before": "a", "after": "b"}, not_declaring=(("m", 1),)), Rule("sql", "sql/locking-target", {"table": "t", "strength": ["update"]}), Rule("every", "required-pattern", {"pattern": "q"}),
    ]
    one, two, three = content.check(spark, [("a.txt", "q\nq\nq\nq"), ("b.go", "// made\nx\ny"), ("c.SQL", b"")], rules, generated=["made"])
    assert one["status"] == "findings" and one["evaluated_rule_ids"] == ["no-q"] and (one["findings_total"], len(one["findings"])) == (4, 4)
    short = content.shortened(one)
    assert (short["findings_total"], short["findings_omitted"], len(short["findings"])) == (4, 1, 3)
    assert one["findings"][0] == {"rule": "no-q", "severity": "error", "path": "a.txt", "line": 1, "message": "matches forbidden pattern q", "cure": "drop it", "explain": "explain no-q"}
    assert {x["rule"]: x["reason"] for x in one["not_evaluated"]} == {"count": "whole_tree_invariant", "homes": "scope_not_declaring", "sql": "content_only_not_supported", "every": "content_only_not_supported"}
    assert one["coverage"] == {"rules_total": 6, "in_scope": 5, "eligible": 1, "evaluated": 1, "deferred": 4, "out_of_scope": 1}
    assert two["status"] == "no_eligible_rules" and {x["reason"] for x in two["not_evaluated"]} == {"generated_excluded"}
    assert three["status"] == "clean" and three["evaluated_rule_ids"] == ["no-q", "sql"]
    assert content.failed([one]) and not content.failed([two, three])
    assert [d["findings_total"] for d in content.check(spark, [("a", "q"), ("a", "x")], rules[:1])] == [1, 0]


def test_fixtures(spark, tmp_path):
    from lintel.plans import fixtures

    for path, text in {"fire-1/a.go": "q // want: r\nx\n", "fire-2/a": "q\n", "fire-2.want": "# c\na:1 forbidden\n", "fire-3/a": "x", "fire-4/a": "q", "fire-4.want": "a:1 other\n", "pass-1/a": "x", "pass-2/a": "q"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = fixtures.run(spark, Rule("r", "forbidden-pattern", {"pattern": "q"}, min_files=9), str(tmp_path))
    assert [(a.name, a.passed) for a in got] == [("fire-1", True), ("fire-2", True), ("fire-3", False), ("fire-4", False), ("pass-1", True), ("pass-2", False)]
    assert got[3].missing == (("a", 1, "other"),) and fixtures.report(got)["summary"] == {"rules": 1, "failed": 1, "arms": 6}
    assert fixtures.manifest("-\n- some text\np/x y\np:3\n") == [("", 0, ""), ("", 0, "some text"), ("p/x", 0, "y"), ("p", 3, "")]


def test_gitignore(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for path in ("out/x/a", "out2/a", "b.log", "keep", ".gitignore"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("out/\n*.log\n" if path == ".gitignore" else "x")
    assert sorted(corpus.ignored(str(tmp_path))) == ["b.log", "out"]
    files, _ = corpus.tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in corpus.prune(files, corpus.ignored(str(tmp_path))).select("path").collect()) == [".gitignore", "keep", "out2/a"]
    assert corpus.ignored("/nowhere") == []


CONSTANTS = """package p
import "fmt"
const tbl = "orders"
const (
	cols = "a, " + "b" // "x"
	both = cols + ", c"
)
func f(x string) {
	run("select " + both + " from " + tbl)
	run(`select 1
from t`, "plain")
	run("select " + x + " from " + "t")
	run(fmt.Sprintf("select %s from %s", cols, tbl), fmt.Sprintf("select 1 from %s where a = %d%%", tbl, n))
	run(("a" + "b") + "c", x + "\\x41\\t\\101")
	if ("k" == x) { g(h("l") + x + "tail") }
	/* "no" */ run('"', "one" +
		"two", x)
}
"""


def test_go_constants():
    from lintel.operators.gosql import composed, sql_shaped

    whole, partly = composed(CONSTANTS)
    alone = [(x.line, x.text) for x in whole if not x.part]
    assert alone == [(2, "fmt"), (3, "orders"), (5, "a, b"), (6, "a, b, c"), (9, "select a, b, c from orders"), (10, "select 1\nfrom t"), (11, "plain"), (13, "select a, b from orders"), (14, "abc"), (15, "k"), (15, "l"), (16, "onetwo")]
    assert [(x.line, x.text) for x in whole if x.part] == [(12, "select "), (12, " from "), (12, "t"), (13, "select 1 from %s where a = %d%%"), (14, "A\tA"), (15, "tail")]
    assert [(x.line, x.text) for x in partly] == [(12, "select unread_expr from t"), (13, "select 1 from orders where a = unread_expr%"), (14, "unread_exprA\tA"), (15, "unread_exprunread_exprtail")]
    assert composed("") == ([], []) and composed('"') == composed('x + "') and len(composed("(" * 50 + '"a"' + ")" * 50)[0]) == 1
    assert [x.text for x in composed("(" * 3000 + '"a"' + ")" * 3000)[0]] == ["a"]
    assert [sql_shaped(x) for x in ("drop table if exists x", "create unique index i", "Select a plan", "-- x\n(select 1 from y", "selected from", "")] == [True, True, False, True, False, False]


def test_sql_in_go(spark):
    go = 'package p\nfunc f(x string) {\n\tq("select a from t where id = " + x)\n\tq("select a from t " + "for update")\n\tq("select a from t" + x + " order by id for update")\n\tq(fmt.Sprintf("select a from t order by %s for update", x))\n}\n'
    files = [("a.go", go), ("b.py", 'q("select a from t for update")')]
    assert found(spark, files, "sql/statement-predicate", {"table": "from t", "forbid": ["for update"]}) == [("a.go", 3), ("a.go", 4), ("a.go", 5), ("a.go", 6), ("a.go", 6)]
    assert found(spark, files, "sql/locking-select-order", {}) == [("a.go", 4), ("a.go", 6)]
    assert found(spark, files, "sql/locking-target", {"table": "^t$", "strength": ["update"]}) == [("a.go", 4), ("a.go", 6)]  # line 5: x ends the name
