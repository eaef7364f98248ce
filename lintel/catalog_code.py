"""Queries of rules over code. A source file is made of each document's id, alike in Spark and in SQL, so that the SQL tells by
arithmetic alone where findings have to be."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.plans import engine
from lintel.plans.rules import Rule
from lintel.schema import files_of
from lintel.sources import corpus

#: {i}: the id. A line in braces with a test stands where the test holds; {n*...} repeats a line.
_GO = (
    "concat('package p\n', 'import o \"os\"\n\n', 'func Save', doc_id, '(x int) {\n',"
    " case when doc_id % 3 = 0 then '\tdb.Exec(\"a }\")\n\tcheck(x)\n' else '\tcheck(x)\n\tdb.Exec(\"a }\")\n' end,"
    " repeat('\twork(x) // check(x)\n', cast(doc_id % 5 as int)), '}\n\n', 'func Load', doc_id, '() int {\n', '\tv := o.ReadFile(\"b\")\n',"
    " case when doc_id % 4 = 0 then '\treturn check(v)\n' else '\treturn 1\n' end, '}\n', '// home:x\n', 'func F', doc_id % 40, '() {}\n')"
)
_DART = (
    "concat('class A', doc_id, ' {\n  void save() async {\n', case when doc_id % 4 = 0 then '    zip();\n' else '    a();\n' end,"
    " case when doc_id % 3 = 0 then '    b();\n' else '    await b();\n' end, '    context.x();\n    if (mounted)\n      context.y();\n  }\n}\n',"
    " '// home:y\nclass B', doc_id % 30, ' {}\n', 'var f = Field(keyboardType: TextInputType.number', case when doc_id % 2 = 0 then ', validator: ok' else repeat(' ', 0) end, ');\n')"
)
_STATEMENTS = (
    "concat(repeat('-- one\n', cast(doc_id % 3 as int)), 'select a from u where a = ''x; y'';\n',"
    " case when doc_id % 4 = 0 then 'select * from shop.orders o where status = 1 for update;\n' else 'select * from shop.orders o order by id for update;\n' end,"
    " 'select 1 from lines for share;\n')"
)
#: Statements in Go constants: a sum with a named constant, a raw string, and one in three that isn't constant.
_LITERALS = (
    "concat('package p\n', repeat('\n', cast(doc_id % 3 as int)), 'const orders = \"shop.orders\"\n', 'func F(x string) {\n',"
    " case when doc_id % 4 = 0 then '\tq(\"select a from \" + orders + \" for update\")\n' else '\tq(\"select a from \" + orders +\n\t\t\" order by id for update\")\n' end,"
    " '\tq(`select b\nfrom shop.orders\nwhere status = 1`)\n',"
    " case when doc_id % 3 = 0 then '\tq(\"delete from \" + x)\n' else '\tq(\"plain \" + x)\n' end, '}\n')"
)
_TESTS = (
    "concat('package p\nimport o \"os\"\nfunc T', doc_id, '(t *T, dir string) {\n\tp := filepath.Join(root(), \"x\")\n\twant, _ := o.ReadFile(p)\n',"
    " case when doc_id % 2 = 0 then '\tgot := render(loadX(p))\n' else '\tgot := render(model)\n' end, '\tif !bytes.Equal(want, got) {\n\t}\n}\n')"
)
_GATES = (
    "concat('class A {\n  bool get _ready => name.text.isNotEmpty && age.text.isNotEmpty;\n', repeat('\n', cast(doc_id % 3 as int)),"
    " '  build() => ListenableBuilder(listenable: Listenable.merge([name', case when doc_id % 2 = 0 then ', age' else repeat(' ', 0) end, ']), builder: (c, _) => Button(on: _ready));\n}\n')"
)
#: One text for each language of transforms: code, a literal and comments that all say todo.
_MIXED = {
    "go": "concat(repeat('\n', cast(doc_id % 4 as int)), 'a := \"todo\"\n', 'b() // todo\n', 'todo()\n', '/* x\ntodo */ c()\n')",
    "dart": "concat(repeat('\n', cast(doc_id % 4 as int)), 'var a = ''todo'';\n', 'b(); // todo\n', 'todo();\n', '/* x\ntodo */ c();\n')",
    "sh": "concat(repeat('\n', cast(doc_id % 4 as int)), 'a=\"todo\"\n', 'b # todo\n', 'todo\n', 'c\nd\n')",
    "sql": "concat(repeat('\n', cast(doc_id % 4 as int)), 'select ''todo'';\n', 'select b; -- todo\n', 'select todo;\n', '/* x\ntodo */ select c;\n')",
    "awk": "concat(repeat('\n', cast(doc_id % 4 as int)), '{ a = \"todo\" }\n', '{ b } # todo\n', '{ todo }\n', '{ c }\n{ d }\n')",
}
#: Lines of the mixed texts, behind the empty ones, that keep todo under each transform.
_KEPT = {
    "decomment-go": (1, 3), "strings-only-go": (1,), "decomment-destring-go": (3,), "comments-only-go": (2, 5), "decomment-sh": (1, 3), "destring-sh": (2, 3), "destring-decomment-sh": (3,), "strings-only-sh": (1,),
    "decomment-dart": (1, 3), "code-only-dart": (3,), "comments-only-dart": (2, 5), "comments-only-sql": (2, 5), "comments-only-awk": (2,),
}


def sources(text: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Files whose text and path are SQL expressions over the documents."""
    return lambda spark, sf_dir: files_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), F.expr(name), F.expr(text.replace("\\", "\\\\").replace("''", "\\'")))


def _sql(id: str, rows: str, line: str, message: str, path: str = "path") -> str:
    return f"select '{id}' \"rule\", 'error' severity, {path} path, ({line})::int line, {message} message from {rows}"


def _docs(name: str, where: str = "true") -> str:
    return f"(select *, doc_id i, doc_id % 5 r, {name} path from documents where {where})"


_PATHS = {x: f"concat('{x}/d', doc_id % 7, '/f', doc_id, '.{x}')" for x in ("go", "dart", "sql", "sh", "awk")}


def _home(id: str, name: str, line: str, identity: str, message: str, n: int) -> str:
    rows = f"(select *, {line} line_no, {identity} ident from {_docs(name)})"
    return _sql(id, f"(select *, first_value(path) over (partition by ident order by path) home, first_value(line_no) over (partition by ident order by path) home_line from {rows}) where path <> home", "line_no", message)


#: Globs, and what they mean.
_GLOBS = {"go/*/f1*.go": "go/[^/]*/f1[^/]*[.]go", "**/d3/**": "(.*/)?d3(/.*)?", "go/d[12]/*": "go/d[12]/[^/]*", "go/{d4,d5}/f?.go": "go/(d4|d5)/f[^/][.]go", "*.go": "[^/]*[.]go", "go/**/f1?.go": "go/(.*/)?f1[^/][.]go"}


def _sides(path: str) -> str:
    """What the functions of two directories' first files don't share, by side."""
    a, b = (f"(select distinct concat('F', i % 40) v from {_docs(path, f'doc_id % 7 = {k} and doc_id < 100')})" for k in (1, 2))
    only = lambda x, y: f"(select string_agg(v, ', ' order by v) s from {x} where v not in (select v from {y}))"
    rows = f"(select concat_ws('; ', 'only in a: ' || a.s, 'only in b: ' || b.s) m from {only(a, b)} a, {only(b, a)} b)"
    return _sql("sides", rows, "0", "'not equal: ' || m", "''")


def _cases() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], list[Rule], str]]:
    go, dart, sql = (sources(x, _PATHS[k]) for x, k in ((_GO, "go"), (_DART, "dart"), (_STATEMENTS, "sql")))
    g, d, s = _PATHS["go"], _PATHS["dart"], _PATHS["sql"]
    rule = lambda i, kind, params, **more: [Rule(i, kind, params, **more)]
    found = {
        "r12_func_line_budget": (go, rule("budget", "go/func-line-budget", {"max_lines": 5}), _sql("budget", _docs(g, "doc_id % 5 > 2"), "4", "concat('func Save', i, ' spans ', 3 + r, ' lines, most are 5')")),
        "r13_call_confined": (go, rule("confined", "go/call-confined-to-func-name", {"symbol": r"^os\.ReadFile$", "allowed_func": "^Save"}), _sql("confined", _docs(g), "10 + r", "concat('os.ReadFile is called in Load', i)")),
        "r14_call_order": (go, rule("order", "go/call-order-in-func", {"sequence": ["^check$", r"^db\."]}), _sql("order", _docs(g, "doc_id % 3 = 0"), "5", r"'^check$ is called after ^db\.'")),
        "r14_call_order_dead_stage": (go, rule("order", "go/call-order-in-func", {"sequence": ["^check$", "^gone$"], "funcs": "^Load"}), _sql("order", "(select 1 where (select count(*) from documents) > 0)", "0", "'anchor matches nothing: ^gone$'", "''")),
        "r15_guard_precedes_call": (go, rule("guard", "go/guard-precedes-call", {"guard": "^check$", "sink": r"^db\.Exec$"}), _sql("guard", _docs(g, "doc_id % 3 = 0"), "5", "'db.Exec without an earlier ^check$'")),
        "r16_count_relation": (go, rule("counts", "go/per-func-count-relation", {"left": "^work$", "right": "^check$", "relation": "<=", "require_symbol": "both"}), _sql("counts", _docs(g, "doc_id % 5 > 1"), "4", "concat('func Save', i, ': ', r, ' ^work$, 1 ^check$, want <=')")),
        "r16_count_relation_used": (go, rule("used", "go/per-func-count-relation", {"left": "^check$", "right": "^none$", "relation": "==", "require_used": "left", "funcs": "^(Load|Save)"}), _sql("used", _docs(g, "doc_id % 4 = 0"), "9 + r", "concat('func Load', i, ': 1 ^check$, 0 ^none$, want ==')")),
        "r18_go_single_home": (go, rule("homes", "go/marked-single-home", {"marker": "home:x"}), _home("homes", g, "13 + r", "concat('func F', i % 40)", "concat(ident, ' has its home at ', home, ':', home_line)", 40)),
        "r9b_pair_same_func": (go, rule("pairs", "pair-consistency", {"trigger": r"db\.Exec", "requires": r"work\(", "where": "same-func", "also_present": "check"}), _sql("pairs", _docs(g, "doc_id % 5 = 0"), "case when i % 3 = 0 then 5 else 6 end", r"'db\.Exec without work\('")),
        "r20_method_delegates": (dart, rule("delegates", "dart/method-delegates", {"method": "^save$", "must_call": r"zip\("}), _sql("delegates", _docs(d, "doc_id % 4 <> 0"), "2", r"'save doesn''t call zip\('")),
        "r21_dart_single_home": (dart, rule("homes", "dart/marked-single-home", {"marker": "home:y"}), _home("homes", d, "10", "concat('class B', i % 30)", "concat(ident, ' has its home at ', home, ':', home_line)", 30)),
        "r22_ref_after_await": (dart, rule("awaited", "dart/ref-after-await", {"method": "^save$", "access": r"context\.", "guard": "mounted"}), _sql("awaited", _docs(d, "doc_id % 3 <> 0"), "5", r"'context\. after await'")),
        "r23_numeric_field": (dart, rule("fields", "dart/numeric-field-validated", {"numeric_value": r"TextInputType\.number"}), _sql("fields", _docs(d, "doc_id % 2 = 1"), "12", "'Field is numeric without validator'")),
        "r17_expected_derives": (sources(_TESTS, g), rule("derives", "go/expected-derives-from-actual", {"reader": r"^os\.ReadFile$", "loader": "^load[A-Z]", "compare": r"^bytes\.Equal$", "declare": "self-comparison:"}), _sql("derives", _docs(g, "doc_id % 2 = 0"), "7", "concat('func T', i, ': both sides of bytes.Equal are read from the same place')")),
        "r24_gate_reads": (sources(_GATES, d), rule("gates", "dart/gate-reads-are-listened", {"builders": ["ListenableBuilder"], "listen_args": ["animation", "listenable"], "builder_arg": "builder", "read_suffixes": [".text"]}), _sql("gates", _docs(d, "doc_id % 2 = 1"), "3 + doc_id % 3", "'ListenableBuilder reads age, which animation doesn''t hold'")),
        "r1i_prefilter": (go, rule("gated", "forbidden-pattern", {"pattern": r"\breturn \d|nothing", "prefilter": "return 1"}), _sql("gated", _docs(g, "doc_id % 4 <> 0"), "11 + r", r"'matches forbidden pattern \breturn \d|nothing'")),
        "r2a_required_multiline": (go, rule("whole", "required-pattern", {"pattern": r"check\(x\)\n\tdb", "when": r"func Save\d+", "multiline": True}), _sql("whole", _docs(g, "doc_id % 3 = 0"), "0", r"'lacks required pattern check\(x\)\n\tdb'")),
        "r9a_pair_also_present": (go, rule("also", "pair-consistency", {"trigger": "return", "requires": "work", "also_present": "return 1"}), _sql("also", _docs(g, "doc_id % 5 = 0 and doc_id % 4 <> 0"), "11 + r", "'return without work'")),
        "r10_set_relation_short": (go, rule("short", "set-relation", {"a": {"files": ["go/d1/**"], "pattern": r"func (F\d+)", "min_count": 1000}, "b": {"files": ["go/d2/**"], "pattern": r"func (F\d+)"}, "relation": "equal"}), _sql("short", f"(select count(distinct i % 40) n from {_docs(g, 'doc_id % 7 = 1')})", "0", "concat('side a has ', n, ' value(s), least are 1000')", "''")),
        "r10_set_relation_equal": (go, rule("sides", "set-relation", {"a": {"files": ["go/d1/f?.go", "go/d1/f??.go"], "pattern": r"func (F\d+)"}, "b": {"files": ["go/d2/f?.go", "go/d2/f??.go"], "pattern": r"func (F\d+)"}, "relation": "equal"}), _sides(g)),
        "f1_scope_globs": (go, [Rule(f"g-{k}", "file-naming", {"forbid_ext": [".go"]}, include=(x,), exclude=("go/d6/**",)) for k, x in enumerate(_GLOBS)], " union all ".join(_sql(f"g-{k}", f"{_docs(g)} where regexp_full_match(path, '{x}') and i % 7 <> 6", "0", "'forbidden extension .go'") for k, x in enumerate(_GLOBS.values()))),
        "r26_locking_order": (sql, rule("locks", "sql/locking-select-order", {}), _sql("locks", f"(select *, unnest(case when i % 4 = 0 then [0, 1] else [1] end) k from {_docs(s)})", "2 + i % 3 + k", "'locking SELECT without a total order or a pinned unique key'")),
        "r27_locking_target": (sql, rule("guarded", "sql/locking-target", {"table": "^orders$", "strength": ["update"], "schema": "^shop$"}), _sql("guarded", _docs(s), "2 + i % 3", "'shop.orders is locked for update'")),
        "r28_statement_predicate": (sql, rule("statements", "sql/statement-predicate", {"table": r"\bshop\.orders\b", "require": ["order by"], "forbid": ["status"]}), _sql("statements", f"(select *, unnest(['lacks order by', 'holds status']) w from {_docs(s, 'doc_id % 4 = 0')})", "2 + i % 3", "concat('statement ', w)")),
        "r28_go_literals": (sources(_LITERALS, g), rule("statements", "sql/statement-predicate", {"table": r"from shop\.orders\b", "require": ["order by"]}), _sql("statements", f"(select *, unnest([case when i % 4 = 0 then 4 end, case when i % 4 = 0 then 5 else 6 end, case when i % 3 = 0 then case when i % 4 = 0 then 8 else 9 end end]) k, unnest([1, 2, 3]) w from {_docs(g)}) where k is not null", "k + i % 3", "case when w = 3 then 'SQL that is put together can''t be read' else 'statement lacks order by' end")),
        "r26_go_literals": (sources(_LITERALS, g), rule("locks", "sql/locking-select-order", {}), _sql("locks", _docs(g, "doc_id % 4 = 0"), "4 + i % 3", "'locking SELECT without a total order or a pinned unique key'")),
        "r27_go_literals": (sources(_LITERALS, g), rule("guarded", "sql/locking-target", {"table": "^orders$", "strength": ["update"], "schema": "^shop$"}), _sql("guarded", _docs(g), "4 + i % 3", "'shop.orders is locked for update'")),
        "f2_production": (go, None, _sql("shipped", _docs(g, "doc_id % 7 not in (3, 4)"), "5 + (doc_id % 3 <> 0)::int", r"'matches forbidden pattern db\.Exec'")),
    }
    for name, lines in _KEPT.items():
        language = name.rpartition("-")[2]
        hits = f"(select *, unnest({[*lines]}) k from {_docs(_PATHS[language])})"
        found["t_" + name.replace("-", "_")] = (sources(_MIXED[language], _PATHS[language]), rule("todo", "forbidden-pattern", {"pattern": "todo"}, preprocess=name), _sql("todo", hits, "i % 4 + k", "'matches forbidden pattern todo'"))
    return found


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    files, rules, _ = _cases()[name]
    if name == "f2_production":
        return engine.evaluate(files(spark, sf_dir), [Rule("shipped", "forbidden-pattern", {"pattern": r"db\.Exec"}, production=True)], tests=["go/d3/**", "**/d4/*"])
    return engine.evaluate(files(spark, sf_dir), rules)


def many_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transforms of one language and no transform, as rules that share a pass."""
    rules = [Rule(f"r-{x}", "forbidden-pattern", {"pattern": "todo"}, preprocess=x) for x in ("raw", "decomment-go", "strings-only-go", "decomment-destring-go", "comments-only-go")]
    return engine.evaluate(sources(_MIXED["go"], _PATHS["go"])(spark, sf_dir), rules)


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: files neither at one of some paths nor below one, by directory."""
    files = sources(_GO, _PATHS["go"])(spark, sf_dir)
    return corpus.prune(files, ["go/d1", "go/d2/f9.go", "go/d", "go/d3/f"]).groupBy("dir").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8: some paths of the tree."""
    files = sources(_GO, _PATHS["go"])(spark, sf_dir)
    some = [r["path"] for r in files.select("path").where("path like '%f1.go' or path like '%f22.go' or path like '%f103.go'").collect()]
    return corpus.restrict(files, some).select("path", "dir", "ext", F.length("text").cast("long").alias("chars"))


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3: a report and annotations, line by line."""
    from lintel.sources import reports

    files, rules, _ = _cases()["r14_call_order"]
    found = reports.collected(engine.evaluate(files(spark, sf_dir), rules))
    rows = [(kind, i, line) for kind, text in (("human", reports.human(rules, found)), ("github", reports.github(rules, found))) for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "kind string, at long, line string")


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: exit codes of a run with errors, with warnings only, and without findings."""
    files = sources(_GO, _PATHS["go"])(spark, sf_dir)
    runs = {"error": Rule("r", "forbidden-pattern", {"pattern": "func"}), "warn": Rule("r", "forbidden-pattern", {"pattern": "func"}, severity="warn"), "none": Rule("r", "forbidden-pattern", {"pattern": "no such text"})}
    return spark.createDataFrame([(k, engine.exit_code(engine.evaluate(files, [r], sort=False))) for k, r in runs.items()], "run string, code int")


def idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rules whose scope holds no file."""
    files = sources(_GO, _PATHS["go"])(spark, sf_dir)
    rules = [Rule(f"r-{i}", "file-size", {"cap": 1}, include=(f"go/d{i}/*.go",)) for i in range(9)]
    return spark.createDataFrame([(x,) for x in engine.idle_rules(files, rules)], "rule string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: functools.partial(_run, name) for name in _cases()}
    return found | {"t_many_transforms": many_transforms, "s3_pruned": pruned, "s8_restricted": restricted, "k1_k3_reports": sinks, "k6_exit_codes": verdict, "f6_idle_rules": idle}


def oracles() -> dict[str, str]:
    found = {name: sql for name, (_, _, sql) in _cases().items()}
    g = _PATHS["go"]
    kept = {"raw": (1, 2, 3, 5)} | {k: v for k, v in _KEPT.items() if k.endswith("-go")}
    found["t_many_transforms"] = " union all ".join(_sql(f"r-{k}", f"(select *, unnest({[*v]}) k from {_docs(g)})", "i % 4 + k", "'matches forbidden pattern todo'") for k, v in kept.items())
    made = f"select {g} path, regexp_replace({g}, '/[^/]*$', '') dir, length({_GO}) n from documents"
    found["s3_pruned"] = f"select dir, count(*) n, sum(n)::bigint chars from ({made}) where dir <> 'go/d1' and path <> 'go/d2/f9.go' group by dir"
    found["s8_restricted"] = f"select path, dir, '.go' ext, n chars from ({made}) where path like '%f1.go' or path like '%f22.go' or path like '%f103.go'"
    hits = f"(select *, row_number() over (order by path) k, count(*) over () n from ({found['r14_call_order']}))"
    found["k1_k3_reports"] = f"""
        select 'github' kind, k - 1 "at", concat('::error file=', path, ',line=', line, '::[order] ', message) line from {hits}
        union all select 'human', k, concat('  ', path, ':', line, '  ', message) from {hits}
        union all select 'human', 0, concat('[order] FAIL — ', count(*), ' finding(s)') from {hits}
        union all select 'human', count(*) + 1, concat('1 rule(s), 0 passed, ', count(*), ' finding(s)') from {hits}"""
    found["k6_exit_codes"] = "select * from (values ('error', 1), ('warn', 0), ('none', 0)) t(run, code)"
    found["f6_idle_rules"] = f"select concat('r-', r) \"rule\" from range(9) t(r) where concat('go/d', r) not in (select dir from ({made}))"
    return found
