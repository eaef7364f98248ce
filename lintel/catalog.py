"""Queries of the rule engine over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel import catalog_code
from lintel.plans import engine
from lintel.plans.rules import Rule
from lintel.schema import files_of

_PATH = "concat(source, '/', lang, '/', doc_id, '.txt')"
_FILES = f"select {_PATH} path, concat(source, '/', lang) dir, coalesce(text, '') text from documents"
_LISTS = f"select path, dir, text, case when body = '' then [] else string_split(body, chr(10)) end ls from (select path, dir, text, regexp_replace(text, '\\n$', '') body from ({_FILES}))"
_LINES = f"select path, dir, unnest(ls) line, unnest(range(1, len(ls) + 1)) line_no from ({_LISTS})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return files_of(rows, F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return files_of(rows, F.regexp_replace("url", "^[a-z]+://", ""), "html")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory for each conversation, a file for each turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return files_of(rows, F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.format_string("%04d", "turn"), F.lit("-"), "role"), "text")


def _rule(name: str, kind: str, params: dict, **more) -> Rule:
    return Rule(name, kind, params, **more)


_HEAD = "select '{id}' \"rule\", 'error' severity, {path} path, ({line})::int line, {message} message from {rows}"


def _sql(id: str, rows: str, message: str, path: str = "path", line: str = "line_no") -> str:
    return _HEAD.format(id=id, path=path, line=line, message=message, rows=rows)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _owned(id: str, home: str, places: str, name: str, pattern: str, guarded: bool) -> str:
    """A text is one declaration: one home in it blanks it whole."""
    hits = f"({_LINES}) where regexp_matches(line, {_text(pattern)}) and path not in (select path from ({_LINES}) where {home})"
    hits = f"(select path, min(line_no) line_no from {hits} group by path)" if guarded else hits
    count = f"(select sum({places})::bigint n from ({_LINES})) where n > 0 and n <> 3"
    return _sql(id, hits, _text(f"matches forbidden pattern {pattern}")) + " union all " + _sql(id, count, f"concat({_text(name)}, ' has ', n, ' holder(s), want 3')", path="''", line="0")


_SECRET = r"(?i)\b(token|secret|password|api_key)\s*=\s*\"?[0-9a-z_\-]{8,}"
_MAIL = r"[\w.+\-]+@[\w\-]+\.[a-z]{2,}"
_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_LICENSE = r"(?i)(license|copyright|all rights reserved)"


def _cases() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], list[Rule], str]]:
    """name -> (files, rules, SQL)."""
    lines, files, lists = f"({_LINES})", f"({_FILES})", f"({_LISTS})"
    forbidden = lambda p: _text(f"matches forbidden pattern {p}")
    one = {
        "r1a_forbidden_lines": (documents, [_rule("no-secrets", "forbidden-pattern", {"pattern": _SECRET})], _sql("no-secrets", f"{lines} where regexp_matches(line, {_text(_SECRET)})", forbidden(_SECRET))),
        "r1a_forbidden_fused": (
            documents,
            [_rule("no-secrets", "forbidden-pattern", {"pattern": _SECRET}), _rule("no-mail", "forbidden-pattern", {"pattern": _MAIL}), _rule("no-hosts", "forbidden-pattern", {"pattern": _IP}, include=("src0/**", "src1*/en/**"))],
            " union all ".join([
                _sql("no-secrets", f"{lines} where regexp_matches(line, {_text(_SECRET)})", forbidden(_SECRET)),
                _sql("no-mail", f"{lines} where regexp_matches(line, {_text(_MAIL)})", forbidden(_MAIL)),
                _sql("no-hosts", f"{lines} where regexp_matches(line, {_text(_IP)}) and (path like 'src0/%' or regexp_full_match(path, 'src1[^/]*/en/.*'))", forbidden(_IP)),
            ]),
        ),
        "r1b_forbidden_multiline": (documents, [_rule("no-break", "forbidden-pattern", {"pattern": r"\.\n(The|Der|El|La)\b", "multiline": True})], _sql("no-break", rf"(select path, regexp_extract(text, '(?s)^(.*?)\.\n(The|Der|El|La)\b', 1) head from {files} where regexp_matches(text, '\.\n(The|Der|El|La)\b'))", forbidden(r"\.\n(The|Der|El|La)\b"), line="1 + length(head) - length(replace(head, chr(10), ''))")),
        "r1c_all_of": (documents, [_rule("mixed", "forbidden-pattern", {"all_of": [_MAIL, _IP], "none_of": ["Copyright"]})], _sql("mixed", f"{files} where regexp_matches(text, {_text(_MAIL)}) and regexp_matches(text, {_text(_IP)}) and not regexp_matches(text, 'Copyright')", _text(f"holds all of {_MAIL}, {_IP}"), line="1")),
        "r1d_window": (documents, [_rule("near", "forbidden-pattern", {"all_of": ["that", "with", "this"], "window": 2})], _sql("near", f"""(
            select path, arg_min(anchor, line_no) line_no from (select path, line_no, least(coalesce(a, line_no), line_no) anchor from (
              select path, line_no, max(regexp_matches(line, 'that')) over w t, max(regexp_matches(line, 'with')) over w u, max(regexp_matches(line, 'this')) over w v,
                min(case when regexp_matches(line, 'that|with|this') then line_no end) over w a, regexp_matches(line, 'that|with|this') own
              from {lines} window w as (partition by path order by line_no range between 1 preceding and current row))
            where t and u and v and own) group by path)""", _text("holds all of that, with, this"))),
        "r1e_require_present": (documents, [_rule("guarded", "forbidden-pattern", {"pattern": _IP, "require_present": [_MAIL]})], _sql("guarded", f"(select path, min(line_no) line_no from {lines} where regexp_matches(line, {_text(_IP)}) and path in (select path from {files} where regexp_matches(text, {_text(_MAIL)})) group by path)", forbidden(_IP))),
        "r1f_evidence": (documents, [_rule("unproven", "forbidden-pattern", {"pattern": r"\bbut\b|\bwas\b", "evidence": {"pattern": r"\bwith\b", "within": 1}})], _sql("unproven", f"(select path, min(line_no) line_no from {lines} l where regexp_matches(line, '\\bbut\\b|\\bwas\\b') and not exists (select 1 from {lines} e where e.path = l.path and abs(e.line_no - l.line_no) <= 1 and regexp_matches(e.line, '\\bwith\\b')) group by path)", forbidden(r"\bbut\b|\bwas\b"))),
        "r1g_credential": (documents, [_rule("owned", "forbidden-pattern", {"pattern": r"\bwas\b", "require_absent": [{"credential": "^[A-D]", "holders": 3}]})], _owned("owned", "regexp_matches(line, '^[A-D]')", "case when regexp_matches(line, '^[A-D]') then 1 else 0 end", "^[A-D]", r"\bwas\b", True)),
        "f4_not_declaring": (documents, [_rule("homes", "forbidden-pattern", {"pattern": r"\bwas\b"}, not_declaring=(("copyright", 3),))], _owned("homes", "contains(line, 'copyright')", "(length(line) - length(replace(line, 'copyright', ''))) // 9", "copyright", r"\bwas\b", False)),
        "r1h_denied_by": (documents, [_rule("denied", "forbidden-pattern", {"pattern": r"\bthe\b", "denied_by": ["of", "in"]})], _sql("denied", rf"{lines} where regexp_matches(line, '\bthe\b') and not regexp_matches(substr(line, 1, length(regexp_extract(line, '^(.*?)\bthe\b', 1))), '(?i)\b(?:of|in)[ \t]+(?:[0-9A-Za-z_]{{1,12}}[ \t]+)?$')", forbidden(r"\bthe\b"))),
        "r2a_required_every_file": (documents, [_rule("needs-stop", "required-pattern", {"pattern": r"\.$", "when": ["(?i)the"]})], _sql("needs-stop", rf"{lists} where regexp_matches(text, '(?i)the') and len(list_filter(ls, lambda x: regexp_matches(x, '\.$'))) = 0", _text(r"lacks required pattern \.$"), line="0")),
        "r2b_required_exists": (documents, [_rule("needs-one", "required-pattern", {"pattern": "no such text anywhere", "mode": "exists"})], _sql("needs-one", f"(select 1 where (select count(*) from {lines} where regexp_matches(line, 'no such text anywhere')) = 0)", _text("no file matches required pattern no such text anywhere"), path="''", line="0")),
        "r3_pattern_count": (documents, [_rule("few-mails", "pattern-count", {"pattern": _MAIL, "op": "at-most", "n": 3})], _sql("few-mails", f"(select count(*) n from {lines} where regexp_matches(line, {_text(_MAIL)})) where n > 3", f"concat({_text(f'pattern {_MAIL} matches ')}, n, ' line(s), want at-most 3')", path="''", line="0")),
        "r4_ordering": (documents, [_rule("order", "ordering", {"before": r"\bwith\b", "after": r"\bthat\b"})], _sql("order", rf"(select path, min(line_no) filter (regexp_matches(line, '\bwith\b')) b, min(line_no) filter (regexp_matches(line, '\bthat\b')) a from {lines} group by path) where a < b", r"concat('\bthat\b comes before \bwith\b at line ', b)", line="a")),
        "r5_file_size": (documents, [_rule("size", "file-size", {"cap": 8, "hard_cap": 40, "overrides": [{"glob": "src0/**", "cap": 0}, {"glob": "**/fr/*", "cap": 20}]})], _sql("size", f"(select path, len(ls) n, case when path like 'src0/%' then 40 when regexp_full_match(path, '(.*/)?fr/[^/]*') then 20 else 8 end cap from {lists}) where n > cap", "concat(n, ' lines, cap is ', cap)", line="0")),
        "r6_file_naming": (pages, [_rule("names", "file-naming", {"forbid_ext": [".php", ".com"], "require_match": r"^[a-z0-9./\-]+$", "reserved": ["**/index*", "blog.*/**"]})], """
            with p as (select regexp_replace(url, '^[a-z]+://', '') path from pages), q as (select path, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1) ext from p)
            select 'names' "rule", 'error' severity, path, 0 line, message from (
              select path, 'forbidden extension ' || ext message from q where ext in ('.php', '.com')
              union all select path, 'path doesn''t match ^[a-z0-9./\\-]+$' from q where not regexp_matches(path, '^[a-z0-9./\\-]+$')
              union all select path, case when regexp_full_match(path, '(.*/)?index[^/]*') then 'reserved name **/index*' else 'reserved name blog.*/**' end from q where regexp_full_match(path, '(.*/)?index[^/]*') or regexp_full_match(path, 'blog\\.[^/]*(/.*)?'))"""),
        "r7_binary_content": (documents, [_rule("bytes", "binary-content", {"max_bytes": 9000, "forbid_binary": True})], _sql("bytes", f"(select path, octet_length(encode(text)) n from {files}) where n > 9000", "concat(n, ' bytes, most are 9000')", line="0")),
        "r8_doc_path_exists": (documents, [_rule("cites", "doc-path-exists", {"pattern": r"(?:from|by|with) ([a-z]+)"})], _sql("cites", rf"(select path, line_no, unnest(regexp_extract_all(line, '(?:from|by|with) ([a-z]+)', 1)) token from {lines}) where token <> '' and token not in (select path from {files})", "concat('cited path doesn''t exist: ', token)")),
        "r9a_pair_same_file": (turns, [_rule("pairs", "pair-consistency", {"trigger": r"\bthe\b", "requires": r"\bof\b", "obligation": "countable"})], ""),
        "r9c_pair_same_dir": (turns, [_rule("dirs", "pair-consistency", {"trigger": r"\bla\b", "requires": r"\bdes\b", "where": "same-dir"})], ""),
        "r10_set_relation": (documents, [_rule("sets", "set-relation", {"a": {"files": ["src1/**"], "pattern": r"\b([a-z]{6})\b", "min_count": 5}, "b": {"files": ["src2/**"], "pattern": r"\b([a-z]{6})\b"}, "relation": "disjoint"})], _sql("sets", rf"(select string_agg(v, ', ' order by v) names from (select distinct unnest(regexp_extract_all(line, '\b([a-z]{{6}})\b', 1)) v from {lines} where path like 'src1/%' intersect select distinct unnest(regexp_extract_all(line, '\b([a-z]{{6}})\b', 1)) v from {lines} where path like 'src2/%')) where names is not null", "'not disjoint: ' || names", path="''", line="0")),
        "r11_baseline": (documents, [_rule("listed", "baseline", {"pattern": r"\b([a-z]+ing)\b", "baseline": ["# endings", "ing", "", "nothing"], "mode": "exact"})], rf"""
            with v as (select distinct unnest(regexp_extract_all(line, '\b([a-z]+ing)\b', 1)) v from {lines}), k as (select unnest(['ing', 'nothing']) v)
            select 'listed' "rule", 'error' severity, '' path, 0 line, message from (select 'not in the baseline: ' || v message from v where v not in (from k) union all select 'in the baseline only: ' || v from k where v not in (from v))"""),
        "f5_min_files": (documents, [_rule("floor", "file-naming", {"forbid_ext": [".md"]}, include=("src3/fr/**",), min_files=100000)], _sql("floor", f"(select count(*) n from {files} where path like 'src3/fr/%') where n < 100000", "concat('scope has ', n, ' file(s), least are 100000')", path="''", line="0")),
        "t_decomment_sh": (documents, [_rule("code", "forbidden-pattern", {"pattern": r"###"}, preprocess="decomment-sh")], None),
    }
    t = "(select concat(conv_id, '/', lpad(turn::varchar, 4, '0'), '-', role) path, conv_id::varchar dir, case when regexp_replace(coalesce(text, ''), '\\n$', '') = '' then [] else string_split(regexp_replace(text, '\\n$', ''), chr(10)) end ls from conversations)"
    n = lambda p: f"len(list_filter(ls, lambda x: regexp_matches(x, {_text(p)})))"
    at = lambda p: f"list_position(list_transform(ls, lambda x: regexp_matches(x, {_text(p)})), true)"
    pair_a = _sql("pairs", rf"(select path, {n(r'\bthe\b')} t, {n(r'\bof\b')} c, {at(r'\bthe\b')} pos from {t}) where t > 0 and c < t", _text(r"\bthe\b without \bof\b"), line="pos")
    pair_c = _sql("dirs", rf"(select dir, sum({n(r'\bla\b')}) t, sum({n(r'\bdes\b')}) c, min(case when {n(r'\bla\b')} > 0 then struct_pack(p := path, l := {at(r'\bla\b')}) end) x from {t} group by dir) where t > 0 and c = 0", _text(r"\bla\b without \bdes\b"), path="x.p", line="x.l")
    one["r9a_pair_same_file"] = (*one["r9a_pair_same_file"][:2], pair_a)
    one["r9c_pair_same_dir"] = (*one["r9c_pair_same_dir"][:2], pair_c)
    return one


def _run(files: Callable[[SparkSession, str], DataFrame], rules: list[Rule], spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.evaluate(files(spark, sf_dir), rules)


def scope_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5: the highest class of any path."""
    return engine.classify_scope(documents(spark, sf_dir).select("path"), ["src0/**"], ["src1/**", "src2/**"])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule, with rules that found nothing."""
    from lintel.plans.rules import as_table

    files, rules, _ = _cases()["r1a_forbidden_fused"]
    found = engine.evaluate(files(spark, sf_dir), rules, sort=False).groupBy("rule").agg(F.count("*").alias("n"))
    return as_table(spark, rules).select("rule").join(found, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_findings"), F.col("n").isNull().alias("passed"))


def changeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8: rules that a part of the files decides see changed files only; the others see all."""
    files = documents(spark, sf_dir)
    rules = [_rule("no-mail", "forbidden-pattern", {"pattern": _MAIL}), _rule("few-mails", "pattern-count", {"pattern": _MAIL, "op": "at-most", "n": 3})]
    return engine.evaluate(files, rules, files.where("path like 'src4/%'").select("path"))


#: Stands for a generator's header: each document gets its source as a leading comment, and some sources are generators.
_HEADER = "from src1"


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with a header in their leading comments are outside one rule and inside the other."""
    headed = F.concat(F.lit("# from "), "source", F.lit("\n"), F.coalesce("text", F.lit("")))
    files = documents(spark, sf_dir).select("path", "text").withColumn("source", F.split_part("path", F.lit("/"), F.lit(1)))
    files = files_of(files, "path", headed)
    params = {"pattern": _MAIL}
    rules = [_rule("no-mail", "forbidden-pattern", params), _rule("no-mail-at-all", "forbidden-pattern", params, generated=True)]
    return engine.evaluate(files, rules, generated=[_HEADER])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: functools.partial(_run, files, rules) for name, (files, rules, _) in _cases().items()}
    return found | catalog_code.queries() | {"o5_scope_class": scope_class, "k_verdicts": verdicts, "s8_changeset": changeset, "f3_generated": generated}


def oracles() -> dict[str, str]:
    found = {name: sql for name, (_, _, sql) in _cases().items() if sql}
    found |= catalog_code.oracles()
    fused = found["r1a_forbidden_fused"]
    found["o5_scope_class"] = f"select case max(case when path like 'src0/%' then 0 when path like 'src1/%' or path like 'src2/%' then 1 else 2 end) when 0 then 'docs' when 1 then 'governance' else 'runtime' end scope from ({_FILES})"
    found["k_verdicts"] = f"select r \"rule\", count(f.path) n_findings, count(f.path) = 0 passed from (select unnest(['no-secrets', 'no-mail', 'no-hosts']) r) left join ({fused}) f on f.\"rule\" = r group by r"
    mail = _sql("no-mail", f"({_LINES}) where regexp_matches(line, {_text(_MAIL)}) and path like 'src4/%'", _text(f"matches forbidden pattern {_MAIL}"))
    found["s8_changeset"] = f"{mail} union all {found['r3_pattern_count']}"
    lists, lines = (x.replace("coalesce(text, '')", "'# from ' || source || chr(10) || coalesce(text, '')") for x in (_LISTS, _LINES))
    lead = f"(select path, ls, list_position(list_transform(ls, lambda x: not regexp_matches(x, '^\\s*(//|#|--|/\\*|\\*|<!--|;|$)')), true) p from ({lists}))"
    made = f"select path from {lead} where len(list_filter(case when coalesce(p, 0) = 0 then ls else ls[1:p - 1] end, lambda x: contains(x, '{_HEADER}'))) > 0"
    hit = _text(f"matches forbidden pattern {_MAIL}")
    found["f3_generated"] = " union all ".join(_sql(i, f"({lines}) where regexp_matches(line, {_text(_MAIL)}) {more}", hit) for i, more in (("no-mail", f"and path not in ({made})"), ("no-mail-at-all", "")))
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, rules, _ = _cases()["r1a_forbidden_fused"]
    return _run(files, rules, spark, sf_dir)
