"""DuckDB SQL for the queries that SQL can express."""

from lintel.llm.quality import BOILERPLATE

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP3 = r"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p from documents),
bad as (select trim(line, ' ') k from l where length(trim(line, ' ')) >= 1 group by 1 having count(distinct source) >= 5),
m as (select l.doc_id, l.p, l.line, bad.k is not null gone from l left join bad on trim(l.line, ' ') = bad.k),
d as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, string_agg(line, chr(10) order by p) filter (not gone) kept from m group by doc_id)
select doc_id, n_lines, n_removed, length(t.text) - length(coalesce(kept, '')) lost_chars, md5(coalesce(kept, '')) kept_md5 from d join documents t using (doc_id)
"""

OP7 = """
select conv_id, turn, 0 part, 'message' kind, cast(null as varchar) call_id, 'ok' status, 0::bigint as "level", concat(turn, ',0,', turn, ',0') place,
  '{"content":' || to_json(text)::varchar || ',"role":' || to_json(role)::varchar || '}' as json
from conversations
"""

OP9 = r"""
with w as (select doc_id, text, @WORDS@ ws from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, t) n from g) where n > 1),
rep as (select doc_id, count(distinct j) n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) j from r) group by 1),
l as (select doc_id, unnest(string_split(text, chr(10))) line from documents),
ll as (select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n, len(regexp_extract_all(line, '[#*$%&|<>]')) sym,
  len(regexp_extract_all(line, '!!')) ex, len(regexp_extract_all(line, '[|›•·]')) bars, regexp_matches(line, '[.!?:;,)\]"''…»”’。！？][ \t\x0b\x0c\r]*$') ended, regexp_matches(lower(line), '@PHRASES@') phrase from l),
lm as (select doc_id, count(*) n_lines, count(*) - count(distinct line) n_dup_lines, count(*) filter (bad) n_lines_removed, coalesce(sum(length(line)) filter (bad), 0) lost_chars, sum(length(line)) line_chars
  from (select *, (n < 20 and not ended) or 2 * sym > n or 2 * ex > n or (bars >= 2 and 4 * bars >= n) or phrase bad from ll where n > 0) group by 1),
m as (select w.doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) n_symbols,
  coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_lines, 0) n_lines, coalesce(n_lines_removed, 0) n_lines_removed, coalesce(lost_chars, 0) lost_chars, coalesce(line_chars, 0) line_chars
  from w left join rep using (doc_id) left join lm using (doc_id))
select doc_id, n_words, word_chars::bigint word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed, n_lines, n_lines_removed, lost_chars::bigint lost_chars, line_chars::bigint line_chars,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 40 * line_chars kept from m
""".replace("@WORDS@", _WORDS).replace("@PHRASES@", "|".join(BOILERPLATE))

OP10 = """
with p as (select page_id, coalesce(html, '') html from pages),
q as (select page_id, octet_length(encode(html)) payload_bytes, sha1(html) hex, max(page_id) over (partition by html) top from p)
select page_id, payload_bytes, record_type, refers_to, list_aggregate(list_transform(range(0, 8), lambda i: (
    with_five(hex, i))), 'string_agg', '') payload_digest
from (select *, case when page_id = top then 'response' else 'revisit' end record_type, case when page_id = top then null else top end refers_to from q)
"""


def _base32() -> str:
    five = "('0x' || substr(hex, (5 * i + 1)::int, 5))::bigint"
    letter = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five} >> {shift}) & 31)::int + 1, 1)"
    return " || ".join(letter(x) for x in (15, 10, 5, 0))


ORACLES = {"op3_line_dedup": OP3, "op7_chat": OP7, "op9_quality": OP9, "op10_warc": OP10.replace("with_five(hex, i)", _base32())}
