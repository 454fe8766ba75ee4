"""The catalogue's queries as SQL over the same tables, written independently of the DataFrame plans."""

from __future__ import annotations

from . import file_queries
from .queries import AFFIX_WORDS, CONFUSABLE, FORBIDDEN, GLOSSARY, LEXICON, SQL_RULES

BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = "███"

LINES = """lines as (
  select doc_id, lang, doc_id * 100000 + pos as id, line from (
    select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
  where trim(line) <> '')"""
MUT = LINES + """, mut as (
  select doc_id, id, case id % 20 when 18 then line || ' someCamelCase' else line end as s, case id % 20
    when 0 then line when 1 then '' when 2 then replace(line, ' ', '  ') when 3 then line || '  ' when 4 then translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 5 then regexp_replace(line, '[0-9]', '', 'g')
    when 6 then replace(line, '.', ',') when 7 then replace(line, 'e', '€') when 8 then replace(line, '.', '') when 9 then line || ' same same'
    when 10 then line || ' mail ann@x.org http://a.example.com/x.' when 11 then line || ' {name} %s AB-1234' when 12 then line || ' (open [x)' when 13 then line || ' NASA!! ?? ..'
    when 14 then substr(line, 1, (length(line) // 4)::int) when 15 then lower(line) when 16 then line || ' zero' || chr(8203) || 'width' when 17 then line || ' p' || chr(1072) || 'ypal'
    when 18 then line else line || ' in 10-20 of 3:4 cases' end as d from lines)"""
PAIR = LINES + ", pair as (select * from (select doc_id, id, line as s, lead(line) over (partition by doc_id order by id) as d from lines) where d is not null)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def collapse(c: str) -> str:
    return f"regexp_replace({strip(c)}, '{BLANK}+', ' ', 'g')"


def bar(c: str) -> str:
    return f"coalesce(array_to_string({c}, '|'), '')"


def only_in(a: str, b: str) -> str:
    return f"list_sort(list_distinct(list_filter({a}, lambda x: not list_contains({b}, x))))"


def lists(pattern: str, clean: str = "x") -> tuple[str, str, str]:
    """(condition, source, target) of two lists of matches that differ."""
    find = lambda c: f"list_transform(regexp_extract_all({c}, '{pattern}'), lambda x: {clean})"
    s, d = find("s"), find("d")
    return f"list_sort({s}) <> list_sort({d})", bar(only_in(s, d)), bar(only_in(d, s))


def first_distinct(c: str) -> str:
    """Distinct values in the order in which they come first."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


LAST_S, LAST_D = f"right({strip('s')}, 1)", f"right({strip('d')}, 1)"
FINAL = "('.', '!', '?', '…', '。', '．', '！', '？')"
FIRST_S, FIRST_D = f"left({strip('s')}, 1)", f"left({strip('d')}, 1)"
SYMBOL = "[<>≤≥≠±×÷√∞‰$€£¥]"
SIGN_LIST = "[" + ", ".join(f"'{c}'" for c in sorted(SYMBOL[1:-1])) + "]"
SIGNS_OF = lambda a, b: f"list_filter({SIGN_LIST}, lambda x: length({a}) - length(replace({a}, x, '')) > length({b}) - length(replace({b}, x, '')))"
MORE = lambda a, b: f"coalesce({SIGNS_OF(a, b)}[1], '')"
ID = lambda c: f"list_filter(regexp_extract_all(translate({c}, '‑‐   ', '--   '), '[A-Za-z0-9][A-Za-z0-9./_-]*[A-Za-z0-9]'), lambda x: length(x) >= 3 and regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]'))"
WORDS = lambda c: f"regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}_]+')"
CAMEL = first_distinct(f"list_filter({WORDS('s')}, lambda x: regexp_full_match(x, '[A-Za-z]*[a-z][A-Z][A-Za-z]*'))")
MISSING = f"list_filter({CAMEL}, lambda x: not contains(d, x))"
INVISIBLE = r"[\x7f\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
RUNS = first_distinct(r"list_filter(regexp_extract_all(d, '\.{2,}|!{2,}|\?{2,}|,{2,}|;{2,}|:{2,}'), lambda x: x <> '...')")
MIXED = first_distinct(r"list_filter(regexp_extract_all(d, '\p{L}+'), lambda x: regexp_matches(x, '[\x{400}-\x{52f}]') and (regexp_matches(x, '[A-Za-z\x{c0}-\x{24f}\x{1e00}-\x{1eff}]') or regexp_matches(x, '[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]')))")

#: Category: (condition, source spans, target spans) over s and d.
RULES: dict[str, tuple[str, str, str]] = {
    "empty_target": (f"{strip('s')} <> '' and {strip('d')} = ''", "''", "''"),
    "untranslated_segment": (f"{strip('s')} = {strip('d')} and length({strip('s')}) >= 8 and regexp_matches(s, '\\p{{L}}')", "''", "''"),
    "length_ratio": (f"length({strip('s')}) >= 20 and length({strip('d')}) > 0 and (length({strip('d')}) / length({strip('s')}) < 0.3 or length({strip('d')}) / length({strip('s')}) > 3.0)", "''", "''"),
    "first_letter_case": (f"(regexp_matches({FIRST_S}, '\\p{{Lu}}') and regexp_matches({FIRST_D}, '\\p{{Ll}}')) or (regexp_matches({FIRST_S}, '\\p{{Ll}}') and regexp_matches({FIRST_D}, '\\p{{Lu}}'))", FIRST_S, FIRST_D),
    "double_spaces": ("regexp_matches(d, '  ')", "''", bar(first_distinct("regexp_extract_all(d, ' {2,}')"))),
    "whitespace_edges": (r"regexp_matches(d, '^[ \x{a0}]|[ \x{a0}]$')", "''", "''"),
    "final_punctuation_mismatch": (
        f"{LAST_S} <> '' and {LAST_D} <> '' and (case when {LAST_S} in {FINAL} then translate({LAST_S}, '。．！？', '..!?') else '' end) <> (case when {LAST_D} in {FINAL} then translate({LAST_D}, '。．！？', '..!?') else '' end)",
        f"case when {LAST_S} in {FINAL} then {LAST_S} else '' end", f"case when {LAST_D} in {FINAL} then {LAST_D} else '' end"),
    "urls": lists(r"(?i)(?:https?://|www\.)[^\s<>""''''"r"]+", r"regexp_replace(x, '[.,;:!?)\]}]+$', '')"),
    "emails": lists(r"[\p{L}\p{N}_.%+\-]+@[\p{L}\p{N}_.\-]+\.\p{L}{2,}"),
    "placeholders": lists(r"%[0-9]*\$?[sdifoxX]|\{\{[^{}]+\}\}|\{[A-Za-z0-9_.\-]+\}|\$\{[^}]+\}|<[A-Za-z]+/>"),
    "symbol_mismatch": (f"len({SIGNS_OF('s', 'd')}) + len({SIGNS_OF('d', 's')}) > 0", MORE("s", "d"), MORE("d", "s")),
    "alphanum_id_mismatch": (f"list_sort({ID('s')}) <> list_sort({ID('d')})", bar(only_in(ID("s"), ID("d"))), bar(only_in(ID("d"), ID("s")))),
    "camelcase_mismatch": (f"d <> '' and len({MISSING}) > 0", bar(MISSING), "''"),
    "control_characters": (f"regexp_matches(d, '{INVISIBLE}')", "''", bar(f"list_sort(list_distinct(regexp_extract_all(d, '{INVISIBLE}')))")),
    "repeated_punctuation": (f"len({RUNS}) > 0", "''", bar(RUNS)),
}


def rule(category: str, table: str = "mut") -> str:
    if category == "mixed_scripts":
        return f"select doc_id, id, '' as span_source, unnest({MIXED}) as span_target from {table}"
    where, source, target = RULES[category]
    return f"select doc_id, id, {source} as span_source, {target} as span_target from {table} where {where}"


def issues() -> str:
    return " union all ".join(f"select *, '{c}' as category_id from ({rule(c)})" for c in SQL_RULES)


ISSUES = f"{MUT}, issues as ({issues()})"
LOW = lambda c: f"list_distinct({WORDS(f'lower({c})')})"
quoted = lambda t: "'" + t.replace("'", "''") + "'"
values = lambda rows: "(values " + ", ".join("(" + ", ".join("null" if x is None else quoted(x) for x in r) + ")" for r in rows) + ")"

PREVIEW = MUT + f""", preview as (
  select *, s <> sa or d <> da as changed from (
    select doc_id, id, s, d, regexp_replace(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '{TOKEN}', 'g') as sa, regexp_replace(d, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '{TOKEN}', 'g') as da from mut))"""
TAGS = r"(?i)</?(?:ph|bpt|ept|it|x|bx|ex|g|hi|ut|mrk)(?:\s+[^<>]*?)?\s*/?>"
plain = lambda c: strip(f"regexp_replace({c}, '{TAGS}', '', 'g')")
count_words = lambda c: f"len(list_filter(regexp_split_to_array({plain(c)}, '{BLANK}+'), lambda w: w <> ''))"
SIGNS = r"^[\d\s\-.,;:!?¿¡()\[\]{}/\\|@#$%^&*+=<>~`""''"r"°ºª•–—…]+$".replace("''", "''") .replace("`", '`"')
joined_tokens = lambda c: f"regexp_replace({c}, '{TOKEN}(?:\\s*[,;.\\-–—/|]\\s*{TOKEN}|\\s+{TOKEN}|\\s*\\(\\s*{TOKEN}\\s*\\))+', '{TOKEN}', 'g')"
FINALS = PREVIEW + f""", final as (
  select *, {joined_tokens(plain('case when changed then sa else s end'))} as source, {joined_tokens(plain('case when changed then da else d end'))} as target,
    ({strip('s')} = '' and {strip('d')} = '') or ({plain('s')} <> '' and (regexp_matches({plain('s')}, '{SIGNS}') or {count_words('s')} < 2)) or ({plain('d')} <> '' and (regexp_matches({plain('d')}, '{SIGNS}') or {count_words('d')} < 2)) as junk
  from preview), groups as (
  select source, count(*) as n, min(id) as first, count(distinct target) as targets from final where not junk and source <> '' and target <> '' group by source having count(*) > 1)"""
share = lambda b, a: f"case when {b} = '' then 0.0 else (1 - length(replace({a}, '{TOKEN}', '')) / greatest(length({b}), 1)) * 100 end"
FUNNEL = FINALS + f""", funnel as (
  select f.doc_id, f.id, f.changed, case when junk then 'junk' when greatest({count_words(f"replace(sa, '{TOKEN}', ' ')")}, {count_words(f"replace(da, '{TOKEN}', ' ')")}) < 5 then 'short'
    when f.source = '' or f.target = '' then 'empty' when (contains(sa, '{TOKEN}') or contains(da, '{TOKEN}')) and greatest({share('s', 'sa')}, {share('d', 'da')}) >= 50 then 'heavy'
    when g.first is not null and g.first <> f.id then 'dedup' else 'kept' end as reason
  from final f left join groups g on f.source = g.source and not f.junk and f.source <> '' and f.target <> '')"""


def consistency(same: str, other: str, size: str) -> str:
    return f"""with {PAIR}, d as (select id, {collapse('s')} as sn, {collapse('d')} as tn, length({strip('s')}) as sl, length({strip('d')}) as tl from pair),
    g as (select {same} as k, min(id) as first, arg_min({other}, id) as first_other, count(*) as n from d where sn <> '' and tn <> '' and {size} >= 8 group by 1 having count(*) > 1)
    select d.id, g.first as reference_id, g.n as group_size from d join g on d.{same} = g.k where d.id > g.first and d.{other} <> g.first_other"""


#: Kinds of the audit as patterns without lookaround: a word character before or after is taken along.
AUDITED = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "url": "https?://\\S+",
    "phone": "\\+\\d{1,3}[-.\\s]?\\(?\\d{1,4}\\)?[-.\\s]?\\d{2,4}[-.\\s]?\\d{2,4}",
    "clinical_id": "(?:^|[^\\p{L}\\p{N}_])NCT\\d{8}(?:[^\\p{L}\\p{N}_]|$)", "eudract_id": "(?:^|[^\\p{L}\\p{N}_])\\d{4}-\\d{6}-\\d{2}(?:[^\\p{L}\\p{N}_]|$)",
}

ORACLE_SQL: dict[str, str] = {
    **{f"qa_{c}": f"with {MUT} select id, span_source, span_target from ({rule(c)})" for c in SQL_RULES},
    "qa_turns_length_ratio": "with seg as (select * from (select conv_id as doc_id, conv_id * 1000 + turn as id, role, text as s, lead(role) over w as r2, lead(text) over w as d from conversations window w as (partition by conv_id order by turn)) where role = 'user' and r2 = 'assistant') "
    + f"select id, span_source, span_target from ({rule('length_ratio', 'seg')})",
    "qa_forbidden_terms": f"with {MUT} select id, '' as span_source, t as span_target from mut, {values([(t,) for t in FORBIDDEN])} v(t) where list_contains({LOW('d')}, t)",
    "qa_glossary": f"""with {MUT}, g(src, tgt, note) as {values(GLOSSARY)}, hit as (select id, s, d, lower(src) as k, min(src) as src, string_agg(distinct tgt, ' | ' order by tgt) as tgts,
      bool_or(case when regexp_matches(tgt, '^[A-Z]{{2,}}$') then list_contains({WORDS('d')}, tgt) else list_contains({LOW('d')}, lower(tgt)) end) as ok
      from mut, g where case when regexp_matches(src, '^[A-Z]{{2,}}$') then list_contains({WORDS('s')}, src) else list_contains({LOW('s')}, lower(src)) end group by 1, 2, 3, 4)
      select id, src as span_source, tgts as span_target from hit where not ok""",
    "qa_confusables": f"with {MUT} select distinct id, '' as span_source, t as span_target from mut, {values([(t,) for g in CONFUSABLE for t in g])} v(t) where list_contains({LOW('d')}, t)",
    "qa_spelling_lexicon": f"""with {LINES}, w as (select id, regexp_extract_all(line, '\\p{{L}}+(?:[''’\\-]\\p{{L}}+)*') as all_words from lines),
      f as (select id, list_filter(all_words, lambda x, i: list_position(all_words, x) = i and length(x) >= 2 and not list_contains([{', '.join(quoted(w) for w in LEXICON)}], lower(replace(x, '’', '''')))) as bad from w)
      select id, '' as span_source, array_to_string(bad[1:20], '|') as span_target from f where len(bad) > 0""",
    "qa_affix_spelling": f"""with {LINES}, e(word, flags) as {values(AFFIX_WORDS)}, s as (select word as form, flags from e
        union select regexp_replace(word, 'y$', 'ies'), flags from e where contains(flags, 'S') and regexp_matches(word, '[^aeiou]y$') union select word || 's', flags from e where contains(flags, 'S') and regexp_matches(word, '[^sxzy]$')
        union select word || 'ed', flags from e where contains(flags, 'D') and regexp_matches(word, '[^e]$') union select word || 'd', flags from e where contains(flags, 'D') and regexp_matches(word, 'e$')),
      forms as (select list(form) as known from (select form from s union select 'un' || form from s where contains(flags, 'U'))),
      w as (select id, regexp_extract_all(line, '\\p{{L}}+(?:[''’\\-]\\p{{L}}+)*') as all_words from lines),
      f as (select id, list_filter(all_words, lambda x, i: list_position(all_words, x) = i and length(x) >= 2 and not list_contains(known, lower(replace(x, '’', '''')))) as bad from w, forms)
      select id, '' as span_source, array_to_string(bad[1:20], '|') as span_target from f where len(bad) > 0""",
    "xs_consistency_target": consistency("sn", "tn", "sl"),
    "xs_consistency_source": consistency("tn", "sn", "tl"),
    "xs_findings": " union all ".join(f"""select x.id, 'exact-{axis}' as kind, g.first as reference_id, g.file as reference_file, md5(g.s || '|' || g.t) as reference_md5, g.first::varchar || '|' || x.id::varchar as siblings,
      'Consistency (exact-{axis}): compare with segment ' || g.first::varchar || '; group size ' || g.n::varchar || '.' as note
      from (with {PAIR} select id, {collapse('s')} as sn, {collapse('d')} as tn from pair) x join (
        with {PAIR}, d as (select doc_id, id, {collapse('s')} as sn, {collapse('d')} as tn, {strip('s')} as s, {strip('d')} as t from pair)
        select {same} as k, min(id) as first, arg_min({other}, id) as first_other, arg_min(doc_id, id)::varchar as file, arg_min(s, id) as s, arg_min(t, id) as t, count(*) as n from d where sn <> '' and tn <> '' and length({side}) >= 8 group by 1 having count(*) > 1) g
      on x.{same} = g.k where x.id > g.first and x.{other} <> g.first_other""" for axis, same, other, side in (("target", "sn", "tn", "s"), ("source", "tn", "sn", "t"))),
    "xs_date_majority": """with o as (select o_orderkey as id, case when o_orderkey % 9 = 0 then strftime(o_orderdate, '%d.%m.%Y') else strftime(o_orderdate, '%d/%m/%Y') end as raw, case when o_orderkey % 9 = 0 then '.' else '/' end as sign from orders),
      c as (select sign, count(*) as n from o group by 1 order by n desc limit 1) select id, c.sign as majority, raw as span_target from o, c where o.sign <> c.sign""",
    "xs_number_majority": """with o as (select o_orderkey as id, case when o_orderkey % 11 = 0 then replace(printf('%.2f', o_totalprice), '.', ',') else printf('%.2f', o_totalprice) end as raw, case when o_orderkey % 11 = 0 then ',' else '.' end as sign from orders),
      c as (select sign, count(*) as n from o group by 1 order by n desc limit 1) select id, c.sign as majority, raw as span_target from o, c where o.sign <> c.sign""",
    "dd_same_source": f"with {FINALS} select f.id as key, case when g.targets = 1 then 'identical' else 'conflict' end as section, g.n, f.id = g.first as kept from final f join groups g on f.source = g.source where not f.junk and f.source <> '' and f.target <> ''",
    "fn_funnel": f"with {FUNNEL} select id as key, reason from funnel",
    "fn_metrics": f"""with {FUNNEL} select coalesce(doc_id::varchar, 'all') as file, count(*) as raw, count(*) filter (reason = 'kept') as kept, count(*) filter (reason = 'junk') as junk, count(*) filter (reason = 'short') as short,
      count(*) filter (reason = 'empty') as empty, count(*) filter (reason = 'heavy') as heavy, count(*) filter (reason = 'dedup') as dedup, count(*) filter (changed) as changed_rows,
      round(count(*) filter (reason = 'kept') * 100.0 / count(*), 2) as retention_percent from funnel group by grouping sets ((doc_id), ())""",
    "rd_email": f"select doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '{TOKEN}', 'g') as text, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) as n from documents",
    "rd_dictionary": f"""with d as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: case when lower(x) in ({', '.join(quoted(w) for w in FORBIDDEN)}) then '{TOKEN}' else x end) as parts from documents)
      select doc_id, array_to_string(parts, '') as text_after, len(list_filter(parts, lambda x: x = '{TOKEN}'))::bigint as n_dictionary from d""",
    "rd_audit": " union all ".join(
        f"select doc_id::varchar as file, '{kind}' as kind, len(regexp_extract_all(text, '{pattern}')) as n from documents where regexp_matches(text, '{pattern}')" for kind, pattern in AUDITED.items()),
    "rp_by_category": f"with {ISSUES} select category_id, count(*) as n, count(distinct id) as n_segments from issues group by 1",
    "rp_by_group": f"""with {ISSUES}, g as (select case when category_id in ('symbol_mismatch', 'alphanum_id_mismatch') then 'Numeric Elements' when category_id = 'placeholders' then 'Tags' else 'Content' end as grp, 'high' as severity from issues)
      select coalesce(grp, 'all') as grp, coalesce(severity, 'all') as severity, count(*) as n from g group by rollup (grp, severity)""",
    "rp_page": f"with {ISSUES} select id, span_source, span_target from issues where category_id = 'final_punctuation_mismatch' order by doc_id::varchar, id offset 50 limit 50",
    "rp_context_window": f"with {LINES} select id, array_to_string(list(id) over (partition by doc_id order by id rows between 2 preceding and 2 following), '|') as ids from lines",
    "rp_signature_groups": f"with {ISSUES} select category_id, span_source as missing, span_target as extra, count(*) as n from issues where category_id in ('tag_count', 'tag_order', 'placeholders') group by 1, 2, 3",
    "rp_flatten_sorted": f"with {ISSUES} select i.id, i.category_id, m.s as source_text, m.d as target_text, false as is_edited from issues i join mut m on i.id = m.id",
    "rp_search": f"with {MUT} select id from mut where (contains(lower(s), 'same same') or contains(lower(d), 'same same')) and id between 1 and 999999999",
    "fl_workbook": f"with {ISSUES} select i.id, i.category_id, md5(m.s) as source_md5, md5(m.d) as target_md5 from issues i join mut m on i.id = m.id",
    **file_queries.ORACLE_SQL,
}
