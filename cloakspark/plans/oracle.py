"""For each query the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from ..functions.aliases import COMPANY_FORMS
from ..functions.text import CASE_FOLDS, LIGATURES
from ..operators.masterlist import COMMON_WORDS
from ..settings import CATEGORIES, SHEETS
from .queries import WORDS

_B = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v\x{1c}-\x{1f}]"
_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(x: str, pairs: dict[str, str]) -> str:
    for k, v in pairs.items():
        x = f"replace({x}, {_q(k)}, {_q(v)})"
    return x


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_B}+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _replace(f"lower({_collapse(x)})", CASE_FOLDS)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def _auto(kind: str, norm: str) -> str:
    prefix = f"case {kind} when 'PERSON' then 'PSN' when 'ORGANIZATION' then 'ORG' when 'EMAIL_ADDRESS' then 'EML' when 'URL' then 'URL' when 'CUSTOM' then 'CST' else upper(substr({kind}, 1, 3)) end"
    return f"{prefix} || '-AUTO-' || upper(substr(sha1({norm}), 1, 5))"


def _aliases(x: str) -> str:
    """List of surface forms of a name."""
    text = _trim(x)
    tokens = f"regexp_split_to_array({text}, '{_B}+')"
    is_and = "t = '&' or lower(rtrim(t, '.')) = 'and'"
    options = lambda ts: f"list_transform({ts}, lambda t: case when {is_and} then ['&', 'and'] else [t] end)"
    cross = lambda ts: f"list_prepend(array_to_string({ts}, ' '), list_reduce({options(ts)}, lambda a, b: flatten(list_transform(a, lambda i: list_transform(b, lambda j: i || ' ' || j)))))"
    last = f"lower(rtrim({tokens}[-1], '.'))"
    forms = f"case {last} " + " ".join(f"when {_q(f)} then [{', '.join(_q(y) for g in fs for y in (g, g + '.'))}]" for fs in COMPANY_FORMS.values() for f in fs) + " else null end"
    stem = f"{tokens}[:-2]"
    with_form = f"flatten(list_transform({cross(stem)}, lambda s: list_transform({forms}, lambda f: s || ' ' || f)))"
    rest = f"case when {forms} is null then {cross(tokens)} when len({tokens}) >= 2 then {with_form} else [{text}] end"
    return f"case when {text} = '' then [] else list_prepend({text}, {rest}) end"


_MEMO = """memos as (select o_orderkey as row_id, c_custkey, c_acctbal, c_name, c_custkey % 10 = 9 as longer, case when c_custkey % 10 = 9 then 'Paid ' else 'Paid to ' end as head,
  case when c_custkey % 10 = 9 then 'to ' else '' end || c_name as first_name, ' by ' || o_orderpriority || ' / ' as mid from orders join customer on o_custkey = c_custkey)"""
_OWN_ID = f"case when c_acctbal >= 0 then 'STF-' || c_custkey else {_auto(_q('PERSON'), 'lower(c_name)')} end"
_FIRST_ID = f"case when longer then 'STF-L' || c_custkey else {_OWN_ID} end"
_REDACTED = f"head || {_FIRST_ID} || mid || {_OWN_ID}"
_FOUND = f"""found as (select row_id, first_name as name, {_FIRST_ID} as pseudonym, not longer and c_acctbal < 0 as auto from memos
  union all select row_id, c_name, {_OWN_ID}, c_acctbal < 0 from memos), names as (select distinct name, pseudonym, auto from found)"""
# a hint is made if a curated name of like length shares enough letters at both ends; for these names that finds every hint
_NEAR = """curated as (select name from names where not auto union select c_name from customer where c_acctbal >= 0),
hinted as (select n.name from names n where n.auto and exists (select 1 from curated c where length(c.name) = length(n.name)
  and len(list_filter(range(1, length(c.name) + 1), lambda i: substr(c.name, i, 1) = substr(n.name, i, 1))) * 2.0 / (2 * length(c.name)) >= 0.84))"""

_SHEET = f"""parsed as (
  select o.ord * 1099511627776 + s.row_id as row_ord, o.category, {_collapse(f"regexp_replace({_trim('s.name')}, '(?s){_B}+-{_B}.*$', '')")} as name, o.entity_type,
         o.prefix || '-' || nullif({_trim("s.internal_id")}, '') as pseudonym
  from master_sheet s join (values {", ".join(f"({n}, {_q(SHEETS[c])}, {_q(c)}, {_q(p)}, {_q(e)})" for n, (c, (p, e)) in enumerate(CATEGORIES.items()))}) o(ord, sheet, category, prefix, entity_type) on s.sheet = o.sheet
  where {_trim("s.category")} = o.category and s.name is not null), rows_ as (select * from parsed where name <> '')"""


def _positions(text: str, pattern: str, more: str = "") -> str:
    """`doc_id, start, end, text` of the matches of a pattern, by the lengths of what stands between them."""
    return f"""
  select doc_id, cast(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) as int) as "start",
         cast(list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(hits[:i], lambda x: length(x))) as int) as "end", hits[i] as text
  from (select doc_id, hits, regexp_split_to_array({text}, '{pattern}') as gaps, unnest(range(1, len(hits) + 1)) as i
        from (select *, regexp_extract_all({text}, '{pattern}') as hits from documents where text is not null {more}))"""


EMAIL = r"[A-Za-z0-9_](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
URL = r"(?i)(?:https?://|www\.)[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{2,5})?(?:[/?#](?:[.,:;!?''@*$]?[A-Za-z0-9_~%&=+/#-])*)?"
_DOC_EMAILS = f"hits_ as (select doc_id, text, list_sort(list_distinct(regexp_extract_all(text, '{EMAIL}')), 'DESC') as found from documents)"
_BY_LENGTH = "list_transform(list_reverse_sort(list_transform(found, lambda m: {'n': length(m), 'm': m})), lambda s: s.m)"
_EML = f"'EML-AUTO-' || upper(substr(sha1({_norm('m[1]')}), 1, 5))"


def _redacted(value: str) -> str:
    """The text with each address replaced, longest first; the state is a list of one so that it reduces over lists of one."""
    return f"list_reduce(list_prepend([text], list_transform({_BY_LENGTH}, lambda m: [m])), lambda t, m: [replace(t[1], m[1], {value})])[1]"


_SPANS = """spans as (select l_orderkey as text_id, cast(l_linenumber as int) as seq, l_returnflag as entity_type, cast(l_partkey % 40 as int) as "start", cast(l_partkey % 40 + 1 + l_suppkey % 15 as int) as "end",
  cast(30 + l_partkey % 70 as double) as score, ['master list', 'pattern match', 'custom word', 'model'][l_linenumber % 4 + 1] as source, l_linenumber % 4 as prio from lineitem)"""


def _best(source: str, out: str) -> str:
    return f"""{out} as (select * exclude (rn) from (select *, row_number() over (partition by text_id, "start", "end" order by score desc, seq, prio, entity_type, source) as rn from {source}) where rn = 1)"""


def _kept(source: str, out: str) -> str:
    """Greedy by priority, start, longest: a fold over each text's ordered spans."""
    item = "[{'p': prio, 's': \"start\", 'n': -\"end\", 'q': seq, 'e': \"end\", 't': entity_type, 'c': score, 'o': source}]"
    return f"""{out} as (select text_id, k.q as seq, k.t as entity_type, k.s as "start", k.e as "end", k.c as score, k.o as source, k.p as prio from (
  select text_id, unnest(list_reduce(list({item} order by prio, "start", "end" desc, seq), lambda a, d: case when len(list_filter(a, lambda k: d[1].s < k.e and d[1].e > k.s)) > 0 then a else a || d end)) as k from {source} group by text_id))"""


def _map_of(rows: str) -> str:
    """CTEs that end in `map_`, the look-up map of list rows."""
    return f"""
cur as (select *, {_aliases("name")} as forms from {rows} where pseudonym is not null and entity_type is not null),
names as (select entity_type, {_norm("name")} as norm_name, row_ord, pseudonym, category, name from cur),
firsts as (select entity_type, norm_name, arg_min(pseudonym, row_ord) as pseudonym from names group by all),
entry as (select n.entity_type, n.norm_name, n.pseudonym, arg_max(n.category, n.row_ord) as category, arg_max(n.name, n.row_ord) as display_name from names n join firsts f on n.entity_type = f.entity_type and n.norm_name = f.norm_name and n.pseudonym = f.pseudonym group by all),
al as (select entity_type, row_ord, pseudonym, category, name, unnest(forms) as form, unnest(range(0, len(forms))) as form_ord from cur),
aln as (select *, {_norm("form")} as norm_name from al where form_ord > 0),
best as (select entity_type, norm_name, arg_min({{'p': pseudonym, 'c': category, 'd': name}}, {{'r': row_ord, 'f': form_ord}}) as e from aln group by all),
map_ as (select entity_type, norm_name, pseudonym, category, display_name from entry
  union all select b.entity_type, b.norm_name, b.e.p, b.e.c, b.e.d from best b where not exists (select 1 from entry x where x.entity_type = b.entity_type and x.norm_name = b.norm_name))"""


def _master_map() -> str:
    return f"with {_SHEET}, {_map_of('rows_')} select entity_type, norm_name, pseudonym, category, display_name from map_"


def _found_in(texts: str, pattern: str, kind: str, seq: int, score: float, source: str, prio: int) -> str:
    """Spans of a pattern in the column `text`, by the lengths of what stands between matches."""
    upto = "list_sum(list_transform(gaps[:i], lambda x: length(x)))"
    hits = lambda n: f"coalesce(list_sum(list_transform(hits[:{n}], lambda x: length(x))), 0)"
    return f"""
  select text_id, {seq} as seq, '{kind}' as entity_type, cast({upto} + {hits('i - 1')} as int) as "start", cast({upto} + {hits('i')} as int) as "end", {score} as score, '{source}' as source, {prio} as prio, hits[i] as text
  from (select text_id, hits, regexp_split_to_array(text, '{pattern}') as gaps, unnest(range(1, len(hits) + 1)) as i from (select *, regexp_extract_all(text, '{pattern}') as hits from {texts}))"""


def _greedy(source: str, out: str, best: bool) -> str:
    """CTE `out`: of spans of one place the best, if asked for, then those that overlap none that goes before."""
    first = f"(select * exclude (rn) from (select *, row_number() over (partition by text_id, \"start\", \"end\" order by score desc, seq, prio, entity_type, source) as rn from {source}) where rn = 1)" if best else source
    item = "[{'p': prio, 's': \"start\", 'n': -\"end\", 'q': seq, 'e': \"end\", 't': entity_type, 'c': score, 'o': source, 'x': text}]"
    return f"""{out} as (select text_id, k.q as seq, k.t as entity_type, k.s as "start", k.e as "end", k.c as score, k.o as source, k.p as prio, k.x as text from (
  select text_id, unnest(list_reduce(list({item} order by prio, "start", "end" desc, seq), lambda a, d: case when len(list_filter(a, lambda k: d[1].s < k.e and d[1].e > k.s)) > 0 then a else a || d end)) as k from {first} group by text_id))"""


def _flow(texts: str, words: bool) -> str:
    """CTEs from `texts` (`text_id, text`) to `done` (`text_id, redacted`) with the names of master_row."""
    custom = " union all ".join(_found_in(texts, r"(?i)\b" + f"{_B}+".join(w.split()) + r"\b", "CUSTOM", n, 1.0, "custom word", 2) for n, w in enumerate(WORDS))
    staged = f"""words_ as ({custom}), all_ as (select * from engine_ union all select * from words_), {_greedy("all_", "spans_", False)}""" if words else "spans_ as (select * from engine_)"
    return f"""
forms_ as (select distinct entity_type, lower(trim(a)) as key from (select entity_type, unnest({_aliases("name")}) as a from master_row where entity_type is not null) where trim(a) <> ''),
met_ as (select text_id, text, low, entity_type, key, string_split(low, key) as parts from (select *, replace(lower(text), 'i̇', 'i') as low from {texts}) join forms_ on contains(low, key)),
at_ as (select text_id, text, low, entity_type, key, cast(list_sum(list_transform(parts[:i], lambda x: length(x))) + (i - 1) * length(key) as int) as pos from (select *, unnest(range(1, len(parts))) as i from met_)),
listed_ as (select text_id, case entity_type when 'PERSON' then 0 else 1 end as seq, entity_type, pos as "start", cast(pos + length(key) as int) as "end", 0.9 as score, 'master list' as source, 0 as prio, substr(text, pos + 1, length(key)) as text
  from at_ where not regexp_matches(substr(low, pos, 1), '^{_W}') and not regexp_matches(substr(low, pos + length(key) + 1, 1), '^{_W}')),
found_ as (select * from listed_ union all {_found_in(texts, EMAIL, "EMAIL_ADDRESS", 0, 0.5, "model", 3)} union all {_found_in(texts, URL, "URL", 0, 0.5, "model", 3)}),
{_greedy("found_", "engine_", True)}, {staged}, {_map_of("master_row")},
valued_ as (select s.text_id, s."start", s."end", coalesce(m.pseudonym, {_auto("s.entity_type", _norm("s.text"))}) as value from spans_ s left join map_ m on m.entity_type = s.entity_type and m.norm_name = {_norm("s.text")}),
done as (select t.text_id, list_reduce(list_prepend({{'s': 0, 'e': 0, 'v': any_value(t.text)}}, list({{'s': v."start", 'e': v."end", 'v': v.value}} order by v."start" desc)), lambda a, d: {{'s': 0, 'e': 0, 'v': substr(a.v, 1, d.s) || d.v || substr(a.v, d.e + 1)}}).v as redacted
  from {texts} t join valued_ v on t.text_id = v.text_id group by t.text_id)"""


def _quality() -> str:
    dup = f"select {_norm('name')} as name, list_sort(list_distinct(list(category))) as cats, min(row_ord) as ord from rows_ group by 1 having count(distinct category) > 1"
    conf = f"select category, {_norm('name')} as name, list_sort(list_distinct(list(pseudonym))) as ids, min(row_ord) as ord from rows_ where pseudonym is not null group by 1, 2 having count(distinct pseudonym) > 1"
    reuse = "select category, pseudonym, list_sort(list_distinct(list(name))) as names, min(row_ord) as ord from rows_ where pseudonym is not null group by 1, 2 having count(distinct name) > 1"
    words = ", ".join(map(_q, sorted(COMMON_WORDS)))
    kinds = {
        "cross_category_duplicate": ("warning", " name(s) appear under multiple categories", f"select ord, '`' || name || '` appears in: ' || array_to_string(cats, ', ') as example from ({dup})"),
        "conflicting_ids": ("warning", " name(s) have multiple Internal IDs", f"select ord, '`' || name || '` (' || category || ') has IDs: ' || array_to_string(ids, ', ') as example from ({conf})"),
        "blank_ids": ("info", " name(s) have no Internal ID", "select row_ord as ord, '`' || name || '` (' || category || ')' as example from rows_ where pseudonym is null"),
        "duplicate_ids": ("warning", " Internal ID(s) reused by multiple names", f"select ord, 'ID `' || pseudonym || '` (' || category || ') used by: ' || array_to_string(names, ', ') as example from ({reuse})"),
        "ambiguous_common_word": ("info", " name(s) are also ordinary English words", f"select row_ord as ord, '`' || name || '` (' || category || ')' as example from rows_ where not contains(name, ' ') and lower(name) in ({words})"),
    }
    parts = [f"select '{k}' as kind, '{s}' as severity, count(*) || '{t}' as title, array_to_string(list(example order by ord)[:5], ' ; ') as examples, count(*) as total from ({q}) having count(*) > 0" for k, (s, t, q) in kinds.items()]
    return f"with {_SHEET} " + " union all ".join(parts)


def _dictionary_hits() -> str:
    return f"""
with forms as (select distinct entity_type, lower(trim(a)) as key from (select entity_type, unnest({_aliases("name")}) as a from (select entity_type, name from master_row union all select 'PERSON', unnest([short_form, full_form]) from nickname) where entity_type is not null) where trim(a) <> ''),
d as (select doc_id, replace(lower(text), 'i̇', 'i') as low from documents where text is not null),
m as (select doc_id, low, entity_type, key, string_split(low, key) as parts from d join forms on contains(low, key)),
p as (select doc_id, low, entity_type, key, cast(list_sum(list_transform(parts[:i], lambda x: length(x))) + (i - 1) * length(key) as int) as pos from (select *, unnest(range(1, len(parts))) as i from m))
select doc_id, entity_type, key, count(*) as n from p where not regexp_matches(substr(low, pos, 1), '^{_W}') and not regexp_matches(substr(low, pos + length(key) + 1, 1), '^{_W}') group by all"""


def _custom() -> str:
    doubled = f"regexp_replace(text, '({_NW})', '\\1\\1', 'g')"
    counts = " + ".join(f"len(regexp_extract_all(t, '(?i)(?:^|{_NW})" + f"{_B}+".join(w.split()) + f"(?:$|{_NW})'))" for w in WORDS)
    return f"select doc_id, n from (select doc_id, {counts} as n from (select doc_id, {doubled} as t from documents where text is not null)) where n > 0"


def _recased() -> str:
    runs = f"regexp_extract_all(text, '{_W}+|{_NW}+')"
    return f"select doc_id, sha1(array_to_string(list_transform({runs}, lambda w: case when regexp_full_match(w, '\\p{{Lu}}{{2,}}') then substr(w, 1, 1) || lower(substr(w, 2)) else w end), '')) as recased_sha1 from documents where text is not null"


def _page() -> str:
    broken = r"replace(regexp_replace(text, '([a-z]{4})([a-z]{4})', '\1-' || chr(10) || ' \2', 'g'), 'fi', 'ﬁ')"
    plain = _collapse(rf"regexp_replace({_replace(broken, LIGATURES)}, '-{_B[:-1]}]*?\n{_B}*([\p{{L}}\p{{N}}])', '\1', 'g')")
    return f"select doc_id, sha1({plain}) as normal_sha1 from documents where text is not null"


_CANON = "canon as (select entity_type, norm_name, pseudonym, category, display_name, canon_id from canon_name where pseudonym is not null)"
_XNAMES = f"xn as (select entity_type, norm_name, arg_min(original_name, xwalk_id) as original_name from (select entity_type, original_name, xwalk_id, {_norm('original_name')} as norm_name from crosswalk where original_name is not null and regexp_matches(original_name, '[^\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')) group by all)"
_IDS = f"ids as (select distinct entity_type, {_norm('original_name')} as norm_name from assignment where original_name is not null)"

_VARIANTS = ", ".join([
    _collapse("name"), "trim(regexp_replace(name, '[.,;]+$', ''))", "replace(name, '&', 'and')", r"regexp_replace(name, '(?i)\band\b', '&', 'g')",
    f"trim(regexp_replace(regexp_replace(name, '{_B}*[.,;]*{_B}*$', ''), '(?i){_B}*\\b(?:{'|'.join(f for fs in COMPANY_FORMS.values() for f in fs)})$', ''))",
])

ORACLE: dict[str, str] = {
    "redact_order_memos": f"with {_MEMO} select row_id, {_REDACTED} as memo from memos",
    "crosswalk_order_memos": f"with {_MEMO}, {_FOUND} select name as original_name, 'PERSON' as entity_type, case when not auto then 'Staff' end as category, pseudonym, auto from names",
    "findings_view": f"""with {_MEMO}, {_FOUND} select row_id + 1 as "Row", 'memo' as "Column", name as "Detected text", 'PERSON' as "Entity type", 0.9::double as "Confidence", 'master list' as "Source" from found""",
    "exported_crosswalk_view": """select original_name as "Original name", entity_type as "Entity type", case when coalesce(category, '') = '' then '(unknown)' else category end as "Category", pseudonym as "Pseudonym", case when auto then 'yes' else '' end as "Flagged",
  case when coalesce(suggested_pseudonym, '') = '' then '' else suggested_name || ' (' || suggested_pseudonym || ', ' || cast(cast(floor(suggested_score * 100 + 0.5) as bigint) as varchar) || '% match)' end as "Possible match" from (select distinct * exclude (loaded_at) from crosswalk)""",
    "entity_cell_counts": f"with {_MEMO}, {_FOUND} select count(*) as entity_count, count(distinct row_id) as cell_count from found",
    "flag_counts": f"with {_MEMO}, {_FOUND}, {_NEAR} select count(*) as n, count(*) filter (where auto) as n_flagged, (select count(*) from hinted) as n_suggested from names",
    "html_rows": f"""with {_MEMO} select row_id, '<tr><td class="changed">' || {_REDACTED} || '</td></tr>' as html from memos""",
    "dictionary_hits": _dictionary_hits(),
    "dictionary_hits_by_join": _dictionary_hits(),
    "email_findings": _positions("text", EMAIL),
    "url_findings": f"select doc_id, len(u) as n, array_to_string(u, ' ') as urls from (select doc_id, regexp_extract_all(text, '{URL}') as u from documents where text is not null) where len(u) > 0",
    "email_redacted_docs": f"with {_DOC_EMAILS} select doc_id, case when len(found) > 0 then {_redacted(_EML)} else text end as redacted from hits_",
    "run_splice": f"with lines_ as (select doc_id, unnest(parts) as text, cast(unnest(range(0, len(parts))) as int) as unit_idx from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null)), hits_ as (select *, list_sort(list_distinct(regexp_extract_all(text, '{EMAIL}')), 'DESC') as found from lines_) select doc_id, unit_idx, {_redacted(_EML)} as redacted, cast(floor((length(text) - 1) / 40) + 1 as int) as n_runs from hits_ where len(found) > 0",
    "blackout": f"with {_DOC_EMAILS} select doc_id, case when len(found) > 0 then {_redacted('repeat(chr(9608), length(m[1]))')} else text end as redacted from hits_",
    "custom_word_counts": _custom(),
    "best_per_span": f"""with {_SPANS}, {_best("spans", "b")} select text_id, seq, entity_type, "start", "end", score, source from b""",
    "threshold_filter": f"with {_SPANS} select entity_type, count(*) as n from spans where score >= 65 group by 1",
    "overlap_resolution": f"""with {_SPANS}, {_best("spans", "b")}, {_kept("b", "k")} select text_id, seq, "start", "end", source from k""",
    "staged_resolution": f"""with {_SPANS}, f as (select * from spans where source <> 'custom word' and score >= 35), {_best("f", "b")}, {_kept("b", "k")},
u as (select text_id, seq, entity_type, "start", "end", score, source, prio from k union all select text_id, seq, entity_type, "start", "end", score, source, prio from spans where source = 'custom word'), {_kept("u", "v")}
select text_id, seq, "start", "end", source from v""",
    "distinct_text_scan": f"select sha1(text) as text_sha1, min(doc_id) as first_doc, count(*) as n_docs from documents where text is not null and regexp_replace(text, '{_B}', '', 'g') <> '' group by text",
    "unpivot_cells": " union all ".join(f"""select row_id, {n} as col_pos, '{c}' as "column", coalesce({c}, '') as text from master_sheet""" for n, c in enumerate(("name", "primary_subsidiary", "country"))),
    "normalize_names": f"select row_id, {_norm('name')} as norm_name from master_sheet",
    "auto_ids": f"with {_IDS} select entity_type, norm_name, {_auto('entity_type', 'norm_name')} as pseudonym from ids",
    "auto_id_collisions": f"with all_ as (select entity_type, original_name as name from assignment union all select entity_type, original_name from crosswalk union all select 'ORGANIZATION', name from master_sheet), ids as (select distinct entity_type, {_norm('name')} as norm_name from all_ where name is not null) select pseudonym, n_names, names from (select {_auto('entity_type', 'norm_name')} as pseudonym, count(distinct norm_name) as n_names, array_to_string(list_sort(list_distinct(list(norm_name))), '|') as names from ids group by 1) where n_names > 1",
    "assign_crosswalk": f"with {_CANON}, {_XNAMES} select x.original_name, x.entity_type, c.category, coalesce(c.pseudonym, {_auto('x.entity_type', 'x.norm_name')}) as pseudonym, c.pseudonym is null as auto from xn x left join canon c on x.entity_type = c.entity_type and x.norm_name = c.norm_name",
    "fuzzy_candidates": f"with {_CANON}, {_XNAMES} select x.entity_type, x.norm_name, count(*) as n from xn x join canon c on x.entity_type = c.entity_type and abs(length(x.norm_name) - length(c.norm_name)) <= 3 group by all",
    "alias_expansion": f"with n as (select distinct name from master_row), a as (select name, unnest(f) as alias, unnest(range(0, len(f))) as p from (select name, {_aliases('name')} as f from n)) select name, cast(row_number() over (partition by name order by p) - 1 as int) as alias_ord, alias from (select name, alias, min(p) as p from a group by 1, 2)",
    "search_variants": f"select distinct name, variant from (select name, unnest([{_VARIANTS}]) as variant from master_row) where variant <> name and variant <> ''",
    "recase_upper": _recased(),
    "page_normalize": _page(),
    "master_rows": f"with {_SHEET} select row_ord, category, name, entity_type, pseudonym from rows_",
    "master_map_collisions": _master_map(),
    "names_by_entity": f"with {_SHEET} select entity_type, row_ord, name from rows_",
    "counts_by_category": f"with {_SHEET} select category, count(*) as n from rows_ group by 1",
    "master_summary": f"with {_SHEET} select coalesce(category, 'Total') as category, format('{{:,}}', count(*)) as entries from rows_ group by rollup (category)",
    "duplicate_names": f"with {_SHEET} select {_norm('name')} as name, array_to_string(list_sort(list_distinct(list(category))), ', ') as categories from rows_ group by 1 having count(distinct category) > 1",
    "conflicting_ids": f"with {_SHEET} select category, {_norm('name')} as norm_name, array_to_string(list_sort(list_distinct(list(pseudonym))), ', ') as ids from rows_ where pseudonym is not null group by 1, 2 having count(distinct pseudonym) > 1",
    "duplicate_ids": f"with {_SHEET} select category, pseudonym, array_to_string(list_sort(list_distinct(list(name))), ', ') as names from rows_ where pseudonym is not null group by 1, 2 having count(distinct name) > 1",
    "quality_report": _quality(),
}
_MERGED = """
lines_ as (
  select 'Staff' as cat, case when c_acctbal >= 0 then cast(c_custkey as varchar) end as id, replace(c_name, '#', ' ') as name, 1 as origin, c_custkey as ord from customer
  union all select 'Staff', null, replace(c_name, '#', ' '), 1, c_custkey - 1073741824 from customer where c_custkey % 3 = 0
  union all select 'Staff', cast(c_custkey + 1000000 as varchar), replace(c_name, '#', ' '), 1, c_custkey - 2147483648 from customer where c_custkey % 5 = 0
  union all select 'Vendor', null, replace(s_name, '#', ' '), 1, s_suppkey + 1099511627776 from supplier
  union all select 'Funder', cast(n_nationkey as varchar), n_name, 0, n_nationkey from nation
  union all select 'Staff', case when c_custkey % 2 = 0 then 'old' || c_custkey end, replace(c_name, '#', ' '), 0, c_custkey from customer where c_custkey % 7 = 0),
merged as (select cat as "Category", id as "Internal ID", name as "Name", null::varchar as "Primary Subsidiary", null::varchar as "Country"
  from (select *, row_number() over (partition by cat, name order by id is null, origin, ord) as p from lines_) where p = 1)"""
ORACLE["migration_merge"] = f"with {_MERGED} select * from merged"
ORACLE["migration_totals"] = f"""with {_MERGED} select "Category", count(*) as n_rows, count("Internal ID") as n_with_id from merged group by 1"""
_WORDS = f"""words_ as (select distinct name from (select unnest([short_form, full_form]) as name from nickname union all select word from stand_in)),
common as (select name from words_ where {_trim("name")} not like '% %' and lower({_trim("name")}) in ({", ".join(map(_q, sorted(COMMON_WORDS)))}))"""
ORACLE["ambiguous_words"] = f"with {_WORDS} select 'Staff' as category, name from common"
ORACLE["quality_common"] = f"""with {_WORDS} select 'blank_ids' as kind, 'info' as severity, count(*) || ' name(s) have no Internal ID' as title, count(*) as total from words_
union all select 'ambiguous_common_word', 'info', count(*) || ' name(s) are also ordinary English words', count(*) from common having count(*) > 0"""
ORACLE["quality_blank"] = f"with {_SHEET} select category, count(*) as n from rows_ where pseudonym is null group by 1"
ORACLE["whitespace_collapse"] = f"select row_id, {_collapse('name')} as name from master_sheet where name is not null"
_IMAGES = "pages_ as (select doc_id, 0 as unit_idx, greatest(doc_id % 10 - 6, 0) as n from documents), boxes_ as (select doc_id, unit_idx, unnest(range(0, n)) as image_idx from pages_ where n > 0)"
ORACLE["page_images"] = f"with {_IMAGES} select doc_id, unit_idx, cast(image_idx as int) as image_idx, cast(image_idx * 10 + 10 as double) as x0, cast(image_idx * 10 + 11 as double) as y0, cast(image_idx * 10 + 12 as double) as x1, cast(image_idx * 10 + 13 as double) as y1, 'black' as fill from boxes_"
ORACLE["page_images_blackout"] = f"with {_IMAGES} select doc_id, count(*) as n, cast(4.0 * count(*) as double) as area from boxes_ group by 1"
ORACLE["page_search"] = f"""
with x as (select distinct xwalk_id, original_name, suggested_name as name from crosswalk where suggested_name is not null and original_name is not null),
t as (select xwalk_id, original_name, list_filter([name, {_VARIANTS}], lambda c: c <> '' and contains(lower(original_name), lower(c)))[1] as candidate from x)
select xwalk_id, candidate, cast((length(lower(original_name)) - length(replace(lower(original_name), lower(candidate), ''))) / length(lower(candidate)) as int) as n_places from t where candidate is not null"""
_CELLS = ("original_name", "entity_type", "category", "pseudonym", "suggested_pseudonym", "suggested_name")
_REDACTED_CELLS = ", ".join(f"coalesce(d{n}.redacted, x.{c}) as {c}" for n, c in enumerate(_CELLS))
_CHANGED = " + ".join(f"cast(d{n}.redacted is not null as int)" for n in range(len(_CELLS)))
_JOINS = " ".join(f"left join done d{n} on d{n}.text_id = x.{c}" for n, c in enumerate(_CELLS))
ORACLE["cells_flow"] = f"""
with x as (select distinct xwalk_id as row_id, {", ".join(_CELLS)} from crosswalk),
cells_ as (select distinct t as text_id, t as text from (select unnest([{", ".join(_CELLS)}]) as t from x) where t is not null), {_flow("cells_", False)}
select x.row_id, {_REDACTED_CELLS}, cast({_CHANGED} as int) as n_changed from x {_JOINS}"""
ORACLE["blocks_flow"] = f"""
with lines_ as (select doc_id, unnest(parts) as text, cast(unnest(range(0, len(parts))) as int) as unit_idx from (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r]') as parts from documents where text is not null)),
units_ as (select {{'d': doc_id, 'u': unit_idx}} as text_id, doc_id, unit_idx, text from lines_), {_flow("units_", True)}
select u.doc_id, u.unit_idx, coalesce(d.redacted, u.text) as redacted from units_ u left join done d on d.text_id = u.text_id"""
# every address found in the running text leads back to the same address in the raw text
_BROKEN = r"regexp_replace(text, '([a-z]{4})([a-z]{4})', '\1-' || chr(10) || ' \2', 'g')"
_RUNNING = _collapse(rf"regexp_replace({_replace(_BROKEN, LIGATURES)}, '-{_B[:-1]}]*?\n{_B}*([\p{{L}}\p{{N}}])', '\1', 'g')")
ORACLE["offset_roundtrip"] = f"select doc_id, cast(n as bigint) as n, cast(n as bigint) as n_same from (select doc_id, len(regexp_extract_all({_RUNNING}, '{EMAIL}')) as n from documents where text is not null) where n > 0"
