"""SQL that gives the same rows, for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .lookalike import tables


def _p1() -> str:
    order = "order by coalesce(trust, -1) desc, edited_at desc nulls last, merge_id"
    name = r"regexp_replace(name, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"
    return f"""
with m as (select distinct merge_id, group_no, category, name, pseudonym, trust, edited_at from master_merge),
g as (select group_no from m group by 1 having count(*) > 1),
c as (select group_no, merge_id, category from (select *, row_number() over (partition by group_no {order}) p from m where category in ('Staff', 'Vendor', 'Funder')) where p = 1),
n as (select group_no, merge_id from (select *, row_number() over (partition by group_no {order}) p from m
      where name is not null and {name} <> '' and lower({name}) not in (select word from stand_in)) where p = 1),
s as (select group_no, merge_id from (select m.group_no, m.merge_id, row_number() over (partition by m.group_no order by coalesce(m.trust, -1) desc, m.edited_at desc nulls last, m.merge_id) p
      from m join c on m.group_no = c.group_no
      where regexp_full_match(m.pseudonym, case c.category when 'Staff' then 'STF' when 'Vendor' then 'VND' else 'FND' end || '-[0-9]+')) where p = 1)
select g.group_no, coalesce(c.merge_id, 0) as category_row, coalesce(n.merge_id, 0) as name_row, coalesce(s.merge_id, 0) as pseudonym_row
from g left join c on g.group_no = c.group_no left join n on g.group_no = n.group_no left join s on g.group_no = s.group_no"""


def _p1_votes() -> str:
    return """
with m as (select distinct merge_id, group_no, category, trust, edited_at from master_merge where group_no is not null and merge_id is not null and category in ('Staff', 'Vendor', 'Funder')),
v as (select group_no, category, sum(coalesce(trust, 0) + 1) as weight, max(row(coalesce(trust, -1), coalesce(edited_at, timestamp '0001-01-01'), -merge_id)) as standing from m group by all)
select group_no, category as value from (select *, row_number() over (partition by group_no order by weight desc, standing desc) as p from v) where p = 1"""


def _p3() -> str:
    def words(text: str) -> str:
        bare = rf"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '([\p{{L}}\p{{N}}])[''‘’ʼ]+([\p{{L}}\p{{N}}])', '\1\2', 'g'), '([\p{{L}}\p{{N}}])[''‘’ʼ]+([\p{{L}}\p{{N}}])', '\1\2', 'g')"
        return rf"list_sort(regexp_extract_all({bare}, '[\p{{L}}\p{{N}}]+'))"

    both = "coalesce(category, '') || ' ' || name"
    return rf"""
select min(row_id) as first_row_id, count(*) as n_copies from (
  select row_id, {words(both)} as pooled, {words("internal_id")} as id_words from master_sheet
  where name is not null and regexp_matches(name, '[^\s\x{{00A0}}]'))
group by pooled, id_words having count(*) >= 2"""


def _p5() -> str:
    single, multi, gone = tables()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = "name"
    for k, v in multi.items():
        if ord(k) < 0x10000 and all(ord(x) < 0x250 for x in v):
            form = f"replace({form}, {quoted(k)}, {quoted(v)})"
    form = f"nfc_normalize(translate({form}, {quoted(''.join(single) + gone)}, {quoted(''.join(single.values()))}))"
    return f"""
with n as (select distinct id, name from (select row_ord as id, name from master_row union all select assign_id, original_name from assignment) where name is not null),
f as (select id, name, {form} as form from n)
select distinct a.id as id_a, b.id as id_b from f a join f b on a.form = b.form where a.id < b.id and a.name <> b.name and trim(a.form) <> ''"""


def _p7() -> str:
    windows = lambda key, text, source: rf"""
select distinct {key}, list_slice(w, i, i + 11) as run from (
  select {key}, w, unnest(range(1, len(w) - 10)) as i from (
    select {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') as w from {source} where {text} is not null) where len(w) >= 12)"""  # noqa: E731
    return f"""
with d as ({windows("doc_id", "text", "documents")}), e as ({windows("item_id", "item_text", "eval_item")})
select distinct d.doc_id, e.item_id from d join e on d.run = e.run"""


ORACLE: dict[str, str] = {"p1_found": _p1(), "p1_votes": _p1_votes(), "p3_found": _p3(), "p5_found": _p5(), "p6_decode": "select doc_id, coalesce(text, '') as text from documents", "p7_found": _p7()}
