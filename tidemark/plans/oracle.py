"""Common table expressions for DuckDB that say what the adapter says: cat, emp and ev."""

from __future__ import annotations

from ..functions.catalog import BANDS, CATEGORIES, SIGNALS

_CAT = ", ".join(f"({i}, '{s}', '{c}', {CATEGORIES.index(c)}, {w!r}::double, {h!r}::double, '{src}')" for i, (s, c, w, h, src) in enumerate(SIGNALS))
BAND = "case " + " ".join(f"when score >= {lo} then '{b}'" for b, lo in BANDS[:-1]) + " else 'low' end"
BANDS_TABLE = ", ".join(f"({i}, '{b}')" for i, (b, _) in enumerate(BANDS))

UUID5 = """(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::int + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
    from (select sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode({name})) as h))"""

BASE = f"""
cat(ordinal, signal, category, category_ordinal, weight, half_life_days, source) as (values {_CAT}),
emp as (
    select c_custkey::varchar as employee_id, 'acme' as tenant_id, c_mktsegment as department,
           case when c_custkey % 10 = 0 then 'director' when c_custkey % 3 = 0 then 'senior' else 'mid' end as seniority, (c_custkey % 2000)::int as tenure_days, n_name as location,
           c_nationkey < 3 as has_admin_access, c_mktsegment = 'FURNITURE' as handles_financial_data, c_custkey % 50 = 0 as is_executive,
           case when c_custkey % 97 = 0 then 'shared@acme.example' else lower(replace(c_name, '#', '')) || '@acme.example' end as email,
           case when c_custkey % 1000 = 999 then 'x' || c_custkey when c_custkey >= 10 then (c_custkey // 10)::varchar end as manager_id,
           (c_nationkey < 3 or c_mktsegment = 'FURNITURE' or c_custkey % 50 = 0) as hv
    from customer left join nation on c_nationkey = n_nationkey),
ev as (
    select e.event_id as seq, (user_id * 10 + k % 10)::varchar as employee_id, signal, category, category_ordinal, ordinal, weight, half_life_days, source, ts as occurred_at, epoch_us(ts) as at_us, k,
           epoch_us(ts) + 1000000 * (case when e.event_id % 25 = 0 then 300 + e.event_id * 37 % 14100 else 1 + e.event_id % 44 end) as in_us, source || '-' || e.event_id as source_event_id
    from (select *, regexp_extract(props, '[0-9]+')::int as k from events) e join cat on e.event_id % {len(SIGNALS)} = cat.ordinal),
term as (
    select ev.*, weight * case when age <= 0 then 1.0 else pow(0.5, age / half_life_days) end as plain
    from (select *, (epoch_us(timestamp '2024-01-31') - at_us) / 86400000000.0 as age from ev) ev where age <= 30),
priced as (select t.*, case when plain > 0 and hv then plain * 1.4 else plain end as c from term t join emp using (employee_id)),
scores as (
    select employee_id, department, tenure_days, raw, n as events_considered, score, {BAND} as band from (
        select emp.employee_id, any_value(department) as department, any_value(tenure_days) as tenure_days, coalesce(sum(c), 0.0) as raw, count(c) as n,
               round(case when coalesce(sum(c), 0.0) <= 0 then 0.0 else (1.0 - exp(-sum(c) / 30.0)) * 100.0 end, 2) as score
        from emp left join priced using (employee_id) group by emp.employee_id)),
factor as (
    select employee_id, signal, category, category_ordinal, count(*) as occurrences, sum(c) as raw, round(sum(c), 3) as contribution, max(at_us) as most_recent_us
    from priced group by all),
bycat as (select employee_id, category, category_ordinal, sum(raw) as raw, round(sum(raw), 3) as value from factor group by all having sum(raw) <> 0)
"""


def sql(select: str, more: str = "") -> str:
    """A whole query: the base, further expressions, and the select."""
    return f"with {BASE}{', ' + more if more else ''}\n{select}"
