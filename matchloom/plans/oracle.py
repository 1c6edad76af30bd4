"""Pieces of DuckDB SQL from which the queries' counterparts are put together."""

from __future__ import annotations

from ..functions.text import LEGAL, STOP


def norm(x: str) -> str:
    inner = f"replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '&', ' and ')"
    return rf"trim(regexp_replace(regexp_replace({inner}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def quoted(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tokens(x: str) -> str:
    return f"[t for t in string_split({x}, ' ') if t <> '']"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def meaningful(x: str) -> str:
    return f"[t for t in {token_set(x)} if not list_contains({quoted(LEGAL)}, t)]"


def bare(x: str) -> str:
    return f"array_to_string([t for t in {tokens(x)} if not list_contains({quoted(LEGAL)}, t)], ' ')"


def numbers(x: str) -> str:
    return f"[regexp_replace(n, '^0+([0-9])', '\\1') for n in regexp_extract_all({x}, '[0-9]+')]"


def address_tokens(x: str, stop: tuple[str, ...] = STOP, least: int = 2) -> str:
    return f"[t for t in {token_set(x)} if not list_contains({quoted(stop)}, t) and not regexp_matches(t, '^[0-9]+$') and length(t) >= {least}]"


def ngrams(x: str, n: int = 3) -> str:
    joined = f"replace({x}, ' ', '')"
    return f"case when {joined} = '' then [] else list_distinct([substring({joined}, i, {n}) for i in range(1, greatest(length({joined}) - {n - 1}, 1) + 1)]) end"


def grams(x: str, low: int, high: int) -> str:
    """Rows of the grams of ``x``, for use as a column."""
    p = "(' ' || t || ' ')"
    parts = []
    for n in range(low, high + 1):
        end = f"greatest(length({p}) - {n - 1}, 1) + 1" if n == low else f"greatest(length({p}) - {n - 2}, 1)"
        parts.append(f"[substring({p}, i, {n}) for i in range(1, {end})]")
    return f"flatten([{' || '.join(parts)} for t in {tokens(x)}])"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    every = f"len(list_distinct({a} || {b}))"
    return f"case when {every} = 0 then 0.0 else {overlap(a, b)}::double / {every} end"


def fraction(x: str) -> str:
    return f"cast('0x' || substring(md5('42:' || {x}), 1, 16) as ubigint)::double / 18446744073709551616.0"


PLACES = "places as (select n_nationkey, replace(n_name, '_', ' ') place, r_name country from nation join region on n_regionkey = r_regionkey)"
SOURCES = f"""{PLACES},
customers as (select 'S1-' || c_custkey entity_id, c_name business_name, cast(floor(c_acctbal) as bigint) || ' ' || place || ' ' || c_mktsegment business_address, country
  from customer join places on c_nationkey = n_nationkey),
suppliers as (select 'S2-' || s_suppkey entity_id, s_name business_name, cast(floor(s_acctbal) as bigint) || ' ' || place business_address, country
  from supplier join places on s_nationkey = n_nationkey)"""
SIDES = f"""{SOURCES},
s1 as materialized (select entity_id id, country, {norm("business_name")} name, {norm("business_address")} address from customers),
s2 as materialized (select entity_id id, country, {norm("business_name")} name, {norm("business_address")} address from suppliers)"""
TRUTH = """truth as materialized (select distinct 'S1-' || c_custkey q_id, 'S2-' || s_suppkey c_id from customer join supplier
  on (c_custkey = s_suppkey or c_nationkey = s_nationkey) join places p on c_nationkey = p.n_nationkey join places r on s_nationkey = r.n_nationkey
  where (c_custkey = s_suppkey and p.country = r.country) or (c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) < 25))"""
LISTS = f"""lists as (select c.entity_id source1_entity_id, coalesce(string_agg(c_id, ',' order by c_id), '') matched_entity_ids
  from customers c left join truth on q_id = c.entity_id group by 1)"""


def weights(name: str, rows: str, column: str, low: int, high: int) -> str:
    """CTEs ``name`` with id, country, gram, w."""
    return f"""{name}_n as (select id, country, unnest({grams(column, low, high)}) gram from {rows}),
{name}_c as (select id, country, gram, count(*) n from {name}_n group by all),
{name} as materialized (select id, country, gram, n / sqrt(sum(n * n) over (partition by id)) w from {name}_c)"""


def cosine(name: str, q: str, c: str) -> str:
    return f"""{name} as materialized (select q.id q_id, c.id c_id, round(sum(q.w * c.w), 6) score from {q} q join {c} c on q.country = c.country and q.gram = c.gram
  group by all having round(sum(q.w * c.w), 6) > 0)"""


def ranked(name: str, scored: str, k: int, columns: str = "q_id, c_id, score") -> str:
    return f"{name} as materialized (select {columns}, row_number() over (partition by q_id order by score desc, c_id) rank from {scored} qualify rank <= {k})"


def keys(name: str, rows: str, kind: str) -> str:
    """CTE with id, country, key: routing keys."""
    if kind == "name":
        listed = f"[case when c <> '' then 'p:' || substring(c, 1, 2) end for c in [regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g') for t in {meaningful('name')}]]"
    else:
        kept = f"[t for t in {token_set('address')} if not list_contains({quoted(STOP)}, t)]"
        clean = "regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')"
        listed = f"[case when regexp_matches(t, '^[0-9]+$') then 'n:' || regexp_replace(t, '^0+([0-9])', '\\1') when {clean} <> '' then 'p:' || substring({clean}, 1, 2) end for t in {kept}]"
    return f"{name} as materialized (select distinct id, country, key from (select id, country, unnest({listed}) key from {rows}) where key is not null)"


def routed(name: str, kind: str, low: int, high: int, k: int = 20) -> str:
    """CTEs up to ``name``: routed cosine top-k of s1 among s2."""
    return f"""{keys(f"{name}_qk", "s1", kind)}, {keys(f"{name}_ck", "s2", kind)},
{name}_df as (select country, key, count(distinct id) df from {name}_ck group by all),
{name}_rare as (select q.id, q.country, q.key, df, row_number() over (partition by id order by df, q.key) nth from {name}_qk q join {name}_df d on q.country = d.country and q.key = d.key qualify nth <= 3),
{name}_pairs as materialized (select distinct r.id q_id, c.id c_id from {name}_rare r join {name}_ck c on r.country = c.country and r.key = c.key),
{weights(f"{name}_qw", "s1", kind, low, high)}, {weights(f"{name}_cw", "s2", kind, low, high)},
{name}_all as materialized (select q_id, c_id, round(sum(q.w * c.w), 6) score from {name}_pairs join {name}_qw q on q.id = q_id join {name}_cw c on c.id = c_id and c.gram = q.gram
  group by all having round(sum(q.w * c.w), 6) > 0),
{ranked(name, f"{name}_all", k)}"""


def postings(name: str, rows: str, stop: tuple[str, ...] = STOP, least: int = 2) -> str:
    return f"""{name} as materialized (select id, country, 'token' kind, unnest({address_tokens("address", stop, least)}) as "key" from {rows}
  union all select id, country, 'number', unnest(list_distinct({numbers("address")})) from {rows})"""


def structured(name: str, k: int, form: str = "all", token_df: int = 500, number_df: int = 1000, stop: tuple[str, ...] = STOP, least: int = 2) -> str:
    counted, sized = (f"{name}_q", "s1") if form == "queries" else (f"{name}_c", "s2")
    rare = "true" if form == "plain" else f"df <= (case when kind = 'token' then {token_df} else {number_df} end)"
    idf = {
        "all": "case when rare then ln((total + 1) / (df + 1)) + 1 else 1 end",
        "selective": "case when rare then ln(1 + total / df) else 0 end",
        "plain": "1",
        "queries": "case when rare then ln((total + 1) / (df + 1)) + 1 else 0 end",
    }[form]
    bonus = (
        "case when t > 0 and n > 0 then 4 else 0 end + case when n > 1 then 2 * (n - 1) else 0 end + case when t > 1 then t - 1 else 0 end"
        if form == "queries"
        else "case when t > 0 and n > 0 then 2 else 0 end + case when n > 1 then 2 else 0 end + case when t > 1 then 1 else 0 end"
    )
    return f"""{postings(f"{name}_q", "s1", stop, least)}, {postings(f"{name}_c", "s2", stop, least)},
{name}_df as (select country, kind, "key", count(distinct id) df, {rare} rare from {counted} group by country, kind, "key"),
{name}_w as (select d.country, kind, "key", rare, ({idf}) * case when kind = 'number' then 2.5 else 1.0 end w from {name}_df d join (select country, count(*)::double total from {sized} group by country) z on z.country = d.country),
{name}_s as materialized (select q.id q_id, c.id c_id, q.kind, w, rare from {name}_q q join {name}_c c on q.country = c.country and q.kind = c.kind and q."key" = c."key"
  join {name}_w w on w.country = q.country and w.kind = q.kind and w."key" = q."key"),
{name}_t as (select q_id, c_id, sum(w) weight, count(*) filter (kind = 'token') t, count(*) filter (kind = 'number') n from {name}_s group by all having bool_or(rare)),
{name}_a as (select q_id, c_id, round((weight + {bonus})::double, 6) score, t tokens, n numbers from {name}_t),
{ranked(name, f"{name}_a", k, "q_id, c_id, score, tokens, numbers")}"""


def lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence of two strings of up to 120 characters: the rows as bits of one number."""
    full = f"((1::hugeint << length({x})) - 1)"
    bits = f"[list_sum([case when substring({x}, i, 1) = ch then 1::hugeint << (i - 1) else 0::hugeint end for i in range(1, length({x}) + 1)])::hugeint for ch in string_split({y}, '')]"
    row = f"list_reduce(list_prepend({full}, {bits}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"case when {x} = {y} then length({x}) when {x} = '' or {y} = '' then 0 else length({x}) - bit_count({row}) end"


def ratios(name: str, pairs: str) -> str:
    """CTEs up to ``name``: a, b and their three ratios as shares of 1, for the distinct pairs (a, b) that ``pairs`` selects."""
    sort = lambda t: f"array_to_string(list_sort({t}), ' ')"
    share = lambda common, total: f"case when {total} = 0 then 1.0 else 200.0 * {common} / ({total}) / 100 end"
    rest = lambda one, other: sort(f"[t for t in {one} if not list_contains({other}, t)]")
    set_ = f"""case when len(xa) = 0 or len(xb) = 0 then 0.0 when both_ <> '' and (oa = '' or ob = '') then 1.0 else greatest({share("(l3.l + lead)", "(2 * lead + length(oa) + length(ob))")},
  case when both_ <> '' then {share("length(both_)", "(length(both_) + lead + length(oa))")} else 0.0 end, case when both_ <> '' then {share("length(both_)", "(length(both_) + lead + length(ob))")} else 0.0 end) end"""
    return f"""{name}_p as materialized (select distinct a, b from ({pairs})),
{name}_t as materialized (select *, {sort(tokens("a"))} sa, {sort(tokens("b"))} sb, {token_set("a")} xa, {token_set("b")} xb from {name}_p),
{name}_o as materialized (select *, {sort("list_intersect(xa, xb)")} both_, {rest("xa", "xb")} oa, {rest("xb", "xa")} ob from {name}_t),
{name}_l as materialized (select x, y, {lcs("x", "y")} l from (select a x, b y from {name}_o union select sa, sb from {name}_o union select oa, ob from {name}_o)),
{name} as materialized (select a, b, {share("l1.l", "(length(a) + length(b))")} ratio, {share("l2.l", "(length(sa) + length(sb))")} sort, {set_} "set"
  from (select *, length(both_) + (both_ <> '')::int lead from {name}_o) join {name}_l l1 on l1.x = a and l1.y = b join {name}_l l2 on l2.x = sa and l2.y = sb join {name}_l l3 on l3.x = oa and l3.y = ob)"""


def reranked(name: str, pool: str, k: int, form: str) -> str:
    """CTEs up to ``name``: the pool ordered anew by its score and by names in ASCII, which are spelled as they are."""
    own = "(partition by q_id)"
    level = f"score / max(score) over {own}"
    if form == "range":
        level = f"case when max(score) over {own} = min(score) over {own} then 1.0 else (score - min(score) over {own}) / (max(score) over {own} - min(score) over {own}) end"
    names = "0.35 * ratio + 0.15 * ratio" if form == "max" else """0.5 * case when n.a = '' or n.b = '' then 0.0 else greatest(ratio, sort, "set") end"""
    return f"""{name}_n as materialized (select p.q_id, p.c_id, {level} as level, s1.name a, s2.name b from {pool} p join s1 on s1.id = q_id join s2 on s2.id = c_id),
{ratios(f"{name}_r", f"select a, b from {name}_n")},
{name}_s as materialized (select q_id, c_id, round((0.5 * level + {names})::double, 6) score from {name}_n n join {name}_r r on r.a = n.a and r.b = n.b),
{ranked(name, f"{name}_s", k)}"""
