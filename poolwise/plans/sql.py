"""Building blocks for the plain-SQL statements that the queries are checked against.

The SQL side uses none of the library's ideas: it writes every partition down,
pairs it with every cell of its profile, groups by pool and sums.
"""

from __future__ import annotations

from poolwise.spec import FactorSpec

DISC = "case when l_discount <= 0.025 then 1 when l_discount <= 0.05 then 2 when l_discount <= 0.075 then 3 else 4 end"
TAX = "case when l_tax <= 0.025 then 1 when l_tax <= 0.05 then 2 else 3 end"
QTY = "cast(ceil(l_quantity / 10) as int)"
FLAG = "case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then 3 end"
DISC0 = "case when l_discount <= 0.0 then 0 when l_discount <= 0.035 then 1 when l_discount <= 0.075 then 2 else 3 end"
OUTCOME = "l_quantity * (1 - l_discount) * (1 + l_tax) / 50"
STATUS = "case l_linestatus when 'F' then 0 when 'O' then 1 end"

PTYPE = "case p_type " + " ".join(f"when '{t}' then {i + 1}" for i, t in enumerate(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])) + " end"

OBS = {
    "single": f"select {QTY} qty, {DISC} disc, {TAX} tax, {FLAG} flag, {OUTCOME} y from lineitem",
    "multi": f"""select case when l_quantity <= 5 then 0 else {QTY} end qty, {DISC0} disc,
        case when l_tax <= 0.0 then 0 when l_tax <= 0.045 then 1 else 2 end tax, {OUTCOME} y from lineitem""",
    "treat": f"select {STATUS} status, {DISC} disc, {TAX} tax, {OUTCOME} y from lineitem",
    "treat2": f"""select {STATUS} status, case when l_returnflag = 'R' then 1 else 0 end returned, {DISC0} disc,
        {OUTCOME} y from lineitem""",
    "slopes": f"""select {DISC} disc, {TAX} tax, {FLAG} flag, l_quantity / 10 x, l_extendedprice / 10000 y from lineitem""",
    "orders": """select cast(substr(o_orderpriority, 1, 1) as int) priority,
        case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 3 end ostatus,
        cast(quarter(o_orderdate) as int) quartile, c_mktsegment segment, o_totalprice / 100000 y
        from orders join customer on o_custkey = c_custkey""",
    "wide": f"""select {QTY} qty, {DISC} disc, {TAX} tax, {FLAG} flag, cast(ceil(p_size / 10) as int) size, {PTYPE} ptype, {OUTCOME} y
        from lineitem join part on p_partkey = l_partkey""",
    "eight": f"""select case when l_quantity <= 16 then 1 when l_quantity <= 33 then 2 else 3 end qty, case when l_discount <= 0.035 then 1 when l_discount <= 0.065 then 2 else 3 end disc,
        {TAX} tax, {FLAG} flag, case when l_linenumber <= 2 then 1 when l_linenumber <= 5 then 2 else 3 end line, case when month(l_shipdate) <= 4 then 1 when month(l_shipdate) <= 8 then 2 else 3 end season,
        case when p_size <= 17 then 1 when p_size <= 34 then 2 else 3 end size, cast(ceil({PTYPE} / 2) as int) ptype, {OUTCOME} y from lineitem join part on p_partkey = l_partkey""",
    "events": """select case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4
        when 'view' then 5 end etype, cast(floor(hour(ts) / 6) + 1 as int) daypart, value, sqrt(value) root_value,
        cast(length(props) as double) props_size from events""",
}


def policy(spec: FactorSpec, names=None) -> str:
    return " + ".join(f"{n} * {s}" for n, s in zip(names or spec.names, spec.strides))


def profile(spec: FactorSpec, names=None) -> str:
    return " + ".join(f"(case when {n} > 0 then {1 << (spec.m - 1 - i)} else 0 end)" for i, n in enumerate(names or spec.names))


def decode(spec: FactorSpec, pid: str = "policy_id") -> str:
    return ", ".join(f"cast(({pid} // {s}) % {r} as int) {n}" for n, s, r in zip(spec.names, spec.strides, spec.levels))


def cells(spec: FactorSpec, obs: str, by: str = "", y: str = "y") -> str:
    """CTEs obs and cells."""
    lead = f"{by}, " if by else ""
    dims = ", ".join(spec.names)
    return f"""obs as ({OBS.get(obs, obs)}),
    cells as (select {lead}{dims}, cast({policy(spec)} as bigint) policy_id, cast({profile(spec)} as int) profile_id,
        count(*) n, sum({y}) sum_y, avg({y}) mean_y, var_pop({y}) * count(*) ssw from obs where {y} is not null group by {lead}{dims})"""


def masks(spec: FactorSpec, profile_id: int | None = None) -> str:
    """CTE parts(profile_id, cut_mask, h): the whole space of one profile, or of all."""
    out = []
    for p in ([profile_id] if profile_id is not None else range(spec.n_profiles)):
        act = [i for i in spec.active_factors(p) if spec.bits[i] > 0]
        frm = ", ".join(f"range({1 << spec.bits[i]}) t{i}(b{i})" for i in act)
        mask = " + ".join(f"(b{i} << {spec.offsets[i]})" for i in act) or "0"
        h = " * ".join(f"(1 + cast(bit_count(b{i}) as bigint))" for i in act) or "1"
        out.append(f"select {p} profile_id, cast({mask} as bigint) cut_mask, cast({h} as bigint) h" + (f" from {frm}" if frm else ""))
    return "parts as (" + " union all ".join(out) + ")"


def segment(spec: FactorSpec, i: int, level: str, mask: str = "cut_mask") -> str:
    return (f"(case when {level} > 0 then cast(bit_count(({mask} >> {spec.offsets[i]}) & {spec.full_mask(i)} & "
            f"((1 << greatest({level} - 1, 0)) - 1)) as bigint) else 0 end)")


def pool(spec: FactorSpec, alias: str = "c", mask: str = "cut_mask") -> str:
    return "cast(" + " + ".join(f"{segment(spec, i, f'{alias}.{n}', mask)} * {s}"
                                for i, (n, s) in enumerate(zip(spec.names, spec.strides))) + " as bigint)"


def pools(spec: FactorSpec, parts: str = "parts", by: str = "") -> str:
    """CTE pooled(profile_id, cut_mask, h, pool_id, n, sum_y, mean_y, sse)."""
    lead = f"c.{by}, " if by else ""
    g = f"{by}, " if by else ""
    return f"""assigned as (select {lead}p.profile_id, p.cut_mask, p.h, {pool(spec, mask='p.cut_mask')} pool_id, c.policy_id, c.n, c.sum_y, c.mean_y, c.ssw
        from {parts} p join cells c on p.profile_id = c.profile_id),
    pooled as (select {g}profile_id, cut_mask, h, pool_id, cast(sum(n) as bigint) n, sum(sum_y) sum_y, sum(sum_y) / sum(n) mean_y,
        greatest(sum(n * mean_y * mean_y) - sum(sum_y) * sum(sum_y) / sum(n), 0) + sum(ssw) sse from assigned group by {g}profile_id, cut_mask, h, pool_id)"""


def scores(spec: FactorSpec, obs: str, reg: float, profile_id: int | None = None, by: str = "", y: str = "y", total_by_group: bool = True) -> str:
    """All CTEs up to scored(profile_id, cut_mask, h, sse, q)."""
    g = f"{by}, " if by else ""
    total = f"(select sum(n) from cells k where k.{by} = pooled.{by})" if by and total_by_group else "(select sum(n) from cells)"
    return f"""{cells(spec, obs, by, y)}, {masks(spec, profile_id)}, {pools(spec, by=by)},
    scored as (select {g}profile_id, cut_mask, h, sum(sse) sse, sum(sse) / any_value({total}) + {reg!r} * h q
        from pooled group by {g}profile_id, cut_mask, h)"""


def wide_scores(spec: FactorSpec, obs: str, reg: float) -> str:
    """CTEs up to scored(cut_mask, h, q) of the full profile, for spaces too large to pair partitions with cells.

    Sums over all interval products of the cells first, then over the segments of each factor's cuts, one factor at a time.
    """
    parts = [cells(spec, obs), """around as (select policy_id rest, cast(0 as bigint) box, n, n * (mean_y - (select sum(sum_y) / sum(n) from cells)) s,
        n * pow(mean_y - (select sum(sum_y) / sum(n) from cells), 2) ss, ssw from cells where profile_id = """ + f"{spec.full_profile})"]
    last = "around"
    for i, r in enumerate(spec.levels):
        w, b = spec.strides[i], spec.box_strides[i]
        parts.append(f"""box{i} as (select box + (lo * {r} + hi) * {b} box, rest % {w} rest, sum(n) n, sum(s) s, sum(ss) ss, sum(ssw) ssw from {last}
            join (select l, lo, hi from range(1, {r}) x(l), range(1, {r}) y(lo), range(1, {r}) z(hi) where lo <= l and l <= hi) on l = rest // {w} group by 1, 2)""")
        last = f"box{i}"
    parts.append(f"errors as (select box, cast(0 as bigint) cut_mask, greatest(ss - s * s / n, 0) + ssw sse from {last})")
    last = "errors"
    for i, r in enumerate(spec.levels):
        b = spec.box_strides[i]
        parts.append(f"""cut{i} as (select box % {b} box, cut_mask + (m << {spec.offsets[i]}) cut_mask, sum(sse) sse from {last}
            join (select lo * {r} + hi code, m from range(1, {r}) y(lo), range(1, {r}) z(hi), range({1 << spec.bits[i]}) t(m) where lo <= hi and (lo = 1 or (m >> greatest(lo - 2, 0)) & 1 = 1)
                and (hi = {r - 1} or (m >> (hi - 1)) & 1 = 1) and (m >> (lo - 1)) & ((1 << (hi - lo)) - 1) = 0) on code = box // {b} group by 1, 2)""")
        last = f"cut{i}"
    h = " * ".join(f"(1 + cast(bit_count((cut_mask >> {spec.offsets[i]}) & {spec.full_mask(i)}) as bigint))" for i in range(spec.m))
    return ", ".join(parts) + f", scored as (select cut_mask, {h} h, sse / (select sum(n) from cells) + {reg!r} * {h} q from {last})"


def models(spec: FactorSpec, obs: str, reg: float, theta: float, max_pools: int | None = None) -> str:
    """CTEs up to models(model_key, loss, n_pools) over the observed profiles, by one join per profile."""
    sql = scores(spec, obs, reg)
    steps, prev = [], None
    for p in range(spec.n_profiles):
        cur = f"m{p}"
        seen = f"exists (select 1 from cells where profile_id = {p})"
        part = f"(select cut_mask, q, h from scored where profile_id = {p} union all select null, 0.0, 0 where not {seen})"
        rest = f"(select coalesce(sum(mq), 0) from (select min(q) mq from scored where profile_id > {p} group by profile_id))"
        token = f"case when s.cut_mask is null then '' else '{p}:' || s.cut_mask end"
        if prev is None:
            steps.append(f"{cur} as (select {token} k, s.q q, s.h h from {part} s where s.q + {rest} <= {theta!r} + 1e-12)")
        else:
            steps.append(f"""{cur} as (select case when k = '' then {token} when s.cut_mask is null then k else k || '|' || {token} end k,
                m.q + s.q q, m.h + s.h h from {prev} m join {part} s on m.q + s.q + {rest} <= {theta!r} + 1e-12)""")
        prev = cur
    budget = "" if max_pools is None else f" and h <= {max_pools}"
    return sql + ", " + ", ".join(steps) + f", models as (select k model_key, q loss, cast(h as bigint) n_pools from {prev} where q <= {theta!r}{budget})"
