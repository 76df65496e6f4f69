"""SQL for regressions: coefficients from residuals, by orthogonalising one column after another with window sums."""

from __future__ import annotations

import math


def orthogonal(source: str, columns: list[str], group: str | None, prefix: str) -> dict[str, str]:
    """Tables up to ``<prefix>``: ``source`` with each of ``columns`` less its projection on the columns before it, in each group."""
    over = f"over (partition by {group})" if group else "over ()"
    out, last = {}, source
    for i, c in enumerate(columns[:-1]):
        name = prefix if i == len(columns) - 2 else f"{prefix}_{i}"
        rest = ", ".join(f"{u} - coalesce(sum({u} * {c}) {over} / nullif(sum({c} * {c}) {over}, 0), 0) * {c} as {u}" for u in columns[i + 1 :])
        out[name] = f"select * replace ({rest}) from {last}"
        last = name
    return out


def residuals(source: str, keys: list[str], x: list[str], y: str, group: str | None, prefix: str) -> dict[str, str]:
    """Table ``<prefix>``: keys, ``y``, its residual ``e`` on ``x``, and for each of ``x`` its residual ``r_<x>`` on the others."""
    out = orthogonal(source, [*x, y], group, f"{prefix}_e")
    parts, joins = [f"a.{k}" for k in keys] + [f"s.{y}", f"a.{y} as e"], ""
    for c in x:
        out |= orthogonal(source, [*(u for u in x if u != c), c], group, f"{prefix}_{c}")
        parts.append(f"t_{c}.{c} as r_{c}")
        joins += f" join {prefix}_{c} t_{c} using ({', '.join(keys)})"
    out[prefix] = f"select {', '.join(parts)} from {prefix}_e a join {source} s using ({', '.join(keys)}){joins}"
    return out


def slope(c: str, y: str) -> str:
    return f"sum(r_{c} * {y}) / sum(r_{c} * r_{c})"


def alphas(source: str, by: str, order: str, x: list[str], y: str, prefix: str, lags: int = 6, least: int = 24) -> dict[str, str]:
    """Table ``<prefix>``: alpha, its Newey-West t, r2, n, idio_var and betas of y on x for each ``by``; ``source`` has a column ``one``."""
    out = residuals(source, [by, order], ["one", *x], y, by, f"{prefix}_r")
    k = len(x) + 1
    lagged = ", ".join(f"lag(r_one * e, {j}) over (partition by {by} order by {order}) as l{j}" for j in range(1, lags + 1))
    out[f"{prefix}_s"] = f"select *, r_one * e as s, {lagged} from {prefix}_r"
    meat = "sum(s * s) + " + " + ".join(f"case when {j} <= count(*) - 1 then 2 * {1 - j / (lags + 1)!r}::double * coalesce(sum(s * l{j}), 0) else 0 end" for j in range(1, lags + 1))
    betas = ", ".join(f"{slope(c, y)} as b_{c}" for c in x)
    out[prefix] = f"select {by}, {slope('one', y)} as alpha, {slope('one', y)} * sum(r_one * r_one) / sqrt({meat}) as alpha_t, 1 - sum(e * e) / (var_pop({y}) * count(*)) as r2, count(*) as n, sum(e * e) / (count(*) - {k}) as idio_var, {betas} from {prefix}_s group by {by} having count(*) >= {least}"
    return out


def normal_p(t: str, steps: int = 2000) -> str:
    """Two-sided normal tail of ``t``: erfc(abs(t) / sqrt 2) by Simpson's rule."""
    x = f"(least(abs({t}), 12) / {steps})"
    weight = f"case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(1 - {math.sqrt(2 / math.pi)!r}::double * {x} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * exp(-(i * {x}) * (i * {x}) / 2))))"


def fixed_effects(source: str, y: str, x: list[str], effect: list[str], cluster: str, prefix: str) -> dict[str, str]:
    """Table ``<prefix>``: rows with the demeaned columns, residual ``e``, residuals ``r_<x>``, clusters, groups and n; ``source`` has a column ``row_id``."""
    w = f"over (partition by {', '.join(effect)})"
    within = ", ".join(f"{c} - avg({c}) {w} as {c}" for c in [y, *x])
    out = {f"{prefix}_d": f"select * replace ({within}) from {source}"}
    out |= residuals(f"{prefix}_d", ["row_id"], x, y, None, f"{prefix}_r")
    out[prefix] = f"select r.*, d.{cluster} as cluster, {' || chr(1) || '.join(f'cast(d.{c} as varchar)' for c in effect)} as grp from {prefix}_r r join {prefix}_d d using (row_id)"
    return out


def clustered(prefix: str, y: str, x: list[str], name: str) -> str:
    """``outcome, var, coef, t, p, n`` from the rows of :func:`fixed_effects`."""
    parts = []
    for c in x:
        parts.append(f"""select '{name}' as outcome, '{c}' as var, {slope(c, y)} as coef, sum(r_{c} * r_{c}) as ss, count(*) as n, count(distinct cluster) as g, count(distinct grp) as k, (select sum(s * s) from (select cluster, sum(r_{c} * e) as s from {prefix} group by cluster)) as meat from {prefix}""")
    rows = " union all ".join(parts)
    t = f"coef / (sqrt(g / (g - 1)::double * (n - 1) / (n - ({len(x)} + k))::double * meat) / ss)"
    return f"select outcome, var, round(coef, 6) + 0.0::double as coef, round(t, 6) + 0.0::double as t, round({normal_p('t')}, 6) + 0.0::double as p, n from (select *, {t} as t from ({rows}))"
