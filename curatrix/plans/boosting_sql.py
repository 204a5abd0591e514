"""Boosted trees as SQL for the checking engine: every level of every tree is a step."""

from __future__ import annotations

from collections.abc import Sequence

UNIT = "1e6"


def bins(expressions: Sequence[str], edges: Sequence[Sequence[float]]) -> str:
    """A list of each feature's number of edges below its value."""
    return "[" + ", ".join(f"len(list_filter([{', '.join(f'{e!r}::double' for e in own)}], lambda e: e < ({x})::double))" for x, own in zip(expressions, edges, strict=True)) + "]"


def boosting(rows: str, rounds: int, depth: int, step: float, shrink: float, least: int = 1, name: str = "b", start: str | None = None) -> list[str]:
    """CTEs over ``rows`` (id, y, b: bins, learn: boolean): ``{name}_m{r}`` (id, m: margin after r rounds) and ``{name}_trees``.

    ``start`` names a table of margins (id, m) to go on from. ``learn`` rows alone are learned from and weigh the classes."""
    more = f"{shrink}e0 * {UNIT}"
    worth = lambda g, h: f"({g})::double * ({g})::double / (({h})::double + {more})"
    value = f"cast(floor(({step}e0 * {UNIT}) * (g::double / (h::double + {more})) + 0.5e0) as bigint)"
    out = [
        f"{name}_c as (select y, count(*) as c from {rows} where learn group by y)",
        f"{name}_w as (select y, (select max(c) from {name}_c) * 1e0 / c as w from {name}_c)",
        f"{name}_m0 as (select id, {'m' if start else 'cast(0 as bigint) as m'} from {start or rows})",
    ]
    add = lambda key, sql: out.append(f"{key} as materialized ({sql})")
    trees = []
    for r in range(rounds):
        t = f"{name}_{r}"
        add(f"{t}_p", f"select x.id, x.b, x.learn, x.y, w.w, 1 / (1 + exp(-(m.m / {UNIT}))) as p from {rows} x join {name}_m{r} m on x.id = m.id left join {name}_w w on x.y = w.y")
        add(f"{t}_g", f"select id, b, cast(floor((w * (y - p)) * {UNIT} + 0.5e0) as bigint) as g, cast(floor(greatest((w * (p * (1 - p))) * {UNIT}, 1) + 0.5e0) as bigint) as h, learn from {t}_p")
        add(f"{t}_n0", f"select id, 1 as node from {t}_g")
        parts = []
        for d in range(depth + 1):
            if d < depth:
                add(f"{t}_h{d}", f"select node, f, b[f + 1] as bin, sum(g) as g, sum(h) as h, count(*) as n from (select n.node, g.*, unnest(range(len(g.b))) as f from {t}_n{d} n join {t}_g g on n.id = g.id where g.learn) x group by node, f, bin")
                run = "over (partition by node, f order by bin)"
                all_ = "over (partition by node, f)"
                add(f"{t}_l{d}", f"select node, f, bin, sum(g) {run} as lg, sum(h) {run} as lh, sum(n) {run} as ln, sum(g) {all_} as g, sum(h) {all_} as h, sum(n) {all_} as n from {t}_h{d}")
                add(f"{t}_s{d}", f"select *, row_number() over (partition by node order by gain desc, f, bin) as k from (select *, {worth('lg', 'lh')} + {worth('g - lg', 'h - lh')} - {worth('g', 'h')} as gain from {t}_l{d}) x where gain > 0 and ln >= {least} and n - ln >= {least}")
                add(f"{t}_b{d}", f"select * from {t}_s{d} where k = 1")
                add(f"{t}_n{d + 1}", f"select n.id, 2 * n.node + (g.b[s.f + 1] > s.bin)::int as node from {t}_n{d} n join {t}_b{d} s on n.node = s.node join {t}_g g on n.id = g.id")
                parts.append(f"select node, f, bin, cast(null as bigint) as value from {t}_b{d}")
                kept = f"n.node not in (select node from {t}_b{d})"
            else:
                kept = "true"
            add(f"{t}_v{d}", f"select n.node, {value} as value from (select n.node, sum(g) as g, sum(h) as h from {t}_n{d} n join {t}_g g on n.id = g.id where g.learn and {kept} group by n.node) n")
            parts.append(f"select node, cast(null as int) as f, cast(null as int) as bin, value from {t}_v{d}")
        ends = " union all ".join(f"select n.id, v.value from {t}_n{d} n join {t}_v{d} v on n.node = v.node" for d in range(depth + 1))
        add(f"{name}_m{r + 1}", f"select m.id, m.m + coalesce(e.value, 0) as m from {name}_m{r} m left join ({ends}) e on m.id = e.id")
        trees.append(f"select {r} as tree, cast(node as int) as node, cast(f as int) as feature, cast(bin as int) as cut, value from ({' union all '.join(parts)}) x")
    add(f"{name}_trees", " union all ".join(trees))
    return out
