"""SQL pieces shared by the oracles: the derived grids, resampling and smoothing written out for DuckDB."""

from __future__ import annotations

GRIDS = """
scene as (select cast(ts as date) d, event_type scene, cast(user_id // 15 as int) r, cast(user_id % 15 as int) c,
                 cast(215.0 + 0.3 * max(value) as double) v from events group by all),
pmw as (select d, r, c, max(v) lst from scene where scene in ('click', 'view', 'error') group by all),
virr as (select d, r, c, max(v) lst from scene where scene in ('purchase', 'signup') group by all),
static as (select cast(p_partkey // 15 as int) r, cast(p_partkey % 15 as int) c, cast((p_size - 5) / 50.0 as double) ndvi,
                  cast((p_retailprice - 900) * 50 as double) dem, case when p_partkey % 10 = 0 then 0 else 1 end roi from part),
era5 as (select cast(g.d as date) d, cast(u // 15 as int) r, cast(u % 15 as int) c,
                cast(250.0 + ((u // 15) * 7 + (u % 15) * 3 + day(g.d) * 5) % 60 as double) t
         from generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day) g(d), (select distinct user_id u from events)),
spine as (select cast(g.d as date) d from generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day) g(d))
"""


def with_grids(body: str, more: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{GRIDS}{', ' + more if more else ''} {body}"


#: kernel: (first tap, last tap, weight of the distance x)
WEIGHTS = {
    "bilinear": (0, 1, "greatest(1 - abs({0}), 0)"),
    "cubic": (-1, 2, "case when abs({0}) <= 1 then 1.25 * pow(abs({0}), 3) - 2.25 * pow(abs({0}), 2) + 1 when abs({0}) < 2 then -0.75 * pow(abs({0}), 3) + 3.75 * pow(abs({0}), 2) - 6 * abs({0}) + 3 else 0 end"),
    "bspline": (-1, 2, "case when abs({0}) < 1 then (4 - 6 * pow({0}, 2) + 3 * pow(abs({0}), 3)) / 6 when abs({0}) < 2 then pow(2 - abs({0}), 3) / 6 else 0 end"),
}


def resized(source: str, value: str, cells: str, low_r: str, low_c: str, high_r: str, high_c: str, method: str) -> str:
    """Query for (d, r, c, value) at the cells of a relation."""
    if method == "nearest":
        return f"""select s.d, f.r, f.c, s.{value} from {cells} f join {source} s
                   on s.r = cast(floor(f.r * ({low_r}) / ({high_r})) as int) and s.c = cast(floor(f.c * ({low_c}) / ({high_c})) as int)"""
    first, last, weight = WEIGHTS[method]
    y, x = f"((f.r + 0.5) * ({low_r}) / ({high_r}) - 0.5)", f"((f.c + 0.5) * ({low_c}) / ({high_c}) - 0.5)"
    return f"""
      select s.d, f.r, f.c, sum({weight.format(f'({y} - floor({y}) - i.k)')} * {weight.format(f'({x} - floor({x}) - j.k)')} * s.{value}) as {value}
      from {cells} f, generate_series({first}, {last}) i(k), generate_series({first}, {last}) j(k), {source} s
      where s.r = least(greatest(cast(floor({y}) as int) + i.k, 0), ({low_r}) - 1) and s.c = least(greatest(cast(floor({x}) as int) + j.k, 0), ({low_c}) - 1)
      group by s.d, f.r, f.c"""


def smoothing(source: str, steps: list[list[float]]) -> tuple[str, str]:
    """CTEs over (r, c, i, d, v) that filter with each list of weights in turn; the name of the last."""
    text, name = "", source
    for n, weights in enumerate(steps):
        half = len(weights) // 2
        values = ", ".join(f"({k - half}, cast({w!r} as double))" for k, w in enumerate(weights))
        text += f""", sm{n} as (select a.r, a.c, a.i, a.d, sum(w.w * b.v) v from {name} a, (values {values}) w(k, w), {name} b,
                   (select r, c, max(i) m from {name} group by r, c) z
                   where z.r = a.r and z.c = a.c and b.r = a.r and b.c = a.c and b.i = least(greatest(a.i + w.k, 1), z.m) group by a.r, a.c, a.i, a.d)"""
        name = f"sm{n}"
    return text.lstrip(", "), name
