"""The queries as SQL for DuckDB, written apart from the Spark plans."""

from __future__ import annotations

R = "1737400.0::double"
RKM = "1737.4::double"

_DEM = f"""
p as (select count(*) as nr, 2*pi()*{R}/64 as a, -pi()*{R} as c, -pi()*{R}/count(*) as e, pi()*{R}/2 as f from embeddings),
px as (select vec_id as row, generate_subscripts(embedding, 1) - 1 as col, floor(unnest(embedding)::double * 8000) as dn from embeddings),
dem as (select row, col, dn * 0.5::double as h from px),
demnd as (select row, col, case when (row*7 + col*13) % 97 = 0 then null else dn * 0.5::double end as h from px)"""


def _targets(row_step: int, row_phase: int = 10, col_step: int = 8, col_phase: int = 3) -> str:
    return f"""
cell as (select r.row, c.col, degrees((e*(r.row + 0.5::double) + f) / {R}) as lat, degrees((a*(c.col + 0.5::double) + c_) / {R}) as lon
         from (select a, c as c_, e, f, nr from p) p, (select unnest(generate_series({row_phase}, (select nr - 1 from p), {row_step})) as row) r,
              (select unnest(generate_series({col_phase}, 63, {col_step})) as col) c)"""


_FLOOR = f"""cast(greatest(0, least(nr - 1, floor(({R}*radians(lat) - f) / e))) as bigint) as prow, cast(((floor(({R}*radians(lon) - c) / a) % 64) + 64) % 64 as bigint) as pcol"""
_NEAR = f"""cast(round_even((a*({R}*radians(lat) - f) - 0*({R}*radians(lon) - c)) / (a*e), 0) as bigint) as prow, cast(round_even((e*({R}*radians(lon) - c) - 0*({R}*radians(lat) - f)) / (a*e), 0) as bigint) as pcol"""


def _tgt(rule: str = _FLOOR, dem: str = "dem") -> str:
    return f"""
tgt as (select row_number() over () as id, q.* exclude (prow, pcol), d.h as h_target from (select cell.*, {rule} from cell, p) q join {dem} d on d.row = q.prow and d.col = q.pcol where d.h is not null)"""


def _schedule(max_km: float, pixel: str) -> str:
    return f"""
seg(k, far, step) as (values (1, 10.0::double, {pixel}), (2, 50.0::double, 0.25::double), (3, 150.0::double, 0.5::double), (4, 300.0::double, 1.0::double), (5, 500.0::double, 2.0::double)),
acc as (select 0 as k, 0.0::double as pos, 0.0::double as n, 0.0::double as step
        union all
        select seg.k, acc.pos + acc.n*acc.step, greatest(0, floor((least(seg.far, {max_km}::double) - (acc.pos + acc.n*acc.step)) / seg.step + 1e-9)), seg.step from acc join seg on seg.k = acc.k + 1),
dist as (select pos + step*i as d from acc, lateral (select unnest(generate_series(1, cast(n as bigint))) as i))"""


def _even(step: float, max_km: float) -> str:
    return f"""
dist as (select {step}::double * i as d from (select unnest(generate_series(1, cast(floor({max_km} / {step}) as bigint))) as i))"""


def _azimuth(n: int, whole: bool = False) -> str:
    return f"""
az as (select i as k, {'i::double' if whole else f'i * (360.0::double / {n})'} as azimuth from (select unnest(generate_series(0, {n - 1})) as i))"""


def _profile(rule: str, clip: bool, outer: bool = False, dem: str = "dem") -> str:
    sine = "sin(radians(t.lat))*cos(arc) + cos(radians(t.lat))*(sin(arc)*cos(b))"
    if clip:
        sine = f"greatest(-1.0::double, least(1.0::double, {sine}))"
    back = "sine" if clip else "sin(asin(sine))"
    x, y = f"{R}*lon2", f"{R}*lat2"
    rule = rule.replace(f"{R}*radians(lat)", y).replace(f"{R}*radians(lon)", x)
    return f"""
ray as (select *, d*1000.0::double as dm, d*1000.0::double / {R} as arc, radians(azimuth) as b from az, dist),
s1 as (select t.id, t.h_target, r.k, r.dm, r.b, r.arc, radians(t.lat) as lat1, radians(t.lon) as lon1, {sine} as sine from tgt t, ray r),
s2 as (select *, asin(sine) as lat2, lon1 + atan2(cos(lat1)*(sin(b)*sin(arc)), cos(arc) - sin(lat1)*{back}) as lon2 from s1),
s3 as (select s2.*, {rule} from s2, p),
best as (select id, k, max((h - h_target - dm*dm / (2.0::double*{R})) / dm) as slope from s3 {'left ' if outer else ''}join {dem} d on d.row = s3.prow and d.col = s3.pcol group by id, k),
full_ as (select tgt.id, az.k, azimuth, degrees(atan(slope)) as angle from tgt cross join az left join best on best.id = tgt.id and best.k = az.k),
prof as (select id, list(angle order by k) as v, list(azimuth order by k) as z from full_ group by id)"""


_EXTREMES = """z[list_position(v, list_max(v))] as worst_azimuth, round(list_max(v), 6) as worst_angle_deg, z[list_position(v, list_min(v))] as best_azimuth, round(list_min(v), 6) as best_angle_deg"""


def _final(*more: str, keep_blank: bool = False) -> str:
    first = "".join(f"{m}, " for m in more)
    blank = "" if keep_blank else " where list_max(v) is not null"
    return f"select {first}cast(row as int) as row, cast(col as int) as col, round(lat, 8) as lat, round(lon, 8) as lon, h_target, {_EXTREMES} from tgt join prof using (id){blank}"


def _with(*parts: str) -> str:
    return "with recursive " + ",".join(parts) + "\n"


_PIXEL_KM = "(select a / 1000.0::double from p)"
_FULLRES = _with(_DEM, _targets(100), _tgt(), _schedule(500, _PIXEL_KM), _azimuth(36), _profile(_FLOOR, True)) + _final()
_CLASSIC = _with(_DEM, _targets(100), _tgt(_NEAR), _even(1, 300), _azimuth(36, True), _profile(_NEAR, False, True)) + _final()

_PTS = """pts as (select c_custkey as id, ((c_custkey*7919) % 17900) / 100.0::double - 89.5::double as lat, ((c_custkey*104729) % 36000) / 100.0::double - 180.0::double as lon, c_acctbal as elevation from customer)"""

_RES = (
    _targets(50)
    + ","
    + _tgt()
    + """,
res as (select cast(row as int) as row, cast(col as int) as col, lat, lon, h_target, cast((row*7 + col*11) % 360 as double) as worst_azimuth, abs(h_target) / 50.0::double as worst_angle_deg,
        cast((row*13 + col*3) % 360 as double) as best_azimuth, -abs(h_target) / 200.0::double as best_angle_deg, cast(row % 3 as int) as run from tgt where (row + col) % 17 != 0)"""
)


def _box(lat0: float, lat1: float, lon0: float, lon1: float, spacing: float, rect: bool) -> str:
    cos = f"cos(radians({0.5 * (lat0 + lat1)}::double))" if rect else "cos(radians(lat))"
    return f"""
k as (select 2.0::double*pi()*{RKM}/360.0::double as km),
lats as (select i as grid_row, {lat0}::double + ({spacing}::double/km)*i as lat, km from k, lateral (select unnest(generate_series(0, cast(floor(({lat1}::double - {lat0}::double) / ({spacing}::double/km) + 1e-9) as bigint))) as i)),
steps as (select *, {spacing}::double / (km*{cos}) as dlon from lats),
box as (select grid_row, j as grid_col, lat, {lon0}::double + dlon*j as lon from steps, lateral (select unnest(generate_series(0, cast(floor(({lon1}::double - {lon0}::double) / dlon + 1e-9) as bigint))) as j))"""


_BOX_CELL = f""",
cell as (select cast(grid_row as int) as grid_row, cast(grid_col as int) as grid_col, cast(floor(({R}*radians(lat) - f) / e) as bigint) as row, cast(floor(({R}*radians(lon) - c) / a) as bigint) as col, lat, lon from box, p)"""


def _polar(spacing: float, x0: str, x1: str, y0: str, y1: str, edge: str | None) -> str:
    inside = "" if edge is None else f" where sqrt(x_km*x_km + y_km*y_km) <= {edge} + 1e-9"
    return f"""
plane as (select * from (select i*{spacing}::double as x_km, j*{spacing}::double as y_km from (select unnest(generate_series({x0}, {x1})) as i), (select unnest(generate_series({y0}, {y1})) as j)){inside}),
cap as (select x_km, y_km, -90.0::double + 2.0::double*degrees(atan(sqrt(x_km*x_km + y_km*y_km) / (2.0::double*{R}/1000.0::double))) as lat, degrees(atan2(x_km, y_km)) as lon from plane)"""


def _edge(lat_max: float) -> str:
    return f"(2.0::double*{RKM}*tan(radians(90.0::double + {lat_max}::double) / 2.0::double))"


def _cap(spacing: float, lat_max: float) -> str:
    n = f"cast(floor({_edge(lat_max)} / {spacing}) as bigint)"
    return _polar(spacing, f"-{n}", n, f"-{n}", n, _edge(lat_max))


_REGION = f"""
p0 as (select count(*) as nr, 2*pi()*{R}/64 as a, -pi()*{R} as c, -pi()*{R}/count(*) as e, pi()*{R}/2 as f from embeddings),
p as (select 300 as nr, a, c + a*10 as c, e, f + e*100 as f from p0),
dem as (select vec_id - 100 as row, generate_subscripts(embedding, 1) - 1 - 10 as col, floor(unnest(embedding)::double * 8000) * 0.5::double as h from embeddings where vec_id between 100 and 399),
reg as (select * from dem where col between 0 and 39)"""
_REG_FLOOR = f"cast(floor(({R}*radians(lat) - f) / e) as bigint) as prow, cast(floor(({R}*radians(lon) - c) / a) as bigint) as pcol"


def _reg_targets(col_step: int, col_phase: int) -> str:
    return f"""
cell as (select r.row, c.col, degrees((e*(r.row + 0.5::double) + f) / {R}) as lat, degrees((a*(c.col + 0.5::double) + c_) / {R}) as lon
         from (select a, c as c_, e, f from p) p, (select unnest(generate_series(5, 299, 50)) as row) r, (select unnest(generate_series({col_phase}, 39, {col_step})) as col) c)"""


def _block(method: str, f: int, n_cols: int) -> str:
    return f"select cast(row // {f} as int) as row, cast(col // {f} as int) as col, round({method}(h), 6) as h from demnd, p where row < (nr // {f})*{f} and col < {n_cols * f} group by 1, 2"


def _histogram(bins: int, by: str = "") -> str:
    key, on = (f"{by}, ", f" using ({by})") if by else ("", " on true")
    group = f" group by {by}" if by else ""
    return f"""ends as (select {key}min(worst_angle_deg) as lo, max(worst_angle_deg) as hi from res{group}),
hits as (select {key}least(cast(floor({bins}*(worst_angle_deg - lo) / (hi - lo)) as int), {bins - 1}) as bin, count(*) as n from res join ends{on} group by all)
select {('e.' + key) if by else ''}cast(b as int) as bin, round(lo + (hi - lo)/{bins}*b, 6) as "left", round(lo + (hi - lo)/{bins}*(b + 1), 6) as "right", coalesce(n, 0) as n
from ends e cross join (select unnest(generate_series(0, {bins - 1})) as b) g left join hits h on h.bin = g.b{f' and h.{by} = e.{by}' if by else ''}"""


_CHUNKS = """
ch as (select i as chunk, i*128 as row_start, least(nr, i*128 + 128) as row_end from p, lateral (select unnest(generate_series(0, (nr - 1)//128)) as i))"""
_SURFACE = """
fit as (select regr_slope(lat, row) as al, regr_intercept(lat, row) as bl, regr_slope(lon, col) as ao, regr_intercept(lon, col) as bo from res),
rs as (select row, cast(dense_rank() over (order by row) - 1 as int) as row_idx from (select distinct row from res)),
cs as (select col, cast(dense_rank() over (order by col) - 1 as int) as col_idx from (select distinct col from res)),
grid as (select row_idx, col_idx, radians(al*rs.row + bl) as la, radians(ao*cs.col + bo) as lo, coalesce(h_target, 0) as h, worst_angle_deg as value from rs cross join cs cross join fit left join res on res.row = rs.row and res.col = cs.col)"""


def _text(c: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', {c}), '')"


def _azimuth_text(c: str) -> str:
    return f"coalesce(case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else printf('%g', {c}) end, '')"


def oracle_sql() -> dict[str, str]:
    found = {
        "horizon_scan_fullres": _FULLRES,
        "horizon_scan_sql": _FULLRES,
        "horizon_scan_tiles": _FULLRES,
        "incremental_scan": _FULLRES,
        "horizon_scan_classic": _CLASSIC,
        "horizon_scan_classic_sql": _CLASSIC,
        "horizon_profile_point": _with(_DEM, " cell as (select -12.3::double as lat, 45.6::double as lon)", _tgt(_NEAR), _even(1, 50), _azimuth(360, True), _profile(_NEAR, False, True)) + "select azimuth, round(angle, 6) as angle_deg from full_",
        "horizon_full_profile": _with(_DEM, _targets(250), _tgt(), _schedule(100, _PIXEL_KM), _azimuth(24), _profile(_FLOOR, True))
        + "select cast(row as int) as row, cast(col as int) as col, list_aggregate(list_transform(v, lambda x: coalesce(printf('%.5f', x), 'null')), 'string_agg', ',') as profile from tgt join prof using (id) where list_max(v) is not null",
        "horizon_scan_box": _with(_DEM, _box(-6, -4, 20, 26, 20, False) + _BOX_CELL, _tgt(_NEAR), _even(5, 150), _azimuth(24), _profile(_NEAR, True, True)) + _final("grid_row", "grid_col", keep_blank=True),
        "horizon_elevation_only": _with(_DEM, _box(-45, -40, 10, 15, 10, True) + _BOX_CELL, _tgt(_NEAR)) + "select grid_row, grid_col, cast(row as int) as row, cast(col as int) as col, round(lat, 8) as lat, round(lon, 8) as lon, h_target from tgt",
        "horizon_scan_polar": _with(_DEM, _cap(100, -80), f" cell as (select x_km, y_km, cast(floor(({R}*radians(lat) - f) / e) as bigint) as row, cast(floor(({R}*radians(lon) - c) / a) as bigint) as col, lat, lon from cap, p)", _tgt(), _schedule(200, _PIXEL_KM), _azimuth(24), _profile(_FLOOR, True)) + _final("x_km", "y_km"),
        "horizon_regional_dem": _with(_REGION, _reg_targets(7, 1), _tgt(_REG_FLOOR, "reg"), _schedule(150, _PIXEL_KM), _azimuth(24), _profile(_REG_FLOOR, True, True, "reg")) + _final(),
        "blank_rays": _with(_REGION, _reg_targets(39, 0), _tgt(_REG_FLOOR, "reg"), " dist as (select unnest([200.0::double, 300.0::double]) as d)", _azimuth(12), _profile(_REG_FLOOR, True, True, "reg")) + "select cast(k as int) as az_id, count(*) as n_rays, cast(count_if(angle is null) as bigint) as n_blank from full_ group by k",
        "dem_sample_points": f"with {_DEM}, {_PTS} select id, round(lat, 6) as lat, round(lon, 6) as lon, d.h from (select pts.*, {_FLOOR} from pts, p) q left join dem d on d.row = q.prow and d.col = q.pcol",
        "dem_sample_classic": f"with {_DEM}, {_PTS} select id, d.h from (select pts.*, {_NEAR} from pts, p) q left join demnd d on d.row = q.prow and d.col = q.pcol",
        "dem_decode_nodata": f"with {_DEM} select cast(row as int) as row, count(*) as n_total, count(h) as n_valid, count(*) - count(h) as n_missing, min(h) as v_min, max(h) as v_max from demnd group by row",
        "dem_downsample_max": f"with {_DEM} {_block('max', 5, 12)}",
        "dem_downsample_avg": f"with {_DEM} {_block('avg', 5, 12)}",
        "dem_downsample_nearest": f"with {_DEM} select cast(row // 9 as int) as row, cast(col // 9 as int) as col, round(h, 6) as h from demnd, p where row % 9 = 4 and col % 9 = 4 and row // 9 < nr // 9 and col // 9 < 7",
        "dem_downsample_stride": f"with {_DEM} select cast(row // 9 as int) as row, cast(col // 9 as int) as col, round(h, 6) as h from demnd where row % 9 = 0 and col % 9 = 0",
        "dem_ingest": f"with {_DEM} select cast(row // 78 as int) as chunk, cast(min(row) as int) as row_start, cast(max(row) + 1 as int) as row_end, count(h) as n_valid from demnd group by row // 78",
        "dem_chunk_lookup": f"with {_DEM}, {_CHUNKS} select cast(chunk as int) as chunk, cast(row_start as int) as row_start, cast(row_end as int) as row_end, count(distinct row) as n_rows, cast(min(dn) as int) as dn_min, cast(max(dn) as int) as dn_max, count(distinct row) as n_same from px join ch on row >= row_start and row < row_end group by chunk, row_start, row_end",
        "dem_window": f"""with {_DEM}, edge as (select {', '.join(f'cast(round_even((a*({R}*radians({v}::double) - f)) / (a*e), 0) as bigint) as {n}' for n, v in (('ra', -20), ('rb', 10)))}, {', '.join(f'cast(round_even((e*({R}*radians({v}::double) - c)) / (a*e), 0) as bigint) as {n}' for n, v in (('ca', 30), ('cb', 80)))} from p)
select cast(row as int) as row, cast(col as int) as col, h from dem, edge where row between least(ra, rb) - 3 and greatest(ra, rb) + 3 and col between ca - 3 and cb + 3""",
        "pixel_centers": f"with {_DEM}, {_targets(50, 0, 1, 0)} select cast(row as int) as row, cast(col as int) as col, round(lat, 9) as lat, round(lon, 9) as lon from cell",
        "geodesic_destinations": f"""with {_PTS}, q as (select id, radians(lat) as a1, radians(lon) as o1, (id % 400 + 1.0::double) / {RKM} as w, radians(id*37 % 360 * 1.0::double) as b from pts),
s as (select *, asin(greatest(-1.0::double, least(1.0::double, sin(a1)*cos(w) + cos(a1)*sin(w)*cos(b)))) as a2 from q) select id, round(degrees(a2), 7) as lat2, round(degrees(o1 + atan2(sin(b)*sin(w)*cos(a1), cos(w) - sin(a1)*sin(a2))), 7) as lon2 from s""",
        "distance_schedule": _with(_schedule(500, "0.11845::double")) + "select row_number() over (order by d) as k, round(d, 9) as distance_km from dist",
        "stride_grid_lat_cap": f"with {_DEM}, {_targets(20, 0, 4, 0)} select cast(row as int) as row, cast(col as int) as col, round(lat, 9) as lat, round(lon, 9) as lon from cell where lat <= -30",
        "polar_cap_grid": f"with {_cap(25, -85)} select x_km, y_km, round(lat, 9) as lat, round(lon, 9) as lon from cap",
        "polar_region_grid": f"with {_polar(10, '-1', '11', '-9', '3', None)} select x_km, y_km, round(lat, 9) as lat, round(lon, 9) as lon from cap",
        "box_grid_exact": f"with {_box(-45, -40, 10, 15, 5, False)} select cast(grid_row as int) as grid_row, cast(grid_col as int) as grid_col, round(lat, 9) as lat, round(lon, 9) as lon from box",
        "box_grid_rect": f"with {_box(-45, -40, 10, 15, 5, True)} select cast(grid_row as int) as grid_row, cast(grid_col as int) as grid_col, round(lat, 9) as lat, round(lon, 9) as lon from box",
        "polar_columns": f"""with {_PTS}, q as (select id, case when lat <= 0 and lat >= -90 then 2.0::double*{RKM}*tan(radians(90.0::double + lat) / 2.0::double) end as rho, radians(lon - 30.0::double) as lam from pts), w as (select id, rho, -(rho*sin(lam)) as x, rho*cos(lam) as y from q)
select id, round(x, 6) as x_km, round(y, 6) as y_km, round(rho, 6) as rho_km, round(((degrees(atan2(x, y)) % 360.0::double) + 360.0::double) % 360.0::double, 6) as azimuth_deg from w""",
        "column_alias_pick": f"with {_PTS} select id, round(case when lat <= 0 and lat >= -90 then 2.0::double*{RKM}*tan(radians(90.0::double + lat) / 2.0::double) end, 6) as rho_km from pts",
        "cartesian_xyz": f"with {_PTS}, q as (select id, radians(lat) as la, radians(lon) as lo, {R} + 10.0::double*elevation as r from pts) select id, round(r*cos(la)*cos(lo), 3) as x, round(r*cos(la)*sin(lo), 3) as y, round(r*sin(la), 3) as z from q",
        "cloud_bounds": f"with {_PTS}, q as (select radians(lat) as la, radians(lon) as lo, {R} + elevation as r from pts), w as (select r*cos(la)*cos(lo) as x, r*cos(la)*sin(lo) as y, r*sin(la) as z from q) select count(*) as n, round(avg(x), 2) as mid_x, round(avg(y), 2) as mid_y, round(avg(z), 2) as mid_z, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2, 3) as half_edge from w",
        "surface_grid": f"with {_DEM}, {_RES}, {_SURFACE} select row_idx, col_idx, round(({R} + 5.0::double*h)*cos(la)*cos(lo), 2) as x, round(({R} + 5.0::double*h)*cos(la)*sin(lo), 2) as y, round(({R} + 5.0::double*h)*sin(la), 2) as z, round(value, 6) as value from grid",
        "surface_missing": f"with {_DEM}, {_RES}, {_SURFACE} select count(*) as n_cells, cast(count_if(value is null) as bigint) as n_missing from grid",
        "angle_summary": f"with {_DEM}, {_RES} " + " union all ".join(f"select '{c}' as field, count({c}) as n, round(min({c}), 6) as v_min, round(quantile_cont({c}, 0.5), 6) as v_median, round(avg({c}), 6) as v_mean, round(quantile_cont({c}, 0.95), 6) as v_p95, round(max({c}), 6) as v_max from res" for c in ("worst_angle_deg", "best_angle_deg")),
        "angle_histogram": f"with {_DEM}, {_RES}, {_histogram(30)}",
        "angle_histogram_by_run": f"with {_DEM}, {_RES}, {_histogram(12, 'run')}",
        "run_stats": f"with {_DEM}, {_RES} select run, count(*) as n, round(avg(worst_angle_deg), 6) as v_mean, round(min(worst_angle_deg), 6) as v_min, round(max(worst_angle_deg), 6) as v_max from res group by run",
        "shaded_values": f"with {_DEM}, {_RES}, m as (select min(worst_angle_deg) as lo, max(worst_angle_deg) as hi from res) select row, col, round((worst_angle_deg - lo) / (hi - lo), 9) as shade from res, m",
        "image_pixels": f"with {_PTS} select id, greatest(0, least(180, cast(trunc((90.0::double - lat) / 180.0::double * 180) as int))) as image_row, greatest(0, least(360, cast(trunc((lon + 180.0::double) / 360.0::double * 360) as int))) as image_col from pts",
        "results_json_roundtrip": f"with {_DEM}, {_RES} select (select count(*) from res) as completed, row, col, round(lat, 8) as lat, round(lon, 8) as lon, h_target, worst_azimuth, worst_angle_deg, best_azimuth, best_angle_deg from res",
        "results_json_list": f"with {_DEM}, {_RES} select row, col, round(lat, 8) as lat, round(lon, 8) as lon, h_target, worst_azimuth, worst_angle_deg, best_azimuth, best_angle_deg from res",
        "results_polar_csv": f"""with {_DEM}, {_RES}, q as (select *, 2.0::double*{RKM}*tan(radians(90.0::double + lat) / 2.0::double) as rho from res)
select row, col, round(rho*sin(radians(lon)), 6) as x_km, round(rho*cos(radians(lon)), 6) as y_km, worst_azimuth, round(worst_angle_deg, 9) as worst_angle_deg, round(best_angle_deg, 9) as best_angle_deg, run from q""",
        "results_box_csv": f"""with {_DEM}, {_RES}, q as (select *, row % 4 != 0 as shown from res) select cast(row // 50 as int) as grid_row, cast(col // 8 as int) as grid_col, row, col, round(lat, 8) as lat, round(lon, 8) as lon, round(h_target, 2) as h_target,
case when shown then worst_azimuth end as worst_azimuth, case when shown then round(worst_angle_deg, 6) end as worst_angle_deg, case when shown then best_azimuth end as best_azimuth, case when shown then round(best_angle_deg, 6) end as best_angle_deg from q""",
        "image_colours": f"""with {_PTS}, q as (select id, greatest(0, least(60, cast(trunc((60.0::double - lat) / 120.0::double * 60) as int))) as r, greatest(0, least(120, cast(trunc((lon + 90.0::double) / 180.0::double * 120) as int))) as c from pts)
select id, (r*31 + c*21) % 256 as red, (r*31 + c*21 + 7) % 256 as green, (r*31 + c*21 + 14) % 256 as blue from q""",
        "region_csv_format": f"""with {_DEM}, {_RES}, q as (select *, row % 4 != 0 as shown from res) select cast(row // 50 as varchar) as grid_row, cast(col // 8 as varchar) as grid_col, cast(row as varchar) as row, cast(col as varchar) as col, {_text('lat', 8)} as lat, {_text('lon', 8)} as lon, {_text('h_target', 2)} as h_target,
case when shown then {_azimuth_text('worst_azimuth')} else '' end as worst_azimuth, case when shown then {_text('worst_angle_deg', 6)} else '' end as worst_angle_deg, case when shown then {_azimuth_text('(best_azimuth / 7.0::double)')} else '' end as best_azimuth, case when shown then {_text('best_angle_deg', 6)} else '' end as best_angle_deg from q""",
        "resume_anti_join": f"with {_DEM}, {_RES} select cast(row as int) as row, cast(col as int) as col from cell where not exists (select 1 from res where res.row = cell.row and res.col = cell.col and run = 0)",
        "probe_targets": f"with {_DEM}, {_targets(50)}, n as (select row, col, row_number() over (order by row, col) - 1 as place, count(*) over () as n from cell) select cast(row as int) as row, cast(col as int) as col from n where place in (select distinct cast(floor(i*(n - 1) / 7) as bigint) from (select unnest(generate_series(0, 7)) as i) s, (select distinct n from n) c)",
    }
    return found
