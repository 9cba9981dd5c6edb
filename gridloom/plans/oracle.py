"""SQL of the registered queries, for an independent engine."""

from __future__ import annotations

import math

from ..functions.projection import HALF, RADIUS
from ..functions.tileid import first_id
from ..sources.regions import boxes_of
from . import points as data
from .queries import BOX, DENSE, LIMIT_BYTES, LIMIT_N, ROLL, TOP, Z


def _d(v: float) -> str:
    return f"cast({v!r} as double)"


def _placed(z: int, name: str = "p") -> str:
    """CTE `name`: points with tx, ty, px, py at a zoom."""
    w, u = _d(2 * HALF / (1 << z)), _d(2 * HALF / ((1 << z) * 256.0))
    return f"""{name}0 as ({data.POINTS_SQL}),
{name}1 as (select *, cast(trunc((gx + {_d(HALF)}) / {w}) as bigint) as tx, cast(trunc(({_d(HALF)} - gy) / {w}) as bigint) as ty from {name}0),
{name} as (select *, cast(round((gx - (tx * {w} - {_d(HALF)})) / {u} * {_d(4096.0)} / {_d(256.0)}) as bigint) as px,
  cast(round((({_d(HALF)} - ty * {w}) - gy) / {u} * {_d(4096.0)} / {_d(256.0)}) as bigint) as py from {name}1)"""


def _hilbert(z: int, source: str, name: str = "h") -> str:
    """CTE `name`: x0, y0, d (tile id) of the distinct tx, ty of a CTE."""
    bit = "(1::bigint << a)"
    return f"""{name}r as (select tx x0, ty y0, {z - 1} a, tx x, ty y, {first_id(z)}::bigint d from (select distinct tx, ty from {source}) union all
 select x0, y0, a - 1, case when (y & {bit}) = 0 then case when (x & {bit}) <> 0 then {bit} - 1 - y else y end else x end,
  case when (y & {bit}) = 0 then case when (x & {bit}) <> 0 then {bit} - 1 - x else x end else y end,
  d + (xor(3 * (x & {bit}), y & {bit}) << a) from {name}r where a >= 0),
{name} as (select x0, y0, d from {name}r where a = -1)"""


def _levels() -> str:
    parts, ctes = [], []
    for z in range(ROLL + 1):
        ctes.append(_placed(z, f"p{z}_"))
        parts.append(f"select {z} z, tx x, ty y, count(*) n from p{z}_ where id % {1 << (ROLL - z)} = 0 group by tx, ty")
    return ",\n".join([*ctes, "lv as (" + " union all ".join(parts) + ")"])


def _density(widths: int, positive: bool) -> str:
    where = "where cnt > 0" if positive else ""
    return f"""with {_placed(DENSE)}, s as (select tx, ty, i, px >> i bx, py >> i by_, cast(sum(cnt) as bigint) s from p, range({widths}) t(i) {where} group by all),
g as (select tx, ty, cast(1 << i as bigint) width, s, count(*) k from s group by all)"""


_DENSITY_TILE = f"select {DENSE} zoom, tx tile_x, ty tile_y, width, s num_pts, k num_grids from g"
_DENSITY_ALL = f"select {DENSE} zoom, width, s num_pts, cast(sum(k) as bigint) num_grids from g group by width, s"


def _in_box(x: str, y: str, b: tuple[float, float, float, float]) -> str:
    return f"({x} >= {_d(b[0])} and {y} >= {_d(b[1])} and {x} <= {_d(b[2])} and {y} <= {_d(b[3])})"


def _in_rings(x: str, y: str, rings: list) -> str:
    out = []
    for ring in rings:
        edges = []
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if yi != yj:
                edges.append(f"case when ({_d(yi)} > {y}) <> ({_d(yj)} > {y}) then case when {x} < {_d(xj - xi)} * ({y} - {_d(yi)}) / {_d(yj - yi)} + {_d(xi)} then 1 else 0 end else 0 end")
        out.append("((" + " + ".join(edges) + ") % 2 = 1)")
    return "(" + " or ".join(out) + ")"


_PICK = f"with p as ({data.POINTS_SQL}) select id, gene, gx, gy from p where "
_BOX = (BOX.xmin, BOX.ymin, BOX.xmax, BOX.ymax)
_POLY = f"with p as ({data.POLYGONS_SQL}), b as (select *, list_min(list_transform(ring, lambda v: v.x)) xmin, list_min(list_transform(ring, lambda v: v.y)) ymin, list_max(list_transform(ring, lambda v: v.x)) xmax, list_max(list_transform(ring, lambda v: v.y)) ymax from p)"
_SUM = "list_reduce(list_transform(ring[1:len(ring) - 1], lambda v: v.{c}), lambda a, v: a + v, cast(0 as double)) / (len(ring) - 1)"
_GRID = _d(2147483648.0)
_UNIT = _d(math.pi * RADIUS / 2147483648.0)
_PARENTS = f"""{_placed(TOP)}, t as (select tx, ty, count(*) n from p group by all),
u as (select tx >> 1 tx, ty >> 1 ty, cast(sum(n) as bigint) n, cast(sum(n) * 9 + 100 as bigint) * 10 est from t group by tx >> 1, ty >> 1),
r as (select max(n) max_n, max(est) max_est from u),
q as (select *, least(case when max_n > {LIMIT_N} then {_d(float(LIMIT_N))} / max_n else cast(1 as double) end, case when max_est > {LIMIT_BYTES * 10} then {_d(float(LIMIT_BYTES * 10))} / max_est else cast(1 as double) end) ratio from r),
c as (select tx, ty, n, greatest(cast(trunc(ratio * n) as bigint), 1) cap from u, q)"""
_SAMPLE = f"""with {_PARENTS}, {_placed(TOP - 1, "s")},
k as (select s.tx, s.ty, s.id, cap, row_number() over (partition by s.tx, s.ty order by md5(concat(({TOP - 1} * 1000000 + s.tx * 1000 + s.ty)::varchar, '|', s.id::varchar)), s.id) pick from s join c on s.tx = c.tx and s.ty = c.ty)"""


def _fixed(v: str) -> str:
    return f"printf('%.3f', {v})"


_W = 2 * HALF / (1 << ROLL)
_TILE_BOX = f"tx * {_d(_W)} - {_d(HALF)} xmin, ({_d(HALF)} - ty * {_d(_W)}) - {_d(_W)} ymin, (tx * {_d(_W)} - {_d(HALF)}) + {_d(_W)} xmax, {_d(HALF)} - ty * {_d(_W)} ymax"
_REGION = " or ".join(f"(xmin <= {_d(b[2])} and {_d(b[0])} <= xmax and ymin <= {_d(b[3])} and {_d(b[1])} <= ymax)" for b in boxes_of([data.CROSS, data.NEGATIVE]))
_MATCH = " or ".join(
    f"({_in_rings('xmin', 'ymin', [r])} and {_in_box('xmin', 'ymin', boxes_of([r])[0])} and {_in_rings('xmax', 'ymax', [r])} and {_in_box('xmax', 'ymax', boxes_of([r])[0])}) or len(list_filter(ring, lambda v: {_in_rings('v.x', 'v.y', [r])})) > 0" for r in data.PARTS
)
_E7 = "cast(trunc({v} * cast(1e7 as double)) as bigint)"
_LON = f"({{c}} / {_d(RADIUS)} * {_d(180 / math.pi)})"
_LAT = f"((cast(2 as double) * atan(exp({{c}} / {_d(RADIUS)})) - {_d(math.pi / 2)}) * {_d(180 / math.pi)})"

ORACLE_SQL: dict[str, str] = {
    "tile_assign": f"with {_placed(Z)} select id, tx, ty from p",
    "pixel_quantize": f"with {_placed(Z)} select id, tx, ty, px, py from p",
    "pixel_to_global": f"with {_placed(Z)} select id, (tx * {_d(float(1 << (32 - Z)))} - {_GRID}) * {_UNIT} + {_d(2 * HALF / (1 << (Z + 12)))} * px gx, ({_d(4294967295.0)} - ty * {_d(float(1 << (32 - Z)))} - {_GRID}) * {_UNIT} - {_d(2 * HALF / (1 << (Z + 12)))} * py gy from p",
    "tile_hilbert_id": f"with recursive {_placed(15)}, {_hilbert(15, 'p')} select id, d tile_id from p join h on tx = x0 and ty = y0",
    "tile_id_inverse": f"with recursive {_placed(ROLL)}, {_hilbert(ROLL, 'p')} select d tile_id, x0 x, y0 y from h",
    "tile_bbox": f"with {_placed(ROLL)} select distinct tx, ty, {_TILE_BOX} from p",
    "tile_parent_children": f"with {_placed(ROLL)}, t as (select distinct tx, ty from p) select tx >> 1 px, ty >> 1 py, count(*) children, min((ty & 1) * 2 + (tx & 1)) first_child from t group by tx >> 1, ty >> 1",
    "wgs84_bounds": f"with p as ({data.POINTS_SQL}), s as (select min(gx) x0, max(gx) x1, min(gy) y0, max(gy) y1 from p) select {_E7.format(v=_LON.format(c='x0'))} min_lon_e7, {_E7.format(v=_LAT.format(c='y0'))} min_lat_e7, {_E7.format(v=_LON.format(c='x1'))} max_lon_e7, {_E7.format(v=_LAT.format(c='y1'))} max_lat_e7 from s",
    "count_tiles_zoom": f"with recursive {_placed(ROLL)}, {_hilbert(ROLL, 'p')} select {ROLL} zoom, tx x, ty y, d tile_id, count(*) tile_count from p join h on tx = x0 and ty = y0 group by all",
    "density_mt": f"{_density(13, True)} {_DENSITY_TILE}",
    "density_st": f"{_density(20, False)} {_DENSITY_TILE}",
    "density_compact": f"{_density(13, True)} {_DENSITY_ALL}",
    "density_grouping_sets": f"{_density(13, True)} select zoom, tile_x::varchar tile_x, tile_y::varchar tile_y, width, num_pts, num_grids from ({_DENSITY_TILE}) union all select zoom, 'ALL', 'ALL', width, num_pts, num_grids from ({_DENSITY_ALL})",
    "export_bbox": _PICK + _in_box("gx", "gy", _BOX),
    "export_partial_bbox": _PICK + f"gx <= {_d(1e6)}",
    "export_polygon_semi": _PICK + _in_rings("gx", "gy", [data.CONCAVE]),
    "export_multipolygon": _PICK + _in_rings("gx", "gy", data.PARTS),
    "export_region_prune": f"with {_placed(ROLL)}, t as (select tx, ty, count(*) n from p group by all), b as (select *, {_TILE_BOX} from t) select tx, ty, n from b where {_REGION}",
    "export_bbox_and_polygon": _PICK + _in_box("gx", "gy", _BOX) + " and " + _in_rings("gx", "gy", [data.CROSS, data.NEGATIVE]),
    "export_tsv_text": f"with p as ({data.POINTS_SQL}) select {_fixed('gx')} \"X\", {_fixed('gy')} \"Y\", id::varchar id, gene, cnt::varchar cnt from p",
    "export_geojson_lines": f"""with p as ({data.POINTS_SQL}) select '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {_fixed('gx')} || ',' || {_fixed('gy')} || ']}},"properties":{{"id":"' || id || '","gene":"' || gene || '","cnt":"' || cnt || '"}}}}' as "value" from p""",
    "polygon_centroid": f"{_POLY} select id, {_SUM.format(c='x')} x, {_SUM.format(c='y')} y from p",
    "polygon_bbox": f"{_POLY} select id, xmin, ymin, xmax, ymax from b",
    "polygon_bbox_overlap": f"{_POLY} select id from b where xmax >= {_d(-1e6)} and xmin <= {_d(2e6)} and ymax >= {_d(-1.5e6)} and ymin <= {_d(2.5e6)}",
    "polygon_region_match": f"{_POLY} select id from b where {_MATCH}",
    "polygon_region_table": f"{_POLY} select id from b where {_MATCH}",
    "polygon_vertices_text": f"{_POLY} select id, '[' || array_to_string(list_transform(ring[1:len(ring) - 1], lambda v: '[' || {_fixed('v.x')} || ',' || {_fixed('v.y')} || ']'), ',') || ']' as \"Vertices\" from p",
    "column_select_fill": f"{_POLY} select {_fixed(_SUM.format(c='x'))} \"X\", {_fixed(_SUM.format(c='y'))} \"Y\", id::varchar as key, case when label is null or label = '' then 'NA' else label end as label from p",
    "type_infer": """with t as (select cast(l_linenumber as varchar) a, case when l_orderkey % 11 = 0 then 'NA' else cast(l_partkey as varchar) end b, case when l_orderkey % 3 = 0 then '' else concat(cast(l_suppkey as varchar), '.5') end c,
  l_returnflag d, case when l_orderkey % 2 = 0 then 'NA' else '' end e, case when l_linenumber = 1 then '12abc' else '7' end f from lineitem),
u as (unpivot t on a, b, c, d, e, f into name "column" value v)
select "column", case when coalesce(bool_and(v in ('', 'NA') or regexp_full_match(v, '\\s*[+-]?[0-9]+')), true) then 'INT' when bool_and(v in ('', 'NA') or regexp_matches(v, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')) then 'FLOAT' else 'STRING' end as type, bool_or(v in ('', 'NA')) nullable from u group by "column" """.replace("\\\\", "\\"),
    "prefix_number_parse": r"""with t as (select p_partkey, case p_partkey % 4 when 0 then concat(p_size, '.000000') when 1 then concat('  -', p_size, p_brand) when 2 then p_name else concat('+', p_partkey) end v from part)
select p_partkey, coalesce(try_cast(nullif(regexp_extract(v, '^\s*([+-]?[0-9]+)', 1), '') as bigint), 0) cnt, try_cast(nullif(regexp_extract(v, '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') as double) num from t""",
    "busiest_tile": f"with recursive {_placed(ROLL)}, {_hilbert(ROLL, 'p')}, c as (select d tile_id, count(*) n from p join h on tx = x0 and ty = y0 group by d) select tile_id from c order by n desc, tile_id limit 1",
    "directory_order": f"with {_levels()} select z, x, y, row_number() over (partition by z order by x, y desc) place from lv",
    "directory_offsets": f"with recursive {_placed(ROLL)}, {_hilbert(ROLL, 'p')}, c as (select d tile_id, count(*) * 13 + 21 length from p join h on tx = x0 and ty = y0 group by d) select tile_id, length, cast(sum(length) over (order by tile_id) - length as bigint) \"offset\" from c",
    "run_length_expand": 'select unnest(range(s_suppkey * 40, s_suppkey * 40 + s_suppkey % 7 + 1)) tile_id, s_suppkey * 1000 as "offset" from supplier',
    "pyramid_level_ratio": f"with {_PARENTS} select max_n, max_est, ratio from q",
    "pyramid_caps": f"with {_PARENTS} select tx, ty, n, cap from c",
    "pyramid_sample": f"{_SAMPLE} select tx, ty, id from k where pick <= cap",
    "pyramid_level_totals": f"{_SAMPLE} select {TOP} zoom, count(*) kept from p union all select {TOP - 1}, count(*) from k where pick <= cap",
    "pyramid_size_estimate": f"with {_PARENTS} select tx, ty, case when cap * 44 > cast(1200 as double) then greatest(cast(trunc(cap * (cast(1200 as double) / (cap * 44)) * cast(0.95 as double)) as bigint), 1) else cap end cap from c",
    "attr_dictionary": f"with {_placed(DENSE)}, f as (select tx, ty, gene, min(id) first from p group by all) select tx, ty, gene, row_number() over (partition by tx, ty order by first) - 1 code from f",
}


def _count_all() -> str:
    ids = ",\n".join(_hilbert(z, f"(select x tx, y ty from tot where zoom = {z})", f"h{z}_") for z in range(1, ROLL + 1))
    every = " union all ".join(["select 0 zoom, 0::bigint x0, 0::bigint y0, 0::bigint d"] + [f"select {z}, x0, y0, d from h{z}_" for z in range(1, ROLL + 1)])
    return f"""with recursive {_levels()}, tot as (select zoom, x >> ({ROLL} - zoom) x, y >> ({ROLL} - zoom) y, cast(sum(n) as bigint) total_count from lv, range({ROLL + 1}) t(zoom) where z = {ROLL} group by all),
{ids}, ids as ({every})
select cast(tot.zoom as integer) zoom, tot.x, tot.y, d tile_id, total_count, coalesce(lv.n, 0) tile_count, coalesce(lv.n, 0)::double / total_count::double frac_in_tile
from tot join ids on ids.zoom = tot.zoom and x0 = tot.x and y0 = tot.y left join lv on lv.z = tot.zoom and lv.x = tot.x and lv.y = tot.y"""


ORACLE_SQL["count_tiles_all"] = _count_all()


def _pyramid(top: int, most: int) -> str:
    """Points kept by level: a level's ratio is what its fullest tile may keep, each tile keeps that share, at least one."""
    levels = []
    for z in range(top - 1, -1, -1):
        levels.append(f"""u{z} as (select tx >> 1 tx, ty >> 1 ty, cast(sum(n) as bigint) n from k{z + 1} group by tx >> 1, ty >> 1),
k{z} as (select tx, ty, least(n, greatest(cast(trunc((select least(cast(1 as double), {_d(float(most))} / max(n)) from u{z}) * n) as bigint), 1)) n from u{z})""")
    ids = ",\n".join(_hilbert(z, f"k{z}", f"h{z}_") for z in range(1, top + 1))
    every = " union all ".join(["select 0 zoom, 0::bigint x, 0::bigint y, 0::bigint d, n from k0", *[f"select {z}, tx, ty, d, n from k{z} join h{z}_ on tx = x0 and ty = y0" for z in range(1, top + 1)]])
    return f"""with recursive {_placed(top)}, k{top} as (select tx, ty, count(*) n from p group by all), {", ".join(levels)},
{ids}, every as ({every}), total as (select z zoom, tx >> ({top} - z) x, ty >> ({top} - z) y, cast(sum(n) as bigint) total_count from k{top}, range({top + 1}) t(z) group by all)
select cast(zoom as integer) zoom, x, y, d tile_id, total_count, n tile_count, n::double / total_count::double frac_in_tile from every join total using (zoom, x, y)"""


# an archive gives back every point within half a pixel; its tiles are those of the points
ORACLE_SQL["archive_roundtrip_mlt"] = ORACLE_SQL["archive_roundtrip_mvt"] = f"""with p as ({data.POINTS_SQL}) select count(*) n, cast(sum(id) as bigint) ids, cast(sum(cnt * (id % 1009)) as bigint) counts,
 cast(sum((ascii(gene) * 31 + length(gene)) * (id % 1009)) as bigint) genes, count(distinct gene) kinds, cast(0 as bigint) far from p"""
ORACLE_SQL["archive_header"] = f"""with {_placed(3)}, t as (select count(*) n from (select distinct tx, ty from p))
select n addressed_tiles_count, n tile_entries_count, 1::bigint tile_type, 2::bigint tile_compression, 1::bigint clustered, 3::bigint min_zoom, 3::bigint max_zoom, 3::bigint center_zoom from t"""
ORACLE_SQL["archive_tiles_in_box"] = f"with recursive {_placed(5)}, {_hilbert(5, 'p')} select 5 z, x0 x, y0 y, d tile_id from h where x0 between 3 and 21 and y0 <= 13 and y0 <> 7"
ORACLE_SQL["archive_polygons"] = f"with p as ({data.POINTS_SQL}) select id, gene, true near from p"
_PIXEL = _d(2 * HALF / (8 * 4096.0))
ORACLE_SQL["archive_polygons_in_box"] = f"""with p as ({data.POINTS_SQL}) select gene, count(*) n from p where gx + 9 * {_PIXEL} > -9000100.5 + {_PIXEL} and gx < 7000100.5 - {_PIXEL} and gy - 6 * {_PIXEL} < 8000100.5 - {_PIXEL} group by gene"""
ORACLE_SQL["archive_summary"] = f"with recursive {_placed(3)}, {_hilbert(3, 'p')} select 3 z, x0 x, y0 y, d tile_id from h"
ORACLE_SQL["archive_pyramid"] = _pyramid(3, 500)
