"""Command line: the eight verbs."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import commands, counts, density
from .sources import sinks


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *needed: str) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.add_argument("--in", dest="source", required=True)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        return p

    p = verb("summarize")
    for n in ("all", "hdr", "meta", "tile"):
        p.add_argument(f"--{n}", action="store_true")
    p = verb("count-tiles", "out-tsv")
    p.add_argument("--zoom", type=int, default=-1)
    for name in ("tile-density-stats", "tile-density-stats-mt"):
        p = verb(name, "out")
        p.add_argument("--count", default="count")
        p.add_argument("--feature", default="gene")
        p.add_argument("--compact", action="store_true")
        p.add_argument("--zoom", type=int, default=-1)
        p.add_argument("--threads", type=int, default=0, help="accepted; tasks run as the session has cores")
    for name in ("export", "export-polygon"):
        p = verb(name)
        p.add_argument("--out-tsv")
        p.add_argument("--zoom", type=int, default=-1)
        for n in ("xmin", "xmax", "ymin", "ymax"):
            p.add_argument(f"--{n}", type=float)
        p.add_argument("--polygon")
        p.add_argument("--precision", type=int, default=3)
        if name == "export":
            p.add_argument("--out-json")
        else:
            p.add_argument("--columns")
            p.add_argument("--layer-name")
            p.add_argument("--remove-columns", default="lat,lon")
            p.add_argument("--missing-value", default="NA")
            p.add_argument("--write-vertices", action="store_true")
    p = verb("build-pyramid-pmtiles", "out")
    for n, kind, value in (("min-zoom", int, 0), ("max-tile-bytes", int, 500_000), ("max-tile-features", int, 50_000), ("threads", int, 0), ("scale-factor-compression", float, 10.0), ("est-bytes-per-column", int, 8), ("est-offset-per-point", int, 20)):
        p.add_argument(f"--{n}", type=kind, default=value)
    p.add_argument("--tmp-dir")
    p = verb("build-point-pmtiles", "out")
    for n, value in (("format", "MLT"), ("colname-x", "X"), ("colname-y", "Y"), ("delim", ",")):
        p.add_argument(f"--{n}", default=value)
    p.add_argument("--zoom", type=int, default=0)
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--tmp-dir")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    if a.verb == "summarize":
        for line in commands.summary_lines(a.source, a.hdr, a.meta, a.tile, a.all, spark):
            print(line)
        return 0
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    if a.verb == "count-tiles":
        sinks.write_tsv(counts.count_text(commands.count_tiles(spark, a.source, a.zoom)), a.out_tsv)
    elif a.verb.startswith("tile-density-stats"):
        run = commands.tile_density_stats_mt if a.verb.endswith("-mt") else commands.tile_density_stats
        sinks.write_tsv(density.density_text(run(spark, a.source, a.count, a.feature, a.compact, a.zoom)), a.out)
    elif a.verb == "export":
        if not (a.out_tsv or a.out_json):
            raise SystemExit("--out-tsv or --out-json is needed")
        points = commands.export(spark, a.source, a.zoom, a.xmin, a.xmax, a.ymin, a.ymax, a.polygon)
        names = points.columns[2:]
        if a.out_tsv:
            sinks.write_tsv(sinks.point_rows(points, names, a.precision), a.out_tsv)
        if a.out_json:
            sinks.write_lines(sinks.geojson_lines(points, names, a.precision), a.out_json)
    elif a.verb == "export-polygon":
        if not a.out_tsv:
            raise SystemExit("--out-tsv is needed")
        rows = commands.export_polygon(spark, a.source, a.columns.split(",") if a.columns else None, a.layer_name, tuple(a.remove_columns.split(",")), a.missing_value, a.write_vertices, a.zoom, a.xmin, a.xmax, a.ymin, a.ymax, a.polygon, a.precision)
        sinks.write_tsv(rows, a.out_tsv)
    elif a.verb == "build-pyramid-pmtiles":
        commands.build_pyramid(spark, a.source, a.out, a.min_zoom, a.max_tile_bytes, a.max_tile_features, a.scale_factor_compression, a.est_bytes_per_column, a.est_offset_per_point)
    else:
        commands.build_points(spark, a.source, a.out, a.format, a.zoom, a.colname_x, a.colname_y, a.delim)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
