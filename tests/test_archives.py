import functools
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.functions.projection import HALF, scale
from gridloom.operators import build, commands, density, pyramid
from gridloom.sources import archive, mvt, tiles
from gridloom.sources.archive import Entry

N = 400


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "spots.v1.csv"
    lines = ["X,Y,gene,count,share,note"]
    for i in range(N):
        x, y = (i * 7919) % 3601 * 1e4 - 18e6, (i * 104729) % 3583 * 1e4 - 17.9e6
        note = "NA" if i % 3 else f"é{i}"
        lines.append(f"{x},{y},g{i % 7},{i % 5},{'' if i % 4 == 0 else i / 8},{note}")
    lines += ["abc,1,g,1,1,x", "1,,g,1,1,x", "12abc,5,g1,2,0.5,y", "5e7,0,g1,1,1,z"]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module", params=["MLT", "MVT"])
def built(request, spark, csv, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / f"{request.param}.archive")
    header = commands.build_points(spark, csv, out, request.param, zoom=3)
    return out, header, request.param


def test_build_and_export(spark, built):
    out, header, codec = built
    found = archive.open_archive(out)
    assert header["points"] == N + 1 and header["outside"] == 1 and found.codec == codec.lower()
    assert found.metadata["vector_layers"][0] == {"id": "spots.v1", "fields": {"gene": "String", "count": "Number", "share": "Number", "note": "String"}, "minzoom": 3, "maxzoom": 3}
    assert found.header["clustered"] == 1 and found.header["min_zoom"] == found.header["center_zoom"] == 3 and found.header["max_lon_e7"] > found.header["min_lon_e7"]
    rows = commands.export(spark, out).toPandas()
    assert len(rows) == N + 1 and list(rows.columns) == ["gx", "gy", "gene", "count", "share", "note"]
    own = {(round(((i * 7919) % 3601 * 1e4 - 18e6) / scale(3)), round(((i * 104729) % 3583 * 1e4 - 17.9e6) / scale(3))): i for i in range(N)}
    hits = 0
    for r in rows.itertuples():
        near = [own.get((round(r.gx / scale(3)) + a, round(r.gy / scale(3)) + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        hits += any(i is not None and r.gene == f"g{i % 7}" and float(r.count) == i % 5 for i in near)
    assert hits >= N
    assert rows["note"].isna().sum() == sum(1 for i in range(N) if i % 3) and rows["share"].isna().sum() == N // 4


def test_filters_reach_the_directory(spark, built):
    out = built[0]
    plan = tiles.read_tiles(spark, out).where("z = 3 and x >= 2 and x <= 5")._jdf.queryExecution().executedPlan().toString()
    assert ">= 2" not in plan and "= 3" not in plan
    some = commands.export(spark, out, xmin=-5e6, xmax=5e6)
    every = commands.export(spark, out)
    assert some.count() == every.where("gx between -5e6 and 5e6").count() > 0
    ring = [(-1e7, -1e7), (1e7, -8e6), (5e6, 9e6), (-1e7, -1e7)]
    assert 0 < commands.export(spark, out, polygon=[ring]).count() < every.count()
    with pytest.raises(ValueError):
        commands.export(spark, out, zoom=7)


def test_counts_and_densities(spark, built):
    out = built[0]
    rows = commands.count_tiles(spark, out).collect()
    assert sum(r["tile_count"] for r in rows) == N + 1 and all(r["zoom"] == 3 for r in rows)
    assert commands.count_tiles(spark, out, 9).count() == 0
    st, mt = commands.tile_density_stats(spark, out), commands.tile_density_stats_mt(spark, out)
    assert st.agg(F.max("width")).first()[0] == 1 << 19 and mt.agg(F.max("width")).first()[0] == 1 << 12
    sums = mt.where("tile_x is null").groupBy("width").agg(F.sum(F.col("num_pts") * F.col("num_grids")).alias("s")).select("s").distinct().collect()
    assert len(sums) == 1 and st.where("num_pts = 0").count() > 0 and mt.where("num_pts <= 0").count() == 0
    compact = commands.tile_density_stats_mt(spark, out, compact=True)
    assert compact.exceptAll(mt.where("tile_x is null")).count() == 0
    with pytest.raises(Exception, match="lacks"):
        commands.tile_density_stats(spark, out, feature="nothing").collect()


def test_pyramid(spark, built, tmp_path):
    source, _, codec = built
    out = str(tmp_path / "p")
    kept = commands.build_pyramid(spark, source, out, 0, max_tile_features=25)
    assert kept[3] == N + 1 and kept[2] <= kept[3] and kept[0] <= 25 and all(kept[z] > 0 for z in range(4))
    again = commands.build_pyramid(spark, source, str(tmp_path / "q"), 0, max_tile_features=25)
    assert again == kept and (tmp_path / "p").read_bytes() == (tmp_path / "q").read_bytes()
    found = archive.open_archive(out)
    assert found.header["min_zoom"] == 0 and found.header["clustered"] == 0 and found.metadata["vector_layers"][0]["minzoom"] == 0
    rows = commands.count_tiles(spark, out).collect()
    root = next(r for r in rows if r["zoom"] == 0)
    assert root["total_count"] == N + 1 and root["tile_count"] == kept[0] and abs(root["frac_in_tile"] - kept[0] / (N + 1)) < 1e-12
    # what is kept at a zoom is kept at the next
    at = [{(r["gene"], r["note"], r["share"]) for r in commands.export(spark, out, zoom=z).collect()} for z in range(4)]
    assert all(at[z] <= at[z + 1] for z in range(3))
    small = commands.build_pyramid(spark, source, str(tmp_path / "r"), 2, max_tile_bytes=60)
    assert small[2] < N


def test_summary(spark, built, capsys):
    out = built[0]
    header, metadata, listing = commands.summarize(spark, out)
    assert header.first()["max_zoom"] == 3 and metadata["name"] == "spots.v1" and listing.count() == header.first()["addressed_tiles_count"]
    assert cli.main(["summarize", "--in", out, "--hdr"]) == 0 and "max_zoom: 3" in capsys.readouterr().out
    with pytest.raises(ValueError):
        commands.summary_text(out)


def test_command_line(spark, built, csv, tmp_path):
    out = built[0]
    cli.main(["export", "--in", out, "--out-tsv", str(tmp_path / "t"), "--out-json", str(tmp_path / "j"), "--precision", "1"], spark)
    lines = spark.read.text(str(tmp_path / "t")).collect()
    assert any(r[0] == "X\tY\tgene\tcount\tshare\tnote" for r in lines)
    assert spark.read.json(str(tmp_path / "j")).where("geometry.type = 'Point'").count() == N + 1
    cli.main(["count-tiles", "--in", out, "--out-tsv", str(tmp_path / "c")], spark)
    assert "frac_in_tile" in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "c")).columns
    cli.main(["tile-density-stats-mt", "--in", out, "--out", str(tmp_path / "d")], spark)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "d")).where("tile_x = 'ALL'").count() > 0
    cli.main(["build-point-pmtiles", "--in", csv, "--out", str(tmp_path / "b"), "--zoom", "1"], spark)
    cli.main(["build-pyramid-pmtiles", "--in", str(tmp_path / "b"), "--out", str(tmp_path / "y")], spark)
    assert archive.open_archive(str(tmp_path / "y")).header["min_zoom"] == 0
    with pytest.raises(SystemExit):
        cli.main(["export", "--in", out], spark)


class Ranged(http.server.SimpleHTTPRequestHandler):
    busy = 2

    def do_GET(self):  # noqa: N802
        if Ranged.busy:
            Ranged.busy -= 1
            self.send_error(503)
            return
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        with open(self.translate_path(self.path), "rb") as f:
            f.seek(a)
            data = f.read(b - a + 1)
        self.send_response(206)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_remote_ranges(built, monkeypatch):
    out = built[0]
    folder, _, name = out.rpartition("/")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Ranged, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Ranged.busy = 2
    found = archive.open_archive(f"http://127.0.0.1:{server.server_port}/{name}")
    assert found.entries == archive.open_archive(out).entries
    monkeypatch.setattr(archive.RangeReader, "_size", lambda self: 1)
    assert archive.RangeReader("s3://b/k/x").path == "https://b.s3.amazonaws.com/k/x"
    server.shutdown()


def test_polygons(spark, tmp_path):
    ring = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]
    tile = mvt.encode_polygons("shapes", [[ring], [ring, ring], [[(4000, 4000), (4090, 4000), (4000, 4090)]]], [{"cell": "a", "lat": 1}, {"cell": "b"}, {"area": 2.5}])
    data = archive.compress(tile)
    front = archive.front_of({"tile_type": 1, "tile_compression": 2}, {"vector_layers": [{"id": "shapes", "fields": {"cell": "String", "area": "Number", "lat": "Number"}}]}, [Entry(0, 0, len(data))])
    path = tmp_path / "polygons"
    path.write_bytes(front + data)
    rows = commands.export_polygon(spark, str(path), write_vertices=True).collect()
    assert [r.asDict().keys() for r in rows][0] == {"X": 0, "Y": 0, "Vertices": 0, "cell": 0, "area": 0}.keys() and len(rows) == 2
    first = next(r for r in rows if r["cell"] == "a")
    assert first["area"] == "NA" and first["Vertices"].count("[") == 5 and abs(float(first["X"]) - (-HALF + 500 * scale(0))) < 0.1
    assert commands.export_polygon(spark, str(path), xmin=0, missing_value="-").collect()[0]["cell"] == "-"
    assert commands.export_polygon(spark, str(path), unique_by="cell").count() == 2
    with pytest.raises(mvt.TileError):
        tiles.read_polygons(tiles.read_tiles(spark, str(path)), "mlt")
    with pytest.raises(Exception, match="not a single point"):
        commands.export(spark, str(path)).collect()


def test_type_lattice(spark):
    rows = spark.createDataFrame([("1", "1", "", "x", "9223372036854775808", "1", "nan"), ("-2", "0x10", "NA", "1", "1", "1e999", "inf"), ("NA", "2.5abc", None, "", "2", "1", "3")], "a string, b string, c string, d string, e string, f string, g string")
    found = {r["column"]: (r["type"], r["nullable"]) for r in build.infer_types(rows, list("abcdefg")).collect()}
    assert found == {"a": ("INT", True), "b": ("FLOAT", False), "c": ("INT", True), "d": ("STRING", True), "e": ("FLOAT", False), "f": ("STRING", False), "g": ("FLOAT", False)}
    b = [r[0] for r in rows.select(build.value_of("b", "FLOAT")).collect()]
    assert b == [1.0, 16.0, 2.5]


def test_density_of_negative_pixels(spark):
    rows = spark.createDataFrame([(0, 0, 0, -1, -1, 5), (0, 0, 0, 0, 0, 2)], "z int, tx long, ty long, px int, py int, cnt int")
    found = density.bin_sums(rows, 3, False).where("i = 2").collect()
    assert {(r["bx"], r["by"], r["s"]) for r in found} == {(-1, -1, 5), (0, 0, 2)}


def test_pyramid_arithmetic(spark):
    parents = spark.createDataFrame([(1000, 9_000_000), (10, 50)], "n long, est long")
    r = pyramid.level_ratio(parents, 500_000, 400).first()
    assert r["ratio"] == 0.4
    caps = [x[0] for x in parents.select(pyramid.tile_cap(F.col("n"), F.lit(r["ratio"]))).collect()]
    assert caps == [400, 4]
    assert spark.range(1).select(pyramid.column_cap(F.lit(1000).cast("long"), 3, 1000, 10.0)).first()[0] == int(10_000 / 44 * 0.95)


def _archive_of(spark, path, codec, blobs, zoom, fields):
    from gridloom.sources.writer import write_archive

    rows = spark.createDataFrame([(k, bytearray(archive.compress(d))) for k, d in blobs.items()], "tile_id long, data binary")
    header = {"tile_compression": 2, "tile_type": archive.TILE_TYPES[codec], "min_zoom": zoom, "max_zoom": zoom}
    write_archive(rows, path, header, {"name": "n", "vector_layers": [{"id": "cells", "fields": fields, "minzoom": zoom, "maxzoom": zoom}]})


def _tile_bytes(path):
    found = archive.open_archive(path)
    with archive.RangeReader(path) as reader:
        return {(z, x, y): reader.read(at, n) for z, x, y, _, at, n in found.tiles()}


def test_pyramid_keeps_layers_and_values(spark, tmp_path):
    """Two layers with fields of their own, whole numbers above 2**24 and doubles come through as they are."""
    from gridloom.functions.tileid import id_of
    from gridloom.sources.wire import field, put_varint

    def double(v):
        import struct

        return field(3, 1, struct.pack("<d", v))

    def long(v):
        return field(4, 0, put_varint(v))

    big = [16777217, 16777219, 16777221]
    cells = mvt.encode_raw("cells", [1, 2, 3], [5, 6, 7], [[("c", long(v)), ("d", double(0.1 + v))] for v in big])
    genes = mvt.encode_raw("genes", [9, 10], [9, 10], [[("g", field(1, 2, b"a"))], [("g", field(1, 2, b"b"))]])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _archive_of(spark, source, "mvt", {id_of(2, 1, 2): cells + genes, id_of(2, 0, 3): genes}, 2, {"c": "Number", "d": "Number"})
    assert commands.build_pyramid(spark, source, out, 0) == {2: 7, 1: 7, 0: 7}
    before, after = _tile_bytes(source), _tile_bytes(out)
    assert all(after[k] == v for k, v in before.items())
    for z, x, y in after:
        layers = {layer.name: layer for layer in mvt.decode(archive.decompress(after[z, x, y], 2))}
        if "cells" in layers:
            assert [f.attrs for f in layers["cells"].features] == [{"c": v, "d": 0.1 + v} for v in big]
    root = {layer.name: layer for layer in mvt.decode(archive.decompress(after[0, 0, 0], 2))}
    assert sorted(f.attrs["g"] for f in root["genes"].features) == ["a", "a", "b", "b"] and len(root) == 2


def test_pyramid_keeps_column_types(spark, tmp_path):
    from gridloom.functions.tileid import id_of
    from gridloom.sources import mlt

    big = [16777217, 16777219, 16777221]
    columns, types = {"i": big, "f": [0.5, None, 2.5], "s": ["é", None, ""], "none": [None] * 3}, {"i": "int", "f": "float", "s": "string", "none": "int"}
    tile = mlt.encode_layer("cells", [1, 2, 3], [4, 5, 6], columns, types)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _archive_of(spark, source, "mlt", {id_of(2, 1, 2): tile, id_of(2, 3, 3): tile}, 2, {"i": "Number"})
    commands.build_pyramid(spark, source, out, 0)
    for (z, _, _), raw in _tile_bytes(out).items():
        layer = mlt.decode(archive.decompress(raw, 2))
        times = 2 if z == 0 else 1
        assert layer.types == types and list(layer.columns) == list(types) and layer.nullable == {"i": False, "f": True, "s": True, "none": True}
        assert layer.columns["i"] == big * times and layer.columns["s"] == ["é", None, ""] * times and layer.columns["f"] == [0.5, None, 2.5] * times


def test_single_files(spark, built, tmp_path):
    import gzip

    out = built[0]
    cli.main(["export", "--in", out, "--out-tsv", str(tmp_path / "t.tsv.gz")], spark)
    lines = gzip.decompress((tmp_path / "t.tsv.gz").read_bytes()).decode().splitlines()
    assert lines[0].startswith("X\tY\tgene") and len(lines) == N + 2
    cli.main(["count-tiles", "--in", out, "--out-tsv", str(tmp_path / "c.tsv")], spark)
    rows = [tuple(map(int, line.split("\t")[:3])) for line in (tmp_path / "c.tsv").read_text().splitlines()[1:]]
    assert rows == sorted(rows) and rows


def test_leaves_outside_the_filter_are_not_read(spark, tmp_path, monkeypatch):
    sizes = [k * k % 997 + 1 for k in range(30_000)]
    entries = [Entry(k, sum(sizes[max(0, k - 1) : k]) + 2000 * k, n) for k, n in enumerate(sizes)]
    monkeypatch.setattr(archive, "ROOT_LIMIT", 200)
    path = str(tmp_path / "many")
    with open(path, "wb") as f:
        f.write(archive.front_of({"tile_type": 1, "tile_compression": 1, "max_zoom": 9}, {}, entries))
    reads = []
    real = archive.RangeReader.read
    monkeypatch.setattr(archive.RangeReader, "read", lambda self, at, n: reads.append(n) or real(self, at, n))
    assert len(archive.open_archive(path).entries) == 30_000
    every = len(reads)
    reads.clear()
    assert [e.tile_id for e in archive.open_archive(path, 100, 103).entries] == [100, 101, 102, 103]
    assert len(reads) < every
