"""Readers on files written here."""

import base64
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.operators import grid, mesh_probe, topology
from lattica.plans import views
from lattica.sources import catalog, datasets, ensight, files, ranges, surfaces, vtk_xml
from lattica.streaming import stats

XYZ = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)


def array(df, name):
    return np.array([r.value for r in df.where(F.col("array") == name).orderBy("file", "idx").collect()])


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", coords=XYZ, t=np.arange(10))
    np.savez(tmp_path / "b.npz", coords=XYZ + 1, t=np.arange(5))
    df = catalog.read(spark, str(tmp_path / "a.npz"), slices={"t": "{ts}::3"}, ts=1)
    assert np.array_equal(array(df, "coords"), XYZ) and array(df, "t")[:, 0].tolist() == [1, 4, 7]
    both = catalog.reader_for("x.npz")(spark, [str(tmp_path / "a.npz"), str(tmp_path / "b.npz")])
    joined = files.concatenated(both, "coords").orderBy("idx").collect()
    assert [r.idx for r in joined] == list(range(8)) and joined[4].value == [1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        catalog.reader_for("x.unknown")


def vtu(how):
    """One tetrahedron with a field, its arrays as text, base64, compressed base64 or appended."""
    appended, compressed = [], how == "zlib"

    def data(name, values, kind, width=1):
        raw = values.astype("<" + vtk_xml.TYPES[kind]).tobytes()
        attributes = f'type="{kind}" Name="{name}" NumberOfComponents="{width}"'
        if how == "ascii":
            return f'<DataArray {attributes} format="ascii">{" ".join(map(str, values.ravel()))}</DataArray>'
        if compressed:
            packed = zlib.compress(raw)
            head = struct.pack("<4I", 1, len(raw), 0, len(packed))
            return f'<DataArray {attributes} format="binary">{base64.b64encode(head).decode()}{base64.b64encode(packed).decode()}</DataArray>'
        whole = struct.pack("<I", len(raw)) + raw
        if how == "base64":
            return f'<DataArray {attributes} format="binary">{base64.b64encode(whole).decode()}</DataArray>'
        offset = sum(map(len, appended))
        appended.append(whole)
        return f'<DataArray {attributes} format="appended" offset="{offset}"/>'

    body = f"""<VTKFile type="UnstructuredGrid" byte_order="LittleEndian" header_type="UInt32"{' compressor="vtkZLibDataCompressor"' if compressed else ""}><UnstructuredGrid><Piece NumberOfPoints="4" NumberOfCells="1">
<Points>{data("xyz", XYZ, "Float64", 3)}</Points><Cells>{data("connectivity", np.arange(4), "Int64")}{data("offsets", np.array([4]), "Int64")}{data("types", np.array([10]), "UInt8")}</Cells>
<PointData>{data("T", np.array([1.5, 2.5, 3.5, 4.5]), "Float32")}</PointData></Piece></UnstructuredGrid>"""
    tail = b'<AppendedData encoding="raw">_' + b"".join(appended) + b"</AppendedData>" if appended else b""
    return body.encode() + tail + b"</VTKFile>"


@pytest.mark.parametrize("how", ["ascii", "base64", "zlib", "appended"])
def test_vtu(spark, tmp_path, how):
    (tmp_path / "m.vtu").write_bytes(vtu(how))
    df = catalog.read(spark, str(tmp_path / "m.vtu"))
    assert np.array_equal(array(df, "points"), XYZ) and array(df, "T")[:, 0].tolist() == [1.5, 2.5, 3.5, 4.5]
    assert [(r.cell_idx, r.local_idx, r.point_idx) for r in vtk_xml.cell_points(df).orderBy("local_idx").collect()] == [(0, n, n) for n in range(4)]
    assert [r.x for r in files.vectors(df, "points", ["x", "y", "z"], "point_idx").orderBy("point_idx").collect()] == [0.0, 1.0, 0.0, 0.0]


HEAD = 'FoamFile {{ version 2.0; format {how}; class {kind}; arch "LSB;label=32;scalar=64"; object {name}; }}\n'


def test_openfoam(spark, tmp_path):
    mesh = tmp_path / "polyMesh"
    mesh.mkdir()
    head = lambda how, kind, name: HEAD.format(how=how, kind=kind, name=name)
    (mesh / "points").write_text(head("ascii", "vectorField", "points") + "4\n(\n" + "\n".join(f"({a} {b} {c})" for a, b, c in XYZ) + "\n)\n")
    (mesh / "faces").write_text(head("ascii", "faceList", "faces") + "2\n(\n3(0 1 2)\n4(0 1 2 3)\n)\n")
    (mesh / "owner").write_bytes(head("binary", "labelList", "owner").encode() + b"2\n(" + np.array([0, 7], "<i4").tobytes() + b")\n")
    (mesh / "T").write_text(head("ascii", "volScalarField", "T") + "dimensions [0 0 0 1 0 0 0];\ninternalField nonuniform List<scalar>\n3\n(\n1.5\n2.5\n3.5\n)\n;\n")
    (mesh / "U").write_bytes(head("binary", "volVectorField", "U").encode() + b"internalField nonuniform List<vector> 4\n(" + XYZ.astype("<f8").tobytes() + b");\n")
    df = catalog.read(spark, str(mesh) + "/")
    assert np.array_equal(array(df, "points"), XYZ) and np.array_equal(array(df, "U"), XYZ)
    assert array(df, "faces")[:, 0].tolist() == [0, 1, 2, 0, 1, 2, 3] and array(df, "offsets")[:, 0].tolist() == [0, 3, 7]
    assert array(df, "owner")[:, 0].tolist() == [0, 7] and array(df, "T")[:, 0].tolist() == [1.5, 2.5, 3.5]


CASE = """FORMAT
type: ensight gold
GEOMETRY
model: 1 mesh***.geo
VARIABLE
scalar per node: 1 temperature temp***.scl
tensor asym per element: 1 stress stress.ten
TIME
time set: 1
number of steps: 2
filename start number: 3
filename increment: 2
time values: 0.5
1.5
"""


def test_ensight(spark, tmp_path):
    case = ensight.parse_case(CASE, offset=1.0)
    assert case.files(case.geometry) == [(1.5, "mesh003.geo"), (2.5, "mesh005.geo")] and case.variables["stress"] == ("tensor9", "cell", "stress.ten")
    line = lambda s: s.encode().ljust(80, b"\0")
    ints = lambda *v: np.array(v, "<i4").tobytes()
    geometry = b"".join([line("C Binary"), line("a"), line("b"), line("node id off"), line("element id off"), line("part"), ints(1), line("body"), line("coordinates"), ints(4), XYZ.T.astype("<f4").tobytes(), line("tetra4"), ints(1), ints(1, 2, 3, 4), line("nsided"), ints(1), ints(3), ints(1, 2, 3)])
    (tmp_path / "mesh.geo").write_bytes(geometry)
    df = catalog.read(spark, str(tmp_path / "mesh.geo"))
    assert np.array_equal(array(df, "part1_points"), XYZ) and array(df, "part1_tetra4").tolist() == [[0, 1, 2, 3]] and array(df, "part1_nsided")[:, 0].tolist() == [0, 1, 2]
    (tmp_path / "v").write_bytes(line("vectors") + line("part") + ints(1) + line("coordinates") + XYZ.T.astype("<f4").tobytes())
    got = ensight.read_variable(spark, str(tmp_path / "v"), "vector", "vertex", {(1, "coordinates"): 4})
    assert np.array_equal(array(got, "part1_coordinates"), XYZ)


def test_case_with_several_time_sets():
    text = """GEOMETRY
model: 2 grid*.geo change_coords_only
VARIABLE
scalar per node: 1 1 t temp**.scl
vector per node: 2 u u*.vec
scalar per element: p p.scl
TIME
time set: 1 fast
number of steps: 3
filename numbers: 4 8
15
time values: 0 0.5
1.0
time set: 2
number of steps: 2
filename start number: 7
filename increment: 1
time values:
0
1
"""
    case = ensight.parse_case(text)
    assert case.files(case.geometry, case.geometry_set) == [(0.0, "grid7.geo"), (1.0, "grid8.geo")]
    assert case.files("temp**.scl", case.variable_sets["t"]) == [(0.0, "temp04.scl"), (0.5, "temp08.scl"), (1.0, "temp15.scl")]
    assert case.files("u*.vec", case.variable_sets["u"]) == [(0.0, "u7.vec"), (1.0, "u8.vec")]
    assert case.variable_sets["p"] is None and case.files("p.scl", None) == [(0.0, "p.scl")]


PLY = """ply
format {} 1.0
comment made for this test
element vertex 5
property float x
property float y
property float z
property uchar red
property uchar green
property uchar blue
property double heat
element face {}
property list uchar int vertex_indices
property short flag
element edge 1
property int a
property int b
end_header
"""


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, form):
    """Faces of changing sizes, many in a row of one size, against the values that were written."""
    order = ">" if form.endswith("big_endian") else "<"
    points = [(0, 0, 0, 1, 2, 3, 0.5), (1, 0, 0, 4, 5, 6, 1.5), (1, 1, 0, 7, 8, 9, 2.5), (0, 1, 0, 10, 11, 255, 3.5), (2, 2, 1, 0, 0, 0, -4.5)]
    faces = [([0, 1, 2, 3], 7), ([0, 1, 4], -2), ([1, 2, 4], 5), ([], 6), *[([k % 5, (k + 1) % 5, (k + 2) % 5], k % 100) for k in range(3000)], ([0, 1, 2, 3, 4], 9)]
    if form == "ascii":
        lines = [" ".join(map(str, p)) for p in points] + [" ".join(map(str, [len(f), *f, flag])) for f, flag in faces] + ["3 4"]
        body = ("\n".join(lines) + "\n").encode()
    else:
        body = b"".join(struct.pack(f"{order}3f3Bd", *p) for p in points) + b"".join(struct.pack(f"{order}B{len(f)}ih", len(f), *f, flag) for f, flag in faces) + struct.pack(f"{order}2i", 3, 4)
    head = PLY.format(form, len(faces)).encode()
    (tmp_path / "a.ply").write_bytes(head + body)
    df = catalog.read(spark, str(tmp_path / "a.ply"))
    assert array(df, "points").tolist() == [list(p[:3]) for p in points] and array(df, "colors").tolist() == [list(p[3:6]) for p in points]
    assert array(df, "heat")[:, 0].tolist() == [p[6] for p in points] and array(df, "flag")[:, 0].tolist() == [flag for _, flag in faces]
    assert array(df, "counts")[:, 0].tolist() == [len(f) for f, _ in faces] and array(df, "faces")[:, 0].tolist() == [k for f, _ in faces for k in f]
    assert array(df, "edge_a")[0, 0] == 3 and array(df, "edge_b")[0, 0] == 4
    links = datasets.surface(df).cell_points.where("cell_idx < 2").orderBy("cell_idx", "local_idx").collect()
    assert [r.point_idx for r in links] == [0, 1, 2, 3, 0, 1, 4]
    with pytest.raises(ValueError, match="ends within"):
        list(surfaces.parse(head + body[: len(body) // 2], "a.ply"))
    with pytest.raises(ValueError, match="not a PLY"):
        list(surfaces.parse(b"solid", "a.ply"))


def test_surfaces(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\nf -3 -2 -1\n")
    assert array(catalog.read(spark, str(tmp_path / "a.obj")), "faces")[:, 0].tolist() == [0, 1, 2, 0, 1, 2]
    rows = np.zeros(1, np.dtype([("n", "<f4", 3), ("c", "<f4", (3, 3)), ("a", "<u2")]))
    rows["c"] = XYZ[:3]
    (tmp_path / "b.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 1) + rows.tobytes())
    df = catalog.read(spark, str(tmp_path / "b.stl"))
    assert len(array(df, "points")) == 3 and sorted(array(df, "faces")[0].tolist()) == [0, 1, 2]


def test_streamed_ranges(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df in (("ranges", stats.windowed_ranges(stream, "ts", "value", "1 day")), ("histogram", stats.windowed_histogram(stream, "ts", "value", 10, 0.0, 500.0, "1 day"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("ranges").agg(F.sum("n")).first()[0] == events.count() == spark.table("histogram").agg(F.sum("n")).first()[0]


def links(mesh):
    order = ["local_idx"] if "local_idx" in mesh.cell_points.columns else ["point_idx"]
    out = {}
    for r in mesh.cell_points.orderBy("cell_idx", *order).collect():
        out.setdefault(r.cell_idx, []).append(r.point_idx)
    return out


def test_unstructured_dataset_is_probed(spark, tmp_path):
    (tmp_path / "a.vtu").write_bytes(vtu("appended"))
    arrays = catalog.read(spark, str(tmp_path / "a.vtu"))
    mesh = datasets.with_fields(datasets.unstructured(arrays), arrays, ["T"])
    assert links(mesh) == {0: [0, 1, 2, 3]} and [r.cell_type for r in mesh.cells.collect()] == [10]
    cells = mesh.cells.join(mesh.cell_points.groupBy("cell_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("local_idx", "point_idx"))), lambda x: x["point_idx"]).alias("pts")), "cell_idx")
    samples = spark.createDataFrame([(0, 0.25, 0.25, 0.25)], "id long, x double, y double, z double")
    got = mesh_probe.probe_mesh(samples, "id", cells, mesh.points.withColumnRenamed("T", "value")).first()
    assert got.value == pytest.approx(3.0) and got.cell_idx == 0
    with pytest.raises(ValueError):
        datasets.with_fields(mesh, arrays, ["nothing"])
    with pytest.raises(ValueError):
        datasets.point_cloud(arrays, ["types"])
    assert datasets.point_cloud(arrays, ["T"]).count() == 4
    both = datasets.partitions([mesh, mesh])
    assert links(both) == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]} and sorted(r.piece_id for r in both.points.collect()) == [0] * 4 + [1] * 4


def test_polygon_image_and_structured_datasets(spark, tmp_path):
    ascii_ = lambda name, v, kind="Int64", n=1: f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="ascii">{" ".join(map(str, np.ravel(v)))}</DataArray>'
    part = lambda tag, c, o: f"<{tag}>{ascii_('connectivity', c)}{ascii_('offsets', o)}</{tag}>"
    (tmp_path / "p.vtp").write_text(f'<VTKFile type="PolyData" byte_order="LittleEndian"><PolyData><Piece><Points>{ascii_("xyz", XYZ, "Float64", 3)}</Points>{part("Verts", [3], [1])}{part("Lines", [0, 1, 2], [2, 3])}{part("Polys", [0, 1, 2], [3])}</Piece></PolyData></VTKFile>')
    mesh = datasets.polygons(catalog.read(spark, str(tmp_path / "p.vtp")))
    assert links(mesh) == {0: [3], 1: [0, 1], 2: [2], 3: [0, 1, 2]}
    assert [r.cell_type for r in mesh.cells.orderBy("cell_idx").collect()] == [1, 3, 3, 7]
    (tmp_path / "i.vti").write_text('<VTKFile type="ImageData" byte_order="LittleEndian"><ImageData WholeExtent="0 2 1 3 0 1" Origin="1 2 3" Spacing="0.5 1 2"><Piece/></ImageData></VTKFile>')
    assert datasets.image(catalog.read(spark, str(tmp_path / "i.vti"))) == grid.ImageGrid((1.0, 2.0, 3.0), (0.5, 1.0, 2.0), (0, 1, 0), (2, 3, 1))
    points = [(x, y, z) for z in range(2) for y in range(2) for x in range(3)]
    (tmp_path / "s.vts").write_text(f'<VTKFile type="StructuredGrid" byte_order="LittleEndian"><StructuredGrid WholeExtent="0 2 0 1 0 1"><Piece><Points>{ascii_("xyz", points, "Float64", 3)}</Points></Piece></StructuredGrid></VTKFile>')
    mesh = datasets.structured(catalog.read(spark, str(tmp_path / "s.vts")))
    assert links(mesh) == {0: [0, 1, 4, 3, 6, 7, 10, 9], 1: [1, 2, 5, 4, 7, 8, 11, 10]} and mesh.points.count() == 12


@pytest.mark.parametrize("binary", [False, True])
def test_legacy_vtk(spark, tmp_path, binary):
    def data(values, code):
        v = np.asarray(values, code)
        return v.astype(v.dtype.newbyteorder(">")).tobytes() + b"\n" if binary else (" ".join(map(str, v.ravel())) + "\n").encode()

    head = f"# vtk DataFile Version 3.0\nmesh\n{'BINARY' if binary else 'ASCII'}\n".encode()
    body = b"DATASET UNSTRUCTURED_GRID\nPOINTS 4 float\n" + data(XYZ, "f4") + b"CELLS 2 8\n" + data([4, 0, 1, 2, 3, 2, 0, 1], "i4") + b"CELL_TYPES 2\n" + data([10, 3], "i4")
    body += b"POINT_DATA 4\nSCALARS T double 1\nLOOKUP_TABLE default\n" + data([1.5, 2.5, 3.5, 4.5], "f8") + b"VECTORS v float\n" + data(XYZ + 1, "f4")
    body += b"CELL_DATA 2\nFIELD more 2\nT 1 2 int\n" + data([7, 8], "i4") + b"id 2 2 long\n" + data([[1, 2], [3, 4]], "i8")
    (tmp_path / "a.vtk").write_bytes(head + body)
    arrays = catalog.read(spark, str(tmp_path / "a.vtk"))
    mesh = datasets.with_fields(datasets.unstructured(arrays), arrays, ["T", "v", "id"])
    assert links(mesh) == {0: [0, 1, 2, 3], 1: [0, 1]} and [r.cell_type for r in mesh.cells.orderBy("cell_idx").collect()] == [10, 3]
    assert [(r["T"], r.v) for r in mesh.points.orderBy("point_idx").collect()] == [(t, list(p + 1)) for t, p in zip((1.5, 2.5, 3.5, 4.5), XYZ)]
    assert [r.id for r in mesh.cells.orderBy("cell_idx").collect()] == [[1, 2], [3, 4]]
    grid_ = b"DATASET STRUCTURED_POINTS\nDIMENSIONS 3 2 2\nORIGIN 1 2 3\nSPACING 1 1 2\nPOINT_DATA 12\nSCALARS a int\n" + data(range(12), "i4")
    (tmp_path / "b.vtk").write_bytes(head + grid_)
    assert datasets.image(catalog.read(spark, str(tmp_path / "b.vtk"))) == grid.ImageGrid((1.0, 2.0, 3.0), (1.0, 1.0, 2.0), (0, 0, 0), (2, 1, 1))
    new = b"DATASET POLYDATA\nPOINTS 4 float\n" + data(XYZ, "f4") + b"POLYGONS 3 7\nOFFSETS vtktypeint64\n" + data([0, 3, 7], "i8") + b"CONNECTIVITY vtktypeint64\n" + data([0, 1, 2, 0, 1, 3, 2], "i8")
    (tmp_path / "c.vtk").write_bytes(head + new)
    assert links(datasets.polygons(catalog.read(spark, str(tmp_path / "c.vtk")))) == {0: [0, 1, 2], 1: [0, 1, 3, 2]}


class Counting:
    """A file that counts the bytes it gives."""

    def __init__(self, f):
        self.f, self.read_bytes = f, 0

    def seek(self, *a):
        return self.f.seek(*a)

    def tell(self):
        return self.f.tell()

    def read(self, n=-1):
        got = self.f.read(n)
        self.read_bytes += len(got)
        return got


def large_vtu(codec, n=3000, block=1000):
    """Points, a vector and a scalar of many rows, appended raw: plain, or in blocks that cut rows."""
    rng = np.random.default_rng(3)
    data = {"xyz": rng.random((n, 3)), "V": rng.random((n, 3)).astype("<f4"), "T": np.arange(n, dtype="<i8")}
    parts, nodes = b"", {}
    for name, values in data.items():
        raw = values.tobytes()
        if codec:
            packed = [zlib.compress(raw[k : k + block]) if codec == "zlib" else pa.Codec("lz4_raw").compress(raw[k : k + block], asbytes=True) for k in range(0, len(raw), block)]
            some = np.array([len(packed), block, len(raw) % block, *map(len, packed)], "<u8").tobytes() + b"".join(packed)
        else:
            some = struct.pack("<Q", len(raw)) + raw
        kind = {"f8": "Float64", "f4": "Float32", "i8": "Int64"}[values.dtype.str[1:]]
        nodes[name] = f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{values.size // n}" format="appended" offset="{len(parts)}"/>'
        parts += some
    compressor = {"": "", "zlib": ' compressor="vtkZLibDataCompressor"', "lz4": ' compressor="vtkLZ4DataCompressor"'}[codec]
    head = f"""<VTKFile type="UnstructuredGrid" byte_order="LittleEndian" header_type="UInt64"{compressor}><UnstructuredGrid><Piece NumberOfPoints="{n}" NumberOfCells="0"><Points>{nodes["xyz"]}</Points><PointData>{nodes["V"]}{nodes["T"]}</PointData></Piece></UnstructuredGrid><AppendedData encoding="raw">_"""
    return head.encode() + parts + b"</AppendedData></VTKFile>", data


@pytest.mark.parametrize("codec", ["", "zlib", "lz4"])
def test_parts_of_a_vtu(spark, tmp_path, codec):
    """Several tasks for one array; others and rows that nobody asks for are not read."""
    content, data = large_vtu(codec)
    path = tmp_path / "large.vtu"
    path.write_bytes(content)
    df = ranges.read_ranges(spark, str(path), ["V", "T"], {"T": "100:{end}:7"}, part=4000, end=2500)
    assert df.rdd.getNumPartitions() > 9 and {r.array for r in df.select("array").distinct().collect()} == {"V", "T"}
    assert np.allclose(array(df, "V"), data["V"]) and array(df, "T")[:, 0].tolist() == list(range(100, 2500, 7))
    assert [r.idx for r in df.where("array = 'T'").orderBy("idx").collect()] == list(range(len(range(100, 2500, 7))))
    whole = ranges.read_ranges(spark, str(path))
    assert np.array_equal(array(whole, "points"), data["xyz"]) and whole.where("array = 'points' and association = 'points'").count() == 3000
    held = {a.name: a for a in ranges.plan(str(path))}
    with open(path, "rb") as f:
        counted = Counting(f)
        some = list(ranges.units(str(path), held["T"], (slice(1000, 1100),), 400))
        got = np.concatenate([ranges.values(counted, u) for u in some])
        assert got[:, 0].tolist() == list(range(1000, 1100)) and len(some) == 2
        assert counted.read_bytes <= (800 if not codec else 3 * 1100) < len(content) / 20
        counted.read_bytes = 0
        f.seek(0)
        list(ranges.plan_vtk(counted))
        assert counted.read_bytes < len(content) if not codec else counted.read_bytes <= len(content) + 3000


def test_parts_of_numpy_files(spark, tmp_path):
    cube = np.arange(400 * 6 * 5, dtype=">f4").reshape(400, 6, 5)
    np.savez(tmp_path / "a.npz", cube=cube, one=np.int16(7), names=np.arange(9))
    np.save(tmp_path / "b.npy", cube[:, 0])
    df = ranges.read_ranges(spark, str(tmp_path / "a.npz"), ["cube", "one"], {"cube": "10:390:3, 1:5:2, -2:"}, part=2000)
    want = cube[10:390:3, 1:5:2, -2:].reshape(127, -1)
    assert np.array_equal(array(df, "cube"), want) and array(df, "one").tolist() == [[7.0]] and df.rdd.getNumPartitions() > 20
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = ranges.read_ranges(spark, str(tmp_path / "a.npz"), part=2000).where("array = 'names'")
        assert pushed.count() == 9 and pushed.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert np.array_equal(array(ranges.read_ranges(spark, [str(tmp_path / "b.npy")] , part=999), "data"), cube[:, 0])
    np.savez_compressed(tmp_path / "c.npz", cube=cube)
    np.save(tmp_path / "d.npy", np.asfortranarray(cube))
    (tmp_path / "e.vtu").write_bytes(vtu("base64"))
    for name in ("c.npz", "d.npy", "e.vtu"):
        with pytest.raises(ranges.NoRanges):
            ranges.read_ranges(spark, str(tmp_path / name))


CUBE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


def test_polyhedra_of_a_vtu_are_probed(spark):
    """A tetrahedron between two polyhedra: a cube, and a wedge on its right side."""
    at = [*CUBE, (2, 0, 0), (2, 0, 1)]
    cube, wedge = topology.FACES[12], [(1, 5, 9, 8), (2, 8, 9, 6), (1, 2, 6, 5), (1, 8, 2), (5, 6, 9)]
    stream = lambda faces: [len(faces), *(x for f in faces for x in (len(f), *f))]
    streams = stream(cube) + stream(wedge)
    arrays = rows(spark, points=at, types=[42, 10, 42], offsets=[8, 12, 18], connectivity=[*range(8), 0, 1, 3, 4, 1, 2, 5, 6, 8, 9], faces=streams, faceoffsets=[len(stream(cube)), -1, len(streams)])
    faces = datasets.polyhedra(arrays)
    got = {(r.cell_idx, r.face_idx): tuple(r.face_pts) for r in faces.collect()}
    assert got == {(0, k): f for k, f in enumerate(cube)} | {(2, k): f for k, f in enumerate(wedge)}
    mesh = datasets.unstructured(arrays)
    value = mesh.points.withColumn("value", F.expr("x + 2 * y - z"))
    cells = mesh.cells.join(topology.unstructured(mesh.points, mesh.cell_points), "cell_idx")
    samples = spark.createDataFrame([(0, 0.9, 0.8, 0.7), (1, 1.3, 0.2, 0.5), (2, 1.9, 0.9, 0.5)], "id long, x double, y double, z double")
    hits = {r.id: (r.cell_idx, r.mask, round(r.value, 6)) for r in mesh_probe.probe_mesh(samples, "id", cells, value, faces).collect()}
    assert hits == {0: (0, 1, 1.8), 1: (2, 1, 1.2), 2: (None, 0, 0.0)}


def test_nsided_and_nfaced_pieces(spark, tmp_path):
    line = lambda s: s.encode().ljust(80, b"\0")
    ints = lambda *v: np.array(v, "<i4").tobytes()
    up = lambda faces: [x + 1 for f in faces for x in f]
    cube = topology.FACES[12]
    pyramid = [(4, 5, 6, 7), (4, 8, 5), (5, 8, 6), (6, 8, 7), (7, 8, 4)]
    at = np.array([*CUBE, (0.5, 0.5, 2)])
    body = [line("coordinates"), ints(9), at.T.astype("<f4").tobytes(), line("nsided"), ints(2, 3, 4), ints(1, 2, 3, 1, 2, 3, 4), line("nfaced"), ints(2, 6, 5), ints(*[len(f) for f in (*cube, *pyramid)]), ints(*up(cube), *up(pyramid)), line("tria3"), ints(1, 1, 2, 4)]
    (tmp_path / "m.geo").write_bytes(b"".join([line("C Binary"), line("a"), line("b"), line("node id off"), line("element id off"), line("part"), ints(3), line("body"), *body]))
    arrays = catalog.read(spark, str(tmp_path / "m.geo"))
    mesh, faces = datasets.part(arrays, 3), datasets.part_faces(arrays, 3)
    assert {r.cell_idx: r.cell_type for r in mesh.cells.collect()} == {0: 5, 1: 7, 2: 7, 3: 42, 4: 42}
    assert links(mesh) == {0: [0, 1, 3], 1: [0, 1, 2], 2: [0, 1, 2, 3], 3: list(range(8)), 4: list(range(4, 9))}
    assert {(r.cell_idx, r.face_idx): tuple(r.face_pts) for r in faces.collect()} == {(3, k): f for k, f in enumerate(cube)} | {(4, k): f for k, f in enumerate(pyramid)}
    solid = mesh.cells.where("cell_type = 42")
    samples = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 0.5, 0.5, 1.5), (2, 0.9, 0.9, 1.9)], "id long, x double, y double, z double")
    value = mesh.points.withColumn("value", F.col("z"))
    hits = {r.id: (r.cell_idx, round(r.value, 6)) for r in mesh_probe.probe_mesh(samples, "id", solid, value, faces).collect()}
    assert hits == {0: (3, 0.5), 1: (4, 1.5), 2: (None, 0.0)}


def rows(spark, **arrays):
    made = [("f", name, "none", i, [float(v) for v in np.ravel(x)]) for name, values in arrays.items() for i, x in enumerate(values)]
    return spark.createDataFrame(made, files.ROWS)


def test_fields_of_several_arrays(spark):
    made = [("f", name, association, i, [float(v)] * width) for name, association, width in (("a", "vertex", 1), ("b", "vertex", 1), ("c", "cell", 1), ("d", "vertex", 3)) for i, v in enumerate((1, 2))]
    arrays = spark.createDataFrame(made, files.ROWS)
    assert {r.idx: r.value for r in datasets.field(arrays, ["b", "a"]).collect()} == {0: [1.0, 1.0], 1: [2.0, 2.0]}
    assert {r.idx: len(r.value) for r in datasets.field(arrays, ["d"]).collect()} == {0: 3, 1: 3}
    for wrong in (["a", "c"], ["a", "d"], ["x"]):
        with pytest.raises(ValueError):
            datasets.field(arrays, wrong)


def test_poly_mesh_and_surface_datasets(spark, tmp_path):
    tets = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)]
    arrays = rows(spark, points=XYZ, offsets=[0, 3, 6, 9, 12], faces=[p for f in tets for p in f], owner=[0, 0, 0, 0], neighbour=[-1])
    mesh, faces = datasets.poly_mesh(arrays, arrays, arrays, arrays)
    assert links(mesh) == {0: [0, 1, 2, 3]} and sorted(tuple(r.face_pts) for r in faces.collect()) == sorted(tets)
    assert datasets.boundary(faces, 1, 2).count() == 2
    samples = spark.createDataFrame([(0, 0.1, 0.2, 0.3)], "id long, x double, y double, z double")
    value = mesh.points.withColumn("value", F.expr("x + 2 * y - z"))
    assert mesh_probe.probe_mesh(samples, "id", mesh.cells, value, faces).first().value == pytest.approx(0.2)
    (tmp_path / "a.obj").write_text("v 0 0 0 1 0 0\nv 1 0 0 0 1 0\nv 0 1 0 0 0 1\nv 1 1 0 1 1 1\nvn 0 0 1\nf 1//1 2//1 4//1 3//1\nf 1 2 3\n")
    surface = catalog.read(spark, str(tmp_path / "a.obj"))
    assert links(datasets.surface(surface)) == {0: [0, 1, 3, 2], 1: [0, 1, 2]}
    assert array(surface, "colors").tolist()[3] == [1, 1, 1] and array(surface, "face_normals")[:, 0].tolist() == [0, 0, 0, 0, -1, -1, -1]
    assert datasets.related({"a": ["b", "c"], "b": ["c", "a"], "c": ["d"]}, ["a"]) == ["a", "b", "c", "d"]


def test_case_in_time(spark, tmp_path):
    line = lambda s: s.encode().ljust(80, b"\0")
    ints = lambda *v: np.array(v, "<i4").tobytes()
    for n, shift in ((3, 0), (5, 1)):
        (tmp_path / f"mesh00{n}.geo").write_bytes(b"".join([line("C Binary"), line("a"), line("b"), line("node id off"), line("element id off"), line("part"), ints(1), line("body"), line("coordinates"), ints(4), (XYZ.T + shift).astype("<f4").tobytes(), line("tetra4"), ints(1), ints(1, 2, 3, 4)]))
    (tmp_path / "x.case").write_text(CASE)
    df = catalog.read(spark, str(tmp_path / "x.case"))
    assert sorted(r.t for r in df.select("t").distinct().collect()) == [0.5, 1.5]
    mesh = datasets.part(df.where("t = 1.5"), 1)
    assert links(mesh) == {0: [0, 1, 2, 3]} and mesh.points.agg(F.min("x")).first()[0] == 1.0


def test_views_of_lines_and_volumes(spark):
    space = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0, 0, 0), (8, 4, 4))
    nodes = grid.grid_points(spark, space).withColumn("heat", F.expr("2 * x - y + z"))
    flow = nodes.select("i", "j", "k", F.lit(2.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    seeds = spark.createDataFrame([(0, 1.0, 2.0, 1.5), (1, 7.9, 2.0, 1.5)], "seed_idx long, x double, y double, z double")
    got = views.streamlines(seeds, flow, nodes, space, ["heat"], "forward", longest=3.0).collect()
    assert {r.seed_idx for r in got} == {0} and max(r.x for r in got) <= 4.0 and sorted(r.seq for r in got) == list(range(len(got)))
    assert all(r.probed_heat == pytest.approx(2 * r.x - r.y + r.z) for r in got)
    voxels, held = views.volume(nodes.withColumnRenamed("heat", "value"), space, 16, ((0.0, 0.0, 0.0), (4.0, 4.0, 4.0)), background=-1.0)
    sure = [r for r in voxels.collect() if r.mask]
    at = lambda r: [(c + 0.5) * held.spacing[0] for c in (r.i, r.j, r.k)]
    assert len(sure) > 1000 and all(r.value == pytest.approx(2 * at(r)[0] - at(r)[1] + at(r)[2]) for r in sure)
    assert {r.value for r in voxels.where("mask = 0").collect()} == {-1.0}
    around = grid.point_links(spark, space)
    assert around.count() == 8 * 4 * 4 * 8 and around.groupBy("point_idx").count().agg(F.max("count")).first()[0] == 8
