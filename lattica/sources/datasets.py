"""Arrays that a reader gave, as meshes in normal form.

Each function takes the rows of one file or case (file, array, association, idx, value)
and returns a ``MeshDataset`` lazily; ids count from 0 in the order of the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import MeshDataset
from ..operators import grid
from ..operators.scan import dense_index, prefix_sum
from .vtk_xml import cell_points

#: Published numbers of the cell types of polygon data: vertex, line, polygon, and of polyhedra; fixed values.
VERTEX, LINE, POLYGON, POLYHEDRON = 1, 3, 7, 42
#: Published cell types of element names, and the order in which a part's pieces are numbered; fixed values.
ELEMENTS = {"point": 1, "bar2": 3, "tria3": 5, "quad4": 9, "tetra4": 10, "hexa8": 12, "penta6": 13, "pyramid5": 14}
XYZ = ("x", "y", "z")


def _of(arrays: DataFrame, name: str) -> DataFrame:
    return arrays.where(F.col("array") == name)


def _scalar() -> Column:
    return F.col("value")[0]


def _points(arrays: DataFrame, name: str = "points") -> DataFrame:
    return _of(arrays, name).select(F.col("idx").alias("point_idx"), *[F.col("value")[i].alias(a) for i, a in enumerate(XYZ)])


def with_fields(mesh: MeshDataset, arrays: DataFrame, names: list[str]) -> MeshDataset:
    """The mesh with arrays as columns of its points or cells, by their association; a vector stays an array."""
    found = arrays.where(F.col("array").isin(names)).groupBy("array", "association").agg(F.max(F.size("value")).alias("width")).collect()
    # A name that both have is taken from the points; what only cells have comes from them.
    held = {r.array: (r.association, r.width) for r in sorted(found, key=lambda r: r.association == "vertex")}
    if missing := sorted(set(names) - set(held)):
        raise ValueError(f"no arrays {missing}")
    for name in names:
        association, width = held[name]
        if association not in ("vertex", "cell"):
            raise ValueError(f"{name} belongs to {association}, not to points or cells")
        key, table = ("point_idx", mesh.points) if association == "vertex" else ("cell_idx", mesh.cells)
        column = _of(arrays, name).where(F.col("association") == association).select(F.col("idx").alias(key), (_scalar() if width == 1 else F.col("value")).alias(name))
        mesh = mesh.with_points(table.join(column, key, "left")) if association == "vertex" else mesh.with_cells(table.join(column, key, "left"))
    return mesh


def field(arrays: DataFrame, names: list[str]) -> DataFrame:
    """One field (idx, value: an array) of an array as it is, or of several arrays of one
    component each, in the given order. Arrays of different associations are no field."""
    found = {(r.array, r.association): r.width for r in arrays.where(F.col("array").isin(names)).groupBy("array", "association").agg(F.max(F.size("value")).alias("width")).collect()}
    if missing := sorted(set(names) - {a for a, _ in found}):
        raise ValueError(f"no arrays {missing}")
    if len({association for _, association in found}) > 1:
        raise ValueError(f"{names} belong to points and to cells")
    rows = arrays.where(F.col("array").isin(names))
    if len(names) == 1:
        return rows.select("idx", "value")
    if wide := sorted(a for (a, _), width in found.items() if width != 1):
        raise ValueError(f"{wide} have several components")
    parts = [F.max(F.when(F.col("array") == n, F.col("value")[0])) for n in names]
    return rows.groupBy("idx").agg(F.array(*parts).alias("value"))


def point_cloud(arrays: DataFrame, names: list[str], points: str = "points") -> DataFrame:
    """A declared cloud: its points with fields of points; a field of anything else is an error."""
    wrong = [r.array for r in arrays.where(F.col("array").isin(names) & (F.col("association") != "vertex")).select("array").distinct().collect()]
    if wrong:
        raise ValueError(f"a cloud has fields of points only, not {sorted(wrong)}")
    no_cells = arrays.limit(0).select(F.col("idx").alias("cell_idx"), F.col("idx").alias("point_idx"))
    return with_fields(MeshDataset(_points(arrays, points), no_cells.select("cell_idx"), no_cells), arrays, names).points


def unstructured(arrays: DataFrame) -> MeshDataset:
    """An unstructured grid: points, connectivity, ends of cells and types."""
    cells = _of(arrays, "types").select(F.col("idx").alias("cell_idx"), _scalar().cast("int").alias("cell_type"))
    return MeshDataset(_points(arrays), cells, cell_points(arrays).drop("file"))


def _taken(spans: DataFrame, flat: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys and the numbers of a flat array (idx, value) at [start, end) of each span, in order."""
    at = spans.where("end > start").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    met = at.join(flat.select("idx", _scalar().cast("long").alias("_n")), "idx")
    lists = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "_n"))).alias("_r"))
    return lists.select(*keys, F.transform("_r", lambda x: x["_n"]).alias(out))


def counted_faces(stream: Column) -> Column:
    """Faces from numbers that are a count and then so many points, again and again."""
    empty = F.array().cast("array<bigint>")
    begin = F.struct(F.lit(0).cast("long").alias("left"), F.array().cast("array<array<bigint>>").alias("faces"))

    def take(state: Column, x: Column) -> Column:
        faces = state["faces"]
        longer = F.concat(F.slice(faces, 1, F.size(faces) - 1), F.array(F.array_append(F.element_at(faces, -1), x)))
        return F.when(state["left"] == 0, F.struct(x.alias("left"), F.array_append(faces, empty).alias("faces"))).otherwise(F.struct((state["left"] - 1).alias("left"), longer.alias("faces")))

    return F.aggregate(stream, begin, take, lambda state: state["faces"])


def polyhedra(arrays: DataFrame) -> DataFrame:
    """cell_idx, face_idx (from 0 in each cell) and face_pts of a file's polyhedra.

    A cell's part of the faces' stream begins where that of the polyhedron before ends and ends at the cell's
    own offset; other cells have offset -1. It is the number of faces and then the faces, each with its count."""
    ends = _of(arrays, "faceoffsets").where(_scalar() >= 0).select(F.col("idx").alias("cell_idx"), _scalar().cast("long").alias("end"))
    numbered = dense_index(ends, "cell_idx", "_k")
    before = numbered.select((F.col("_k") + 1).alias("_k"), F.col("end").alias("start"))
    spans = numbered.join(before, "_k", "left").select("cell_idx", F.coalesce("start", F.lit(0)).alias("start"), "end")
    streams = _taken(spans, _of(arrays, "faces"), ["cell_idx"], "s")
    return streams.select("cell_idx", F.posexplode(counted_faces(F.slice("s", 2, F.size("s") - 1))).alias("face_idx", "face_pts"))


def polygons(arrays: DataFrame) -> MeshDataset:
    """Polygon data: vertices, then lines, then polygons in one sequence of cells. Strips are an error."""
    if not _of(arrays, "strips_offsets").isEmpty():
        raise ValueError("triangle strips are not read")
    sizes = arrays.where(F.col("array").isin("verts_offsets", "lines_offsets")).groupBy("array").agg(F.count("*").alias("n"))
    before = {r.array: r.n for r in sizes.collect()}
    cells = links = None
    base = 0
    for kind, cell_type in (("verts", VERTEX), ("lines", LINE), ("polys", POLYGON)):
        some = cell_points(arrays, f"{kind}_offsets", f"{kind}_connectivity").drop("file").withColumn("cell_idx", F.col("cell_idx") + base)
        those = _of(arrays, f"{kind}_offsets").select((F.col("idx") + base).alias("cell_idx"), F.lit(cell_type).alias("cell_type"))
        cells, links = (those, some) if cells is None else (cells.unionByName(those), links.unionByName(some))
        base += before.get(f"{kind}_offsets", 0)
    return MeshDataset(_points(arrays), cells, links)


def image(arrays: DataFrame) -> grid.ImageGrid:
    """The implicit grid of an image: a few numbers."""
    rows = arrays.where(F.col("array").isin("extent", "origin", "spacing")).orderBy("array", "idx").collect()
    of = lambda name: [r.value[0] for r in rows if r.array == name]
    e = [int(x) for x in of("extent")]
    return grid.ImageGrid(tuple(of("origin")), tuple(of("spacing")), (e[0], e[2], e[4]), (e[1], e[3], e[5]))


def structured(arrays: DataFrame) -> MeshDataset:
    """A structured grid: its own points, and cells by arithmetic on the extent."""
    e = [int(r.value[0]) for r in _of(arrays, "extent").orderBy("idx").collect()]
    implicit = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0, 0, 0), (e[1] - e[0], e[3] - e[2], e[5] - e[4]))
    links = grid.cell_points(arrays.sparkSession, implicit)
    cells = links.where("local_idx = 0").select("cell_idx", F.lit(12).alias("cell_type"))
    return MeshDataset(_points(arrays), cells, links)


def part(arrays: DataFrame, number: int) -> MeshDataset:
    """A part of an EnSight geometry: the cells of its pieces, one piece after the other; polygons and polyhedra last."""
    prefix = f"part{number}_"
    base, cells, links = _bases(arrays, prefix)[0], None, None
    for name, first in base.items():
        rows = _of(arrays, prefix + name)
        if name == "nsided":
            those = _of(arrays, prefix + "nsided_counts").select((F.col("idx") + first).alias("cell_idx"), F.lit(POLYGON).alias("cell_type"))
            rings = _taken(_spans(arrays, prefix + "nsided_counts"), rows, ["item"], "value").select(F.col("item").alias("idx"), "value")
            rows = rings
        elif name == "nfaced":
            those = _of(arrays, prefix + "nfaced_faces").select((F.col("idx") + first).alias("cell_idx"), F.lit(POLYHEDRON).alias("cell_type"))
        else:
            those = rows.select((F.col("idx") + first).alias("cell_idx"), F.lit(ELEMENTS[name]).alias("cell_type"))
        if name == "nfaced":  # each point of a cell once, in the order of its number
            points = part_faces(arrays, number).select("cell_idx", F.explode("face_pts").alias("point_idx")).groupBy("cell_idx").agg(F.array_sort(F.collect_set("point_idx")).alias("p"))
            some = points.select("cell_idx", F.posexplode("p").alias("local_idx", "point_idx"))
        else:
            some = rows.select((F.col("idx") + first).alias("cell_idx"), F.posexplode("value").alias("local_idx", "p")).select("cell_idx", "local_idx", F.col("p").cast("long").alias("point_idx"))
        cells, links = (those, some) if cells is None else (cells.unionByName(those), links.unionByName(some))
    return MeshDataset(_points(arrays, prefix + "points"), cells, links)


def _bases(arrays: DataFrame, prefix: str) -> tuple[dict[str, int], int]:
    """(the first cell of each piece of a part, in order; the number of cells)."""
    sizes = arrays.where(F.col("array").startswith(prefix)).groupBy("array").agg(F.max("idx").alias("last")).collect()  # a row for each array
    held = {r.array.removeprefix(prefix): r.last + 1 for r in sizes}
    # Pieces of polygons and polyhedra are as long as their counts.
    held = {n: held.get({"nsided": "nsided_counts", "nfaced": "nfaced_faces"}.get(n, n)) for n in held if n in ELEMENTS or n in ("nsided", "nfaced")}
    out, base = {}, 0
    for name in sorted(held, key=[*ELEMENTS, "nsided", "nfaced"].index):
        out[name] = base
        base += held[name]
    return out, base


def _spans(arrays: DataFrame, name: str) -> DataFrame:
    """item, start and end of each of an array of counts, by their prefix sums."""
    counts = _of(arrays, name).select(F.col("idx").alias("item"), _scalar().cast("long").alias("n"))
    return prefix_sum(counts, "item", "n", "start").select("item", "start", (F.col("start") + F.col("n")).alias("end"))


def part_faces(arrays: DataFrame, number: int) -> DataFrame:
    """cell_idx, face_idx and face_pts of the polyhedra of a part of an EnSight geometry.

    Three levels: cells count faces, faces count points; both become spans by prefix sums."""
    prefix = f"part{number}_"
    first = _bases(arrays, prefix)[0].get("nfaced", 0)
    rings = _taken(_spans(arrays, prefix + "nfaced_counts"), _of(arrays, prefix + "nfaced"), ["item"], "face_pts").withColumnRenamed("item", "_face")
    held = _spans(arrays, prefix + "nfaced_faces").where("end > start").select((F.col("item") + first).alias("cell_idx"), F.posexplode(F.sequence("start", F.col("end") - 1)).alias("face_idx", "_face"))
    return held.join(rings, "_face").select("cell_idx", "face_idx", "face_pts")


def poly_mesh(points: DataFrame, faces: DataFrame, owner: DataFrame, neighbour: DataFrame) -> tuple[MeshDataset, DataFrame]:
    """(mesh of polyhedra, its faces: cell_idx, face_idx, face_pts) of a polyMesh's arrays.

    Cells are what owner and neighbour name; a cell's points are those of its faces, each once."""
    ends = _of(faces, "offsets").select(F.col("idx").alias("face_idx"), _scalar().cast("long").alias("start"), (F.col("idx") - 1).alias("before"))
    spans = ends.join(ends.select(F.col("before").alias("face_idx"), F.col("start").alias("end")), "face_idx").where("end > start")
    flat = spans.select("face_idx", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    flat = flat.join(_of(faces, "faces").select("idx", _scalar().cast("long").alias("point_idx")), "idx")
    rings = flat.groupBy("face_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "point_idx"))).alias("r")).select("face_idx", F.transform("r", lambda x: x["point_idx"]).alias("face_pts"))
    side = lambda df, name: _of(df, name).select(F.col("idx").alias("face_idx"), _scalar().cast("long").alias("cell_idx"))
    refs = side(owner, "owner").unionByName(side(neighbour, "neighbour")).where("cell_idx >= 0")
    held = refs.join(rings, "face_idx").select("cell_idx", "face_idx", "face_pts")
    links = held.select("cell_idx", F.explode("face_pts").alias("point_idx")).distinct()
    return MeshDataset(_points(points), refs.select("cell_idx").distinct().withColumn("cell_type", F.lit(42)), links), held


def boundary(faces: DataFrame, start: int, count: int) -> DataFrame:
    """A boundary patch: the faces [start, start + count) of a polyMesh, numbered from 0."""
    return faces.where(F.col("face_idx").between(start, start + count - 1)).select((F.col("face_idx") - start).alias("cell_idx"), "face_pts").dropDuplicates(["cell_idx"])


def surface(arrays: DataFrame) -> MeshDataset:
    """A surface of triangles or of faces with counts (OBJ, STL, PLY)."""
    flat = _of(arrays, "faces")
    if _of(arrays, "counts").isEmpty():
        links = flat.select(F.col("idx").alias("cell_idx"), F.posexplode("value").alias("local_idx", "p")).select("cell_idx", "local_idx", F.col("p").cast("long").alias("point_idx"))
    else:
        counts = prefix_sum(_of(arrays, "counts").select(F.col("idx").alias("cell_idx"), _scalar().cast("long").alias("n")), "cell_idx", "n", "start")
        at = counts.where("n > 0").select("cell_idx", "start", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("idx"))
        links = at.join(flat.select("idx", _scalar().cast("long").alias("point_idx")), "idx").select("cell_idx", (F.col("idx") - F.col("start")).alias("local_idx"), "point_idx")
    return MeshDataset(_points(arrays), links.select("cell_idx").distinct().withColumn("cell_type", F.lit(POLYGON)), links)


def partitions(pieces: list[MeshDataset]) -> MeshDataset:
    """Several files of one mesh as one: ids go on from piece to piece, with piece_id beside them."""
    points = cells = links = None
    at_point = at_cell = 0
    for k, p in enumerate(pieces):
        sizes = p.points.agg(F.coalesce(F.max("point_idx") + 1, F.lit(0))).first()[0], p.cells.agg(F.coalesce(F.max("cell_idx") + 1, F.lit(0))).first()[0]
        some = p.points.withColumn("point_idx", F.col("point_idx") + at_point).withColumn("piece_id", F.lit(k))
        those = p.cells.withColumn("cell_idx", F.col("cell_idx") + at_cell).withColumn("piece_id", F.lit(k))
        both = p.cell_points.withColumn("point_idx", F.col("point_idx") + at_point).withColumn("cell_idx", F.col("cell_idx") + at_cell)
        points, cells, links = (some, those, both) if points is None else (points.unionByName(some), cells.unionByName(those), links.unionByName(both))
        at_point, at_cell = at_point + sizes[0], at_cell + sizes[1]
    return MeshDataset(points, cells, links)


def related(relations: dict[str, list[str]], names: list[str]) -> list[str]:
    """All that some datasets rest on, directly or through others, in the order they are met.

    Relations are a catalog's own few names, so this is plain Python."""
    seen, open_ = [], list(names)
    while open_:
        name = open_.pop(0)
        if name not in seen:
            seen.append(name)
            open_ += relations.get(name, [])
    return seen

