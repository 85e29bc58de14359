"""Faces, owners and neighbours, and dense renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import dense_index, prefix_sum

#: Corners of each face, outward, by published cell type number (tetra, voxel, hexahedron, wedge, pyramid): fixed values.
FACES = {
    10: [(0, 1, 3), (1, 2, 3), (2, 0, 3), (0, 2, 1)],
    11: [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)],
    12: [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
    13: [(0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)],
    14: [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
}


def cell_faces(cells: DataFrame) -> DataFrame:
    """cell_idx, local_face and the points of every face of cells (cell_idx, cell_type, pts).

    The template is a constant expression, so this is one projection without a join."""
    pick = F.lit(None).cast("array<array<bigint>>")
    for kind, faces in FACES.items():
        pick = F.when(F.col("cell_type") == kind, F.array(*[F.array(*[F.element_at("pts", n + 1) for n in f]) for f in faces])).otherwise(pick)
    return cells.select("cell_idx", F.posexplode(pick).alias("local_face", "face_pts"))


def external_faces(cells: DataFrame) -> DataFrame:
    """Faces that only one cell has."""
    named = cell_faces(cells).withColumn("_key", F.sort_array("face_pts"))
    once = named.groupBy("_key").agg(F.count("*").alias("_n"), F.min(F.struct("cell_idx", "local_face", "face_pts")).alias("f"))
    return once.where("_n = 1").select("f.*")


def compacted(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: point_idx, new_idx of those used, ascending; faces with new indices)."""
    flat = faces.select("cell_idx", "local_face", F.posexplode("face_pts").alias("pos", "point_idx"))
    points = dense_index(flat.select("point_idx").distinct(), "point_idx", "new_idx")
    renumbered = flat.join(points, "point_idx").groupBy("cell_idx", "local_face").agg(F.sort_array(F.collect_list(F.struct("pos", "new_idx"))).alias("p"))
    return points, renumbered.select("cell_idx", "local_face", F.transform("p", lambda x: x["new_idx"]).alias("face_pts"))


def face_cells(owner: DataFrame, neighbour: DataFrame) -> DataFrame:
    """(cell_idx, face_idx, side) of owner and neighbour lists: two scans, no join."""
    return owner.select("cell_idx", "face_idx", F.lit("owner").alias("side")).unionAll(neighbour.select("cell_idx", "face_idx", F.lit("neighbour").alias("side")))


def signed_faces(cell_faces: DataFrame, faces: DataFrame, start: int = 1) -> DataFrame:
    """Polyhedra by signed face references (cell_idx, face) joined with faces (face_idx from 0)."""
    refs = cell_faces.select("cell_idx", (F.abs("face") - start).alias("face_idx"), (F.col("face") < 0).alias("reversed"))
    return refs.join(faces, "face_idx")


def fields_to_faces(cell_faces: DataFrame, cells: DataFrame, name: str, check: bool = True) -> DataFrame:
    """A cell field on faces: each face takes the value of its smallest cell. A face whose cell
    is not among the cells is an error, which names their number and the first of them."""
    least = cell_faces.groupBy("face_idx").agg(F.min("cell_idx").alias("cell_idx"))
    if check:
        lost = least.join(cells.select("cell_idx"), "cell_idx", "left_anti").agg(F.count("*").alias("n"), F.min("face_idx").alias("first")).first()
        if lost.n:
            raise ValueError(f"{lost.n} faces have no cell with a value, the first is {lost.first}")
    return least.join(cells.select("cell_idx", name), "cell_idx").select("face_idx", "cell_idx", name)


def field_of_faces(values: DataFrame, name: str, cell_faces: DataFrame, n_cells: int, n_faces: int) -> DataFrame:
    """A field (idx, name) of a mesh of polyhedra on its faces: one value for each face passes,
    one for each cell is moved to the faces, any other number is an error."""
    n = values.count()
    if n == n_faces:
        return values.select(F.col("idx").alias("face_idx"), name)
    if n == n_cells:
        return fields_to_faces(cell_faces, values.withColumnRenamed("idx", "cell_idx"), name).select("face_idx", name)
    raise ValueError(f"{n} values for {n_cells} cells and {n_faces} faces")


def faces_without_cell(faces: DataFrame, cell_faces: DataFrame) -> DataFrame:
    """Faces that no cell names."""
    return faces.join(cell_faces.select("face_idx"), "face_idx", "left_anti")


def oriented_faces(faces: DataFrame, points: DataFrame) -> DataFrame:
    """cell_idx, local_face, the face's centre and 1 if its points go around outwards, else -1.

    faces: cell_idx, local_face, face_pts. The sign is of the normal, summed over the ring as
    Newell does, against the way from the cell's centre to the face's."""
    flat = faces.select("cell_idx", "local_face", F.posexplode("face_pts").alias("pos", "point_idx")).join(points.select("point_idx", "x", "y", "z"), "point_idx")
    cell = flat.groupBy("cell_idx").agg(*[F.avg(a).alias(f"cell_{a}") for a in "xyz"])
    ring = flat.groupBy("cell_idx", "local_face").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("r"), *[F.avg(a).alias(f"center_{a}") for a in "xyz"])
    turned = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    part = lambda a, b: F.aggregate(F.zip_with("r", turned, lambda p, q: (p[a] - q[a]) * (p[b] + q[b])), F.lit(0.0), lambda s, x: s + x)
    both = ring.join(cell, "cell_idx")
    out = sum(n * (F.col(f"center_{c}") - F.col(f"cell_{c}")) for n, c in ((part("y", "z"), "x"), (part("z", "x"), "y"), (part("x", "y"), "z")))
    return both.select("cell_idx", "local_face", *[f"center_{a}" for a in "xyz"], F.when(out < 0, -1).otherwise(1).alias("orientation"))


def face_centres(faces: DataFrame, points: DataFrame) -> DataFrame:
    """face_idx and the mean of its points (face_idx, point_idx)."""
    return faces.join(points.select("point_idx", "x", "y", "z"), "point_idx").groupBy("face_idx").agg(*[F.avg(a).alias(f"center_{a}") for a in "xyz"], F.count("*").alias("n"))


def unique_cell_points(incidence: DataFrame) -> DataFrame:
    """Points of each cell once, however many of its faces name them."""
    return incidence.select("cell_idx", "point_idx").distinct()


def face_summary(faces: DataFrame) -> DataFrame:
    """Totals over faces (face_pts): faces, corners and the largest face."""
    return faces.agg(F.count("*").alias("faces"), F.sum(F.size("face_pts")).alias("corners"), F.max(F.size("face_pts")).alias("largest"))


def dense_faces(faces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arrays of a mesh in terms of faces, from faces (cell_idx, local_face, face_pts): three tables with dense numbers.

    cells: cell_idx, n_faces, first_ref; refs: ref_idx, cell_idx, local_face, face_id; faces: face_id,
    n_points, first_corner, face_pts. A face that cells share is numbered once, where its smallest cell names it:
    its number is the count of faces that smaller cells named first, and its place among those of its cell, so
    numbers come from prefix sums over cells and no order of point lists is needed."""
    keyed = faces.select("cell_idx", "local_face", "face_pts", F.sort_array("face_pts").alias("_key"))
    own = keyed.groupBy("_key").agg(F.min(F.struct("cell_idx", "local_face", "face_pts")).alias("f")).select("_key", "f.*")
    place = F.row_number().over(W.partitionBy("cell_idx").orderBy("local_face")) - 1
    named = prefix_sum(own.groupBy("cell_idx").agg(F.count("*").alias("_n")), "cell_idx", "_n", "_base")
    numbered = own.withColumn("_at", place).join(named, "cell_idx").select("_key", (F.col("_base") + F.col("_at")).alias("face_id"), "face_pts")
    sized = numbered.select("face_id", F.size("face_pts").cast("long").alias("n_points"), "face_pts")
    out = prefix_sum(sized, "face_id", "n_points", "first_corner").select("face_id", "n_points", "first_corner", "face_pts")
    cells = prefix_sum(faces.groupBy("cell_idx").agg(F.count("*").alias("n_faces")), "cell_idx", "n_faces", "first_ref")
    refs = keyed.join(numbered.select("_key", "face_id"), "_key").withColumn("_at", place).join(cells, "cell_idx")
    return cells, refs.select((F.col("first_ref") + F.col("_at")).alias("ref_idx"), "cell_idx", "local_face", "face_id"), out


def unstructured(mesh_points: DataFrame, incidence: DataFrame) -> DataFrame:
    """cell_idx and pts in local order, from (cell_idx, local_idx, point_idx): the export form."""
    lists = incidence.groupBy("cell_idx").agg(F.sort_array(F.collect_list(F.struct("local_idx", "point_idx"))).alias("p"))
    return lists.select("cell_idx", F.transform("p", lambda x: x["point_idx"]).alias("pts"))
