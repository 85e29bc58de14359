"""EnSight Gold: case files, binary geometry and variables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_arrays

#: Points of each element type, and components of each kind of variable: fixed values.
NODES = {"point": 1, "bar2": 2, "bar3": 3, "tria3": 3, "tria6": 6, "quad4": 4, "quad8": 8, "tetra4": 4, "tetra10": 10, "pyramid5": 5, "pyramid13": 13, "penta6": 6, "penta15": 15, "hexa8": 8, "hexa20": 20}
WIDTHS = {"scalar": 1, "vector": 3, "tensor": 6, "tensor9": 9}


@dataclass
class TimeSet:
    """Times of a time set, and the numbers that stand for the stars of its files' names."""

    times: list[float] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    count: int = 0
    start: int = 0
    step: int = 1

    def filed(self) -> list[tuple[float, int]]:
        numbers = self.numbers or [self.start + self.step * k for k in range(self.count)]
        return list(zip(self.times, numbers, strict=True))


@dataclass
class Case:
    geometry: str = ""
    geometry_set: int | None = None
    variables: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # name -> (kind, association, pattern)
    variable_sets: dict[str, int | None] = field(default_factory=dict)
    sets: dict[int, TimeSet] = field(default_factory=dict)

    def time_set(self, number: int | None) -> TimeSet:
        """A time set by its number; a file that names none takes the first."""
        if number is not None and self.sets:
            return self.sets[number]
        return next(iter(self.sets.values()), TimeSet())

    def files(self, pattern: str, number: int | None = None) -> list[tuple[float, str]]:
        """(time, file name) of each step of a time set: the stars of a pattern take the step's number."""
        stars, steps = re.search(r"\*+", pattern), self.time_set(number)
        if not stars:
            return [(steps.times[0] if steps.times else 0.0, pattern)]
        return [(t, pattern.replace(stars[0], str(n).zfill(len(stars[0])))) for t, n in steps.filed()]


def _leading(words: list[str]) -> int | None:
    """The time set of a line: the first of the numbers before its names."""
    return int(words[0]) if words and words[0].isdigit() else None


def parse_case(text: str, offset: float = 0.0) -> Case:
    """A case file; its geometry and each variable may have a time set of their own."""
    case, section, listing = Case(), "", ""
    now = TimeSet()
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        if re.fullmatch(r"[A-Z]+", line):
            section, listing = line, ""
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        if section == "GEOMETRY" and key == "model":
            words = [w for w in value.split() if w != "change_coords_only"]
            case.geometry, case.geometry_set = words[-1], _leading(words[:-1])
        elif section == "VARIABLE" and (m := re.fullmatch(r"(scalar|vector|tensor symm|tensor asym|tensor) per (node|element)", key)):
            words = value.split()
            kind = {"tensor symm": "tensor", "tensor asym": "tensor9"}.get(m[1], m[1])
            case.variables[words[-2]] = (kind, "vertex" if m[2] == "node" else "cell", words[-1])
            case.variable_sets[words[-2]] = _leading(words[:-2])
        elif section == "TIME" and key == "time set":
            now, listing = case.sets.setdefault(int(value.split()[0]), TimeSet()), ""
        elif section == "TIME":
            if not case.sets:
                case.sets[1] = now
            listing = key if colon else listing
            words = (value if colon else line).split()
            if listing == "number of steps":
                now.count = int(words[0])
            elif listing == "filename start number":
                now.start = int(words[0])
            elif listing == "filename increment":
                now.step = int(words[0])
            elif listing == "filename numbers":
                now.numbers += [int(x) for x in words]
            elif listing == "time values":
                now.times += [float(x) + offset for x in words]
    return case


class Reader:
    """80-character lines and little-endian numbers, one after the other."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 0

    def line(self) -> str:
        self.at += 80
        return self.content[self.at - 80 : self.at].split(b"\0")[0].decode("ascii", "replace").strip()

    def array(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.content, kind, n, self.at)
        self.at += out.nbytes
        return out

    @property
    def more(self) -> bool:
        return self.at < len(self.content)


def parse_geometry(content: bytes, name: str) -> Iterator[tuple[str, str, np.ndarray]]:
    """For each part: points, and connectivity from 0 of each piece."""
    r = Reader(content)
    if r.line() != "C Binary":
        raise ValueError("only C Binary files are read")
    r.line(), r.line()
    node_ids, element_ids = ("given" in r.line() for _ in range(2))
    part, count = 0, 0
    while r.more:
        word = r.line()
        if word == "extents":
            r.array("<f4", 6)
        elif word == "part":
            part = int(r.array("<i4", 1)[0])
            r.line()
        elif word == "coordinates":
            count = int(r.array("<i4", 1)[0])
            if node_ids:
                r.array("<i4", count)
            yield f"part{part}_points", "vertex", r.array("<f4", 3 * count).reshape(3, count).T
        else:
            n = int(r.array("<i4", 1)[0])
            if element_ids:
                r.array("<i4", n)
            if word == "nsided":
                sizes = r.array("<i4", n)
                yield f"part{part}_nsided_counts", "cell", sizes
                yield f"part{part}_nsided", "topology", r.array("<i4", int(sizes.sum())) - 1
            elif word == "nfaced":
                faces = r.array("<i4", n)
                sizes = r.array("<i4", int(faces.sum()))
                yield f"part{part}_nfaced_faces", "cell", faces
                yield f"part{part}_nfaced_counts", "face", sizes
                yield f"part{part}_nfaced", "topology", r.array("<i4", int(sizes.sum())) - 1
            elif word in NODES:
                yield f"part{part}_{word}", "topology", r.array("<i4", n * NODES[word]).reshape(n, NODES[word]) - 1
            else:
                raise ValueError(f"unknown element {word}")


def variable_parser(kind: str, association: str, counts: dict[tuple[int, str], int]):
    """A variable's values; counts gives the numbers of (part, "coordinates" or element)."""
    width = WIDTHS[kind]

    def parse(content: bytes, name: str) -> Iterator[tuple[str, str, np.ndarray]]:
        r, part = Reader(content), 0
        r.line()
        while r.more:
            word = r.line()
            if word == "part":
                part = int(r.array("<i4", 1)[0])
            else:
                n = counts[(part, word)]
                yield f"part{part}_{word}", association, r.array("<f4", n * width).reshape(width, n).T

    return parse


def read_geometry(spark: SparkSession, path: str | list[str], arrays: list[str] | None = None) -> DataFrame:
    return read_arrays(spark, path, parse_geometry, arrays)


def read_variable(spark: SparkSession, path: str | list[str], kind: str, association: str, counts: dict[tuple[int, str], int]) -> DataFrame:
    return read_arrays(spark, path, variable_parser(kind, association, counts))


def read_case(spark: SparkSession, path: str, arrays: list[str] | None = None, offset: float = 0.0) -> DataFrame:
    """The geometry of a case file with a column t, at each of its times; variables are read by
    ``read_case_variable`` once the geometry's counts are known."""
    case = parse_case(_text(spark, path), offset)
    out = None
    for t, name in case.files(case.geometry, case.geometry_set):
        one = read_geometry(spark, _beside(path, name), arrays).withColumn("t", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out


def read_case_variable(spark: SparkSession, path: str, name: str, counts: dict[tuple[int, str], int], offset: float = 0.0) -> DataFrame:
    """A variable of a case file with a column t, at each of its times."""
    case = parse_case(_text(spark, path), offset)
    kind, association, pattern = case.variables[name]
    out = None
    for t, file in case.files(pattern, case.variable_sets[name]):
        one = read_variable(spark, _beside(path, file), kind, association, counts).withColumn("t", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a case file is a page of names


def _beside(path: str, name: str) -> str:
    return name if "://" in name or name.startswith("/") else f"{path.rpartition('/')[0]}/{name}"
