"""SVG drawings as segment rows.

Files are read by Spark (binaryFile) and parsed one by one inside mapInArrow; a file that cannot be read
gives a row with its error and no segment. Curves become chords, about one for every five units.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units of a curve's length for each chord.
CHORD = 5
SCHEMA = "filename string, contour_id bigint, seg_id bigint, x1 double, y1 double, x2 double, y2 double, width bigint, height bigint, error string"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "Z": 0, "Q": 4, "T": 2, "C": 6, "S": 4, "A": 7}


def numbers(text: str | None) -> list[float]:
    return [float(x) for x in re.findall(_NUMBER, text or "")]


def transform_matrix(text: str | None, svg_spec: bool = False) -> np.ndarray:
    """The product of a transform list; ``rotate(a, cx, cy)`` adds the centre before and takes it off after,
    unless ``svg_spec`` asks for the standard's order."""
    m = np.eye(3)
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = numbers(args)
        if name == "translate":
            step = [[1, 0, v[0]], [0, 1, v[1] if len(v) > 1 else 0], [0, 0, 1]]
        elif name == "scale":
            step = [[v[0], 0, 0], [0, v[1] if len(v) > 1 else v[0], 0], [0, 0, 1]]
        elif name == "rotate":
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            step = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
            if len(v) > 2:
                there = np.array([[1, 0, v[1]], [0, 1, v[2]], [0, 0, 1]])
                back = np.array([[1, 0, -v[1]], [0, 1, -v[2]], [0, 0, 1]])
                step = there @ step @ back if svg_spec else back @ step @ there
        elif name == "skewX":
            step = [[1, math.tan(math.radians(v[0])), 0], [0, 1, 0], [0, 0, 1]]
        elif name == "skewY":
            step = [[1, 0, 0], [math.tan(math.radians(v[0])), 1, 0], [0, 0, 1]]
        elif name == "matrix":
            step = [[v[0], v[2], v[4]], [v[1], v[3], v[5]], [0, 0, 1]]
        else:
            continue
        m = m @ np.array(step, float)
    return m


def bezier(points: list[np.ndarray]) -> list[np.ndarray]:
    """Points after the first on a quadratic or cubic curve; at least four, one for every CHORD of its control polygon."""
    p = np.array(points)
    n = max(4, round(float(np.hypot(*np.diff(p, axis=0).T).sum()) / CHORD))
    t = np.linspace(0, 1, n + 1)[1:, None]
    d = len(p) - 1
    return list(sum(math.comb(d, k) * t**k * (1 - t) ** (d - k) * p[k] for k in range(d + 1)))


def arc(p: np.ndarray, rx: float, ry: float, tilt: float, large: bool, sweep: bool, q: np.ndarray) -> list[np.ndarray]:
    """Points after the first on an elliptical arc from p to q; radii that are too small are scaled up."""
    rx, ry = abs(rx), abs(ry)
    if rx == 0 or ry == 0 or (p == q).all():
        return [q]
    c, s = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    turn = np.array([[c, s], [-s, c]])
    u = turn @ (p - q) / 2
    grow = math.sqrt((u[0] / rx) ** 2 + (u[1] / ry) ** 2)
    if grow > 1:
        rx, ry = rx * grow, ry * grow
    num = max(0.0, (rx * ry) ** 2 - (rx * u[1]) ** 2 - (ry * u[0]) ** 2)
    k = math.sqrt(num / ((rx * u[1]) ** 2 + (ry * u[0]) ** 2)) * (-1 if large == sweep else 1)
    centre = k * np.array([rx * u[1] / ry, -ry * u[0] / rx])
    a0 = math.atan2((u[1] - centre[1]) / ry, (u[0] - centre[0]) / rx)
    a1 = math.atan2((-u[1] - centre[1]) / ry, (-u[0] - centre[0]) / rx)
    span = (a1 - a0) % (2 * math.pi) - (0 if sweep else 2 * math.pi)
    n = max(4, round(2 * math.pi * max(rx, ry) * math.degrees(span) / 360 / CHORD))
    a = a0 + span * np.linspace(0, 1, n + 1)[1:]
    at = (turn.T @ np.stack([rx * np.cos(a) + centre[0], ry * np.sin(a) + centre[1]])).T + (p + q) / 2
    at[-1] = q
    return list(at)


def path_contours(d: str) -> list[np.ndarray]:
    """The polylines of a path's commands, absolute and relative; each M begins one, and Z closes it."""
    contours: list[list[np.ndarray]] = []
    here = start = control = np.zeros(2)
    last = ""
    for letter, args in re.findall(r"([MmLlHhVvZzQqTtCcSsAa])([^MmLlHhVvZzQqTtCcSsAa]*)", d):
        kind = letter.upper()
        # arc flags may stand without a space before the next number
        v = [float(x) for x in re.findall(_NUMBER, re.sub(rf"({_NUMBER}[\s,]+{_NUMBER}[\s,]+{_NUMBER}[\s,]+)([01])[\s,]*([01])", r"\1 \2 \3 ", args))] if kind == "A" else numbers(args)
        take = _TAKES[kind]
        for k in range(0, max(len(v), 1), max(take, 1)):
            w = v[k : k + take]
            if len(w) < take:
                break
            base = here if letter.islower() else np.zeros(2)
            pts = [base + w[i : i + 2] for i in range(0, take - 1, 2)] if kind in "MLQTCS" else []
            if kind == "M" and k == 0:
                here = start = pts[0]
                contours.append([here])
                last = kind
                continue
            if not contours:
                contours.append([here])
            if kind in "ML":
                new = [pts[0]]
            elif kind == "H":
                new = [np.array([base[0] + w[0], here[1]])]
            elif kind == "V":
                new = [np.array([here[0], base[1] + w[0]])]
            elif kind == "Z":
                new = [start] if (here != start).any() else []
            elif kind in "QT":
                control = pts[0] if kind == "Q" else 2 * here - control if last in ("Q", "T") else here
                new = bezier([here, control, pts[-1]])
            elif kind in "CS":
                first = pts[0] if kind == "C" else 2 * here - control if last in ("C", "S") else here
                new, control = bezier([here, first, *pts[-2:]]), pts[-2]
            else:
                new = arc(here, w[0], w[1], w[2], w[3] != 0, w[4] != 0, base + w[5:7])
            contours[-1] += new
            here = new[-1] if new else here
            last = kind
        if kind == "Z":
            here = start
            contours.append([start])
    return [np.array(c) for c in contours if len(c) > 1]


def shape_contours(tag: str, get) -> list[np.ndarray]:
    """The polylines of one element; ``get`` reads an attribute."""
    f = lambda name: (numbers(get(name)) or [0.0])[0]
    if tag == "line":
        return [np.array([[f("x1"), f("y1")], [f("x2"), f("y2")]])]
    if tag in ("polyline", "polygon"):
        v = numbers(get("points"))
        p = np.array(v[: len(v) // 2 * 2]).reshape(-1, 2)
        p = np.concatenate([p, p[:1]]) if tag == "polygon" and len(p) else p
        return [p] if len(p) > 1 else []
    if tag == "rect":
        x, y, w, h = f("x"), f("y"), f("width"), f("height")
        return [np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]])]
    if tag in ("circle", "ellipse"):
        rx, ry = (f("r"), f("r")) if tag == "circle" else (f("rx"), f("ry"))
        n = max(8, round(2 * math.pi * max(rx, ry) / CHORD))
        a = np.linspace(0, 2 * math.pi, n + 1)
        return [np.stack([f("cx") + rx * np.cos(a), f("cy") + ry * np.sin(a)], axis=1)]
    return path_contours(get("d") or "") if tag == "path" else []


def parse(content: bytes, svg_spec: bool = False, size_as: tuple[int, int] | None = None) -> tuple[list[np.ndarray], int, int]:
    """(contours, width, height): of all shapes, with the transforms of their groups, outer first. The size is
    ``size_as``, else that of the last viewBox, else what the coordinates need."""
    found: list[np.ndarray] = []
    size: list[float] = []

    def walk(node: ET.Element, outer: np.ndarray) -> None:
        nonlocal size
        tag = node.tag.rpartition("}")[2]
        m = outer @ transform_matrix(node.get("transform"), svg_spec)
        if tag == "svg" and len(box := numbers(node.get("viewBox"))) == 4:
            size = box[2:]
        for c in shape_contours(tag, node.get):
            found.append((m @ np.column_stack([c, np.ones(len(c))]).T).T[:, :2])
        for child in node:
            walk(child, m)

    walk(ET.fromstring(content), np.eye(3))
    if size_as is not None:
        size = list(size_as)
    if not size:
        size = [math.ceil(max((float(c[:, k].max()) for c in found), default=0.0)) for k in (0, 1)]
    return found, round(size[0]), round(size[1])


def parse_files(files: DataFrame, svg_spec: bool = False, size_as: tuple[int, int] | None = None) -> DataFrame:
    """Segment rows (SCHEMA) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), *[pa.int64()] * 2, *[pa.float64()] * 4, *[pa.int64()] * 2, pa.string()]
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = path.rpartition("/")[2]
                try:
                    contours, w, h = parse(content, svg_spec, size_as)
                    for c, p in enumerate(contours):
                        rows += [(name, c, s, *p[s].tolist(), *p[s + 1].tolist(), w, h, None) for s in range(len(p) - 1)]
                except Exception as error:  # noqa: BLE001  one bad file must not stop the others
                    rows.append((name, *[None] * 8, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_svg(spark: SparkSession, folder: str, svg_spec: bool = False, size_as: tuple[int, int] | None = None) -> DataFrame:
    """Every .svg file of a folder; ``size_as`` (width, height) stands for the sizes that the files give."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][vV][gG]").load(folder)
    return parse_files(files, svg_spec, size_as)


def svg_text(segments: DataFrame, width: int, height: int) -> DataFrame:
    """(drawing_id, value): each drawing as SVG text, a polyline a contour; coordinates have three decimals."""
    one = lambda x, y: F.concat_ws(",", F.format_string("%.3f", F.col(x)), F.format_string("%.3f", F.col(y)))
    ordered = F.array_sort(F.collect_list(F.struct("seg_id", one("x1", "y1").alias("a"), one("x2", "y2").alias("b"))))
    line = segments.groupBy("drawing_id", "contour_id").agg(ordered.alias("s"))
    pts = F.concat_ws(" ", F.get("s", F.lit(0))["a"], F.concat_ws(" ", F.transform("s", lambda e: e["b"])))
    line = line.select("drawing_id", "contour_id", F.concat(F.lit('<polyline fill="none" stroke="black" points="'), pts, F.lit('"/>')).alias("p"))
    body = line.groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contour_id", "p"))), lambda e: e["p"]), "\n").alias("b"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">\n'
    return body.select("drawing_id", F.concat(F.lit(head), "b", F.lit("\n</svg>")).alias("value"))


def write_svg(segments: DataFrame, folder: str, width: int, height: int) -> None:
    """``svg_text`` under ``folder``/drawing_id=..."""
    svg_text(segments, width, height).write.partitionBy("drawing_id").text(folder)
