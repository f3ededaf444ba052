"""Rasters in the classic NetCDF formats (versions 1, 2 and 5, also inside zip files) as rows.

``scan`` gives a row for each frame and pixel: path, member (of a zip, else null), time, date, pixel (the row-major place on latitude and longitude),
lat_idx, lon_idx, lat, lon and a double for each variable. Packed values are unpacked, fill values are null, rows without any value go.

The driver lists files and their sizes only; a task opens its files and reads the shares of them that are its own, a block of rows at a time. Files larger
than ``bytes_a_task`` are shared by several tasks, small ones go together; a zip is one task's (in a compressed
member each step back starts its decompression again, so one variable at a time is cheapest there). A box and a span of days are arguments of the scan: the reader
seeks past frames and rows outside of them. They are not pushed filters, since Spark 4.1 keeps a Python reader and the filters pushed into it for the next query over
the same frame, which then lacks rows. NetCDF 4 (HDF5), calendars other than the civil one and coordinates of two dimensions are errors that say so.
"""

from __future__ import annotations

import json
import math
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

# Fixed values of the format: types by their number, and the tags of the header's lists.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
# Names under which coordinates are found, in order, and what providers call their variables.
COORDINATES = {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "time": ("time", "valid_time", "date")}
ALIASES = {"10m_u_component_of_wind": "u10", "10m_v_component_of_wind": "v10"}
SECONDS = {"millisecond": 0.001, "second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}
CELLS = 1 << 18  # cells of a block that is read and sent to Spark at once


@dataclass
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: np.dtype
    attributes: dict
    begin: int
    record: bool


@dataclass
class Header:
    variables: dict[str, Variable] = field(default_factory=dict)
    stride: int = 0  # bytes from one record to the next

    def coordinate(self, what: str) -> str | None:
        return next((c for c in COORDINATES[what] if c in self.variables and len(self.variables[c].dims) <= 1), None)


class _Fields:
    """The header's fields one after the other, read from the file in pieces."""

    def __init__(self, f, wide: bool = False):
        self.f, self.held, self.at, self.wide = f, b"", 0, wide

    def take(self, n: int) -> bytes:
        while len(self.held) < self.at + n:
            more = self.f.read(max(1 << 16, n))
            if not more:
                raise ValueError("the header ends too early")
            self.held += more
        self.at += n
        return self.held[self.at - n : self.at]

    def whole(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def count(self) -> int:
        return self.whole(8 if self.wide else 4)

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def entries(self, tag: int) -> range:
        found, n = self.whole(4), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"a list of the header has tag {found} instead of {tag}")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.entries(ATTRIBUTES):
            name, kind, n = self.name(), np.dtype(KINDS[self.whole(4)]), self.count()
            raw = self.padded(n * kind.itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind.kind == "S" else np.frombuffer(raw, kind)
        return out


def header(f, size: int) -> Header:
    """What lies where in an open file of ``size`` bytes."""
    f.seek(0)
    fields = _Fields(f)
    magic = fields.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file" + (" but NetCDF 4, which has no reader here" if magic[1:4] == b"HDF" else ""))
    fields.wide = magic[3] == 5
    records = fields.count()
    streamed = records == (1 << (64 if fields.wide else 32)) - 1
    dims = [(fields.name(), fields.count()) for _ in fields.entries(DIMENSIONS)]
    fields.attributes()
    out = Header()
    for _ in fields.entries(VARIABLES):
        name = fields.name()
        ids = [fields.count() for _ in range(fields.count())]
        attributes, kind = fields.attributes(), np.dtype(KINDS[fields.whole(4)])
        fields.count()  # a size that follows from the shape and overflows for large ones
        begin = fields.whole(4 if magic[3] == 1 else 8)
        shape = tuple(dims[i][1] for i in ids)
        out.variables[name] = Variable(tuple(dims[i][0] for i in ids), shape, kind, attributes, begin, bool(shape) and shape[0] == 0)
    steps = [math.prod(v.shape[1:]) * v.kind.itemsize for v in out.variables.values() if v.record]
    out.stride = steps[0] if len(steps) == 1 else sum(s + -s % 4 for s in steps)
    if streamed and steps and out.stride:
        first = min(v.begin for v in out.variables.values() if v.record)
        records = max(0, size - first) // out.stride
    for v in out.variables.values():
        if v.record:
            v.shape = (records, *v.shape[1:])
    return out


def values(f, head: Header, v: Variable, at: int, n: int) -> np.ndarray:
    """``n`` values of a variable from row-major place ``at``, as they are in the file."""
    size, whole = v.kind.itemsize, []
    frame = math.prod(v.shape[1:]) if v.record else max(1, at + n)
    for step in range(at // frame, -(-(at + n) // frame)):
        first, last = max(at, step * frame), min(at + n, (step + 1) * frame)
        f.seek(v.begin + step * head.stride + (first - step * frame) * size)
        raw = f.read((last - first) * size)
        if len(raw) < (last - first) * size:
            raise ValueError("the file ends too early")
        whole.append(np.frombuffer(raw, v.kind))
    return whole[0] if len(whole) == 1 else np.concatenate([np.array([], v.kind), *whole])


def unpacked(raw: np.ndarray, attributes: Mapping) -> np.ndarray:
    """Doubles: fill values become NaN, the scale and the offset are applied."""
    if attributes.get("_Unsigned") == "true":
        raw = raw.view(raw.dtype.str.replace("i", "u"))
    out = raw.astype("f8")
    missing = np.isnan(out)
    for name in ("_FillValue", "missing_value"):
        for m in np.atleast_1d(attributes.get(name, [])):
            missing |= raw == np.asarray(m).astype(raw.dtype)
    out = out * float(np.ravel(attributes.get("scale_factor", 1.0))[0]) + float(np.ravel(attributes.get("add_offset", 0.0))[0])
    out[missing] = np.nan
    return out


def axis(f, head: Header, name: str) -> np.ndarray:
    """All values of a coordinate; a missing one is an error."""
    v = head.variables[name]
    out = unpacked(values(f, head, v, 0, math.prod(v.shape)), v.attributes)
    if np.isnan(out).any():
        raise ValueError(f"{name} has missing values")
    return out


def micros(offsets: np.ndarray, attributes: Mapping) -> np.ndarray:
    """Microseconds since 1970 (UTC) of times that count from the date that their units name."""
    units, calendar = attributes.get("units", ""), attributes.get("calendar", "standard").lower()
    m = re.fullmatch(r"(\w+?)s? since (\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+(?:\.\d*)?))?)?(?: ?(?:UTC|Z|[+-]?0?0:00))?", units.strip())
    if not m or m[1] not in SECONDS or calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"times in {units!r} of calendar {calendar!r} can't be read")
    start = datetime(int(m[2]), int(m[3]), int(m[4]), int(m[5] or 0), int(m[6] or 0), tzinfo=timezone.utc)
    if start.year < 1583 and calendar != "proleptic_gregorian":
        raise ValueError(f"times in {units!r} count through the change of calendars")
    base = round(start.timestamp()) * 1_000_000 + round(float(m[7] or 0) * 1e6)
    step = SECONDS[m[1]] * 1e6
    whole = np.floor(offsets)  # the whole part apart, so that no digits are lost
    return base + np.rint(whole * step).astype("i8") + np.rint((offsets - whole) * step).astype("i8")


class Slabs:
    """One open file: the places of the wanted steps and rows, and the rows of a share of them."""

    def __init__(self, f, size: int, wanted: Sequence[str], bounds: Mapping[str, tuple]):
        self.f, self.head = f, header(f, size)
        names = {what: self.head.coordinate(what) for what in COORDINATES}
        if names["lat"] is None or names["lon"] is None:
            raise ValueError("no latitude or longitude of one dimension found")
        on = {what: (self.head.variables[c].dims or (None,))[0] for what, c in names.items() if c}
        self.wanted = {w: self.head.variables.get(w) or self.head.variables.get(ALIASES.get(w, "")) for w in wanted}
        if lost := [w for w, v in self.wanted.items() if v is None]:
            raise ValueError(f"no variable {', '.join(lost)} among {', '.join(self.head.variables)}")
        shapes = {tuple(d for d, n in zip(v.dims, v.shape, strict=True) if n != 1 or d in on.values()) for v in self.wanted.values()}
        if len(shapes) != 1:
            raise ValueError("the variables lie on different dimensions; scan them one by one")
        dims = shapes.pop()
        timed = "time" in on and on["time"] in dims
        if sorted(dims[timed:]) != sorted([on["lat"], on["lon"]]) or (timed and dims[0] != on["time"]):
            raise ValueError(f"dimensions {dims} instead of a time, a latitude and a longitude")
        self.lat, self.lon = axis(f, self.head, names["lat"]), axis(f, self.head, names["lon"])
        self.time = micros(axis(f, self.head, names["time"]), self.head.variables[names["time"]].attributes) if timed else None
        lat, lon = _within(self.lat, bounds.get("lat")), _within(self.lon, bounds.get("lon"))
        self.turned = dims[-1] == on["lat"]  # a row of the file is a meridian
        self.rows, self.columns = (lon, lat) if self.turned else (lat, lon)
        if timed:
            steps = np.flatnonzero(_within(self.time // 86_400_000_000, bounds.get("date")))
        else:
            steps = [] if "date" in bounds else [0]  # a null date is within no bounds
        n, block = len(self.rows), max(1, CELLS // max(1, len(self.columns)))
        starts = [r for r in range(0, n, block) if self.rows[r : r + block].any()] if self.columns.any() else []
        self.units = [(int(s), r, min(r + block, n)) for s in steps for r in starts]

    def batches(self, share: int, shares: int) -> Iterator[dict]:
        width = len(self.columns)
        for step, r0, r1 in self.units[share * len(self.units) // shares : (share + 1) * len(self.units) // shares]:
            inside = np.flatnonzero(self.rows[r0:r1])
            r0, r1 = r0 + int(inside[0]), r0 + int(inside[-1]) + 1
            at = (step * len(self.rows) + r0) * width
            read = {w: unpacked(values(self.f, self.head, v, at, (r1 - r0) * width), v.attributes) for w, v in self.wanted.items()}
            cells = (self.rows[r0:r1, None] & self.columns[None, :]).ravel() & ~np.all([np.isnan(x) for x in read.values()], axis=0)
            place = np.flatnonzero(cells)
            row, column = place // width + r0, place % width
            lat, lon = (column, row) if self.turned else (row, column)
            yield {"time": None if self.time is None else int(self.time[step]), "lat": lat, "lon": lon, **{w: x[place] for w, x in read.items()}}


def _within(x: np.ndarray, bounds: tuple | None) -> np.ndarray:
    return np.ones(len(x), bool) if bounds is None else (x >= bounds[0]) & (x <= bounds[1])


def _opened(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs, inner


@dataclass
class Shares(ds.InputPartition):
    """What one task reads: (path, share, number of shares) of each of its files."""

    files: list[tuple[str, int, int]]


class NetcdfReader(ds.DataSourceReader):
    def __init__(self, options: Mapping[str, str], variables: Sequence[str]):
        self.paths, self.bytes_a_task = json.loads(options["paths"]), int(options["bytesATask"])
        self.variables, self.bounds = list(variables), {k: tuple(v) for k, v in json.loads(options["bounds"]).items()}

    def partitions(self):
        """Large files in shares, small ones together."""
        out, held, size = [], [], 0
        for path, n in found_files(self.paths):
            shares = 1 if path.endswith(".zip") else max(1, -(-n // self.bytes_a_task))
            if shares > 1:
                out += [Shares([(path, i, shares)]) for i in range(shares)]
                continue
            if held and size + n > self.bytes_a_task:
                out.append(Shares(held))
                held, size = [], 0
            held, size = [*held, (path, 0, 1)], size + n
        return [*out, Shares(held)] if held else out or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        for path, share, shares in partition.files:
            fs, inner = _opened(path)
            with fs.open_input_file(inner) as f:
                if not path.endswith(".zip"):
                    yield from self._rows(path, None, Slabs(f, f.size(), self.variables, self.bounds), share, shares)
                    continue
                with zipfile.ZipFile(f) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        if info.filename.endswith(".nc"):
                            with z.open(info) as member:
                                yield from self._rows(path, info.filename, Slabs(member, info.file_size, self.variables, self.bounds), share, shares)

    def _rows(self, path, member, slabs: Slabs, share: int, shares: int) -> Iterator[pa.RecordBatch]:
        for b in slabs.batches(share, shares):
            n = len(b["lat"])
            time = pa.array([b["time"]], pa.int64()).cast(pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(path), n), pa.repeat(pa.scalar(member, pa.string()), n), pa.repeat(time[0], n), pa.repeat(time.cast(pa.date32(), safe=False)[0], n),
                    pa.array(b["lat"] * len(slabs.lon) + b["lon"], pa.int64()), pa.array(b["lat"], pa.int64()), pa.array(b["lon"], pa.int64()), pa.array(slabs.lat[b["lat"]]),
                    pa.array(slabs.lon[b["lon"]]), *(pa.array(b[v], from_pandas=True) for v in self.variables),
                ],
                names=["path", "member", "time", "date", "pixel", "lat_idx", "lon_idx", "lat", "lon", *self.variables],
            )


class NetcdfSource(ds.DataSource):
    """The data source ``netcdf``; options paths, variables and bounds (JSON), bytesATask."""

    @classmethod
    def name(cls):
        return "netcdf"

    def schema(self):
        columns = "".join(f", `{v}` double" for v in json.loads(self.options["variables"]))
        return f"path string, member string, time timestamp_ntz, date date, pixel long, lat_idx long, lon_idx long, lat double, lon double{columns}"

    def reader(self, schema):
        return NetcdfReader(self.options, json.loads(self.options["variables"]))


def found_files(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of files, and of the .nc and .zip files of folders, by path. A path that is not there is an error."""
    out = []
    for path in paths:
        fs, inner = _opened(path)
        info = fs.get_file_info(inner)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pyarrow.fs.FileType.File:
            out.append((path, info.size))
            continue
        inside = fs.get_file_info(pyarrow.fs.FileSelector(inner))
        out += [(f"{path.rstrip('/')}/{i.base_name}", i.size) for i in inside if i.type == pyarrow.fs.FileType.File and i.extension in ("nc", "zip")]
    return sorted(set(out))


def scan(
    spark: SparkSession, paths: str | Sequence[str], variables: Sequence[str], box: tuple[float, float, float, float] | None = None,
    days: tuple[date | str, date | str] | None = None, bytes_a_task: int = 128 << 20,
) -> DataFrame:
    """The rows of all files at the paths (files or folders), or those within a box (lon0, lat0, lon1, lat1) and from a first to a last day, ends included
    and in any order. Rasters without a time are within no days. No file gives an empty table; variables may be named by what a provider calls them."""
    bounds = {}
    if box is not None:
        bounds |= {"lon": sorted(map(float, box[0::2])), "lat": sorted(map(float, box[1::2]))}
    if days is not None:
        bounds["date"] = sorted((date.fromisoformat(str(d)) - date(1970, 1, 1)).days for d in days)
    spark.dataSource.register(NetcdfSource)
    options = {"paths": [paths] if isinstance(paths, str) else list(paths), "variables": list(variables), "bounds": bounds}
    return spark.read.format("netcdf").options(**{k: json.dumps(v) for k, v in options.items()}, bytesATask=str(bytes_a_task)).load()


def encode(dims: Mapping[str, int | None], variables: Mapping[str, tuple[Sequence[str], np.ndarray, Mapping]], version: int = 2) -> bytes:
    """A file's bytes: variables are (dimensions, values, attributes); the dimension of length None is the one of the records."""
    wide = version == 5
    codes = {np.dtype(k): c for c, k in KINDS.items()}

    def count(n: int) -> bytes:
        return n.to_bytes(8 if wide else 4, "big")

    def name(s: str) -> bytes:
        return count(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)

    def entries(tag: int, items: list[bytes]) -> bytes:
        return (tag if items else 0).to_bytes(4, "big") + count(len(items)) + b"".join(items)

    def attribute(key: str, value) -> bytes:
        raw = value.encode() if isinstance(value, str) else (x := np.atleast_1d(value).astype(np.atleast_1d(value).dtype.newbyteorder(">"))).tobytes()
        kind, n = (2, len(raw)) if isinstance(value, str) else (codes[x.dtype], len(x))
        return name(key) + kind.to_bytes(4, "big") + count(n) + raw + b"\0" * (-len(raw) % 4)

    ids, records = {d: i for i, d in enumerate(dims)}, 0
    made = {}
    for key, (on, array, attributes) in variables.items():
        array = np.asarray(array)
        array, record = array.astype(array.dtype.newbyteorder(">")), bool(on) and dims[on[0]] is None
        records = len(array) if record else records
        size = array.nbytes // max(1, len(array)) if record else array.nbytes
        head = name(key) + count(len(on)) + b"".join(count(ids[d]) for d in on) + entries(ATTRIBUTES, [attribute(k, a) for k, a in attributes.items()])
        made[key] = (array, record, size, head + codes[array.dtype].to_bytes(4, "big") + count(min(size + -size % 4, (1 << 32) - 1)))
    alone = sum(r for _, r, _, _ in made.values()) == 1
    top = b"CDF" + bytes([version]) + count(records) + entries(DIMENSIONS, [name(d) + count(n or 0) for d, n in dims.items()]) + entries(ATTRIBUTES, [])
    place = len(top) + len(entries(VARIABLES, [h + b"\0" * (4 if version == 1 else 8) for _, _, _, h in made.values()]))
    begins = {}
    for key, (_, record, size, _) in sorted(made.items(), key=lambda kv: kv[1][1]):  # those without records first
        begins[key] = place
        place += size if record and alone else size + -size % 4
    out = [top, entries(VARIABLES, [h + begins[k].to_bytes(4 if version == 1 else 8, "big") for k, (_, _, _, h) in made.items()])]
    out += [a.tobytes() + b"\0" * (-s % 4) for a, r, s, _ in made.values() if not r]
    for i in range(records):
        out += [a[i : i + 1].tobytes() + (b"" if alone else b"\0" * (-s % 4)) for a, r, s, _ in made.values() if r]
    return b"".join(out)


def write_frames(df: DataFrame, folder: str, variable: str, shape: tuple[int, int], day: str = "day", frames_a_file: int = 512) -> None:
    """Files of daily frames from rows of a day (counted from 1970, one row a day) and an array of shape[0] x shape[1] values, row-major, nulls as NaN.
    Coordinates are the places' numbers. A file holds one range of days and is one task's; a repeated task writes the same file again."""
    fs, inner = _opened(folder)
    fs.create_dir(inner)

    def one(frames):
        frames = frames.sort_values(day)
        block = int(frames[day].iloc[0]) // frames_a_file
        stacked = np.stack([np.asarray(x, "f8").reshape(shape) for x in frames[variable]])
        lat, lon, time = np.arange(shape[0], dtype="f8"), np.arange(shape[1], dtype="f8"), frames[day].to_numpy("f8")
        held = {"lat": (("lat",), lat, {}), "lon": (("lon",), lon, {}), "time": (("time",), time, {"units": "days since 1970-01-01"}), variable: (("time", "lat", "lon"), stacked, {})}
        fs, inner = _opened(folder)
        with fs.open_output_stream(f"{inner}/{block:+09d}.nc") as out:
            out.write(encode({"time": None, "lat": shape[0], "lon": shape[1]}, held))
        return frames[[day]].head(1)

    df.select(F.col(day).cast("long").alias(day), variable).groupBy(F.floor(F.col(day) / frames_a_file)).applyInPandas(one, f"`{day}` long").write.format("noop").mode("overwrite").save()
