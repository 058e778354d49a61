"""A Spark data source for the classic NetCDF formats (CDF-1, CDF-2 and CDF-5): tables of cells from arrays, and back.

    spark.dataSource.register(NetcdfDataSource)
    spark.read.format("netcdf").option("variables", "flux").load("/data/grids")

A row is a cell of the asked variables: a column for each dimension (its coordinate variable's value, or the index), then
the variables. Tasks read shares of a file's first dimension, and of these only the bytes of the asked variables and
coordinates, at the places that the header names. Filters on coordinates choose what is read if Spark hands them over
(spark.sql.python.filterPushdown.enabled; `read_netcdf` looks at it). Writing makes one dense file for each key.

Times are decoded from "<unit> since <date>" in the standard calendar; other calendars keep their numbers. _FillValue,
missing_value and NaN are null; scale_factor and add_offset are applied. Characters along the last dimension are a string.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .shared import files_below, opened

# The format's tags, and its types with their numpy and Spark types.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
KINDS = {1: (">i1", "tinyint"), 2: ("S1", "string"), 3: (">i2", "smallint"), 4: (">i4", "int"), 5: (">f4", "float"), 6: (">f8", "double"), 7: (">u1", "smallint"), 8: (">u2", "int"), 9: (">u4", "bigint"), 10: (">i8", "bigint"), 11: (">u8", "decimal(20,0)")}
TYPES = {"tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "decimal(20,0)": T.DecimalType(20, 0)}
STREAMED = {4: 0xFFFFFFFF, 8: 0xFFFFFFFFFFFFFFFF}
UNITS_US = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000, "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": 86_400_000_000, "d": 86_400_000_000}
CALENDARS = ("standard", "gregorian", "proleptic_gregorian")
EPOCH = dt.datetime(1970, 1, 1)
#: cells of a batch, bytes of a file that a task takes, bytes of a header that are read at first
CELLS, SPLIT_BYTES, HEAD_BYTES = 1 << 16, 64 << 20, 1 << 16
#: bytes between a variable's parts that are read along, bytes of records that are put together at once, of cells held in memory
GAP_BYTES, BLOCK_BYTES, SPOOL_BYTES = 1 << 12, 4 << 20, 8 << 20
SUFFIXES = (".nc", ".nc3", ".cdf")


# ---------------------------------------------------------------- the format

@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attrs: dict
    kind: int
    begin: int
    record: bool

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(KINDS[self.kind][0])


@dataclass
class Header:
    version: int
    records: int
    names: list[str]
    sizes: list[int]  # of the dimensions; the record dimension's is the number of records
    attrs: dict
    variables: dict[str, Variable]
    record_bytes: int

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.sizes[d] for d in v.dims)


class _Short(Exception):
    """The header goes on beyond the bytes at hand."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at, self.wide = data, 4, 8 if data[3] == 5 else 4

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int = 4) -> int:
        return int.from_bytes(self.take(n), "big")

    def count(self) -> int:
        return self.number(self.wide)

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode("utf-8", "replace")

    def listed(self, tag: int) -> int:
        found, n = self.number(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("not a classic NetCDF header")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(ATTRIBUTE)):
            name, kind = self.name(), self.number()
            if kind not in KINDS:
                raise ValueError(f"unknown NetCDF type {kind}")
            n = self.count()
            raw = self.padded(n * np.dtype(KINDS[kind][0]).itemsize)
            out[name] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, KINDS[kind][0]).tolist()
        return out


def parse_header(data: bytes, size: int) -> Header:
    """The header of a file of `size` bytes that begins with data; _Short if data ends too early."""
    if len(data) < 4:
        raise ValueError("not a classic NetCDF file")
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file" + (" (HDF5 files need another reader)" if data[:4] == b"\x89HDF" else ""))
    c = _Cursor(data)
    records = c.count()
    dims = [(c.name(), c.count()) for _ in range(c.listed(DIMENSION))]
    attrs = c.attributes()
    variables, bytes_of = {}, {}
    record_dim = next((i for i, (_, n) in enumerate(dims) if n == 0), None)
    for _ in range(c.listed(VARIABLE)):
        name = c.name()
        ids = tuple(c.count() for _ in range(c.count()))
        own, kind = c.attributes(), c.number()
        c.count()  # the stored size can't be trusted for large variables; it follows from the shape
        begin = c.number(4 if data[3] == 1 else 8)
        if kind not in KINDS or any(i >= len(dims) for i in ids):
            raise ValueError(f"variable {name} has an unknown type or dimension")
        variables[name] = Variable(name, ids, own, kind, begin, bool(ids) and ids[0] == record_dim)
        bytes_of[name] = math.prod(dims[i][1] for i in ids if i != record_dim) * variables[name].dtype.itemsize
    of_records = [n for n, v in variables.items() if v.record]
    # a single record variable isn't padded
    record_bytes = bytes_of[of_records[0]] if len(of_records) == 1 else sum(-(-bytes_of[n] // 4) * 4 for n in of_records)
    if records == STREAMED[c.wide]:
        first = min((variables[n].begin for n in of_records), default=size)
        records = (size - first) // record_bytes if record_bytes else 0
    sizes = [records if i == record_dim else n for i, (_, n) in enumerate(dims)]
    return Header(data[3], records, [n for n, _ in dims], sizes, attrs, variables, record_bytes)


class NetcdfFile:
    """One open file; `read(offset, n)` gives bytes. Counts what it has read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.size, self.bytes_read = read, size, 0
        have = HEAD_BYTES
        while True:
            data = self.read(0, min(have, size))
            try:
                self.header = parse_header(data, size)
                return
            except _Short:
                if have >= size:
                    raise ValueError("the NetCDF header is cut off") from None
                have *= 4

    @classmethod
    def open(cls, path: str) -> NetcdfFile:
        system, at = opened(path)
        f = system.open_input_file(at)
        return cls(lambda offset, n: f.read_at(n, offset), f.size())

    def read(self, offset: int, n: int) -> bytes:
        out = self._read(offset, n)
        self.bytes_read += len(out)
        if len(out) < n:
            raise ValueError(f"the file ends at {offset + len(out)}, before {offset + n}")
        return out

    def flat(self, v: Variable, outer: int, stop: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The numbers of a variable at places outer..stop of its first dimension; lo..hi: within each place."""
        shape = self.header.shape(v)
        inner, width = math.prod(shape[1:]), v.dtype.itemsize
        hi = inner if hi is None else hi
        if not shape:
            return np.frombuffer(self.read(v.begin, width), v.dtype)
        if v.record and (every := self.header.record_bytes) - (hi - lo) * width <= GAP_BYTES:  # whole stretches of records
            parts, some, step = [], (hi - lo) * width, max(1, BLOCK_BYTES // max(1, every))
            for r in range(outer, stop, step):
                k = min(step, stop - r)
                got = self.read(v.begin + r * every + lo * width, (k - 1) * every + some)
                parts.append(np.frombuffer(got + bytes(every - some), np.uint8).reshape(k, every)[:, :some].tobytes())
        elif v.record:
            parts = [self.read(v.begin + r * self.header.record_bytes + lo * width, (hi - lo) * width) for r in range(outer, stop)]
        elif (lo, hi) == (0, inner):
            parts = [self.read(v.begin + outer * inner * width, (stop - outer) * inner * width)]
        else:
            parts = [self.read(v.begin + (r * inner + lo) * width, (hi - lo) * width) for r in range(outer, stop)]
        return np.frombuffer(b"".join(parts), v.dtype)


# ---------------------------------------------------------------- values

def time_origin(attrs: dict) -> tuple[int, int] | None:
    """(microseconds of a unit, of the origin since 1970) of a standard time variable."""
    m = re.fullmatch(r"\s*([A-Za-z]+?)s?\s+since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(?:Z|UTC|GMT|\+?00:?00)?\s*", str(attrs.get("units", "")))
    if not m or str(attrs.get("calendar", "standard")).lower() not in CALENDARS:
        return None
    unit = UNITS_US.get(m[1].lower()) or UNITS_US.get(m[1].lower() + "s")
    if unit is None:
        return None
    second = float(m[7] or 0)
    origin = dt.datetime(max(int(m[2]), 1), int(m[3]), int(m[4]), int(m[5] or 0), int(m[6] or 0)) - EPOCH
    return unit, (origin.days * 86_400 + origin.seconds) * 1_000_000 + round(second * 1e6)


def is_packed(v: Variable) -> bool:
    return "scale_factor" in v.attrs or "add_offset" in v.attrs


def spark_type(v: Variable) -> str:
    if v.kind == 2:
        return "string"
    if time_origin(v.attrs):
        return "timestamp_ntz"
    return "double" if is_packed(v) else KINDS[v.kind][1]


def _scalar(x) -> float:
    return x[0] if isinstance(x, list) else x


def decoded(v: Variable, raw: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Numbers as they are stored, as an Arrow column without fill values."""
    gone = np.isnan(raw) if raw.dtype.kind == "f" else np.zeros(len(raw), bool)
    for name in ("_FillValue", "missing_value"):
        if name in v.attrs and not isinstance(v.attrs[name], str):
            gone |= np.isin(raw, np.array(v.attrs[name]).astype(raw.dtype))
    origin = time_origin(v.attrs)
    if origin and pa.types.is_timestamp(kind):
        safe = np.where(gone, 0, raw)
        us = (safe.astype(np.int64) * origin[0] if raw.dtype.kind in "iu" else np.rint(safe.astype(np.float64) * origin[0]).astype(np.int64)) + origin[1]
        return pa.array(us, pa.int64(), mask=gone).cast(pa.timestamp("us"))
    if is_packed(v):
        raw = raw.astype(np.float64) * _scalar(v.attrs.get("scale_factor", 1.0)) + _scalar(v.attrs.get("add_offset", 0.0))
    native = raw.astype(raw.dtype.newbyteorder("="), copy=False)
    return pa.array(native, mask=gone).cast(kind)


def texts(raw: np.ndarray, width: int) -> pa.Array:
    joined = np.ascontiguousarray(raw).reshape(-1, width).view(f"S{width}").ravel() if width else np.zeros(len(raw), "S1")
    return pa.array([x.decode("utf-8", "replace") for x in joined.tolist()], pa.string())


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


# ---------------------------------------------------------------- reading

def cell_dims(h: Header, v: Variable) -> tuple[int, ...]:
    return v.dims[:-1] if v.kind == 2 else v.dims


def data_variables(h: Header, asked: Sequence[str] | None) -> list[Variable]:
    """The asked variables, or all that lie on the dimensions of the (first) one with most; no coordinate variables."""
    if asked:
        if missing := [n for n in asked if n not in h.variables]:
            raise ValueError(f"no variable {missing[0]}; there are {sorted(h.variables)}")
        return [h.variables[n] for n in asked]
    own = [v for n, v in h.variables.items() if not (n in h.names and len(v.dims) == 1) and cell_dims(h, v)]
    widest = max((cell_dims(h, v) for v in own), key=len, default=())
    return [v for v in own if cell_dims(h, v) == widest]


def table_dims(h: Header, asked: list[Variable]) -> tuple[int, ...]:
    dims = max((cell_dims(h, v) for v in asked), key=len, default=())
    if odd := [v.name for v in asked if not set(cell_dims(h, v)) <= set(dims)]:
        raise ValueError(f"variables {[v.name for v in asked]} have no dimensions in common: ask for {odd} apart")
    return dims


def coordinate(h: Header, dim: int) -> Variable | None:
    v = h.variables.get(h.names[dim])
    return v if v is not None and v.dims == (dim,) else None


@dataclass
class Share(InputPartition):
    """The k-th of m parts of a file's first dimension."""

    path: str
    k: int
    m: int


LONG = ("file", "variable", "long_name", "units")


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.asked = [x.strip() for x in options["variables"].split(",")] if options.get("variables") else None
        self.long, self.split = options.get("layout", "wide") == "long", int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[tuple[str, str, object]] = []

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in files_below(self.path, SUFFIXES):
            m = max(1, -(-size // self.split))
            out += [Share(path, k, m) for k in range(m)]
        return out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        f = NetcdfFile.open(share.path)
        stored = f.header.variables
        asked = self.asked or ([] if self.long else [n for n in self.schema.names if n in stored and n not in f.header.names])
        some = [stored[n] for n in asked if n in stored] if asked else data_variables(f.header, None)
        if not some:
            return
        groups = [[v] for v in some] if self.long else [some]
        for group in groups:
            yield from read_table(f, share, group, self.schema, self.filters, self.long)


class PushingReader(NetcdfReader):
    """The reader with filters on coordinates; Spark applies them again, as only ranges are left out here."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], signs[type(f)], f.value))
            yield f


def chosen(column: pa.Array, filters: list[tuple[str, object]]) -> np.ndarray:
    """Which coordinates meet the filters; a null meets none."""
    import pyarrow.compute as pc

    ops = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
    out = np.ones(len(column), bool)
    for sign, value in filters:
        try:
            hit = pc.is_in(column, pa.array(list(value), column.type)) if sign == "in" else ops[sign](column, pa.scalar(value, column.type))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, pa.ArrowTypeError):
            continue  # Spark applies the filter in any case
        out &= hit.fill_null(False).to_numpy(zero_copy_only=False)
    return out


def read_table(f: NetcdfFile, share: Share, group: list[Variable], schema: T.StructType, filters: list, long: bool) -> Iterator[pa.RecordBatch]:
    h = f.header
    dims = table_dims(h, group)
    if not dims:
        return
    sizes = [h.sizes[d] for d in dims]
    outer, inner = sizes[0], math.prod(sizes[1:])
    first, last = share.k * outer // share.m, (share.k + 1) * outer // share.m
    if first >= last or not inner:
        return
    names = {h.names[d]: i for i, d in enumerate(dims)}
    kinds = {x.name: arrow_type(x.dataType) for x in schema.fields}
    axes = []  # a column of coordinates for each dimension
    for d in dims:
        v = coordinate(h, d)
        kind = kinds.get(h.names[d])
        begin, end = (first, last) if d == dims[0] else (0, h.sizes[d])  # of the first one, the share's part
        if v is None:
            axes.append(pa.array(np.arange(begin, end)).cast(kind or pa.int64()))
        else:
            axes.append(decoded(v, f.flat(v, begin, end), kind or arrow_type(TYPES[spark_type(v)])))
    of = [[(sign, value) for name, sign, value in filters if name == h.names[d]] for d in dims]
    keep = [chosen(a, x) if x else np.ones(len(a), bool) for a, x in zip(axes, of, strict=True)]
    if not all(k.any() for k in keep):
        return
    # the part of the inner cells that the second dimension's chosen range spans
    lo, hi = 0, inner
    if len(dims) > 1:
        at, step = np.flatnonzero(keep[1]), inner // sizes[1]
        lo, hi = int(at[0]) * step, (int(at[-1]) + 1) * step
    whole: dict[str, np.ndarray] = {}

    def values(v: Variable, places: np.ndarray, a: int, b: int, index: list[np.ndarray]) -> pa.Array:
        own, kind = cell_dims(h, v), kinds.get("value" if long else v.name)
        width = h.shape(v)[-1] if v.kind == 2 else 1
        if own == dims:
            runs = np.split(places, np.flatnonzero(np.diff(places) != 1) + 1)
            raw = np.concatenate([f.flat(v, int(r[0]), int(r[-1]) + 1, a * width, b * width) for r in runs])
        else:  # on fewer dimensions: read once and spread out
            if v.name not in whole:
                whole[v.name] = f.flat(v, 0, h.sizes[v.dims[0]] if v.dims else 1)
            at = np.zeros(len(index[0]), np.int64)
            for d in own:
                at = at * h.sizes[d] + index[dims.index(d)]
            raw = whole[v.name].reshape(-1, width)[at].ravel()
        return texts(raw, width) if v.kind == 2 else decoded(v, raw, kind)

    base = os.path.basename(share.path)
    rows_at_once = max(1, CELLS // (hi - lo))
    places = np.flatnonzero(keep[0]) + first
    for p in range(0, len(places), rows_at_once):
        some = places[p : p + rows_at_once]
        for a in range(lo, hi, CELLS):
            b = min(a + CELLS, hi)
            inside = np.unravel_index(np.arange(a, b), sizes[1:]) if len(dims) > 1 else ()
            index = [np.repeat(some, b - a), *(np.tile(i, len(some)) for i in inside)]
            on_axis = [index[0] - first, *index[1:]]
            mask = np.logical_and.reduce([k[i] for k, i in zip(keep, on_axis, strict=True)])
            if not mask.any():
                continue
            rows = pa.array(np.flatnonzero(mask))
            fixed = {"file": base}
            if long:
                v = group[0]
                fixed |= {"variable": v.name, "long_name": v.attrs.get("long_name"), "units": v.attrs.get("units")}
            out = []
            for x in schema.fields:
                if x.name in names:
                    out.append(axes[names[x.name]].take(pa.array(on_axis[names[x.name]])).take(rows))
                elif x.name in fixed:
                    out.append(pa.array([fixed[x.name]] * len(rows), pa.string()))
                elif long and x.name == "value":
                    out.append(values(group[0], some, a, b, index).take(rows))
                elif not long and (v := next((v for v in group if v.name == x.name), None)):
                    out.append(values(v, some, a, b, index).take(rows))
                else:
                    out.append(pa.nulls(len(rows), kinds[x.name]))
            yield pa.RecordBatch.from_arrays(out, [x.name for x in schema.fields])


# ---------------------------------------------------------------- writing

WRITTEN = {"tinyint": 1, "string": 2, "smallint": 3, "int": 4, "float": 5, "double": 6, "bigint": 10, "timestamp_ntz": 6}
FILLS = {1: -127, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 10: -9223372036854775806}
TIME_ATTRS = {"units": "seconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def classic_head(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], int, dict]], attrs: dict | None = None, version: int = 2, record: str | None = None) -> tuple[bytes, dict[str, int]]:
    """The header of a file with (dimensions, type, attributes) by variable, and the bytes of each one (of a record), padded."""
    wide = 8 if version == 5 else 4
    num = lambda n: n.to_bytes(wide, "big")
    text = lambda s: num(len(s.encode())) + _pad(s.encode())

    def listed(tag: int, items: list[bytes]) -> bytes:
        return (tag.to_bytes(4, "big") + num(len(items)) if items else bytes(4) + num(0)) + b"".join(items)

    def attributes(a: dict) -> bytes:
        out = []
        for k, v in a.items():
            if isinstance(v, str):
                out.append(text(k) + (2).to_bytes(4, "big") + num(len(v.encode())) + _pad(v.encode()))
            else:
                kind, values = v
                out.append(text(k) + kind.to_bytes(4, "big") + num(len(values)) + _pad(np.array(values).astype(KINDS[kind][0]).tobytes()))
        return listed(ATTRIBUTE, out)

    order = list(dims)
    head = b"CDF" + bytes([version]) + num(dims[record] if record else 0) + listed(DIMENSION, [text(n) + num(0 if n == record else s) for n, s in dims.items()]) + attributes(attrs or {})
    one = {n: -(-math.prod(dims[d] for d in ds if d != record) * np.dtype(KINDS[k][0]).itemsize // 4) * 4 for n, (ds, k, _) in variables.items()}
    moving = moving_variables(variables, record)
    offset_bytes = 4 if version == 1 else 8

    def described(begins: dict[str, int]) -> bytes:
        items = []
        for n, (ds, kind, a) in variables.items():
            size = min(one[n], (1 << 32) - 1) if wide == 4 else one[n]
            items.append(text(n) + num(len(ds)) + b"".join(num(order.index(d)) for d in ds) + attributes(a) + kind.to_bytes(4, "big") + num(size) + begins[n].to_bytes(offset_bytes, "big"))
        return listed(VARIABLE, items)

    at, begins = len(head) + len(described(dict.fromkeys(variables, 0))), {}
    for n in [*(n for n in variables if n not in moving), *moving]:
        begins[n] = at
        at += one[n]
    return head + described(begins), one


def moving_variables(variables: dict[str, tuple], record: str | None) -> list[str]:
    """Those on the record dimension; a single one isn't padded."""
    return [n for n, (ds, *_) in variables.items() if record is not None and bool(ds) and ds[0] == record]


def classic_bytes(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], int, dict, np.ndarray]], attrs: dict | None = None, version: int = 2, record: str | None = None) -> bytes:
    """A file: dims, and (dimensions, type, attributes, values) by variable; `record` is the dimension without a bound."""
    head, _ = classic_head(dims, {n: v[:3] for n, v in variables.items()}, attrs, version, record)
    moving = moving_variables(variables, record)
    stored = {n: np.ascontiguousarray(v.astype(KINDS[k][0])) for n, (_, k, _, v) in variables.items()}
    body = [head, *(_pad(stored[n].tobytes()) for n in variables if n not in moving)]
    for r in range(dims[record] if record else 0):
        body += [stored[n][r : r + 1].tobytes() if len(moving) == 1 else _pad(stored[n][r : r + 1].tobytes()) for n in moving]
    return b"".join(body)


class GridFile:
    """A dense file of cells that come sorted by the first dimension; absent cells and nulls have the fill value; of equal
    cells the last one counts. The header needs the sizes, so that cells go to a temporary file first (to memory, if few) and
    records are put together from there: what is held are some blocks of records, a record at least, and the inner axes."""

    def __init__(self, dims: Sequence[str], schema: T.StructType, attrs: dict):
        self.dims, self.attrs = list(dims), attrs
        self.kinds = {x.name: x.dataType.simpleString() for x in schema.fields}
        self.names = [n for n in self.kinds if n not in dims]
        self.records, self.last = 0, None  # of the first dimension's values
        self.axes = {d: np.zeros(0, np.int64) for d in self.dims[1:]}
        self.widths = {n: 1 for n in self.names if WRITTEN[self.kinds[n]] == 2}
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.cells: pa.RecordBatchStreamWriter | None = None

    def _numbers(self, batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(name)
        if column.null_count:
            raise ValueError(f"dimension {name} holds a null")
        return (column.cast(pa.timestamp("us")).cast(pa.int64()) if self.kinds[name] == "timestamp_ntz" else column).to_numpy(zero_copy_only=False)

    @staticmethod
    def _turns(values: np.ndarray, last) -> np.ndarray:
        """Where a value differs from the one before it."""
        before = np.concatenate([values[:1] if last is None else np.array([last], values.dtype), values[:-1]])
        turn = (values != before) & ~((values != values) & (before != before))  # NaN is one value
        turn[0] |= last is None
        if (values < before).any() or ((before != before) & (values == values)).any():
            raise ValueError("rows aren't sorted by the first dimension; use write_netcdf")
        return turn

    def add(self, batch: pa.RecordBatch) -> None:
        import pyarrow.compute as pc

        if not len(batch):
            return
        first = self._numbers(batch, self.dims[0])
        self.records += int(self._turns(first, self.last).sum())
        self.last = first[-1]
        for d, axis in self.axes.items():
            values = self._numbers(batch, d)
            self.axes[d] = np.unique(np.concatenate([axis.astype(values.dtype), values]))
        for n in self.widths:
            self.widths[n] = max(self.widths[n], pc.max(pc.binary_length(batch.column(n))).as_py() or 0)
        if self.cells is None:
            self.cells = pa.ipc.new_stream(self.spool, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
        self.cells.write_batch(batch)

    def _coordinate(self, d: str, values: np.ndarray) -> np.ndarray:
        return values / 1e6 if self.kinds[d] == "timestamp_ntz" else values

    def write(self, out) -> None:
        """The file's bytes, to a stream."""
        first = self.dims[0]
        sizes = {first: self.records, **{d: len(a) for d, a in self.axes.items()}, **{f"{n}_length": w for n, w in self.widths.items()}}
        variables: dict[str, tuple[tuple[str, ...], int, dict]] = {}
        for n in [*self.dims, *self.names]:
            kind, times = WRITTEN[self.kinds[n]], TIME_ATTRS if self.kinds[n] == "timestamp_ntz" else {}
            own = {**times, **self.attrs.get(n, {})}
            if n in self.dims:
                variables[n] = ((n,), kind, own)
            elif kind == 2:
                variables[n] = ((*self.dims, f"{n}_length"), 2, own)
            else:
                variables[n] = (tuple(self.dims), kind, {**own, "_FillValue": (kind, [FILLS[kind]])})
        head, one = classic_head(sizes, variables, self.attrs.get("", {}), 5 if any(k == 10 for _, k, _ in variables.values()) else 2, first)
        out.write(head)
        for d, axis in self.axes.items():
            out.write(_pad(self._coordinate(d, axis).astype(KINDS[variables[d][1]][0]).tobytes()))
        inner = math.prod(len(a) for a in self.axes.values())
        moving = moving_variables(variables, first)
        at, every = {}, 0  # where a variable begins in a record
        for n in moving:
            at[n] = every
            every += one[n] if len(moving) > 1 else np.dtype(KINDS[variables[n][1]][0]).itemsize
        empty = np.zeros((1, every), np.uint8)
        for n in self.names:
            if n not in self.widths:
                kind = variables[n][1]
                fill = np.full(inner, FILLS[kind], KINDS[kind][0]).view(np.uint8)
                empty[0, at[n] : at[n] + len(fill)] = fill
        self.cells.close()
        self.spool.seek(0)
        step, opened_record, last = max(1, BLOCK_BYTES // every), None, None
        for batch in pa.ipc.open_stream(self.spool):
            values = self._numbers(batch, first)
            record = np.cumsum(self._turns(values, last)) - (last is None)  # 0: the one that is open
            last = values[-1]
            for lo in range(0, int(record[-1]) + 1, step):
                a, b = np.searchsorted(record, [lo, lo + step])
                part, row = batch.slice(a, b - a), record[a:b] - lo
                block = np.repeat(empty, min(step, int(record[-1]) + 1 - lo), axis=0)
                if lo == 0 and opened_record is not None:
                    block[:1] = opened_record
                self._fill(block, part, row, at, variables, inner)
                done = lo + len(block) <= record[-1]
                out.write((block if done else block[:-1]).tobytes())
                if not done:  # goes on in the next batch, perhaps
                    opened_record = block[-1:].copy()
        out.write(opened_record.tobytes())
        self.spool.close()

    def _fill(self, block: np.ndarray, cells: pa.RecordBatch, row: np.ndarray, at: dict[str, int], variables: dict, inner: int) -> None:
        cell = np.zeros(len(cells), np.int64)
        for d, axis in self.axes.items():
            cell = cell * len(axis) + np.searchsorted(axis, self._numbers(cells, d))
        first = self.dims[0]

        def put(name: str, rows: np.ndarray, places: np.ndarray, values: np.ndarray, count: int) -> None:
            stored = block[:, at[name] : at[name] + count * values.dtype.itemsize].copy()
            stored.view(values.dtype)[rows, places] = values
            block[:, at[name] : at[name] + stored.shape[1]] = stored

        put(first, row, np.zeros(len(row), np.int64), self._coordinate(first, self._numbers(cells, first)).astype(KINDS[variables[first][1]][0]), 1)
        for n in self.names:
            column, kind = cells.column(n), variables[n][1]
            if kind == 2:
                put(n, row, cell, np.array([(x or "").encode() for x in column.to_pylist()], f"S{self.widths[n]}"), inner)
                continue
            if self.kinds[n] == "timestamp_ntz":
                column = column.cast(pa.timestamp("us")).cast(pa.int64())
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            got = column.fill_null(0).to_numpy(zero_copy_only=False)[valid]
            put(n, row[valid], cell[valid], (got / 1e6 if self.kinds[n] == "timestamp_ntz" else got).astype(KINDS[kind][0]), inner)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NetcdfWriter(DataSourceArrowWriter):
    """One file for each value of the key columns, by which a task's rows are sorted, then by the dimensions; files get their
    names on commit."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.schema = options["path"], overwrite, schema
        self.dims, self.key = options["dims"].split(","), [x for x in options.get("key", "").split(",") if x]
        self.attrs = json.loads(options.get("attributes", "{}"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        stored = T.StructType([x for x in self.schema.fields if x.name not in self.key])
        done: list[tuple[str, str]] = []
        held: GridFile | None = None
        last: tuple | None = None

        def close() -> None:
            if held is None:
                return
            stem = "_".join(["part", *(re.sub(r"[^A-Za-z0-9.-]", "-", str(x)) for x in last or ())])
            name, hidden = f"{stem}-{uuid.uuid4().hex}.nc", f"_writing-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{root}/{hidden}") as f:
                held.write(f)
            done.append((hidden, name))

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in self.key), strict=True)) if self.key else [()] * len(b)
            cells = b.select(stored.names)
            lo = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[lo]:
                    if held is None or last != keys[lo]:
                        close()
                        held, last = GridFile(self.dims, stored, self.attrs), keys[lo]
                    held.add(cells.slice(lo, i - lo))
                    lo = i
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        old = [p for p, _ in files_below(self.path, SUFFIXES)] if self.overwrite and system.get_file_info(root).type == fs.FileType.Directory else []
        for m in messages:
            for hidden, name in m.files if m else ():
                system.move(f"{root}/{hidden}", f"{root}/{name}")
        for p in old:
            system.delete_file(opened(p)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for m in messages:
            for hidden, _ in m.files if m else ():
                system.delete_file(f"{root}/{hidden}")


class NetcdfDataSource(DataSource):
    """Options for reading: path, variables (comma-separated; all on the largest set of dimensions if absent), layout
    (wide: a column a variable; long: file, variable, long_name, units, coordinates, value), split_bytes, pushdown.
    The schema is that of the first file; a given one chooses columns, and `file` is one of them."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> T.StructType:
        found = files_below(self.options["path"], SUFFIXES)
        if not found:
            raise FileNotFoundError(f"no NetCDF files in {self.options['path']}")
        h = NetcdfFile.open(found[0][0]).header
        asked = data_variables(h, [x.strip() for x in self.options["variables"].split(",")] if self.options.get("variables") else None)
        coords = [(h.names[d], spark_type(v) if (v := coordinate(h, d)) else "bigint", {}) for d in table_dims(h, asked)]
        if self.options.get("layout", "wide") == "long":
            pairs = [*((n, "string", {}) for n in LONG), *coords, ("value", "double", {})]
        else:
            units = lambda v: {"units": v.attrs["units"]} if isinstance(v.attrs.get("units"), str) else {}
            pairs = [*coords, *((v.name, spark_type(v), units(v)) for v in asked)]
        return T.StructType([T.StructField(n, TYPES[t], True, m) for n, t, m in pairs])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else NetcdfReader
        return kind(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options, schema, overwrite)


def read_netcdf(spark: SparkSession, path: str, variables: Sequence[str] | None = None, layout: str = "wide", schema: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cells of the classic NetCDF files in a folder. Only the asked variables' bytes are read. A file without the asked
    variables gives no rows; one without some of them has nulls there. Empty dimensions give no rows."""
    spark.dataSource.register(NetcdfDataSource)
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    r = spark.read.format("netcdf").option("layout", layout).option("split_bytes", split_bytes).option("pushdown", pushing)
    if variables:
        r = r.option("variables", ",".join(variables))
    return (r.schema(schema) if schema else r).load(path)


def write_netcdf(df: DataFrame, path: str, dims: Sequence[str], per_file: Sequence[str] = (), attributes: dict | None = None, mode: str = "append") -> None:
    """Write one dense file for each value of the per_file columns (or one a partition); the first dimension is the record
    dimension. A file is put together in one task, by records, from rows that Spark sorts: a record must fit in memory, a file
    needn't. attributes: by variable."""
    df.sparkSession.dataSource.register(NetcdfDataSource)
    if per_file:
        df = df.repartition(*per_file).sortWithinPartitions(*per_file, *dims)
    else:  # of equal cells the last one counts
        df = df.withColumn("_place", F.monotonically_increasing_id()).sortWithinPartitions(*dims, "_place").drop("_place")
    w = df.write.format("netcdf").mode(mode).option("dims", ",".join(dims)).option("key", ",".join(per_file)).option("attributes", json.dumps(attributes or {}))
    w.save(path)


def with_component_time(df: DataFrame, parts: DataFrame, on: Sequence[str], component: str, time: str = "time") -> DataFrame:
    """df with times from a table (on, component, value) of year, month, day, hour, minute, second by index."""
    each = parts.groupBy(*on).agg(*[F.max(F.when(F.col(component) == i, F.col("value"))).cast("int").alias(f"_{i}") for i in range(6)])
    made = each.select(*on, F.make_timestamp_ntz(*[F.col(f"_{i}") for i in range(6)]).alias("_time"))
    return df.join(made, list(on), "left").withColumn(time, F.col("_time")).drop("_time")
