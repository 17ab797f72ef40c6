"""NetCDF's classic format (versions 1, 2 and 5): a header of dimensions, attributes and variables, then big-endian arrays. Ranges of steps are read alone."""

from __future__ import annotations

import math
import struct
from typing import Any, BinaryIO

import numpy as np

# Fixed values of the format: tags of the lists of a header, and the codes of types.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_CODES = {np.dtype(t): c for c, t in _TYPES.items()}


class Variable:
    """A variable; v[a:b] are its steps a to b along the first dimension, masked where they hold the fill value, and with scale and offset applied."""

    def __init__(self, file: Classic, dims: list[int], attrs: dict[str, Any], kind: np.dtype, size: int, begin: int):
        self._file, self._dims, self._attrs, self._kind, self._size, self._begin = file, dims, attrs, kind, size, begin
        self.record = bool(dims) and file.sizes[dims[0]] == 0
        self.shape = tuple(file.n_records if self.record and i == 0 else file.sizes[d] for i, d in enumerate(dims))
        self.dimensions = tuple(file.names[d] for d in dims)

    def __len__(self) -> int:
        return self.shape[0]

    def ncattrs(self) -> list[str]:
        return list(self._attrs)

    def getncattr(self, name: str):
        return self._attrs[name]

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._attrs:
            raise AttributeError(name)
        return self._attrs[name]

    def raw(self, first: int, last: int) -> np.ndarray:
        inner, f = self.shape[1:], self._file
        each = math.prod(inner) * self._kind.itemsize
        if not self.record:
            f.stream.seek(self._begin + first * each)
            return np.frombuffer(f.stream.read((last - first) * each), self._kind).reshape(last - first, *inner)
        f.stream.seek(self._begin + first * f.record_size)  # records of all variables lie one behind the other
        got = np.frombuffer(f.stream.read(max(0, (last - first - 1) * f.record_size + each)).ljust((last - first) * f.record_size, b"\0"), np.uint8)
        return np.ascontiguousarray(got.reshape(last - first, f.record_size)[:, :each]).view(self._kind).reshape(last - first, *inner)

    def __getitem__(self, at: slice) -> np.ndarray:
        first, last, _ = at.indices(len(self))
        got = self.raw(first, max(first, last))
        if got.dtype.kind == "S":
            return got
        fills = [self._attrs[k] for k in ("_FillValue", "missing_value") if k in self._attrs]
        hidden = np.isin(got, np.array([np.asarray(x).ravel()[0] for x in fills]).astype(got.dtype)) if fills else False
        if "scale_factor" in self._attrs or "add_offset" in self._attrs:
            got = got * float(self._attrs.get("scale_factor", 1)) + float(self._attrs.get("add_offset", 0))
        return np.ma.array(got, mask=hidden)


class Classic:
    """An open file: variables, attributes (ncattrs, getncattr), groups (none in this format)."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.groups = stream, {}
        if stream.read(3) != b"CDF" or (version := stream.read(1)[0]) not in (1, 2, 5):
            raise ValueError("no NetCDF file of the classic format")
        self._count, self._offset = (">q", ">q") if version == 5 else (">i", ">i" if version == 1 else ">q")
        self.n_records = self._number()
        self.names, self.sizes = [], []
        for _ in range(self._list(_DIMENSIONS)):
            self.names.append(self._name())
            self.sizes.append(self._number())
        self._attrs = self._attributes()
        found = {}
        for _ in range(self._list(_VARIABLES)):
            name = self._name()
            dims = [self._number() for _ in range(self._number())]
            attrs, kind, size = self._attributes(), np.dtype(_TYPES[self._plain(">i")]), self._number()
            found[name] = (dims, attrs, kind, size, self._plain(self._offset))
        self.variables = {n: Variable(self, *v) for n, v in found.items()}
        records = [v for v in self.variables.values() if v.record]
        inner = [math.prod(v.shape[1:]) * v._kind.itemsize for v in records]
        self.record_size = inner[0] if len(inner) == 1 else sum(-(-n // 4) * 4 for n in inner)  # a single one isn't padded

    def __enter__(self) -> Classic:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def ncattrs(self) -> list[str]:
        return list(self._attrs)

    def getncattr(self, name: str):
        return self._attrs[name]

    def _plain(self, code: str) -> int:
        return struct.unpack(code, self.stream.read(struct.calcsize(code)))[0]

    def _number(self) -> int:
        return self._plain(self._count)

    def _padded(self, n: int) -> bytes:
        return self.stream.read(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._number()).decode("utf-8")

    def _list(self, tag: int) -> int:
        there, n = self._plain(">i"), self._number()
        if there not in (0, tag):
            raise ValueError("a header of another order than the format's")
        return n

    def _attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self._list(_ATTRIBUTES)):
            name, kind = self._name(), np.dtype(_TYPES[self._plain(">i")])
            n = self._number()
            raw = self._padded(n * kind.itemsize)
            value = raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind)
            out[name] = value if isinstance(value, str) else value[0].item() if n == 1 else value.tolist()
        return out


def encoded(dims: dict[str, int | None], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict[str, Any]]], attrs: dict[str, Any] | None = None) -> bytes:
    """A file of version 2. dims: sizes (None: records); variables: name -> (dimensions, values, attributes)."""

    def padded(raw: bytes) -> bytes:
        return raw + b"\0" * (-len(raw) % 4)

    def name(text: str) -> bytes:
        raw = text.encode("utf-8")
        return struct.pack(">i", len(raw)) + padded(raw)

    def typed(value) -> tuple[int, int, bytes]:
        if isinstance(value, str):
            return 2, len(value.encode("utf-8")), value.encode("utf-8")
        x = np.atleast_1d(np.asarray(value))
        x = x.astype(x.dtype.newbyteorder(">") if x.dtype.newbyteorder(">") in _CODES else ">f8")
        return _CODES[x.dtype], len(x), x.tobytes()

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attributes(given: dict[str, Any]) -> bytes:
        return listed(_ATTRIBUTES, [name(k) + struct.pack(">ii", c, n) + padded(raw) for k, v in given.items() for c, n, raw in [typed(v)]])

    order = list(dims)
    arrays = {k: np.asarray(v).astype(np.asarray(v).dtype.newbyteorder(">")) for k, (_, v, _) in variables.items()}
    record = {k: bool(d) and dims[d[0]] is None for k, (d, _, _) in variables.items()}
    n_records = max((len(arrays[k]) for k in arrays if record[k]), default=0)
    sizes = {k: -(-(x.nbytes // max(1, len(x)) if record[k] else x.nbytes) // 4) * 4 for k, x in arrays.items()}
    head = b"CDF\x02" + struct.pack(">i", n_records) + listed(_DIMENSIONS, [name(k) + struct.pack(">i", n or 0) for k, n in dims.items()]) + attributes(attrs or {})

    def table(begins: dict[str, int]) -> bytes:
        return listed(_VARIABLES, [name(k) + struct.pack(f">i{len(d)}i", len(d), *map(order.index, d)) + attributes(a) + struct.pack(">iiq", _CODES[arrays[k].dtype], sizes[k], begins[k]) for k, (d, _, a) in variables.items()])

    at, begins = len(head) + len(table(dict.fromkeys(variables, 0))), {}
    for k in sorted(variables, key=lambda k: record[k]):
        begins[k] = at
        at += sizes[k]
    fixed = b"".join(padded(arrays[k].tobytes()) for k in variables if not record[k])
    rows = [k for k in variables if record[k]]
    pad = (lambda raw: raw) if len(rows) == 1 else padded
    return head + table(begins) + fixed + b"".join(pad(arrays[k][i : i + 1].tobytes()) for i in range(n_records) for k in rows)
