"""Parsers of binary payloads: PLY, PNG, NPZ/NPY, COCO run lengths.  Pure functions on bytes, used from Arrow
UDFs over ``binaryFile`` scans."""

from __future__ import annotations

import io
import pickle
import struct
import zlib

import numpy as np

_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_ply(blob: bytes) -> dict[str, dict[str, np.ndarray | list]]:
    """The elements of a PLY file (ascii or binary), each as columns; list properties as lists of arrays."""
    end = blob.index(b"end_header")
    body = blob.index(b"\n", end) + 1
    fmt, elements = "ascii", []
    for line in blob[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            fmt = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append((w[-1], w[1:-1]))
    out: dict = {}
    if fmt == "ascii":
        lines = blob[body:].decode("ascii").split("\n")
        at = 0
        for name, n, props in elements:
            rows = [ln.split() for ln in lines[at : at + n]]
            at += n
            cols: dict = {}
            if all(t[0] != "list" for _, t in props):
                for k, (p, t) in enumerate(props):
                    cols[p] = np.array([r[k] for r in rows], dtype=_PLY[t[0]])
            else:
                cols = {p: [] for p, _ in props}
                for r in rows:
                    k = 0
                    for p, t in props:
                        if t[0] == "list":
                            size = int(r[k])
                            cols[p].append(np.array(r[k + 1 : k + 1 + size], dtype=_PLY[t[2]]))
                            k += 1 + size
                        else:
                            cols[p].append(np.dtype(_PLY[t[0]]).type(r[k]))
                            k += 1
            out[name] = cols
        return out
    order = "<" if fmt == "binary_little_endian" else ">"
    at = body
    for name, n, props in elements:
        if all(t[0] != "list" for _, t in props):
            dt = np.dtype([(p, order + _PLY[t[0]]) for p, t in props])
            rows = np.frombuffer(blob, dt, n, at)
            at += dt.itemsize * n
            out[name] = {p: rows[p] for p, _ in props}
            continue
        cols = {p: [] for p, _ in props}
        for _ in range(n):
            for p, t in props:
                if t[0] == "list":
                    size_t, item_t = np.dtype(order + _PLY[t[1]]), np.dtype(order + _PLY[t[2]])
                    size = int(np.frombuffer(blob, size_t, 1, at)[0])
                    at += size_t.itemsize
                    cols[p].append(np.frombuffer(blob, item_t, size, at))
                    at += item_t.itemsize * size
                else:
                    dt = np.dtype(order + _PLY[t[0]])
                    cols[p].append(np.frombuffer(blob, dt, 1, at)[0])
                    at += dt.itemsize
        out[name] = cols
    return out


def write_ply(points: dict[str, np.ndarray]) -> bytes:
    """A binary PLY of vertices, one property per column."""
    kinds = {"f4": "float", "f8": "double", "u1": "uchar", "i4": "int"}
    n = len(next(iter(points.values())))
    dt = np.dtype([(k, "<" + v.dtype.str[1:]) for k, v in points.items()])
    rows = np.zeros(n, dt)
    for k, v in points.items():
        rows[k] = v
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property {kinds[v.dtype.str[1:]]} {k}\n" for k, v in points.items()) + "end_header\n"
    return head.encode() + rows.tobytes()


def read_png(blob: bytes) -> np.ndarray:
    """The pixels of a non-interlaced grey or colour PNG of 8 or 16 bits: (rows, columns[, channels])."""
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head, palette = 8, b"", None, None
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        part = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += part
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if interlace or depth not in (8, 16):
        raise ValueError("only non-interlaced PNGs of 8 or 16 bits")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for r in range(height):
        kind, line = raw[r, 0], raw[r, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for k in range(len(line)):
                left = int(line[k - step]) if k >= step else 0
                up, corner = int(above[k]), int(above[k - step]) if k >= step else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                line[k] = (int(line[k]) + guess) & 255
        out[r] = above = line
    px = out.reshape(height, width, step) if depth == 8 else out.reshape(height, width, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if palette is not None:
        return palette[px[..., 0]]
    return px[..., 0] if channels == 1 else px


def write_png(px: np.ndarray) -> bytes:
    """A grey or colour PNG of 8 or 16 bits."""
    px = px[..., None] if px.ndim == 2 else px
    depth = px.dtype.itemsize * 8
    body = px.astype(px.dtype.newbyteorder(">")).reshape(len(px), -1).view(np.uint8)
    raw = np.concatenate([np.zeros((len(px), 1), np.uint8), body], 1).tobytes()
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], depth, {1: 0, 3: 2, 2: 4, 4: 6}[px.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_npz_matrix(blob: bytes, key: str) -> list[float]:
    with np.load(io.BytesIO(blob)) as z:
        return np.asarray(z[key], float).ravel().tolist()


def coco_decode_counts(text: bytes | str) -> list[int]:
    """The run lengths of a compressed COCO mask string: 5 bits a byte, differences to the last but one."""
    data = text.encode() if isinstance(text, str) else text
    out, at = [], 0
    while at < len(data):
        value = shift = 0
        while True:
            c = data[at] - 48
            value |= (c & 31) << shift
            at += 1
            shift += 5
            if not c & 32:
                if c & 16:
                    value |= -1 << shift
                break
        out.append(value + (out[-2] if len(out) > 2 else 0))
    return out


def coco_encode_counts(counts: list[int]) -> str:
    out = []
    for k, n in enumerate(counts):
        value = n - counts[k - 2] if k > 2 else n
        while True:
            c = value & 31
            value >>= 5
            more = value != (-1 if c & 16 else 0)
            out.append(chr((c | 32 if more else c) + 48))
            if not more:
                break
    return "".join(out)


class _Record:
    """Stands for an object of any class that isn't trusted: its state is kept, its code isn't run."""

    def __init__(self, *args, **kwargs):
        pass

    def __setstate__(self, state):
        self.__dict__.update(state if isinstance(state, dict) else {"state": state})


class _PlainUnpickler(pickle.Unpickler):
    """Builds numbers, strings, containers and numpy arrays; every other class becomes a record."""

    KNOWN = {("collections", "OrderedDict"), ("numpy", "ndarray"), ("numpy", "dtype"), *((f"numpy.{m}.multiarray", n) for m in ("core", "_core") for n in ("_reconstruct", "scalar")), ("numpy._core.numeric", "_frombuffer"), ("_codecs", "encode")}

    def find_class(self, module: str, name: str):
        return super().find_class(module, name) if (module, name) in self.KNOWN else _Record


def read_plain_pickle(blob: bytes) -> dict:
    """The fields of a pickled dictionary or record of plain values; a record's own ``_fields`` come first."""
    got = _PlainUnpickler(io.BytesIO(blob)).load()
    state = got if isinstance(got, dict) else vars(got)
    inner = state.get("_fields")
    return dict(inner) if isinstance(inner, dict) else dict(state)
