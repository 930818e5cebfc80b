"""Files of named 32-bit float tensors: an 8-byte length, a JSON header, then the data."""

from __future__ import annotations

import json

import numpy as np


def read_tensors(path: str) -> dict[str, np.ndarray]:
    """Tensors by name; another number format, or a part outside the file, is an error."""
    with open(path, "rb") as f:
        blob = f.read()
    size = int.from_bytes(blob[:8], "little")
    if 8 + size > len(blob):
        raise ValueError(f"{path}: the header is longer than the file")
    header, data = json.loads(blob[8 : 8 + size]), memoryview(blob)[8 + size :]
    out = {}
    for name, part in header.items():
        if name == "__metadata__":
            continue
        if part["dtype"] != "F32":
            raise ValueError(f"{path}: {name} is {part['dtype']}, only F32 is read")
        start, end = part["data_offsets"]
        if not 0 <= start <= end <= len(data):
            raise ValueError(f"{path}: {name} lies outside the file")
        out[name] = np.frombuffer(data[start:end], dtype="<f4").reshape(part["shape"])
    return out
