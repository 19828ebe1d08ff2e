"""Elias-Fano sequences and memory-mapped files of named arrays."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import cache

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the r-th set bit of a byte.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)
#: Masks to count the set bits of 64 at once.
_PAIRS, _NIBBLES, _LOW_NIBBLES = (np.uint64(m * 0x0101010101010101) for m in (0x55, 0x33, 0x0F))
_ONES, _TOPS, _BYTE = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0xFF)


def encode_monotone(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold a sequence that never falls: low bits packed, high bits in unary."""
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    low = max(0, int(top // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-(int(high[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
    bits[high] = 1
    packed = np.packbits(bits, bitorder="little")
    lows = np.zeros(0, np.uint8)
    if low:
        rest = values & np.uint64((1 << low) - 1)
        lows = np.packbits(((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    return {
        "high": packed,
        "ranks": np.r_[0, np.cumsum(np.bitwise_count(packed.view("<u8")))].astype(np.uint32),
        "low": np.r_[lows, np.zeros(8, np.uint8)],
        "width": np.array([low], np.int64),
    }


def gather(arrays: list[np.ndarray], at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Items of several arrays: of array i those at the places ``at[edges[i] : edges[i + 1]]``."""
    out = np.empty(len(at), np.result_type(*{a.dtype for a in arrays}) if arrays else np.int64)
    edges = edges.tolist()
    for own, i, j in zip(arrays, edges, edges[1:]):
        if i < j:
            out[i:j] = own[at[i:j]]
    return out


def decode_all(parts: list[dict[str, np.ndarray]], at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The values of several sequences, with ``edges`` as for ``gather``.

    Sequences are many and each is asked for little, so only reading goes one by one.
    """
    word = np.empty(len(at), np.int64)
    ranks = [p["ranks"] for p in parts]
    # In the type of the ranks, else all of them would be converted for each call.
    own_at = at.astype(np.uint32)
    for own, i, j in zip(ranks, edges.tolist(), edges[1:].tolist()):
        word[i:j] = own.searchsorted(own_at[i:j], "right")
    word -= 1
    left = (at - gather(ranks, word, edges)).astype(np.uint64)
    own = gather([p["high"].view("<u8") for p in parts], word, edges)
    # Each byte of ``upto`` counts the set bits up to and with that byte.
    upto = own - ((own >> np.uint64(1)) & _PAIRS)
    upto = (upto & _NIBBLES) + ((upto >> np.uint64(2)) & _NIBBLES)
    upto = ((upto + (upto >> np.uint64(4))) & _LOW_NIBBLES) * _ONES
    # The top bit of a byte stays where no more bits than ``left`` are set up to it.
    byte = np.bitwise_count(((left * _ONES) | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)
    left -= ((upto << np.uint64(8)) >> byte) & _BYTE
    place = word * 64 + byte.astype(np.int64) + _SELECT[(own >> byte) & _BYTE, left]
    value = place - at
    widths = np.array([int(p["width"][0]) for p in parts], np.int64)
    if widths.any():
        width = np.repeat(widths, np.diff(edges))
        start = at * width
        eight = np.zeros(len(at), np.uint64)
        lows = [p["low"] for p in parts]
        for k in range(min(8, (int(widths.max()) + 14) // 8)):
            eight |= gather(lows, (start >> 3) + k, edges).astype(np.uint64) << np.uint64(8 * k)
        rest = (eight >> (start & 7).astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
        value = (value << width) | rest.astype(np.int64)
    return value


def decode_at(parts: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The values at the places ``at``."""
    return decode_all([parts], at, np.array([0, len(at)]))


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write the arrays as one file; a second attempt replaces it whole."""
    heads, at = {}, 0
    for name, values in arrays.items():
        heads[name] = (values.dtype.str, len(values), at)
        at += -(-values.nbytes // 64) * 64
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 8) % 64)
    files, path = _file_system(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for values in arrays.values():
            out.write(np.ascontiguousarray(values).tobytes())
            out.write(b"\0" * (-values.nbytes % 64))
    files.move(draft, path)


@cache
def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; from a remote store by way of an unlinked copy."""
    from pyarrow.fs import LocalFileSystem

    files, path = _file_system(uri)
    if isinstance(files, LocalFileSystem):
        data = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        with tempfile.NamedTemporaryFile() as copy:
            with files.open_input_stream(path) as stream:
                while block := stream.read(1 << 24):
                    copy.write(block)
            copy.flush()
            data = np.asarray(np.memmap(copy.name, np.uint8, "r"))
    size = int(data[:8].view("<i8")[0])
    found = {}
    for name, (kind, n, at) in json.loads(data[8 : 8 + size].tobytes()).items():
        start = 8 + size + at
        found[name] = data[start : start + n * np.dtype(kind).itemsize].view(kind)
    return found
