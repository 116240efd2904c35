"""Byte codes of neighbour lists.

Fixed values of the format: the first neighbour is the signed difference to the
source (6 data bits, a sign bit 0x40 and a continue bit 0x80 in the first byte,
7 data bits and a continue bit in the others); every other neighbour is the gap to
the one before it (7 data bits and a continue bit a byte); blocks of the block
format hold 1000 neighbours.
"""

from __future__ import annotations

import struct

BLOCK = 1000


def _tail(value: int) -> bytearray:
    out = bytearray()
    while value:
        low, value = value & 0x7F, value >> 7
        out.append(low | (0x80 if value else 0))
    return out


def encode(source: int, neighbours: list[int]) -> bytes:
    """A list without blocks; neighbours ascend and do not repeat."""
    if not neighbours:
        return b""
    first = neighbours[0] - source
    size = abs(first)
    head = (size & 0x3F) | (0x40 if first < 0 else 0) | (0x80 if size >> 6 else 0)
    out = bytearray([head]) + _tail(size >> 6)
    for a, b in zip(neighbours, neighbours[1:]):
        out += _tail(b - a) or b"\0"
    return bytes(out)


def decode(source: int, degree: int, cell: bytes, at: int = 0) -> tuple[list[int], int]:
    """The neighbours and the place after them."""
    if degree == 0:
        return [], at
    byte = cell[at]
    at += 1
    size, shift, negative, more = byte & 0x3F, 6, byte & 0x40, byte & 0x80
    while more:
        byte = cell[at]
        at += 1
        size |= (byte & 0x7F) << shift
        shift, more = shift + 7, byte & 0x80
    found = [source - size if negative else source + size]
    for _ in range(degree - 1):
        gap, shift, more = 0, 0, 0x80
        while more:
            byte = cell[at]
            at += 1
            gap |= (byte & 0x7F) << shift
            shift, more = shift + 7, byte & 0x80
        found.append(found[-1] + gap)
    return found, at


def encode_blocks(source: int, neighbours: list[int]) -> bytes:
    """The block format: degree, the later blocks' offsets, then each block's header and codes."""
    if not neighbours:
        return b""
    parts = [struct.pack("<I", min(BLOCK, len(neighbours) - k)) + encode(source, neighbours[k : k + BLOCK]) for k in range(0, len(neighbours), BLOCK)]
    start = 4 + 4 * (len(parts) - 1)
    offsets, at = [], start
    for part in parts[:-1]:
        at += len(part)
        offsets.append(at)
    return struct.pack(f"<I{len(offsets)}I", len(neighbours), *offsets) + b"".join(parts)


def decode_blocks(source: int, cell: bytes) -> list[int]:
    if not cell:
        return []
    (degree,) = struct.unpack_from("<I", cell, 0)
    blocks = -(-degree // BLOCK)
    at, found = 4 + 4 * (blocks - 1), []
    for k in range(blocks):
        own, at = decode(source, min(BLOCK, degree - k * BLOCK), cell, at + 4)
        found += own
    return found
