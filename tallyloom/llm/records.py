"""Framed binary records: a length, its masked checksum, the payload, its masked checksum; all numbers little-endian."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Fixed values of the format: the reflected Castagnoli polynomial and the constant of the mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a block; a record's blocks fold into one sum by shifts.
BLOCK = 64
#: Bytes of a frame beside its payload, and those before it.
AROUND, BEFORE = 16, 12


def byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = byte_table()


def apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear operator, given by its values on single bytes of a sum, applied to sums."""
    return op[0][x & 255] ^ op[1][(x >> 8) & 255] ^ op[2][(x >> 16) & 255] ^ op[3][x >> 24]


@cache
def shift(log: int) -> np.ndarray:
    """What 2**log zero bytes do to a sum."""
    if log:
        half = shift(log - 1)
        return np.stack([apply(half, h) for h in half])
    return np.stack([TABLE, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) >> np.uint32(8) for k in (1, 2, 3))])


def shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each sum after its own number of zero bytes."""
    x, log = x.copy(), 0
    while (by >> log).any():
        some = np.nonzero((by >> log) & 1)[0]
        x[some] = apply(shift(log), x[some])
        log += 1
    return x


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload. Leading zeros leave a sum that starts at zero alone, so payloads are padded in front to whole blocks."""
    if not payloads:
        return np.zeros(0, np.uint32)
    lengths = np.array([len(p) for p in payloads], np.int64)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    padded = b"".join(x for p, n in zip(payloads, blocks.tolist(), strict=True) for x in (bytes(n * BLOCK - len(p)), p))
    words = np.frombuffer(padded, "<u4").reshape(-1, BLOCK // 4)
    sums, log = apply(shift(2), words), 2
    while sums.shape[1] > 1:
        sums, log = apply(shift(log), sums[:, ::2]) ^ sums[:, 1::2], log + 1
    ends = np.cumsum(blocks)
    behind = np.repeat(ends, blocks) - 1 - np.arange(ends[-1])
    own = np.bitwise_xor.reduceat(shifted(sums[:, 0], behind * BLOCK), ends - blocks)
    return own ^ shifted(np.full(len(payloads), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    """Sums turned right by 15 bits plus a constant, so that a sum over data that holds sums stays sound."""
    return ((sums >> np.uint32(15)) | (sums << np.uint32(17))) + np.uint32(MASK)


def sums_of(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    return heads, masked(crc32c(heads)), masked(crc32c(payloads))


def frames(payloads: list[bytes]) -> list[bytes]:
    heads, of_head, of_body = sums_of(payloads)
    return [b"".join((h, a, p, b)) for h, a, p, b in zip(heads, (x.tobytes() for x in of_head.astype("<u4")), payloads, (x.tobytes() for x in of_body.astype("<u4")), strict=True)]


def unframe(data: bytes, offsets: list[int], lengths: list[int], where: str) -> list[bytes]:
    """Payloads of the frames at `offsets` of data, each `lengths` bytes long with its frame. ValueError names the first record that is damaged."""
    payloads = [data[o + BEFORE : o + n - 4] for o, n in zip(offsets, lengths, strict=True)]
    heads, of_head, of_body = sums_of(payloads)
    for o, n, h, a, b in zip(offsets, lengths, heads, of_head.tolist(), of_body.tolist(), strict=True):
        if o + n > len(data) or data[o : o + 8] != h or data[o + 8 : o + 12] != a.to_bytes(4, "little") or data[o + n - 4 : o + n] != b.to_bytes(4, "little"):
            raise ValueError(f"damaged record in {where}, {o} bytes into what was read")
    return payloads


def walk(data: bytes) -> list[tuple[int, int]]:
    """(offset, length with frame) of every record of a file's bytes, by the lengths alone."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little") + AROUND
        if at + n > len(data):
            raise ValueError(f"record cut short at {at}")
        out.append((at, n))
        at += n
    return out
