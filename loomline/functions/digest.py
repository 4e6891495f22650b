"""SHA-256 whose state between two inputs is bytes, so that one task can go on where another has stopped."""

from __future__ import annotations

import ctypes
import struct

#: What has been hashed, the bytes of the last unfinished block: eight words, the number of bytes so far, then the rest.
START = struct.pack("<8IQ", 0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19, 0)
BLOCK = 64


def _roots() -> list[int]:
    """The first 32 bits of the fractional parts of the cube roots of the first 64 primes."""
    primes = [n for n in range(2, 312) if all(n % k for k in range(2, n))]
    out = []
    for p in primes:
        x = int(round((p << 96) ** (1 / 3)))
        while x**3 > p << 96:
            x -= 1
        while (x + 1) ** 3 <= p << 96:
            x += 1
        out.append(x & 0xFFFFFFFF)
    return out


def _plain(words: list[int], data: memoryview) -> list[int]:
    """The eight words after whole blocks of data."""
    turn = lambda x, n: (x >> n | x << 32 - n) & 0xFFFFFFFF
    k = _roots()
    for at in range(0, len(data), BLOCK):
        w = list(struct.unpack_from(">16I", data, at))
        for i in range(16, 64):
            x, y = w[i - 15], w[i - 2]
            w.append((w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ x >> 3) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ y >> 10)) & 0xFFFFFFFF)
        a, b, c, d, e, f, g, h = words
        for i in range(64):
            s = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + k[i] + w[i]
            t = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (s + t) & 0xFFFFFFFF, a, b, c, (d + s) & 0xFFFFFFFF, e, f, g
        words = [(x + y) & 0xFFFFFFFF for x, y in zip(words, (a, b, c, d, e, f, g, h), strict=True)]
    return words


class _Context(ctypes.Structure):
    """OpenSSL's public SHA256_CTX."""

    _fields_ = (("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("size", ctypes.c_uint))


def _fast(words: list[int], data: memoryview) -> list[int]:
    """The same by the library that hashlib uses."""
    import _hashlib

    library = ctypes.CDLL(_hashlib.__file__)
    context = _Context()
    library.SHA256_Init(ctypes.byref(context))
    context.h[:] = words
    library.SHA256_Update(ctypes.byref(context), ctypes.c_char_p(bytes(data)), ctypes.c_size_t(len(data)))
    return list(context.h)


def _blocks(words: list[int], data: memoryview) -> list[int]:
    try:
        return _fast(words, data)
    except (ImportError, OSError, AttributeError):  # a Python that is built without it
        return _plain(words, data)


def update(state: bytes, data: bytes) -> bytes:
    *words, n = struct.unpack_from("<8IQ", state)
    todo = state[40:] + data
    whole = len(todo) // BLOCK * BLOCK
    words = _blocks(words, memoryview(todo)[:whole]) if whole else words
    return struct.pack("<8IQ", *words, n + len(data)) + todo[whole:]


def hexdigest(state: bytes) -> str:
    n = struct.unpack_from("<Q", state, 32)[0]
    end = b"\x80" + bytes((55 - n) % BLOCK) + struct.pack(">Q", 8 * n)
    return struct.pack(">8I", *struct.unpack_from("<8I", update(state, end))).hex()
