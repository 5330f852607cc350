"""The format's early methods: shrink, reduce, implode, deflate64 and the DCL's implode, each read and written.

Writers take the plainest form that a reader must know: they serve tests and
comparisons of size, not the smallest result. Readers raise ValueError on bad
data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache


class _Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            if self.at >= len(self.data):
                raise ValueError("cut short")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8
        out = self.held & ((1 << k) - 1)
        self.held >>= k
        self.n -= k
        return out

    def left(self) -> int:
        return self.n + 8 * (len(self.data) - self.at)

    def align(self) -> None:
        self.take(self.n % 8)


class _Packer:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, k: int) -> None:
        self.held |= value << self.n
        self.n += k
        while self.n >= 8:
            self.out.append(self.held & 255)
            self.held >>= 8
            self.n -= 8

    def put_code(self, value: int, k: int) -> None:
        """A prefix code, most significant bit first."""
        for i in range(k - 1, -1, -1):
            self.put(value >> i & 1, 1)

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.held]) if self.n else b"")


class _Code:
    """A canonical prefix code by its lengths."""

    def __init__(self, lengths: list[int], most_first: bool = False):
        """most_first: long codes have the small values, so all bits are flipped."""
        self.symbols: dict[tuple[int, int], int] = {}
        self.codes: dict[int, tuple[int, int]] = {}
        code, last = 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            last = n
            if code >> n:
                raise ValueError("too many codes")
            own = code ^ ((1 << n) - 1) if most_first else code
            self.symbols[n, own] = s
            self.codes[s] = (own, n)
            code += 1
        self.most = last

    def read(self, bits: _Bits) -> int:
        code = 0
        for n in range(1, self.most + 1):
            code = code << 1 | bits.take(1)
            s = self.symbols.get((n, code))
            if s is not None:
                return s
        raise ValueError("no such code")

    def write(self, packer: _Packer, symbol: int) -> None:
        packer.put_code(*self.codes[symbol])


def _copy(out: bytearray, distance: int, length: int) -> None:
    """Repeats what lies `distance` back; zeros before the start."""
    while length:
        start = len(out) - distance
        if start < 0:
            n = min(-start, length)
            out += bytes(n)
        else:
            n = min(distance, length)
            out += out[start : start + n]
        length -= n


def _matches(data: bytes, window: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """(0, byte) or (distance, length): the latest place where the next bytes stood, taken as far as it goes."""
    seen: dict[bytes, int] = {}
    i, n, key = 0, len(data), max(least, 3)
    while i < n:
        at, length = seen.get(data[i : i + key], -1), 0
        if 0 <= at and i - at <= window and i + key <= n:
            while length < most and i + length < n and data[at + length] == data[i + length]:
                length += 1
        step = length if length >= key else 1
        yield (i - at, length) if length >= key else (0, data[i])
        for j in range(i, i + step):
            seen[data[j : j + key]] = j
        i += step


# Shrink: LZW of 9 to 13 bits whose code 256 widens the codes or clears those that no other builds on.


def unshrink(data: bytes) -> bytes:
    bits, width, out = _Bits(data), 9, bytearray()
    if not data:
        return b""
    parent, suffix, used = [0] * 8192, [0] * 8192, [True] * 257 + [False] * (8192 - 257)
    free = 257

    def spelled(code: int) -> bytes:
        back = bytearray()
        while code > 256:
            back.append(suffix[code])
            code = parent[code]
            if len(back) > 8192:
                raise ValueError("a code builds on itself")
        back.append(code)
        return bytes(reversed(back))

    before = bits.take(width)
    if before > 255:
        raise ValueError("no such code")
    last = bytes([before])
    out += last
    while bits.left() >= width:
        code = bits.take(width)
        if code == 256:
            what = bits.take(width)
            if what == 1 and width < 13:
                width += 1
            elif what == 2:
                built = {parent[c] for c in range(257, 8192) if used[c]}
                for c in range(257, 8192):
                    used[c] = used[c] and c in built
                free = 257
            else:
                raise ValueError("no such order")
            continue
        while free < 8192 and used[free]:
            free += 1
        if used[code]:
            text = spelled(code)
        elif code == free:
            text = last + last[:1]
        else:
            raise ValueError("no such code")
        out += text
        if free < 8192:
            parent[free], suffix[free], used[free] = before, text[0], True
        before, last = code, text
    return bytes(out)


def shrink(data: bytes) -> bytes:
    packer, width, codes = _Packer(), 9, {bytes([i]): i for i in range(256)}
    nxt, text = 257, b""

    def put(code: int) -> None:
        nonlocal width
        while code >> width:
            packer.put(256, width)
            packer.put(1, width)
            width += 1
        packer.put(code, width)

    for i in range(len(data)):
        longer = text + data[i : i + 1]
        if longer in codes:
            text = longer
            continue
        put(codes[text])
        if nxt < 8192:
            codes[longer] = nxt
            nxt += 1
        text = data[i : i + 1]
    if text:
        put(codes[text])
    return packer.done()


# Reduce, factors 1 to 4: bytes by sets of likely followers, then runs behind the mark 144.

_MARK = 144


def unreduce(data: bytes, factor: int, size: int) -> bytes:
    bits, followers = _Bits(data), [b""] * 256
    if size == 0:
        return b""
    for i in range(255, -1, -1):
        followers[i] = bytes(bits.take(8) for _ in range(bits.take(6)))
    out, last, mask, state, head, length = bytearray(), 0, (1 << 8 - factor) - 1, "byte", 0, 0
    while len(out) < size:
        some = followers[last]
        if some and not bits.take(1):
            at = bits.take(max(1, (len(some) - 1).bit_length()))
            if at >= len(some):
                raise ValueError("no such follower")
            last = some[at]
        else:
            last = bits.take(8)
        if state == "byte":
            if last == _MARK:
                state = "head"
            else:
                out.append(last)
        elif state == "head":
            if last == 0:
                out.append(_MARK)
                state = "byte"
            else:
                head, length = last, last & mask
                state = "length" if length == mask else "distance"
        elif state == "length":
            length += last
            state = "distance"
        else:
            _copy(out, (head >> 8 - factor) * 256 + last + 1, length + 3)
            state = "byte"
    if len(out) > size:
        raise ValueError("too long")
    return bytes(out)


def reduce(data: bytes, factor: int) -> bytes:
    """Without follower sets."""
    packer, mask = _Packer(), (1 << 8 - factor) - 1
    if not data:
        return b""
    for _ in range(256):
        packer.put(0, 6)
    for distance, x in _matches(data, 256 << factor, 4, mask + 255 + 3):  # from 4 on, the head isn't 0
        if not distance:
            packer.put(x, 8)
            if x == _MARK:
                packer.put(0, 8)
            continue
        packer.put(_MARK, 8)
        packer.put((distance - 1 >> 8) << 8 - factor | min(x - 3, mask), 8)
        if x - 3 >= mask:
            packer.put(x - 3 - mask, 8)
        packer.put(distance - 1 & 255, 8)
    return packer.done()


# Implode: matches in 4 or 8 KiB by Shannon-Fano codes; flag bit 1 is the larger window, bit 2 coded literals.


def _tree(bits: _Bits, count: int) -> _Code:
    lengths: list[int] = []
    for _ in range(bits.take(8) + 1):
        x = bits.take(8)
        lengths += [(x & 15) + 1] * ((x >> 4) + 1)
    if len(lengths) != count:
        raise ValueError("bad tree")
    return _Code(lengths, most_first=True)


def explode(data: bytes, flags: int, size: int) -> bytes:
    if size == 0:
        return b""
    bits, low, coded = _Bits(data), 7 if flags & 2 else 6, bool(flags & 4)
    literals = _tree(bits, 256) if coded else None
    lengths, distances = _tree(bits, 64), _tree(bits, 64)
    out = bytearray()
    while len(out) < size:
        if bits.take(1):
            out.append(literals.read(bits) if literals else bits.take(8))
            continue
        distance = bits.take(low)
        distance |= distances.read(bits) << low
        length = lengths.read(bits)
        if length == 63:
            length += bits.take(8)
        _copy(out, distance + 1, length + (3 if coded else 2))
    if len(out) > size:
        raise ValueError("too long")
    return bytes(out)


def implode(data: bytes, flags: int = 0) -> bytes:
    """Codes of even length."""
    if not data:
        return b""
    packer, low, coded = _Packer(), 7 if flags & 2 else 6, bool(flags & 4)
    flat = lambda n: _Code([n.bit_length() - 1] * n, most_first=True)
    for n in [256] * coded + [64, 64]:
        packer.put(n // 16 - 1, 8)
        for _ in range(n // 16):
            packer.put(15 << 4 | n.bit_length() - 2, 8)
    literals, pairs, least = flat(256), flat(64), 3 if coded else 2
    for distance, x in _matches(data, 64 << low, least, 63 + 255 + least):
        packer.put(0 if distance else 1, 1)
        if not distance:
            literals.write(packer, x) if coded else packer.put(x, 8)
            continue
        packer.put(distance - 1 & (1 << low) - 1, low)
        pairs.write(packer, distance - 1 >> low)
        pairs.write(packer, min(x - least, 63))
        if x - least >= 63:
            packer.put(x - least - 63, 8)
    return packer.done()


# Deflate64: deflate with a window of 64 KiB and lengths up to 65,538.

#: Fixed: the order in which a block gives the lengths of its length codes.
_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


@cache
def _steps() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Base and extra bits of the length codes from 257 on and of the distance codes."""
    lengths, base = [], 3
    for i in range(28):
        extra = max(0, i // 4 - 1)
        lengths.append((base, extra))
        base += 1 << extra
    distances, base = [], 1
    for i in range(32):
        extra = max(0, i // 2 - 1)
        distances.append((base, extra))
        base += 1 << extra
    return [*lengths, (3, 16)], distances


@cache
def _fixed() -> tuple[_Code, _Code]:
    return _Code([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _Code([5] * 32)


def _block_codes(bits: _Bits) -> tuple[_Code, _Code]:
    n, d, c = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    first = [0] * 19
    for i in _ORDER[:c]:
        first[i] = bits.take(3)
    code, lengths = _Code(first), []
    while len(lengths) < n + d:
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
        elif s == 16:
            if not lengths:
                raise ValueError("nothing to repeat")
            lengths += lengths[-1:] * (3 + bits.take(2))
        else:
            lengths += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
    if len(lengths) != n + d:
        raise ValueError("bad lengths")
    return _Code(lengths[:n]), _Code(lengths[n:])


def inflate64(data: bytes) -> bytes:
    bits, out, last = _Bits(data), bytearray(), 0
    lengths, distances = _steps()
    while not last:
        last, kind = bits.take(1), bits.take(2)
        if kind == 0:
            bits.align()
            n = bits.take(16)
            if n ^ bits.take(16) != 0xFFFF:
                raise ValueError("bad stored block")
            out += bytes(bits.take(8) for _ in range(n))
            continue
        if kind == 3:
            raise ValueError("no such block")
        codes, far = _fixed() if kind == 1 else _block_codes(bits)
        while (s := codes.read(bits)) != 256:
            if s < 256:
                out.append(s)
                continue
            if s > 285:
                raise ValueError("no such length")
            base, extra = lengths[s - 257]
            length = base + bits.take(extra)
            base, extra = distances[far.read(bits)]
            distance = base + bits.take(extra)
            if distance > len(out):
                raise ValueError("before the start")
            _copy(out, distance, length)
    return bytes(out)


def deflate64(data: bytes) -> bytes:
    """One block of fixed codes."""
    packer, (codes, far), (lengths, distances) = _Packer(), _fixed(), _steps()
    packer.put(1, 1)
    packer.put(1, 2)
    for distance, x in _matches(data, 1 << 16, 3, 65_538):
        if not distance:
            codes.write(packer, x)
            continue
        i = 28 if x > 257 else max(i for i in range(28) if lengths[i][0] <= x)
        codes.write(packer, 257 + i)
        packer.put(x - lengths[i][0], lengths[i][1])
        j = max(j for j in range(32) if distances[j][0] <= distance)
        far.write(packer, j)
        packer.put(distance - distances[j][0], distances[j][1])
    codes.write(packer, 256)
    return packer.done()


# The DCL's implode: its codes are fixed, literals may be coded, the length 519 ends the data.

#: The code length of each literal, length code and distance code, and each length code's base and extra bits.
_DCL_LITERALS = [
    11, 12, 12, 12, 12, 12, 12, 12, 12, 8, 7, 12, 12, 7, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 13, 12, 12, 12, 12, 12,
    4, 10, 8, 12, 10, 12, 10, 8, 7, 7, 8, 9, 7, 6, 7, 8, 7, 6, 7, 7, 7, 7, 8, 7, 7, 8, 8, 12, 11, 7, 9, 11,
    12, 6, 7, 6, 6, 5, 7, 8, 8, 6, 11, 9, 6, 7, 6, 6, 7, 11, 6, 6, 6, 7, 9, 8, 9, 9, 11, 8, 11, 9, 12, 8,
    12, 5, 6, 6, 6, 5, 6, 6, 6, 5, 11, 7, 5, 6, 5, 5, 6, 10, 5, 5, 5, 5, 8, 7, 8, 8, 10, 11, 11, 12, 12, 12,
    13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13,
    13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12,
    12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12,
    13, 12, 13, 13, 13, 12, 13, 13, 13, 12, 13, 13, 13, 13, 12, 13, 13, 13, 12, 12, 12, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13, 13,
]
_DCL_LENGTHS = [
    2, 3, 3, 3, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 7, 7,
]
_DCL_DISTANCES = [
    2, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7,
    7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
]
_DCL_STEPS = [(3, 0), (2, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (10, 1), (12, 2), (16, 3), (24, 4), (40, 5), (72, 6), (136, 7), (264, 8)]
_DCL_END = 519


@cache
def _dcl_codes() -> tuple[_Code, _Code, _Code]:
    literals, lengths, distances = (_Code(x, most_first=True) for x in (_DCL_LITERALS, _DCL_LENGTHS, _DCL_DISTANCES))
    return literals, lengths, distances


def dcl_explode(data: bytes) -> bytes:
    if len(data) < 2 or data[0] > 1 or data[1] not in (4, 5, 6):
        raise ValueError("not of this form")
    bits, coded, low, out = _Bits(data[2:]), data[0], data[1], bytearray()
    literals, lengths, distances = _dcl_codes()
    while True:
        if not bits.take(1):
            out.append(literals.read(bits) if coded else bits.take(8))
            continue
        base, extra = _DCL_STEPS[lengths.read(bits)]
        length = base + bits.take(extra)
        if length == _DCL_END:
            return bytes(out)
        own = 2 if length == 2 else low
        distance = distances.read(bits) << own
        distance += bits.take(own) + 1
        if distance > len(out):
            raise ValueError("before the start")
        _copy(out, distance, length)


def dcl_implode(data: bytes, low: int = 6, coded: bool = False) -> bytes:
    packer, (literals, lengths, distances) = _Packer(), _dcl_codes()

    def put_length(n: int) -> None:
        i = next(i for i, (base, extra) in enumerate(_DCL_STEPS) if base <= n < base + (1 << extra))
        packer.put(1, 1)
        lengths.write(packer, i)
        packer.put(n - _DCL_STEPS[i][0], _DCL_STEPS[i][1])

    for distance, x in _matches(data, 64 << low, 3, 518):
        if not distance:
            packer.put(0, 1)
            literals.write(packer, x) if coded else packer.put(x, 8)
            continue
        put_length(x)
        distances.write(packer, distance - 1 >> low)
        packer.put(distance - 1 & (1 << low) - 1, low)
    put_length(_DCL_END)
    return bytes([int(coded), low]) + packer.done()
