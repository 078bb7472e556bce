"""8x8 transforms of blocks, as array kernels over all blocks of a batch.

A block is one row with an array of 64 numbers in natural order. Between its
roundings every pass of the slow-but-accurate integer transform is linear, so
it is one product with an 8x8 integer matrix and a rounding shift, rows and
columns in turn; the inverse uses the transposed matrix, the reduced inverses
matrices of their own, those to 3, 5 to 7 and 9 to 16 samples rounded cosines
with a few corrections, the 12-bit ones other shifts. The fast and float
methods are the five-multiplication flow graph of Arai, Agui and Nakajima.
Blocks are independent: one narrow Arrow pass, no shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..workers import map_array, matrix, ready

# fixed values: 13-bit integer transform, left half of each row; the right half mirrors it (even rows) or negates the mirror (odd rows)
HALF = [
    [8192, 8192, 8192, 8192], [11363, 9633, 6437, 2260], [10703, 4433, -4433, -10703], [9633, -2259, -11362, -6436],
    [8192, -8192, -8192, 8192], [6437, -11362, 2261, 9633], [4433, -10704, 10704, -4433], [2260, -6436, 9633, -11363],
]
FORWARD = np.array([[*h, *[x if u % 2 == 0 else -x for x in reversed(h)]] for u, h in enumerate(HALF)], np.int64)
# fixed values: reduced inverse transforms, weights of the 8 frequencies in the first outputs; the last outputs mirror them with odd frequencies negated
FOUR = [[16384, 20995, 15137, 7373, 0, -4926, -6270, -4176], [16384, 8697, -15137, -17799, 0, 11893, 6270, -1730]]
TWO = [[32768, 29692, 0, -10426, 0, 6967, 0, -5906]]
# fixed values: where the integer weights of the inverse transforms to other sizes differ from rounded cosines, as (output, frequency, difference)
CORRECTIONS = {
    3: [(1, 2, -1)],
    5: [(0, 1, 1), (0, 2, -1), (1, 4, 1), (2, 2, 1), (2, 4, -1)],
    6: [(1, 4, -1)],
    7: [],
    9: [(1, 6, -1), (4, 2, -1), (4, 4, 1), (4, 6, -1)],
    10: [(0, 2, 1), (0, 3, -1), (1, 7, 1), (2, 4, -1), (3, 3, 1), (4, 2, -1), (4, 7, 1)],
    11: [(0, 1, 1), (0, 7, 1), (2, 5, 1), (2, 6, 1), (3, 1, 1), (3, 2, 1), (4, 3, 1)],
    12: [(0, 1, 1), (0, 5, 1), (2, 1, 1), (2, 5, 1), (4, 3, -1), (4, 5, 1), (5, 1, 1)],
    13: [(0, 1, -2), (1, 4, 1), (2, 5, -1), (3, 4, 1), (4, 3, 1), (4, 6, -1), (5, 6, -1), (5, 7, 1)],
    14: [(0, 1, 1), (1, 6, 1), (2, 5, 1), (3, 4, -1), (5, 3, 1), (5, 6, -1)],
    15: [(0, 7, -1), (1, 1, 1), (1, 2, -1), (2, 2, -1), (2, 4, 1), (2, 6, -1), (3, 1, -1), (4, 4, 1), (5, 2, -1), (6, 4, 1), (7, 2, 1), (7, 4, -1), (7, 6, -1)],
    16: [(0, 6, -1), (2, 2, 1), (2, 5, 1), (3, 7, 1), (5, 2, -1), (5, 5, -1), (6, 3, 1), (7, 6, 1)],
}
# fixed values: scale of each frequency in the fast and float methods
AAN = [1.0, 1.387039845, 1.306562965, 1.175875602, 1.0, 0.785694958, 0.541196100, 0.275899379]
AAN_12 = [4096, 5681, 5352, 4816, 4096, 3218, 2217, 1130]
METHODS = ("islow", "ifast", "ifast_raw", "float")


def _mirrored(rows: list[list[int]], size: int) -> np.ndarray:
    """All outputs from the first half; a middle one mirrors itself."""
    return np.array([*rows, *[[-x if f % 2 else x for f, x in enumerate(r)] for r in reversed(rows[: size // 2])]], np.int64)


def _cosines(size: int) -> np.ndarray:
    """13-bit weights of the frequencies an output of ``size`` samples reads, others 0."""
    weight = lambda i, f: 8192 if f == 0 else round(8192 * math.sqrt(2) * math.cos((2 * i + 1) * f * math.pi / (2 * size)))
    rows = [[weight(i, f) if f < size else 0 for f in range(8)] for i in range(-(-size // 2))]
    for i, f, more in CORRECTIONS[size]:
        rows[i][f] += more
    return _mirrored(rows, size)


#: size -> (outputs by frequencies, shifts of both passes beyond the usual)
INVERSE = {8: (FORWARD.T, 0), 4: (_mirrored(FOUR, 4), 1), 2: (_mirrored(TWO, 2), 2)} | {n: (_cosines(n), 0) for n in CORRECTIONS}
SIZES = tuple(sorted([1, *INVERSE]))


def _wrapped(x: np.ndarray) -> np.ndarray:
    """As 32-bit two's complement."""
    return x.astype(np.int32).astype(np.int64)


def _rounded(x: np.ndarray, n: int) -> np.ndarray:
    return (_wrapped(x) + (1 << (n - 1))) >> n


def forward_integer(x: np.ndarray, precision: int = 8) -> np.ndarray:
    """(n, 64) centred samples to coefficients scaled by 8; rows first."""
    extra = 2 if precision == 8 else 1
    rows = _rounded(x.reshape(-1, 8, 8) @ FORWARD.T, 13 - extra)
    return _rounded(FORWARD @ rows, 13 + extra).reshape(-1, 64)


def inverse_integer(x: np.ndarray, size: int = 8, precision: int = 8) -> np.ndarray:
    """(n, 64) coefficients to (n, size * size) samples, level-shifted and clamped; columns first."""
    center = 1 << (precision - 1)
    if size == 1:
        out = _rounded(x[:, :1], 3)
    else:
        weights, more = INVERSE[size]
        extra = 2 if precision == 8 else 1
        columns = _rounded(weights @ x.reshape(-1, 8, 8), 13 - extra + more)
        out = _rounded(columns @ weights.T, 13 + extra + 3 + more).reshape(-1, size * size)
    return np.clip(out + center, 0, 2 * center - 1)


def _aan_forward(x: list, mul) -> list:
    """Eight lanes to eight frequencies, still scaled by ``AAN``; ``mul`` takes one of four constants by number."""
    s, d = [x[i] + x[7 - i] for i in range(4)], [x[i] - x[7 - i] for i in range(4)]
    outer, inner, rest = s[0] + s[3], s[1] + s[2], s[0] - s[3]
    turn = mul(rest + (s[1] - s[2]), 1)
    low, middle, high = d[3] + d[2], d[2] + d[1], d[1] + d[0]
    both, side = mul(low - high, 0), mul(middle, 1)
    a, b = mul(low, 2) + both, mul(high, 3) + both
    plus, minus = d[0] + side, d[0] - side
    return [outer + inner, plus + b, rest + turn, minus - a, outer - inner, minus + a, rest - turn, plus - b]


def _aan_inverse(x: list, mul) -> tuple[list, list]:
    """Even and odd halves: outputs i and 7 - i are their sum and difference."""
    a, b, c = x[0] + x[4], x[0] - x[4], x[2] + x[6]
    turn = mul(x[2] - x[6], 1) - c
    even = [a + c, b + turn, b - turn, a - c]
    plus, minus, outer, inner = x[5] + x[3], x[5] - x[3], x[1] + x[7], x[1] - x[7]
    both = mul(minus + inner, 2)
    first = outer + plus
    second = mul(minus, 3) + both - first
    third = mul(outer - plus, 1) - second
    return even, [first, second, third, -(mul(inner, 0) - both + third)]


def _passes(x: np.ndarray, one_d, axes: tuple[int, int]) -> np.ndarray:
    for axis in axes:
        x = np.stack(one_d([x.take(i, axis) for i in range(8)]), axis)
    return x


def forward_fast(x: np.ndarray, raw: bool = False) -> np.ndarray:
    """8-bit constants, products cut by a shift. ``raw``: 16-bit lanes that wrap, scales left in."""
    # fixed values: sin and cosine constants with 8 bits
    constants = [98, 181, 139, 334]
    kind = np.int16 if raw else np.int64
    mul = lambda v, i: ((v.astype(np.int64) * constants[i]) >> 8).astype(kind)
    y = _passes(x.reshape(-1, 8, 8).astype(kind), lambda v: _aan_forward(v, mul), (2, 1)).astype(np.int64)
    if not raw:
        scale = np.outer(AAN_12, AAN_12)
        y = np.sign(y) * ((np.abs(y) << 24) // scale)
    return y.reshape(-1, 64)


def forward_float(x: np.ndarray) -> np.ndarray:
    # fixed values: sin and cosine constants
    constants = [0.382683433, 0.5**0.5, 0.541196100, 1.306562965]
    y = _passes(x.reshape(-1, 8, 8).astype(np.float64), lambda v: _aan_forward(v, lambda a, i: a * constants[i]), (2, 1))
    y = y / np.outer(AAN, AAN)
    return np.trunc(y + np.where(y >= 0, 0.5, -0.5)).astype(np.int64).reshape(-1, 64)


def inverse_fast(x: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """16-bit lanes that wrap, as the fast method is defined; quantized coefficients in."""
    # fixed values: sin and cosine constants with 8 bits
    constants = [277, 362, 473, -669]
    table = ((quant.reshape(8, 8) * np.rint(16384 * np.outer(AAN, AAN)).astype(np.int64) + 2048) >> 12).astype(np.int16)
    mul = lambda v, i: ((v.astype(np.int64) * constants[i]) >> 8).astype(np.int16)

    def one_d(lanes):
        even, odd = (np.array(v, np.int64) for v in _aan_inverse([v.astype(np.int16) for v in lanes], mul))
        return [*(even + odd), *(even - odd)[::-1]]

    lanes = (x.reshape(-1, 8, 8) * table.astype(np.int64)).astype(np.int16)
    return np.clip((_passes(lanes, one_d, (1, 2)) >> 5) + 128, 0, 255).reshape(-1, 64)


def inverse_float(x: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Single precision; quantized coefficients in."""
    # fixed values: sin and cosine constants
    constants = [np.float32(c) for c in (1.082392200, 1.414213562, 1.847759065, -2.613125930)]
    scale = np.array(AAN, np.float32)
    table = quant.reshape(8, 8).astype(np.float32) * scale[:, None] * scale[None, :] * np.float32(0.125)

    def one_d(lanes):
        even, odd = (np.array(v, np.float32) for v in _aan_inverse(lanes, lambda v, i: v * constants[i]))
        return [*(even + odd), *(even - odd)[::-1]]

    y = _passes(x.reshape(-1, 8, 8).astype(np.float32) * table, one_d, (1,))
    y[:, :, 0] += np.float32(128.5)
    return np.clip(np.trunc(_passes(y, one_d, (2,))), 0, 255).astype(np.int64).reshape(-1, 64)


def forward(rows: DataFrame, column: str = "block", method: str = "islow", precision: int = 8) -> DataFrame:
    """Centred samples to coefficients scaled by 8 (``ifast_raw``: and by ``AAN``)."""
    if method not in METHODS or (precision == 12 and method != "islow") or precision not in (8, 12):
        raise ValueError(f"no forward transform {method} with {precision} bits")
    kernel = {"islow": lambda x: forward_integer(x, precision), "ifast": forward_fast, "ifast_raw": lambda x: forward_fast(x, raw=True), "float": forward_float}[method]
    return map_array(rows, column, 64, kernel)


def inverse(rows: DataFrame, column: str = "block", method: str = "islow", size: int = 8, precision: int = 8, quant: list[int] | None = None) -> DataFrame:
    """Coefficients, times ``quant`` if given, to size x size samples with the level
    shift, clamped. The method only matters for 8 x 8; other sizes, 1 to 16, are
    the integer transforms."""
    if method not in ("islow", "ifast", "float") or size not in SIZES or precision not in (8, 12) or (precision == 12 and (size != 8 or method != "islow")):
        raise ValueError(f"no inverse transform {method} to {size} x {size} with {precision} bits")
    table = np.array(quant if quant is not None else [1] * 64, np.int64)
    if method != "islow" and size == 8:
        kernel = inverse_fast if method == "ifast" else inverse_float
        return map_array(rows, column, 64, lambda x: kernel(x, table))
    return map_array(rows, column, 64, lambda x: inverse_integer(x * table, size, precision))


def inverse_sizes(rows: DataFrame, size: str = "size", column: str = "block", quant: str | None = None) -> DataFrame:
    """``rows`` with coefficients turned into as many samples as the column ``size`` says
    for each row (1 to 16 a side), so scales may be mixed in one table.

    ``quant`` names an array column to multiply with. A batch is done size by size.
    Rows with another size, a null, or arrays that aren't 64 numbers become null."""
    ready(rows.sparkSession)
    k, at = rows.columns.index(column), rows.columns.index(size)
    table = None if quant is None else rows.columns.index(quant)
    fields = list(rows.schema.fields)
    fields[k] = StructField(column, ArrayType(LongType()))
    names = rows.columns

    def run(batches):
        for b in batches:
            values, good = matrix(b.column(k), 64)
            x = np.zeros((b.num_rows, 64), np.int64)
            x[good] = values
            there = np.zeros(b.num_rows, bool)
            there[good] = True
            if table is not None:
                values, good = matrix(b.column(table), 64)
                q = np.zeros((b.num_rows, 64), np.int64)
                q[good] = values
                known = np.zeros(b.num_rows, bool)
                known[good] = True
                x, there = x * q, there & known
            sizes = np.asarray(b.column(at).fill_null(0)).astype(np.int64)
            there &= np.isin(sizes, SIZES)
            ends = np.cumsum(np.where(there, sizes**2, 0))
            flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
            for n in np.unique(sizes[there]):
                which = np.flatnonzero(there & (sizes == n))
                flat[(ends[which] - n * n)[:, None] + np.arange(n * n)] = inverse_integer(x[which], int(n))
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.append(~there, False))
            out = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], out, *b.columns[k + 1 :]], names=names)

    return rows.mapInArrow(run, StructType(fields))
