"""DuckDB SQL of functions that DuckDB lacks, for the twins of the queries."""

from __future__ import annotations

# The primes of XXH64, the polynomial of CRC-32
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
CRC_POLYNOMIAL = 0xEDB88320

_ALL = (1 << 64) - 1


def _n(value: int) -> str:
    return f"{value % (1 << 64)}::UHUGEINT"


def _low(x: str) -> str:
    return f"({x} & {_n(_ALL)})"


def _times(x: str, prime: int) -> str:
    return _low(f"({x} * {_n(prime)})")


def _plus(x: str, y: str) -> str:
    return _low(f"({x} + {y})")


def _turned(x: str, bits: int) -> str:
    return _low(f"(({x} * {_n(1 << bits)}) | ({x} >> {_n(64 - bits)}))")


def _little(width: int, at: str) -> str:
    """The number that ``width`` bytes make from byte ``at`` (from 0) of the hexadecimal digits ``x``, lowest first."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(width - 1, -1, -1)) + ")::UBIGINT::UHUGEINT"


def xxh64_sql(source: str, name: str, seed: int = 42) -> str:
    """CTEs that end in ``name``: ``source`` (with hexadecimal digits ``x``) and its XXH64 ``h``, a UBIGINT."""
    rounded = lambda lane: _times(_turned(_times(lane, P2), 31), P1)
    taken = lambda start, lanes, step: f"list_reduce(list_prepend({start}, {lanes}), lambda a, b: {step})"
    starts = [seed + P1 + P2, seed + P2, seed, seed - P1]
    every = lambda k: f"list_transform(range(0, n // 32), lambda i: {_little(8, f'32 * i + {8 * k}')})"
    lanes = [taken(_n(s), every(k), _times(_turned(_plus("a", _times("b", P2)), 31), P1)) + f" AS v{k}" for k, s in enumerate(starts)]
    joined = "v0r"
    for k in range(1, 4):
        joined = _plus(joined, f"v{k}r")
    merge = "h"
    steps = []
    for k in range(4):
        steps.append(f"{name}_m{k} AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_plus(_times(f'xor({merge}, {rounded(f"v{k}")})', P1), _n(P4))} ELSE h END AS h) FROM {name}_{'j' if k == 0 else f'm{k - 1}'})")
    turned = ", ".join(f"{_turned(f'v{k}', t)} AS v{k}r" for k, t in enumerate((1, 7, 12, 18)))
    eights = f"list_transform(range(n // 32 * 4, n // 8), lambda i: {_little(8, '8 * i')})"
    ones = f"list_transform(range(n // 4 * 4, n), lambda i: {_little(1, 'i')})"
    finish = [
        ("e", taken("h", eights, _plus(_times(_turned(f"xor(a, {rounded('b')})", 27), P1), _n(P4)))),
        ("f", f"CASE WHEN n % 8 >= 4 THEN {_plus(_times(_turned(f'xor(h, {_times(_little(4, "n // 8 * 8"), P1)})', 23), P2), _n(P3))} ELSE h END"),
        ("o", taken("h", ones, _times(_turned(f"xor(a, {_times('b', P5)})", 11), P1))),
        ("x", _times(f"xor(h, h >> {_n(33)})", P2)),
        ("y", _times(f"xor(h, h >> {_n(29)})", P3)),
    ]
    out = [
        f"{name}_l AS (SELECT *, {', '.join(lanes)} FROM (SELECT *, len(x) // 2 AS n FROM {source}))",
        f"{name}_j AS (SELECT *, {_plus(f'CASE WHEN n >= 32 THEN {joined} ELSE {_n(seed + P5)} END', '0::UHUGEINT')} AS h FROM (SELECT *, {turned} FROM {name}_l))",
        *steps,
        f"{name}_n AS (SELECT * REPLACE ({_plus('h', 'n::UHUGEINT')} AS h) FROM {name}_m3)",
    ]
    before = f"{name}_n"
    for suffix, expression in finish:
        out.append(f"{name}_{suffix} AS (SELECT * REPLACE ({expression} AS h) FROM {before})")
        before = f"{name}_{suffix}"
    out.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (h, x, n, v0, v1, v2, v3, v0r, v1r, v2r, v3r), xor(h, h >> {_n(32)})::UBIGINT AS h FROM {before})")
    return ",\n".join(out)


def long_digits(column: str) -> str:
    """The eight bytes of a BIGINT, lowest first, as hexadecimal digits."""
    big = f"lpad(hex({column}::BIGINT), 16, '0')"
    return " || ".join(f"substr({big}, {k}, 2)" for k in range(15, 0, -2))


def crc32_sql(digits: str) -> str:
    """CRC-32 of the bytes that hexadecimal ``digits`` (a column) stand for, byte by byte; each bit of a byte adds its own remainder."""
    remainders = [1 << bit for bit in range(8)]
    for _ in range(8):
        remainders = [(r >> 1) ^ (CRC_POLYNOMIAL * (r & 1)) for r in remainders]
    step = "c >> 8"
    for bit, remainder in enumerate(remainders):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {remainder})"
    codes = f"list_transform(regexp_extract_all({digits}, '..'), lambda d: ('0x' || d)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"
