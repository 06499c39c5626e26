"""A small writer of transport files, for fixtures only."""

from __future__ import annotations

import struct

BLANK = b" "


def _record(text: str) -> bytes:
    return text.encode("latin-1").ljust(80, BLANK)


def _number(value, width: int = 8) -> bytes:
    if value is None:
        return b"." + b"\0" * (width - 1)
    if value == 0:
        return b"\0" * width
    sign, magnitude, exponent = (0x80 if value < 0 else 0), abs(value), 64
    while magnitude >= 1:
        magnitude /= 16
        exponent += 1
    while magnitude < 1 / 16:
        magnitude *= 16
        exponent -= 1
    return (bytes([sign | exponent]) + int(magnitude * 2**56).to_bytes(7, "big"))[:width]


def write_xport(path: str, columns: list[tuple[str, str, int]], rows: list[tuple]) -> None:
    """``columns`` are (name, "num" or "char", width)."""
    out = [
        _record("HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!" + "0" * 30),
        _record("SAS     SAS     SASLIB  9.4     X64"), _record("01JAN20:00:00:00"),
        _record("HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!" + "0" * 17 + "1600000000140"),
        _record("HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!" + "0" * 30),
        _record("SAS     TOPIC   SASDATA 9.4     X64"), _record("01JAN20:00:00:00"),
        _record("HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!" + f"000000{len(columns):04d}" + "0" * 20),
    ]
    names, position = b"", 0
    for i, (name, kind, width) in enumerate(columns):
        names += struct.pack(">hhhh", 1 if kind == "num" else 2, 0, width, i + 1)
        names += name.encode().ljust(8, BLANK) + BLANK * 40 + BLANK * 8 + struct.pack(">hhh", 8, 0, 0) + b"\0\0"
        names += BLANK * 8 + struct.pack(">hh", 0, 0) + struct.pack(">i", position) + b"\0" * 52
        position += width
    out.append(names.ljust(-(-len(names) // 80) * 80, BLANK))
    out.append(_record("HEADER RECORD*******OBS     HEADER RECORD!!!!!!!" + "0" * 30))
    body = b"".join(
        b"".join(_number(v, w) if kind == "num" else str(v).encode().ljust(w, BLANK)
                 for v, (_, kind, w) in zip(row, columns, strict=True)) for row in rows)
    out.append(body.ljust(-(-len(body) // 80) * 80, BLANK))
    with open(path, "wb") as handle:
        handle.write(b"".join(out))
