"""Reads a SentencePiece model file (the published protobuf layout) without other libraries."""

from __future__ import annotations

from dataclasses import dataclass, field
from struct import unpack

#: Fixed values of the published format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_suffix: bool = False

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        data = f.read()
    m = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            m.pieces.append((got.get(1, b"").decode(), unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            m.model_type, m.byte_fallback, m.whitespace_suffix = got.get(3, UNIGRAM), bool(got.get(35, 0)), bool(got.get(24, 0))
        elif number == 3:
            got = dict(_fields(value))
            m.charsmap = got.get(2, b"")
            m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(got.get(i, 1)) for i in (3, 4, 5))
    return m
