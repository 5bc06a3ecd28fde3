"""The WAV container: chunks, sample formats, samples.

Only headers are read to find the samples: a reader is any function of
(offset, count), so the same walk serves bytes in a row and a file of hours.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: tags of the fmt chunk.
PCM, FLOAT, EXTENSIBLE = 0x0001, 0x0003, 0xFFFE
#: Fixed values of the format: names of sample formats by (tag, bits).
SUBTYPES = {
    (PCM, 8): "PCM_U8", (PCM, 16): "PCM_16", (PCM, 24): "PCM_24", (PCM, 32): "PCM_32",
    (FLOAT, 32): "FLOAT", (FLOAT, 64): "DOUBLE",
}


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are and how they are stored."""

    tag: int
    channels: int
    rate: int
    bits: int
    offset: int
    frames: int

    @property
    def align(self) -> int:
        return self.channels * self.bits // 8

    @property
    def subtype(self) -> str:
        return SUBTYPES[self.tag, self.bits]


def _int(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """Walks the chunks of a file of ``size`` bytes up to its samples.

    Chunks of any kind and length may come before. A data chunk that says it
    is longer than the file, as those of unfinished or piped recordings do,
    ends with the file. Anything else is a ValueError.
    """
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        head = read(at, 8)
        name, length = head[:4], _int(head[4:])
        if name == b"fmt ":
            form = read(at + 8, min(length, 40))
        elif name == b"data":
            return _layout_of(form, at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


def _layout_of(form: bytes | None, offset: int, length: int) -> Layout:
    if form is None or len(form) < 16:
        raise ValueError("no format chunk before the samples")
    tag, channels, rate, bits = _int(form[:2]), _int(form[2:4]), _int(form[4:8]), _int(form[14:16])
    if tag == EXTENSIBLE:
        if len(form) < 26:
            raise ValueError("extensible format without a subformat")
        tag = _int(form[24:26])
    if (tag, bits) not in SUBTYPES or not channels or not rate:
        raise ValueError(f"unsupported samples: format {tag}, {bits} bits, {channels} channels, rate {rate}")
    return Layout(tag, channels, rate, bits, offset, length // (channels * bits // 8))


def samples(raw: bytes, of: Layout) -> np.ndarray:
    """(frames x channels) float32 of whole frames in ``raw``; integers end up in [-1, 1)."""
    raw = raw[: len(raw) // of.align * of.align]
    width = of.bits // 8
    if of.tag == FLOAT:
        x = np.frombuffer(raw, f"<f{width}").astype("float32")
    elif width == 1:
        x = (np.frombuffer(raw, "u1").astype("float32") - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), "u1")
        wide[:, 1:] = np.frombuffer(raw, "u1").reshape(-1, 3)
        x = wide.view("<i4").ravel().astype("float32") / 2147483648.0
    else:
        x = np.frombuffer(raw, f"<i{width}").astype("float32") / float(1 << (of.bits - 1))
    return x.reshape(-1, of.channels)


def in_memory(blob: bytes) -> Callable[[int, int], bytes]:
    return lambda at, count: blob[at : at + count]
