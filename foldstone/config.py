"""Settings as tables: one row an option says its default, its rule, and where it shows.

A settings object is a kind (a table of options) with values. Everything else
follows from the table: what is refused, which options make up the storage
key, and which of them appear in the readable name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from .vocab import AGGREGATIONS, DELTA_CONTEXT_MS, EXTRAS, NORMALISATIONS, POOLINGS, TARGET_RATE


class Option(NamedTuple):
    """``rule(value)`` holds for allowed values, ``wants`` says so in words.

    ``stored``: the option changes stored numbers, so it is part of the key.
    """

    default: Any
    rule: Callable[[Any], bool] = lambda value: True
    wants: str = "anything"
    stored: bool = True


def one_of(default: Any, allowed, stored: bool = True) -> Option:
    return Option(default, lambda value: value in allowed, f"one of {', '.join(map(str, allowed))}", stored)


class Kind(NamedTuple):
    """A table of options, the parts of its names, and quantities derived from it."""

    options: Mapping[str, Option]
    parts: tuple[Callable[[Settings], str], ...]
    views: Mapping[str, Callable[[Settings], Any]]


class Settings:
    """Values for the options of a kind; options and derived quantities are attributes. Immutable."""

    kind: Kind

    def __init__(self, **values: Any):
        unknown = set(values) - set(self.kind.options)
        if unknown:
            raise TypeError(f"no such option: {', '.join(sorted(unknown))}")
        chosen = {name: values.get(name, option.default) for name, option in self.kind.options.items()}
        for name, option in self.kind.options.items():
            if not option.rule(chosen[name]):
                raise ValueError(f"{name}: {chosen[name]!r} is not {option.wants}")
        self.__dict__["values"] = chosen

    def __getattr__(self, name: str) -> Any:
        if name in (values := self.__dict__.get("values", {})):
            return values[name]
        if name in self.kind.views:
            return self.kind.views[name](self)
        raise AttributeError(name)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError(f"settings do not change: {name}")

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.values == other.values

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.hash, self.name))

    def replace(self, **changes: Any) -> Settings:
        """The same settings but for ``changes``."""
        return type(self)(**self.values | changes)

    def is_default(self, *names: str) -> bool:
        return all(self.values[n] == self.kind.options[n].default for n in names)

    @property
    def hash(self) -> str:
        """The storage key: settings that differ only in what is applied later share it."""
        kept = {
            name: sorted(value) if isinstance(value, tuple) else value
            for name, value in self.values.items() if self.kind.options[name].stored
        }
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:12]

    @property
    def name(self) -> str:
        return "-".join(filter(None, (part(self) for part in self.kind.parts)))

    def describe(self) -> str:
        """A line for the name, the key, each derived quantity and each option."""
        rows = {"name": self.name, "hash": self.hash}
        rows |= {view: getattr(self, view) for view in self.kind.views} | self.values
        return "\n".join(f"{key:<22}{value:g}" if isinstance(value, float) else f"{key:<22}{value}" for key, value in rows.items())


# ------------------------------------------------------------------ time views

def milliseconds(samples: int, rate: int) -> float:
    return samples / rate * 1000.0


def frames_spanning(context_ms: float, hop_ms: float) -> int:
    """The odd number of frames, 3 at least, nearest above a time context."""
    return max(3, round(context_ms / hop_ms)) | 1


def delta_frames(s: Settings) -> int:
    return s.delta_width or frames_spanning(DELTA_CONTEXT_MS, milliseconds(s.hop_length, s.sr))


# ------------------------------------------------------------- part of a name

def always(template: str) -> Callable[[Settings], str]:
    return lambda s: template.format(s=s)


def unless_default(option: str, template: str) -> Callable[[Settings], str]:
    """The formatted value where it is not the default; a null reads as 0."""
    return lambda s: "" if s.is_default(option) else template.format(getattr(s, option) or 0)


def switch(option: str, on: str, off: str = "") -> Callable[[Settings], str]:
    return lambda s: on if getattr(s, option) else off


def framing(s: Settings) -> str:
    if s.is_default("n_fft", "hop_length"):
        return ""
    return f"win{milliseconds(s.n_fft, s.sr):g}ms-hop{milliseconds(s.hop_length, s.sr):g}ms"


class FeatureSettings(Settings):
    """How the frames of a series become one feature vector."""

    kind = Kind(
        options={
            "sr": Option(TARGET_RATE),
            "n_fft": Option(2048),
            "hop_length": Option(512),
            "n_mels": Option(128),
            "fmin": Option(0.0),
            "fmax": Option(None),
            "n_mfcc": Option(40),
            "deltas": Option(True),
            "delta_deltas": Option(True),
            "delta_width": Option(None, lambda w: w is None or (w >= 3 and w & 1), "an odd number from 3 on"),
            "extras": Option((), lambda names: set(names) <= set(EXTRAS), f"among {', '.join(EXTRAS)}"),
            "aggregation": one_of("mean_std", AGGREGATIONS),
            "trim": Option(True),
            "top_db": Option(30),
            "normalisation": one_of("none", NORMALISATIONS, stored=False),
        },
        parts=(
            always("mfcc{s.n_mfcc}"), switch("deltas", "d"), switch("delta_deltas", "dd"), always("{s.aggregation}"),
            switch("trim", "trim", "notrim"), lambda s: "+".join(sorted(s.extras)), framing,
            unless_default("delta_width", "dw{}"), unless_default("n_mels", "mel{}"), unless_default("fmin", "fmin{:g}"),
            unless_default("fmax", "fmax{:g}"), unless_default("normalisation", "{}"),
        ),
        views={
            "resolved_delta_width": delta_frames,
            "delta_frames": delta_frames,
            "window_ms": lambda s: milliseconds(s.n_fft, s.sr),
            "hop_ms": lambda s: milliseconds(s.hop_length, s.sr),
        },
    )


class VectorSettings(Settings):
    """Which encoder made the vectors, and which part of its layers is read; the latter is chosen after storing."""

    kind = Kind(
        options={
            "model_id": Option("facebook/wav2vec2-base"),
            "sr": Option(TARGET_RATE),
            "trim": Option(False),
            "top_db": Option(30),
            "peak_norm": Option(False),
            "max_duration_s": Option(None, lambda t: t is None or t > 0, "a positive time or None"),
            "layer": Option("last", lambda x: not isinstance(x, str) or x in ("last", "weighted"), "a number, last or weighted", False),
            "pooling": one_of("mean", POOLINGS, stored=False),
            "normalisation": one_of("none", NORMALISATIONS, stored=False),
            "batch_size": Option(8, stored=False),
        },
        parts=(
            lambda s: s.model_id.split("/")[-1], always("L{s.layer}"), always("{s.pooling}"), switch("trim", "trim"),
            switch("peak_norm", "peaknorm"), unless_default("max_duration_s", "max{:g}s"), unless_default("normalisation", "{}"),
        ),
        views={},
    )


# --------------------------------------------------------------- augmentations

#: The kinds of copies, and which amounts each of them takes. Only noise has a
#: transform here; the others name copies made by other tools.
TRANSFORMS: dict[str, Callable[[float], bool]] = {
    "pitch": lambda steps: True,
    "stretch": lambda rate: rate > 0,
    "noise": lambda decibel: True,
}


class NoiseSettings(NamedTuple("Copy", [("name", str), ("kind", str), ("amount", float), ("sr", int)])):
    """A named copy: kind, amount, rate."""

    def __new__(cls, name: str, kind: str, amount: float, sr: int = TARGET_RATE):
        if not TRANSFORMS.get(kind, lambda _: False)(amount):
            raise ValueError(f"no {kind!r} copy by {amount!r}")
        return super().__new__(cls, name, kind, amount, sr)


#: FIXED VALUES -- the augmentations tried
DEFAULT_AUGMENTATIONS = tuple(
    NoiseSettings(*row) for row in (("pitch+2", "pitch", 2.0), ("stretch1.1", "stretch", 1.1), ("noise20db", "noise", 20.0))
)
