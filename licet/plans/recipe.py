"""Encoding recipes: an algebra of composable column encodings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Recipe:
    """``kind`` is one of BitPack, FOR, Delta, UnsignedDelta, Dictionary, RLE, Patch, Nullable, Frame."""

    kind: str
    child: Recipe | None = None
    interval: int = 0

    def name(self) -> str:
        at = f"@{self.interval}" if self.interval else ""
        return f"{self.kind}{at}({self.child.name()})" if self.child else self.kind

    def nodes(self) -> list[Recipe]:
        return [self, *(self.child.nodes() if self.child else [])]


LEAVES = {"BitPack"}
KINDS = {"BitPack", "FOR", "Delta", "UnsignedDelta", "Dictionary", "RLE", "Patch", "Nullable", "Frame"}


def bitpack() -> Recipe:
    return Recipe("BitPack")


def validate(r: Recipe) -> None:
    for i, n in enumerate(r.nodes()):
        if n.kind not in KINDS or (n.kind in LEAVES) != (n.child is None):
            raise ValueError(f"{n.kind} is malformed")
        if n.kind in ("Delta", "UnsignedDelta") and (n.interval <= 0 or n.interval % 128):
            raise ValueError("a restart is a positive multiple of 128")
        if n.kind in ("RLE", "Patch") and n.interval <= 0:
            raise ValueError("an interval is positive")
        if n.kind == "Nullable" and (n.interval <= 0 or n.interval % 8):
            raise ValueError("a rank interval is a positive multiple of 8")
        if n.kind == "Nullable" and any(m.kind == "Nullable" for m in n.nodes()[1:]):
            raise ValueError("nested Nullable")
        if n.kind == "Frame" and i:
            raise ValueError("a frame stands outside the decoder")


def decoder(r: Recipe) -> Recipe:
    """The recipe without its frame, which decodes nothing."""
    return r.child if r.kind == "Frame" else r
