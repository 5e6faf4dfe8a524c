"""Ceilings. A value exceeds one only when it is greater."""

from __future__ import annotations

from dataclasses import dataclass

KIB, MIB = 1 << 10, 1 << 20
#: Decoded bytes at once, and decoded bytes before the ratio counts.
BUFFER = GRACE = 64 * KIB


@dataclass(frozen=True)
class ArchiveLimits:
    archive: int = 64 * MIB
    entries: int = 256
    name: int = 255
    entry: int = 32 * MIB
    total: int = 128 * MIB
    ratio: int = 100
    extra: int = 4 * KIB
    comment: int = KIB


@dataclass(frozen=True)
class DocumentLimits:
    document: int = 32 * MIB
    depth: int = 32
    elements: int = 10_000
    attributes: int = 32
    text: int = MIB


@dataclass(frozen=True)
class PlanLimits:
    files: int = 256
    total: int = 128 * MIB
    path: int = 1024
    component: int = 255
    depth: int = 16
