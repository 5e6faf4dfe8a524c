"""A rule that was violated first: its code and what is known about it, never content."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Violation(Exception):
    code: str
    entry: int | None = None
    limit: int | None = None
    observed: int | None = None
    field: str | None = None
    attachment: int | None = None
    number: int | None = None

    def row(self) -> dict:
        return {"code": self.code, "entry_index": self.entry, "field": self.field, "attachment_index": self.attachment, "attachment_number": self.number, "limit_value": self.limit, "observed": self.observed}


def within(observed: int, limit: int, code: str, **about) -> None:
    if observed > limit:
        raise Violation(code, limit=limit, observed=observed, **about)
