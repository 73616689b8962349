"""Job parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


def _text(value) -> str | None:
    return None if value in (None, "") else str(value)


def _int(value) -> int | None:
    return None if value in (None, "") else int(value)


def _items(value) -> list[str]:
    """A list, or a comma-separated text whose items may be quoted."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else [str(v) for v in value]
    return [p for p in (part.strip().strip("'\"") for part in parts) if p]


@dataclass(frozen=True)
class VisitCondition:
    """Optional bounds on the visit log; absent ones do not restrict it."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] = ()
    target_page_flow: tuple[int, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str) -> "VisitCondition":
        raw = json.loads(text)
        return cls(
            start_date=_text(raw.get("startDate")),
            end_date=_text(raw.get("endDate")),
            start_age=_int(raw.get("startAge")),
            end_age=_int(raw.get("endAge")),
            professionals=tuple(_items(raw.get("professionals"))),
            target_page_flow=tuple(int(p) for p in _items(raw.get("targetPageFlow"))),
        )

    def to_json(self) -> str:
        return json.dumps(
            {
                "startDate": self.start_date,
                "endDate": self.end_date,
                "startAge": self.start_age,
                "endAge": self.end_age,
                "professionals": ",".join(self.professionals),
                "targetPageFlow": ",".join(str(p) for p in self.target_page_flow),
            },
            ensure_ascii=False,
        )
