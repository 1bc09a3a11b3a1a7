"""Typed task parameters, read from the JSON of a task row."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class TaskParams:
    """Parameters of an analysis task; one that is absent restricts nothing."""

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] = field(default=())
    cities: tuple[str, ...] = field(default=())
    sex: str | None = None
    keywords: tuple[str, ...] = field(default=())
    category_ids: tuple[int, ...] = field(default=())
    page_flow: tuple[int, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str) -> TaskParams:
        """Each value is a list whose first element counts; lists of names and ids are comma-joined in it."""
        raw: dict[str, Any] = {k: (v[0] if v else None) if isinstance(v, list) else v for k, v in json.loads(text).items()}
        parts = lambda key: tuple(x for x in (p.strip() for p in str(raw.get(key) or "").split(",")) if x)
        day = lambda key: dt.date.fromisoformat(raw[key]) if raw.get(key) else None
        whole = lambda key: int(raw[key]) if raw.get(key) not in (None, "") else None
        return cls(
            start_date=day("startDate"), end_date=day("endDate"), start_age=whole("startAge"), end_age=whole("endAge"), professionals=parts("professionals"), cities=parts("cities"),
            sex=raw.get("sex") or None, keywords=parts("keywords"), category_ids=tuple(map(int, parts("categoryIds"))), page_flow=tuple(map(int, parts("targetPageFlow"))),
        )

    def given(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) not in (None, ())]


def find_task(tasks, task_id: int) -> TaskParams:
    """Parameters of the task with this id; an error if there is none."""
    row = tasks.where(tasks["task_id"] == task_id).select("params").first()
    if row is None:
        raise LookupError(f"no task {task_id}")
    return TaskParams.from_json(row.params)
