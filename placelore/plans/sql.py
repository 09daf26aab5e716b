"""Assembly of SQL statements from named common table expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    if name in VIEWS:
        raise ValueError(f"duplicate view {name}")
    VIEWS[name] = sql.strip()


def statement(sql: str) -> str:
    """Prefixes ``sql`` with the views it mentions, directly or through other views."""
    order: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in entered:
                entered.add(name)  # a recursive view mentions itself
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    # MATERIALIZED: deep chains of views are otherwise inlined again at every mention
    ctes = ",\n".join(
        f"{name} AS {'' if name in VIEWS[name] else 'MATERIALIZED '}(\n{VIEWS[name]}\n)" for name in order
    )
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def same_over(prefix: str, names: list[str], changes: dict[str, str]) -> None:
    """The views ``names`` once more over another input: each as ``prefix`` + name, mentioning one another and ``changes``."""
    renamed = {name: f"{prefix}{name}" for name in names} | changes
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(old)}(?!\w)" for old in sorted(renamed, key=len, reverse=True)))
    for name in names:
        view(renamed[name], pattern.sub(lambda found: renamed[found.group()], VIEWS[name]))
