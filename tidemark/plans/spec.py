"""Sync specs: which tables to copy, which rows and columns, and where to."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Fixed value: the grammar of variables in a spec, ${NAME} and ${NAME:-default}.
_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """Replace ${VAR} and ${VAR:-default}; a variable that is unset or empty gives the default, or nothing."""
    env = os.environ if env is None else env
    return _VAR.sub(lambda m: env.get(m[1]) or m[2] or "", text)


#: The field names of a spec file, as load() reads them, are fixed values.
@dataclass(frozen=True)
class TableSpec:
    """One table of a spec. Criteria are mappings of field, operator and value, all of which must hold."""

    db: str
    coll: str
    target_db: str | None = None
    enabled: bool = True
    db_priority: int = 0
    priority: int = 0
    criteria: tuple[dict, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    always: tuple[str, ...] = ()
    key: str = "_id"

    @property
    def name(self) -> str:
        return f"{self.db}.{self.coll}"


@dataclass(frozen=True)
class SyncSpec:
    tables: tuple[TableSpec, ...] = field(default_factory=tuple)

    @staticmethod
    def load(text: str, env: Mapping[str, str] | None = None) -> SyncSpec:
        """From JSON: {"databases": [{"name", "target", "priority", "enabled", "collections": [{"name", ...}]}]}. A database may be listed twice."""
        out = []
        for db in json.loads(expand(text, env))["databases"]:
            for c in db.get("collections", ()):
                rows, cols = c.get("filter") or {}, c.get("fields") or {}
                out.append(TableSpec(db["name"], c["name"], db.get("target"), bool(db.get("enabled", True) and c.get("enabled", True)), db.get("priority", 0), c.get("priority", 0),
                                     tuple(rows.get("criteria") or ()), tuple(cols.get("include") or ()), tuple(cols.get("exclude") or ()), tuple(cols.get("always") or ()), c.get("key", "_id")))
        return SyncSpec(tuple(out))

    def select(self, names: list[str] | None = None) -> list[TableSpec]:
        """Enabled tables by priority; `names` are databases or db.coll. An unknown name or an empty selection is an error."""
        tables = sorted((t for t in self.tables if t.enabled), key=lambda t: (t.db_priority, t.priority, t.name))
        if names is not None:
            for n in names:
                if not any(n in (t.db, t.name) for t in self.tables):
                    raise ValueError(f"no such database or table: {n}")
            tables = [t for t in tables if t.db in names or t.name in names]
            if not tables:
                raise ValueError("the selection is empty")
        return tables
