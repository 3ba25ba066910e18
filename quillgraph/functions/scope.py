"""Tenant scope predicates: nodes without an organisation are hidden, edges without one are visible."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def public_orgs(setting: str | None = None) -> list[str]:
    """Organisations whose data everybody sees: a comma-separated setting, by default the one named default."""
    value = setting if setting is not None else os.environ.get("PUBLIC_ORGS", "")
    return [x.strip() for x in value.split(",") if x.strip()] or ["default"]


@dataclass(frozen=True)
class Scope:
    """The caller's organisation and the public ones."""

    org: str
    public: tuple[str, ...] = ("default",)

    def node(self, org: Column | str = "org") -> Column:
        org = F.col(org) if isinstance(org, str) else org
        return F.coalesce((org == self.org) | org.isin(*self.public), F.lit(False))

    def edge(self, org: Column | str = "org") -> Column:
        org = F.col(org) if isinstance(org, str) else org
        return self.node(org) | org.isNull()


def optional_tenant(org: Column, caller: str | None) -> Column:
    """All rows without a caller, else the caller's own."""
    return F.lit(True) if caller is None else F.coalesce(org == caller, F.lit(False))
