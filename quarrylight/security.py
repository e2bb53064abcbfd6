"""Who may see what: one predicate over labels, used by every read path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.model import SECRET, SENSITIVE, has


@dataclass(frozen=True)
class Caller:
    clearance: int
    tenant: int
    sci: int = 0

    def narrowed(self, clearance: int, tenant: int, sci: int) -> Caller:
        """A requested context inside this one; raises if it asks for more."""
        if clearance > self.clearance or tenant != self.tenant or sci & ~self.sci:
            raise PermissionError("the requested context exceeds the bound one")
        return Caller(min(clearance, self.clearance), self.tenant, sci & self.sci)


def holds(required: Column, held: int) -> Column:
    """All required bits are held."""
    return required.bitwiseAND(F.lit(~held)) == 0


def allowed(caller: Caller | None, shared_tenant: bool = True, check_sci: bool = True) -> Column:
    """Rows of tenant 0 are everyone's (unless shared_tenant is off); sensitive rows need SECRET; nobody sees nothing."""
    if caller is None:
        return F.lit(False)
    tenant = F.col("tenant_id") == caller.tenant
    out = (F.col("classification") <= caller.clearance) & ((F.col("tenant_id") == 0) | tenant if shared_tenant else tenant)
    if shared_tenant and caller.clearance < SECRET:
        out = out & ~has(F.col("flags"), SENSITIVE)
    return out & holds(F.col("sci"), caller.sci) if check_sci else out


def valid_scope_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._-]{1,63}$")


def valid_scope(project: Column, worktree: Column, workstream: Column, session: Column) -> Column:
    """A child scope needs its parent; given ids must be valid."""
    levels = [project, worktree, workstream, session]
    out = valid_scope_id(project)
    for parent, child in zip(levels, levels[1:]):
        out = out & (child.isNull() | (parent.isNotNull() & valid_scope_id(child)))
    return F.coalesce(out, F.lit(False))


def glob(value: Column, pattern: str) -> Column:
    """* and ? as in file names."""
    import re

    return value.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")
