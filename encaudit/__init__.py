"""Auditing and repairing the text encoding of large file corpora on Spark."""

from encaudit.plans.audit import Audit, audit, audit_tree
from encaudit.plans.census import census
from encaudit.plans.repair import Repair, repair, repair_tree

__all__ = ["Audit", "Repair", "audit", "audit_tree", "census", "repair", "repair_tree"]
