"""Repair a corpus: find, propose, decide, apply, verify, sum up."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encaudit.operators import repair as steps
from encaudit.operators.encoding import with_overrides
from encaudit.operators.routing import (
    REPAIR,
    audit_files,
    audited_findings,
    file_results,
    kept_originals,
)
from encaudit.session import settle
from encaudit.sources.tree import files_to_audit


@dataclass(frozen=True)
class Repair:
    """Outcome of a repair run."""

    results: DataFrame
    findings: DataFrame
    repairs: DataFrame
    contents: DataFrame
    remaining: DataFrame
    summary: DataFrame


def repair(
    files: DataFrame,
    extensions: Iterable[str],
    clean_texts: DataFrame | None = None,
    proposals: DataFrame | None = None,
    decisions: DataFrame | None = None,
    automatic: bool = True,
    overrides: DataFrame | None = None,
) -> Repair:
    """Repairs ``files(path, content)`` from a clean corpus or a proposals table.

    Findings, repairs and new contents are settled one after the other, so no
    stage computes an earlier one again.
    """
    if (clean_texts is None) == (proposals is None):
        raise ValueError("Give either clean_texts or proposals")
    if overrides is not None:
        files = with_overrides(files, overrides)
    audited = settle(
        audit_files(files, extensions, repair=True, with_word=proposals is None)
    )
    results, found = file_results(audited), audited_findings(audited)
    if proposals is None:
        words = steps.vocabulary(clean_texts)
        ranked = steps.candidates(words, found.select("word"))
        chosen = steps.repairs_from_corpus(found, ranked, decisions, automatic)
    else:
        chosen = steps.repairs_from_proposals(found, proposals, decisions, automatic)
    chosen = settle(chosen)
    # the contents that may change were kept with the findings: the files are read
    # once, and only damaged contents are ever shuffled
    damaged = kept_originals(audited)
    rewritten = settle(steps.apply_repairs(damaged, chosen))
    remaining = settle(steps.remaining_findings(rewritten))
    verified = steps.verify(chosen, remaining)
    return Repair(
        results=results,
        findings=found,
        repairs=verified,
        contents=rewritten.select("path", F.col("repaired").alias("content")),
        remaining=remaining,
        summary=steps.repair_summary(
            results.where(F.col("action") == REPAIR), found, verified, remaining
        ),
    )


def repair_tree(
    spark: SparkSession,
    path: str,
    extensions: Iterable[str],
    skip_dirs: Iterable[str] = (),
    overrides: DataFrame | None = None,
    **options,
) -> Repair:
    """``repair`` of a directory tree or of one file."""
    extensions = list(extensions)
    files = files_to_audit(spark, path, extensions, skip_dirs, overrides)
    return repair(files, extensions, **options)
