"""Check or convert a corpus: one pass over the contents, reports from the result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from encaudit.operators import reports
from encaudit.operators.encoding import with_overrides
from encaudit.operators.findings import with_lines
from encaudit.operators.routing import (
    audit_files,
    audited_findings,
    audited_lines,
    converted_contents,
    file_results,
    kept_originals,
)
from encaudit.session import settle
from encaudit.sources.tree import files_to_audit


@dataclass(frozen=True)
class Audit:
    """Outcome of an audit. Every table reads the one settled pass over the files."""

    files: DataFrame

    @property
    def results(self) -> DataFrame:
        return file_results(self.files)

    @property
    def findings(self) -> DataFrame:
        return audited_findings(self.files)

    @property
    def lines(self) -> DataFrame:
        """The lines with damage, each once, of an audit ``with_string``."""
        return audited_lines(self.files)

    @property
    def converted(self) -> DataFrame:
        return converted_contents(self.files)

    @property
    def originals(self) -> DataFrame:
        """Old content of the files that were to be converted, if it was kept."""
        return kept_originals(self.files)

    def reports(
        self, with_string: bool = False, only_relevant: bool = False
    ) -> dict[str, DataFrame]:
        """All report tables by name.

        ``with_string`` needs an audit with the same option; every row of the tables
        of findings then repeats its line.
        """
        results, found = self.results, self.findings
        if with_string:
            found = with_lines(found, self.lines)
        tables = {
            "encodings": reports.encoding_histogram(results),
            "detection": reports.detection_totals(results),
            "converted": reports.converted_files(results),
            "skipped": reports.skipped_files(results),
            "skipped_count": reports.skipped_count(results),
            "errors": reports.error_files(results),
            "unsupported": reports.findings_unsupported(found, with_string),
            "code": reports.findings_in_code(found, with_string, only_relevant),
        }
        if not only_relevant:
            tables["comments"] = reports.findings_in_comments(found, with_string)
        return tables


def audit(
    files: DataFrame,
    extensions: Iterable[str],
    checks: bool = True,
    convert: bool = False,
    overrides: DataFrame | None = None,
    with_string: bool = False,
    keep_originals: bool = False,
    target: str | None = None,
) -> Audit:
    """Audits ``files(path, content)``.

    The outcome is written to ``target`` as Parquet, or settled in the shared
    folder if there is none, so the contents are read once for all reports.
    """
    if overrides is not None:
        files = with_overrides(files, overrides)
    audited = audit_files(
        files,
        extensions,
        checks,
        convert,
        with_text=with_string,
        keep_originals=keep_originals,
    )
    if target is None:
        return Audit(settle(audited))
    audited.write.mode("overwrite").parquet(target)
    return Audit(files.sparkSession.read.parquet(target))


def audit_tree(
    spark: SparkSession,
    path: str,
    extensions: Iterable[str],
    skip_dirs: Iterable[str] = (),
    overrides: DataFrame | None = None,
    **options,
) -> Audit:
    """``audit`` of a directory tree or of one file."""
    extensions = list(extensions)
    files = files_to_audit(spark, path, extensions, skip_dirs, overrides)
    return audit(files, extensions, **options)
