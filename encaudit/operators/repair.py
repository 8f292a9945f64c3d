"""Repairing damaged characters: propose, decide, apply, verify, sum up.

A repair puts one character in the place of one, so no index ever moves and all
repairs of a file are applied in one rewrite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind
from encaudit.functions.charsets import (
    REPLACEMENT,
    decode_lossy,
    decode_plan,
    encode_text,
    family_of,
    is_decodable,
    is_encodable,
    latin1_view,
    scan_pattern,
    with_bom,
)
from encaudit.functions.paths import extension
from encaudit.functions.suggestions import sanitize_suggestion
from encaudit.operators.findings import damaged_files, findings, with_lines
from encaudit.operators.skew import PARTS, lookup_join
from encaudit.session import settle

APPLY, RETRY, SKIP = "apply", "retry", "skip"
APPLIED, SKIPPED, FAILED, OPEN = "applied", "skipped", "failed", "open"

PLACE = ["path", "absolute_char_index"]
_KEPT = [*PLACE, "byte_sequence_file_pos", "write_charset"]

# A word with at least one letter outside ASCII.
_ACCENTED_WORD = r"(?<![\p{L}\p{M}])[A-Za-z]*+[\p{L}\p{M}]++"
_NOT_ASCII = "[^\x00-\x7f]"


def repairable(found: DataFrame) -> DataFrame:
    """Findings that can be repaired: the visible ones. Hidden ones stay as they are."""
    return found.where(F.col("char_found") & F.col("absolute_char_index").isNotNull())


# ---------------------------------------------------------------- contexts


def rejected_suggestions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions turned down at each place, in the order they were made."""
    turned_down = decisions.where(F.col("decision") == RETRY).select(*PLACE, "rank").distinct()
    made = proposals.select(*PLACE, "rank", "suggestion")
    return (
        made.join(turned_down, [*PLACE, "rank"])
        .groupBy(*PLACE, "suggestion")
        .agg(F.min("rank").alias("rank"))
        .groupBy(*PLACE)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("rejected"))
        .withColumn("rejected", F.transform("rejected", lambda item: item["suggestion"]))
    )


def repair_context(
    found: DataFrame,
    rejected: DataFrame | None = None,
    reach: int | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """What a scorer needs to propose a character for each repairable finding.

    ``found`` needs the line text (``with_lines``), or ``lines`` gives it
    (``damaged_lines``): then each line is shuffled once, not with all its findings.
    ``request`` holds all of it as one JSON object. ``reach`` cuts the line to so many
    characters on either side of the damage; ``char_position`` then counts in the cut.
    """
    places = repairable(found)
    if rejected is None:
        places = places.withColumn("rejected", F.lit(None).cast("array<string>"))
    else:
        places = places.join(rejected, PLACE, "left")
    if lines is not None:
        places = with_lines(places, lines.select("path", "line", "line_text"))
    none = F.lit("none")
    said = F.array_join(F.coalesce("rejected", F.array().cast("array<string>")), ", ")
    suffix = extension(F.col("path"))
    if reach is not None:
        start = F.greatest(F.col("char_position") - reach, F.lit(0))
        places = places.withColumns(
            {
                "line_text": F.substring("line_text", start + 1, F.col("char_position") - start + 1 + reach),
                "char_position": F.col("char_position") - start,
            }
        )
    line, position = F.col("line_text"), F.col("char_position")
    context = places.select(
        *PLACE,
        F.when(suffix == "", "unknown").otherwise(suffix).alias("extension"),
        line.alias("line_text"),
        position.alias("char_position"),
        F.substring(line, F.lit(1), position).alias("left_context"),
        F.substring(line, position + 2, F.length(line)).alias("right_context"),
        F.when(said == "", none).otherwise(said).alias("rejected"),
    )
    asked = [name for name in context.columns if name not in PLACE]
    return context.withColumn("request", F.to_json(F.struct(*asked)))


def propose_with(
    context: DataFrame, propose: Callable[[pd.DataFrame], pd.Series], rank: int = 1
) -> DataFrame:
    """Proposals of an external scorer: a function from context rows to raw answers.

    It runs in Arrow batches on the executors; its answers are cleaned by
    ``sanitize_suggestion``, and an unusable one becomes a null suggestion.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.Series(list(propose(batch)), index=batch.index, dtype="object")
            yield batch[PLACE].assign(answer=answers)

    answers = context.mapInPandas(ask, "path string, absolute_char_index bigint, answer string")
    return answers.select(
        *PLACE,
        F.lit(rank).alias("rank"),
        sanitize_suggestion(F.col("answer")).alias("suggestion"),
        F.lit("external").alias("source"),
    )


# ---------------------------------------------------------------- vocabulary


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """Words with non-ASCII letters, how often they occur, and how they look damaged."""
    text = F.col(column)
    words = (
        texts.where(text.rlike(_NOT_ASCII))
        .select(F.explode(F.regexp_extract_all(text, F.lit(_ACCENTED_WORD), F.lit(0))).alias("word"))
        .where(F.col("word").rlike(_NOT_ASCII))
    )
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("support"))
    return counts.withColumn("pattern", F.regexp_replace("word", _NOT_ASCII, REPLACEMENT))


def candidates(vocabulary: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Ranked characters for every damaged place of every damaged word.

    One row per (pattern, offset, character): ``support`` sums the words that
    have the character there, ``rank`` follows the most frequent of them. The
    rows of one place are as many as there are different characters, whatever
    the size of the corpus. ``wanted(word)`` limits the patterns to those that occur.
    """
    words = vocabulary
    if wanted is not None:
        patterns = wanted.select(F.col("word").alias("pattern")).distinct()
        words = vocabulary.join(patterns, "pattern", "left_semi")
    letters = words.select(
        "pattern",
        "word",
        "support",
        F.posexplode(F.split("word", "")).alias("word_offset", "suggestion"),
    ).where(F.col("suggestion").rlike(_NOT_ASCII))
    best = F.min(F.struct((-F.col("support")).alias("order"), "word"))
    places = letters.groupBy("pattern", "word_offset", "suggestion").agg(
        best.alias("best"), F.sum("support").alias("support")
    )
    order = Window.partitionBy("pattern", "word_offset").orderBy("best", "suggestion")
    return places.withColumn("rank", F.row_number().over(order)).select(
        "pattern", "word_offset", "rank", "suggestion", "support"
    )


# ---------------------------------------------------------------- decisions


def decided_ranks(decisions: DataFrame) -> DataFrame:
    """Per place: how many suggestions were turned down first, and what came then."""
    pairs = F.collect_set(F.struct("rank", "decision"))
    grouped = decisions.groupBy(*PLACE).agg(F.array_sort(pairs).alias("pairs"))
    refused = F.array_sort(
        F.array_distinct(
            F.transform(
                F.filter("pairs", lambda pair: pair["decision"] == RETRY),
                lambda pair: pair["rank"],
            )
        )
    )
    retries = F.size(F.filter(refused, lambda rank, place: rank == place + 1))
    counted = grouped.withColumn("retries", retries)
    final = F.filter("pairs", lambda pair: pair["rank"] == F.col("retries") + 1)
    return counted.select(*PLACE, "retries", F.get(final, F.lit(0))["decision"].alias("decision"))


def _with_ranks(places: DataFrame, decisions: DataFrame | None) -> DataFrame:
    if decisions is None:
        ranked = places.withColumns({"retries": F.lit(0), "decision": F.lit(None).cast("string")})
    else:
        ranked = places.join(decided_ranks(decisions), PLACE, "left").withColumn(
            "retries", F.coalesce("retries", F.lit(0))
        )
    return ranked.withColumn("rank", F.col("retries") + 1)


def _outcome(proposed: DataFrame, automatic: bool, min_support: int) -> DataFrame:
    # A charset without U+FFFD cannot hold the rest of the damage either, so the
    # rewrite of its file fails whatever the suggestion is.
    family = family_of(F.col("write_charset"))
    writable = is_encodable(F.concat("suggestion", F.lit(REPLACEMENT)), family)
    decision = F.col("decision")
    if automatic:
        enough = F.coalesce("support", F.lit(0)) >= min_support
        decision = F.coalesce(decision, F.when(enough, APPLY))
    status = (
        F.when(F.col("suggestion").isNull(), FAILED)
        .when(decision == SKIP, SKIPPED)
        .when(decision == APPLY, F.when(writable, APPLIED).otherwise(FAILED))
        .otherwise(OPEN)
    )
    return proposed.select(
        *PLACE, "byte_sequence_file_pos", "suggestion", status.alias("status"), "retries"
    )


def repairs_from_corpus(
    found: DataFrame,
    ranked: DataFrame,
    decisions: DataFrame | None = None,
    automatic: bool = True,
    min_support: int = 1,
    parts: int = PARTS,
) -> DataFrame:
    """Repairs by the characters the clean corpus has in the same word.

    ``found`` needs the damaged words and should be settled. Every place looks
    up just the rank its decisions call for, so nothing is multiplied. Without a
    decision the first suggestion is applied when ``automatic``.
    """
    places = _with_ranks(
        repairable(found).select(
            *_KEPT, F.col("word").alias("pattern"), "word_offset"
        ),
        decisions,
    )
    if decisions is not None:
        # the lookup reads its rows twice; the join with the decisions runs once
        places = settle(places)
    keys = ["pattern", "word_offset", "rank"]
    proposed = lookup_join(places, ranked, keys, PLACE, parts)
    return _outcome(proposed, automatic, min_support)


def repairs_from_proposals(
    found: DataFrame,
    proposals: DataFrame,
    decisions: DataFrame | None = None,
    automatic: bool = False,
) -> DataFrame:
    """Repairs by proposals ``(path, absolute_char_index, rank, suggestion)``."""
    if decisions is not None:
        decisions = decisions.join(proposals, [*PLACE, "rank"], "left_semi")
    places = _with_ranks(repairable(found).select(*_KEPT), decisions)
    offered = proposals.select(*PLACE, "rank", "suggestion", F.lit(1).alias("support"))
    return _outcome(places.join(offered, [*PLACE, "rank"], "left"), automatic, 1)


# ---------------------------------------------------------------- applying


#: So many paths at most are sent to all tasks, to drop the files that no repair touches before they are shuffled.
BROADCAST_PATHS = 200_000


def apply_repairs(files: DataFrame, repairs: DataFrame) -> DataFrame:
    """``path``, ``label``, old ``content``, ``repaired`` content and ``n_applied``.

    Holds the files with at least one applied repair; all others stay as they
    are. The list of repairs of a file is no longer than the file itself. Only
    damaged files take part in the join.
    """
    fix = F.struct("byte_sequence_file_pos", "suggestion")
    lists = (
        repairs.where(F.col("status") == APPLIED)
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(fix)).alias("fixes"))
    )
    lists = settle(lists)
    touched = lists.select("path")
    if touched.count() <= BROADCAST_PATHS:
        touched = F.broadcast(touched)
    # contents without an applied repair leave before the join that shuffles contents
    wanted = damaged_files(files.select("path", "label", "content")).join(touched, "path", "left_semi")
    joined = wanted.join(lists, "path")
    return joined.select(
        "path",
        "label",
        "content",
        _rewritten().alias("repaired"),
        F.size("fixes").alias("n_applied"),
    )


def _rewritten() -> Column:
    """Content with the damaged bytes replaced, in one pass over its slices.

    Bytes that do not decode are written back as the U+FFFD they are read as.
    """
    content = F.col("content")

    def splice(bound: Column) -> Column:
        plan, fixes = bound["plan"], bound["fixes"]
        width = F.octet_length(scan_pattern(plan["family"]))

        def slice_before(fix: Column, number: Column) -> Column:
            end = F.get(fixes, number - 1)["byte_sequence_file_pos"] + width
            start = F.coalesce(end, plan["skip"].cast("long")).cast("int")
            length = fix["byte_sequence_file_pos"].cast("int") - start
            kept = F.substring(bound["content"], start + 1, length)
            new = encode_text(fix["suggestion"], plan["family"])
            return F.concat(latin1_view(kept), latin1_view(new))

        after = (F.element_at(fixes, -1)["byte_sequence_file_pos"] + width).cast("int")
        rest = F.substring(bound["content"], after + 1, F.octet_length(bound["content"]))
        view = F.concat(F.array_join(F.transform(fixes, slice_before), ""), latin1_view(rest))
        return bind(
            F.struct(F.encode(view, "ISO-8859-1").alias("body"), plan.alias("plan")),
            lambda done: with_bom(_sound(done["body"], done["plan"]["family"]), done["plan"]),
        )

    start = F.struct(
        content.alias("content"),
        decode_plan(content, F.col("label")).alias("plan"),
        F.col("fixes").alias("fixes"),
    )
    return bind(start, splice)


def _sound(body: Column, family: Column) -> Column:
    again = encode_text(decode_lossy(body, family), family)
    return F.when(is_decodable(body, family), body).otherwise(again)


def remaining_findings(repaired: DataFrame) -> DataFrame:
    """Findings of the repaired files, read again from their new content."""
    return findings(repaired.select("path", "label", F.col("repaired").alias("content")))


def verify(repairs: DataFrame, remaining: DataFrame) -> DataFrame:
    """Repairs with every applied one that is still damaged turned into a failure."""
    still = remaining.select(*PLACE, F.lit(True).alias("still")).distinct()
    status = F.when(
        (F.col("status") == APPLIED) & F.col("still").isNotNull(), FAILED
    ).otherwise(F.col("status"))
    return repairs.join(still, PLACE, "left").withColumn("status", status).drop("still")


def repair_summary(
    results: DataFrame, found: DataFrame, repairs: DataFrame, remaining: DataFrame
) -> DataFrame:
    """Counters per file; a file without findings counts as skipped.

    ``remaining`` lists findings of rewritten files; a file that was not
    rewritten keeps all it had. All inputs shrink to one row per file first.
    """
    totals = found.groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    outcomes = repairs.groupBy("path").agg(
        F.count_if(F.col("status") == APPLIED).alias("applied"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped"),
        F.sum("retries").alias("retries"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )
    left = remaining.groupBy("path").agg(F.count(F.lit(1)).alias("left"))
    joined = (
        results.select("path")
        .join(totals, "path", "left")
        .join(outcomes, "path", "left")
        .join(left, "path", "left")
    )
    counters = ["total", "applied", "skipped", "retries", "failed"]
    rewritten = F.coalesce("applied", F.lit(0)) > 0
    return joined.select(
        "path",
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counters],
        F.when(rewritten, F.coalesce("left", F.lit(0)))
        .otherwise(F.coalesce("total", F.lit(0)))
        .alias("remaining"),
        F.col("total").isNull().alias("file_skipped"),
    )
