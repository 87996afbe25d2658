"""From a scanned draft and its review to what is saved: review state, problems, the final document, and what is shown of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import top
from ..functions import text as tx
from .registry import MOCK, Field, frame, prune, resolve_text

# Messages by reason, sections, and instructions of the four prompts.
MESSAGES = {
    "absent-and-empty": "{} is required, and the scan found no source content for it. Write it yourself before saving.",
    "unreviewed-placeholder": "{} still contains the mock placeholder. Replace it with real content — placeholder text is never saved.",
    "empty": "{} is required and is currently empty.",
    "no-entries": "At least one {} is required. Add one manually if the scan found none.",
}
SECTIONS = ["foundation", "positioning", "market", "branding", "presence", "people", "offerings", "extensions"]


def label_of(path: str) -> str:
    """A field's name in words, from the last part of its path."""
    words = re.sub(r"([A-Z])", r" \1", path.rpartition(".")[2]).lower()
    return words[:1].upper() + words[1:]


def get_path(df: DataFrame, path: str) -> Column:
    """The value at a dotted path; null where the schema has no such path."""
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return F.lit(None)
        kind = kind[part].dataType
    return F.col(path)


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """The rows with the value at a dotted path; everything beside the path stays."""
    head, _, tail = path.partition(".")
    return df.withColumn(head, F.col(head).withField(tail, value) if tail else value)


def initial_review(drafts: DataFrame, fields: list[Field], keys: list[str]) -> DataFrame:
    """(keys, path, value, reviewed): a row for each field of evidence, holding its placeholder and not reviewed."""
    states = []
    for f in (f for f in fields if f.category == 2):
        status = F.col(f.path)["status"]
        states.append(F.struct(F.lit(f.path).alias("path"), F.when(status == "found", F.lit(f"{MOCK} {label_of(f.path)}]")).otherwise("").alias("value"), F.lit(False).alias("reviewed")))
    return drafts.select(*keys, F.explode(F.array(*states)).alias("s")).select(*keys, "s.*")


def review_join(drafts: DataFrame, review: DataFrame, fields: list[Field], keys: list[str]) -> DataFrame:
    """(keys, path, required, status, value, reviewed, problem): each field of evidence with the state of its review."""
    two = [f for f in fields if f.category == 2]
    rows = drafts.select(*keys, F.explode(F.array(*[F.struct(F.lit(f.path).alias("path"), F.lit(f.required).alias("required"), F.col(f.path)["status"].alias("status")) for f in two])).alias("f")).select(*keys, "f.*")
    met = rows.join(review.select(*keys, "path", "value", "reviewed"), [*keys, "path"], "left")
    reason = resolve_text(F.col("value"), F.coalesce("reviewed", F.lit(True)), F.col("status"))
    return met.withColumn("problem", F.when(reason.isin("unreviewed", "mock-text"), "unreviewed-placeholder").otherwise(reason))


def message(label: Column, reason: Column) -> Column:
    """What a reviewer is told of a problem."""
    out = F.lit(None).cast("string")
    for k, m in MESSAGES.items():
        before, after = m.split("{}")
        name = F.regexp_replace(label, "s$", "") if k == "no-entries" else label
        out = F.when(reason == k, F.concat(F.lit(before), name, F.lit(after))).otherwise(out)
    return out


def draft_to_final(drafts: DataFrame, review: DataFrame, fields: list[Field], keys: list[str]) -> DataFrame:
    """The drafts' columns as they are saved, with ok and problems (path, reason, message).

    Empty entries of lists go, also notes (customNotes: title, body) of which nothing is written; one with a title or a body stays.
    Texts become what the reviewer left, or null; required ones must be there, and at least one named offering.  A draft with
    problems isn't ok, and its texts are null.
    """
    two = [f for f in fields if f.category == 2]
    joined = review_join(drafts, review, fields, keys)
    texts = joined.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(F.when(F.col("problem").isNull(), F.trim("value")).alias("text"), "problem")))).alias("__r"))  # one entry for each field
    out = prune(drafts, fields).join(texts, keys)
    if "customNotes" in out.columns:
        out = out.withColumn("customNotes", F.filter("customNotes", lambda n: tx.has_visible(n["title"]) | tx.has_visible(n["body"])))
    problems = [F.when(F.col("__r")[f.path]["problem"].isNotNull(), F.struct(F.lit(f.path).alias("path"), F.col("__r")[f.path]["problem"].alias("reason"), message(F.lit(label_of(f.path)), F.col("__r")[f.path]["problem"]).alias("message"))) for f in two if f.required]
    for f in (f for f in fields if f.required and f.kind == "objectList"):
        named = F.exists(f.path, lambda e: F.length(F.trim(F.coalesce(e["name"], F.lit("")))) > 0)
        problems.append(F.when(~F.coalesce(named, F.lit(False)), F.struct(F.lit(f.path).alias("path"), F.lit("no-entries").alias("reason"), message(F.lit(label_of(f.path)), F.lit("no-entries")).alias("message"))))
    out = out.withColumn("problems", F.array_compact(F.array(*problems))).withColumn("ok", F.size("problems") == 0)
    for f in two:
        out = set_path(out, f.path, F.when(F.col("ok"), F.col("__r")[f.path]["text"]))
    return out.drop("__r")


def problem_rows(final: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, reason, message) of drafts that can't be saved."""
    return final.select(*keys, F.explode("problems").alias("p")).select(*keys, "p.*")


def badge(status: Column, value: Column, first: Column) -> Column:
    """Whether a field's source badge shows: found ones always, others once a reviewer has written something else than at first."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (status == "found") | ((v != "") & (v != F.trim(F.coalesce(first, F.lit("")))))


def section_problem(section: Column, action: Column) -> Column:
    """Why a request to hide or restore a section is refused; null if it isn't."""
    return F.when(section.isNull() | ~section.isin(SECTIONS), "unknown-section").when(action.isNull() | ~action.isin("hide", "restore"), "unknown-action")


def required_fields(owners: DataFrame, hidden: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, grp, hidden): the fields that each owner's document must have, and whether the owner hides their group (keys, section)."""
    fields = F.broadcast(frame(owners.sparkSession).filter("required").select("path", "grp"))  # some five fields
    marked = hidden.select(*keys, F.col("section").alias("grp"), F.lit(True).alias("hidden")).distinct()
    return owners.select(*keys).join(fields).join(marked, [*keys, "grp"], "left").select(*keys, "path", "grp", F.coalesce("hidden", F.lit(False)).alias("hidden"))


def with_versions(current: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, company_id, hidden_sections, n_versions): a company's document with its hidden sections and how many versions there are, this one included."""
    shut = sections.filter("hidden").groupBy("company_id").agg(F.array_sort(F.collect_set("section")).alias("hidden_sections"))  # at most all sections
    old = versions.groupBy("company_id").agg(F.count("*").alias("n"))
    rows = current.join(shut, "company_id", "left").join(old, "company_id", "left")
    return rows.select("id", "company_id", F.coalesce("hidden_sections", F.array().cast("array<string>")).alias("hidden_sections"), (F.coalesce("n", F.lit(0)) + 1).alias("n_versions"))


def grid(rows: DataFrame, keys: list[str], order: list[str], columns: int, first_row: int, rows_shown: int, overscan: int = 2) -> DataFrame:
    """The cards of the grid's rows in view, and overscan rows on either side: adds place and grid_row, both from 0."""
    last = (first_row + rows_shown + overscan) * columns
    placed = top(rows, keys, order, last, "place").withColumn("place", F.col("place") - 1)
    return placed.withColumn("grid_row", F.floor(F.col("place") / columns)).filter(F.col("grid_row") >= max(first_row - overscan, 0))


def tone(score: Column) -> Column:
    """How a completeness score is shown."""
    return F.when(score >= 70, "good").when(score >= 40, "fair").otherwise("poor")


def initials(name: Column) -> Column:
    """The first letters of the first and last word of a name."""
    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.upper(F.concat(F.coalesce(F.substring(F.get(words, 0), 1, 1), F.lit("")), F.when(F.size(words) > 1, F.substring(F.element_at(words, -1), 1, 1)).otherwise("")))


def ink(hex_color: Column) -> Column:
    """Black or white, whichever reads better on a colour (#rrggbb), by its relative luminance."""
    part = lambda i: F.conv(F.substring(hex_color, i, 2), 16, 10).cast("double") / 255
    lin = lambda v: F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return F.when(0.2126 * lin(part(2)) + 0.7152 * lin(part(4)) + 0.0722 * lin(part(6)) > 0.179, "black").otherwise("white")


def prompt_inputs(snippets: DataFrame, keys: list[str], task: str) -> DataFrame:
    """(keys, task, place, line): the tagged evidence lines that a writing task would get; nothing is sent anywhere."""
    return snippets.select(*keys, F.lit(task).alias("task"), "place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "text").alias("line"))


def tenant_view(rows: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """The rows of the tenants that a user belongs to."""
    own = members.filter(F.col("user") == user).select("tenant").distinct()
    return rows.join(own, "tenant", "left_semi")


def deadline(tries: DataFrame, keys: list[str], each_ms: int, all_ms: int) -> DataFrame:
    """The tries (keys, start_ms, took_ms) with reason: timeout where a page took too long or came to its turn too late; null otherwise."""
    late = (F.col("took_ms") > each_ms) | (F.col("start_ms") >= all_ms) | (F.col("start_ms") + F.col("took_ms") > all_ms)
    return tries.withColumn("reason", F.when(late, "timeout"))
