"""Checking stage reports and the artifacts they claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.lookup import fits_broadcast, lookup
from tabulon.session import materialize

# Fixed value: the reason of a failed report that gives none.
NO_REASON = "no reason given"

# Stand-ins for escaped backslashes and quotes while strings are cut out of a JSON text; raw
# control characters cannot occur inside valid JSON strings.
BACKSLASH, QUOTE = "\u0001", "\u0002"


def json_strings(text: Column) -> Column:
    """Every string value (not key) at any depth of a JSON text, unescaped."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    found = F.regexp_extract_all(marked, F.lit(r'"[^"]*"(?:\s*:)?'), F.lit(0))
    values = F.filter(found, lambda t: t.endswith('"'))
    restored = F.transform(
        values, lambda t: F.replace(F.replace(t, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))
    )
    return F.transform(
        restored, lambda t: F.when(t.contains("\\"), F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"])
        .otherwise(t.substr(F.lit(2), F.length(t) - 2))
    )


def normal_path(path: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def artifact_claims(reports: DataFrame, report: str = "report", root: str = "output_dir") -> DataFrame:
    """`<other columns>, path`: distinct absolute paths a report names below its output folder."""
    keys = [c for c in reports.columns if c not in (report, root)]
    strings = reports.where(F.try_parse_json(report).isNotNull()).select(
        *keys, F.col(root).alias("_root"), F.explode(json_strings(F.col(report))).alias("_text")
    )
    below = F.startswith(F.col("path"), F.concat(normal_path(F.col("_root")), F.lit("/")))
    paths = strings.where(F.col("_text").startswith("/")).select(*keys, "_root", normal_path(F.col("_text")).alias("path"))
    return paths.where(below).select(*keys, "path").distinct()


def folders_of(path: Column) -> Column:
    """A path and every folder above it."""
    parts = F.filter(F.split(normal_path(path), "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


def listed(claimed: DataFrame, files: DataFrame) -> DataFrame:
    """Those of the distinct `claimed.path` that are in the listing, or a folder above something that is.

    Claims whose measured size allows it are broadcast: every file then tests the folders above it where it
    is read, and only what was claimed is shuffled. Otherwise the listing is first reduced to folders at
    depths that are claimed, and each of those is kept once.
    """
    if fits_broadcast(claimed):
        above = files.select(F.explode(folders_of(F.col("path"))).alias("path"))
        return above.join(F.broadcast(claimed), "path", "left_semi").distinct()
    depth = lambda c: F.size(F.split(c, "/"))
    # As many rows as there are depths of paths.
    depths = [r[0] for r in claimed.select(depth(F.col("path"))).distinct().collect()]
    above = F.filter(folders_of(F.col("path")), lambda p: depth(p).isin(depths))
    return claimed.join(files.select(F.explode(above).alias("path")).distinct(), "path", "left_semi")


def missing_artifacts(claims: DataFrame, files: DataFrame) -> DataFrame:
    """The claims whose path is neither among `files.path` nor a folder above one of them.

    The claimed paths that exist come back to the claims by lookup, so that one path claimed by very many
    reports does not become one task.
    """
    claims = materialize(claims, "claims")
    claimed = materialize(claims.select("path").distinct(), "claimed")
    out = lookup(claims, listed(claimed, files).select("path", F.lit(True).alias("_there")), ["path"])
    return out.where(F.col("_there").isNull()).select(*claims.columns)


def validate_reports(expected: DataFrame, reports: DataFrame, files: DataFrame, key: str = "run_id") -> DataFrame:
    """`<key>, outcome, reason`; the first failing check decides.

    missing: no report; invalid: not JSON; not_an_object; failed: the report says so itself;
    missing_artifact: it names files or folders that do not exist, all of which are listed; unknown: it carries no status; else ok.
    `expected` has `key, output_dir`; `reports` has `key, report`; both at most one row per key.
    """
    joined = materialize(expected.join(reports.select(key, "report"), key, "left"), "reports")
    gaps = (
        missing_artifacts(artifact_claims(joined.where("report is not null").select(key, "output_dir", "report")), files)
        .groupBy(key)
        .agg(F.count("*").alias("_gaps"), F.array_join(F.array_sort(F.collect_set("path")), ", ").alias("_gap"))
    )
    doc = F.try_parse_json("report")
    status = F.try_variant_get(doc, "$.pipeline_status", "string")
    why = F.coalesce(F.try_variant_get(doc, "$.pipeline_status_reason", "string"), F.lit(NO_REASON))
    is_object = F.substring(F.regexp_replace("report", r"^\s+", ""), 1, 1) == "{"
    has_gaps = F.coalesce("_gaps", F.lit(0)) > 0
    outcome = (
        F.when(F.col("report").isNull(), "missing")
        .when(doc.isNull(), "invalid")
        .when(~is_object, "not_an_object")
        .when(status == "failed", "failed")
        .when(has_gaps, "missing_artifact")
        .when(status.isNull() | (status != "success"), "unknown")
        .otherwise("ok")
    )
    return joined.join(gaps, key, "left").select(
        key, outcome.alias("outcome"), F.col("_gap"), why.alias("_why")
    ).select(
        key, "outcome",
        F.when(F.col("outcome") == "failed", F.col("_why")).when(F.col("outcome") == "missing_artifact", F.col("_gap")).alias("reason"),
    )


def validate_plans(plans: DataFrame, column: str = "plan") -> DataFrame:
    """Add `tasks` and `reason`: a plan must be a non-empty JSON list of strings."""
    doc = F.try_parse_json(column)
    shape = F.schema_of_variant(doc)
    ok = shape == "ARRAY<STRING>"
    reason = (
        F.when(doc.isNull(), "not valid JSON")
        .when(~shape.startswith("ARRAY"), "not a list")
        .when(shape == "ARRAY<VOID>", "empty list")
        .when(~ok, "not a list of strings")
    )
    return plans.withColumns({"tasks": F.when(ok, F.from_json(column, "array<string>")), "reason": reason})


def upstream_context(info: DataFrame, eda: DataFrame, features: DataFrame, key: str = "session_id") -> DataFrame:
    """Each session with its earlier reports; `missing_input` names a mandatory one that is absent.

    All inputs have one row per session. The feature report is optional.
    """
    renamed = lambda df, name: df.select(key, F.col("report").alias(name))
    joined = (
        renamed(info, "info")
        .join(renamed(eda, "eda"), key, "full")
        .join(renamed(features, "features"), key, "left")
    )
    lacking = F.when(F.col("info").isNull(), "info").when(F.col("eda").isNull(), "eda")
    return joined.withColumn("missing_input", lacking)
