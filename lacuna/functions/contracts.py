"""Contracts of stored records as named rules: a run, an intake journal, a preparation report, the layouts, a review.

A rule is a Column that is true where the record keeps it; `evidence.violations` turns rules into a table. A value that is
absent (null) breaks a rule only where the record must have it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import gates, text
from lacuna.operators import evidence
from lacuna.plans import policy

# fixed values: words of the published records
STATUSES = ["completed", "needs_review", "partial", "queued", "running", "pending_digitizer", "timed_out", "failed"]
SOURCES = ["reference", "upload"]
LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]
QUANTITATIVE = ["canonicalCsv", "segmentsCsv", "uncertaintyCsv", "segmentMapJson"]
DIAGNOSTIC = ["diagnosticBundle", "diagnosticManifest", "diagnostic", "paperRender"]
CONFIRMATIONS = ["sourceCompared", "leadIdentityVerified", "scaleAndGapsReviewed"]
MAX_UPLOAD = 50 * 1024 * 1024
JOURNAL = "version int, runId string, fileName string, safeFileName string, fileSizeBytes bigint, sourceSha256 string, createdAt string, storage struct<version:int,admittedAt:string,minimumFreeBytes:bigint,reservedBytes:bigint>, owner struct<ownerId:string,pid:bigint,hostname:string>, captureQuality struct<outcome:string,sourceSha256:string>"


def absent_or(value: Column, rule: Column) -> Column:
    return value.isNull() | F.coalesce(rule, F.lit(False))


def sha256_text(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-f0-9]{64}$"), F.lit(False))


def run_rules() -> dict[str, Column]:
    """Rules of a stored run: columns as in the record, `assets` an array of the keys that it has."""
    c = F.col
    has = lambda key: F.array_contains("assets", key)
    photo, trust = c("photo"), c("reliability")
    rules = {"invalid_run_header": c("id").isNotNull() & c("local_path").isNotNull() & c("source").isin(SOURCES) & c("status").isin(STATUSES) & c("assets").isNotNull()}
    rules |= {f"invalid_{k}": absent_or(c(k), gates.positive(c(k))) for k in ("sample_rate", "effective_rate", "paper_speed", "gain")}
    rules["invalid_calibration_confidence"] = absent_or(c("calibration_confidence"), gates.unit_fraction(c("calibration_confidence")))
    rules |= {f"invalid_{k}": absent_or(c(k), c(k) >= 0) for k in ("lead_count", "file_size")}
    kept = c("retention")
    rules["invalid_retention_contract"] = absent_or(kept, kept["version"].isin(1, 2) & (kept["policy"] == F.concat(F.lit("lean-final-evidence-v"), kept["version"])) & kept["removed"].isNotNull())
    rules |= {f"invalid_reliability_{k}": absent_or(trust, gates.positive(trust[k])) for k in ("width", "height", "nominal_rate", "effective_rate")}
    rules |= {f"invalid_reliability_{k}": absent_or(trust, trust[k] >= 0) for k in ("masked_pixels", "uncertain", "missing")}
    rules["invalid_reliability_evidence"] = absent_or(trust, gates.unit_fraction(trust["masked_fraction"]) & ~trust["reconstructed"] & trust["preserved"])
    rules["source_photo_manifest_identity_mismatch"] = absent_or(photo, (photo["state"] == "failed") | (c("manifest_sha256") == photo["manifest_sha256"]))
    diagnostic = (c("reason_code") == "diagnostic_source_photo") & (c("outcome") == "partial")
    whole = ~F.arrays_overlap("assets", F.array(*(F.lit(k) for k in QUANTITATIVE)))
    for key in DIAGNOSTIC:
        whole = whole & has(key)
    available = F.coalesce(photo["state"] == "diagnostic_available", F.lit(False))
    claimed = F.coalesce(c("reason_code") == "diagnostic_source_photo", F.lit(False))
    rules["invalid_source_photo_publication"] = (~available | F.coalesce(diagnostic & whole, F.lit(False))) & (~claimed | available)
    return rules


def journal(source: Column) -> Column:
    """The parsed journal, null for text that is no JSON object of that form."""
    return F.from_json(source, JOURNAL)


def journal_rules(j: Column) -> dict[str, Column]:
    """Rules of an intake journal; one that breaks any of them is not taken up."""
    held, owner, quality = j["storage"], j["owner"], j["captureQuality"]
    time = F.try_to_timestamp
    return {
        "version": j["version"] == 1, "run_id": F.coalesce(j["runId"].rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)), "file_name": F.length(j["fileName"]) > 0, "safe_file_name": j["safeFileName"] == text.safe_stem(j["fileName"]),
        "file_size": j["fileSizeBytes"].between(0, MAX_UPLOAD), "source_sha256": sha256_text(j["sourceSha256"]), "created_at": time(j["createdAt"]).isNotNull(), "storage_version": held["version"] == 1, "admitted_at": time(held["admittedAt"]).isNotNull(),
        "minimum_free": held["minimumFreeBytes"] >= policy.MIN_FREE, "reserved": held["reservedBytes"] >= evidence.reservation(j["fileSizeBytes"]), "owner_id": F.length(owner["ownerId"]) > 0, "pid": owner["pid"] > 0, "hostname": F.length(owner["hostname"]) > 0,
        "capture_quality": absent_or(quality, (quality["outcome"] == "ready") & (quality["sourceSha256"] == j["sourceSha256"])),
    }


def layout_rules() -> dict[str, Column]:
    """Rules of a row of the layout table (version, layout, page_rows, leads: an array)."""
    known = F.array(*(F.lit(k) for k in LEADS))
    return {"version": F.col("version") == 1, "page_rows": F.col("page_rows") > 0, "unknown_lead": F.size(F.array_except("leads", known)) == 0}


def confirmed(confirmations: Column) -> Column:
    """Every confirmation of a review (a map) is true."""
    return F.forall(F.array(*(F.lit(k) for k in CONFIRMATIONS)), lambda k: F.coalesce(F.element_at(confirmations, k), F.lit(False)))


def acceptable(outcome: Column, assets: Column, retention_version: Column) -> Column:
    """A review can accept the numbers: the run waits for it and has its signals; a lean run of version 2 also its evidence."""
    has = lambda keys: F.forall(F.array(*(F.lit(k) for k in keys)), lambda k: F.array_contains(assets, k))
    lean = F.coalesce(retention_version == 2, F.lit(False))
    return F.coalesce((outcome == "needs_review") & has(QUANTITATIVE[:2]) & (~lean | has([*QUANTITATIVE[2:], "provenanceJson"])), F.lit(False))


def interpreter_state(input_sha: Column, source_sha: Column, canonical_sha: Column, assets: Column, has_map: Column) -> Column:
    """What an interpreter may be given: nothing without a verified original, the reconstruction only with its whole evidence."""
    whole = canonical_sha.isNotNull() & has_map & F.forall(F.array(F.lit("segmentsCsv"), F.lit("uncertaintyCsv"), F.lit("provenanceJson")), lambda k: F.array_contains(assets, k))
    lost = source_sha.isNull() | ~F.array_contains(assets, "input") | F.coalesce(input_sha != source_sha, F.lit(False))
    return F.when(lost, "missing_original_identity").when(F.coalesce(whole, F.lit(False)), "available_for_source_review").otherwise("unavailable")


def preparation_rules() -> dict[str, Column]:
    """Rules of a preparation report: version, sha, source (width, height), working (width, height, scale_x, scale_y, method,
    most), quality (outcome, eligible, long_edge, short_edge, scale, reasons) and correction (applied, method, confidence,
    width, height, transform of nine doubles, reconstructed); working and quality belong to version 7, a correction is optional."""
    from lacuna.functions import geometry

    c = F.col
    source, working, quality, fixed = c("source"), c("working"), c("quality"), c("correction")
    sized = lambda s: (s["width"] > 0) & (s["height"] > 0)
    near = lambda a, b: F.abs(a - b) <= 1e-6
    scales = near(working["scale_x"], working["width"] / source["width"]) & near(working["scale_y"], working["height"] / source["height"])
    raster = sized(working) & scales & working["method"].isNotNull() & (F.greatest(working["width"], working["height"]) <= working["most"])
    outcome = quality["outcome"].isin("acceptable", "review", "insufficient") & (quality["eligible"] == (quality["outcome"] != "insufficient"))
    edges = (quality["long_edge"] == F.greatest(source["width"], source["height"])) & (quality["short_edge"] == F.least(source["width"], source["height"]))
    seventh = raster & outcome & edges & near(quality["scale"], F.least(working["scale_x"], working["scale_y"])) & quality["reasons"].isNotNull()
    known = F.forall(fixed["transform"], lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(fixed["transform"]) == 9) & geometry.invertible(fixed["transform"])
    transform = fixed["applied"].isNotNull() & fixed["method"].isNotNull() & gates.unit_fraction(fixed["confidence"]) & sized(fixed) & known & ~fixed["reconstructed"]
    return {
        "invalid_preprocessing_provenance": c("version").isin(5, 6, 7) & sha256_text(c("sha")) & sized(source),
        "invalid_input_quality": (c("version") != 7) | F.coalesce(seventh, F.lit(False)),
        "invalid_transform": absent_or(fixed, transform),
    }
