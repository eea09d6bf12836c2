"""SQL of the scoring, for the oracles of every query that scores planted findings."""

from __future__ import annotations

from probatio import dims

POINTS = "CASE severity WHEN 'low' THEN 5 WHEN 'medium' THEN 15 WHEN 'high' THEN 30 WHEN 'critical' THEN 50 ELSE 0 END"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
#: Module, weight and place of each module.
MODULES = [(m, dims.MODULE_WEIGHTS[m]) for m in dims.MODULE_ORDER]
#: Codes of a module in the order in which its rules report them.
RULE_ORDER = (
    "META_IMAGE_EDITOR", "META_IMAGE_CONVERSION", "META_AI_GENERATED", "META_ONLINE_CONVERTER", "META_SUSPICIOUS_PRODUCER", "META_NO_METADATA", "META_NO_PRODUCER",
    "CONTENT_FAR_FUTURE_DATE", "CONTENT_VERY_OLD_DATE", "CONTENT_ANACHRONISM_SERVICE", "CONTENT_ANACHRONISM_DUE", "CONTENT_ANACHRONISM_ORDER", "CONTENT_FUTURE_INVOICE_DATE",
    "CONTENT_REFERENCE_DATE_MISMATCH", "CONTENT_INCONSISTENT_REFERENCES", "CONTENT_INVALID_SIRET", "CONTENT_INVALID_SIREN", "CONTENT_INVALID_VAT", "CONTENT_SIREN_VAT_MISMATCH",
    "CONTENT_MISSING_COMPANY_ID", "VISUAL_WATERMARK_SPECIMEN", "VISUAL_WATERMARK_TEST", "VISUAL_WATERMARK_CONFIDENTIAL", "VISUAL_CONVERTER_WATERMARK", "FONTS_EXCESSIVE_DIVERSITY",
    "FONTS_HIGH_DIVERSITY", "FONTS_SYSTEM_FONTS", "FONTS_NOT_EMBEDDED", "FONTS_MIXED_SUBSETS", "FONTS_MIDLINE_CHANGE", "IMAGES_SCREENSHOT_DETECTED", "IMAGES_RESOLUTION_MISMATCH",
    "IMAGES_HEAVY_COMPRESSION", "IMAGES_EXCESSIVE_COUNT", "IMAGES_NO_IMAGES", "IMAGES_IMAGE_ONLY_PDF", "IMAGES_MOSTLY_IMAGE_PDF", "STRUCT_SIGNATURE_TRUSTED", "STRUCT_SIGNATURE_TRUSTED_EXPIRED",
    "STRUCT_SIGNATURE_NOT_TRUSTED", "STRUCT_SIGNATURE_UNVERIFIABLE", "STRUCT_SIGNATURE_INVALID", "STRUCT_INCREMENTAL_UPDATES", "STRUCT_JAVASCRIPT_DETECTED", "STRUCT_HIDDEN_ANNOTATIONS",
    "STRUCT_SUSPICIOUS_ANNOTATIONS", "STRUCT_EMBEDDED_FILES", "STRUCT_ACROFORM_DETECTED", "STRUCT_DELETED_OBJECTS", "META_FUTURE_CREATION_DATE", "META_DOCUMENT_MODIFIED", "META_IMPOSSIBLE_DATES",
    "STRUCT_XMP_EDITOR_MISMATCH", "FORENSICS_ELA_MAJOR_EDIT", "FORENSICS_ELA_MINOR_EDIT", "EXTERNAL_SIRET_NOT_FOUND", "EXTERNAL_SIRET_VERIFICATION_FAILED", "EXTERNAL_COMPANY_CLOSED",
)


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def scored_sql(flags: str, documents: str, confidence: str, modules=MODULES) -> str:
    """CTEs from a list with ``flags`` (doc_id, module, severity, code) and ``documents`` on: mods, scores, counts, final.

    Scores are summed in module order, as the engine does, so that means close to a half round the same way.
    """
    rows = ", ".join(f"('{m}', {w}, {i})" for i, (m, w) in enumerate(modules))
    mean = "sum(score * (weight * confidence) ORDER BY spot) / sum(weight * confidence ORDER BY spot)"
    return f"""
mods AS (SELECT *, {confidence}::DOUBLE AS confidence FROM {documents}, (VALUES {rows}) m(module, weight_, spot)),
scores AS (SELECT doc_id, module, confidence, weight_::DOUBLE AS weight, spot, greatest(0, 100 - coalesce(sum({POINTS}), 0))::INT AS score, count(code) AS found FROM mods LEFT JOIN {flags} USING (doc_id, module) GROUP BY ALL),
counts AS (SELECT doc_id, count(code) AS n_flags, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high,
             count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low FROM {documents} LEFT JOIN {flags} USING (doc_id) GROUP BY 1),
base AS (SELECT doc_id, round_even(greatest(0, least(100, {mean})), 0)::INT AS base_score FROM scores GROUP BY 1),
capped AS (SELECT *, greatest(5, least(base_score, 40) - 5 * n_high - 2 * n_medium)::INT AS cap,
             CASE WHEN base_score >= 80 THEN 'LOW' WHEN base_score >= 50 THEN 'MEDIUM' WHEN base_score >= 20 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM base JOIN counts USING (doc_id)),
final AS (SELECT doc_id, base_score, n_flags, n_critical, n_high, n_medium, n_low,
            CASE WHEN n_critical >= 2 THEN least(cap, 19) WHEN n_critical = 1 THEN cap ELSE base_score END::INT AS trust_score,
            CASE WHEN n_critical >= 2 THEN 'CRITICAL' WHEN n_critical = 1 AND level IN ('LOW', 'MEDIUM') THEN 'HIGH' ELSE level END AS risk_level FROM capped)"""


def ranked_sql(flags: str) -> str:
    """CTE ``r``: the flags with rank, spot of the module and place of the code in it."""
    spots = "list_position(" + listed(dims.MODULE_ORDER) + ", module)"
    return f"r AS (SELECT *, {RANK} AS rank, {spots} AS spot, list_position({listed(RULE_ORDER)}, code) AS seq FROM {flags})"
