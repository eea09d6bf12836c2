"""Derived documents through all eight modules: scores, risk levels, verdicts and summaries.

Texts and file facts come from the orders; fonts and images from their lines; registries from the customers. A
document that has nothing of a kind still runs through its module, which then has no flags and little confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio import dims
from probatio.operators import external, fonts, forensics, images, metadata, scoring, structure, summary
from probatio.plans import files as registries
from probatio.plans import invoices as texts
from probatio.plans import structures
from probatio.plans.scored import POINTS, ranked_sql, scored_sql
from probatio.sources.derived import AS_OF, Dialect, facts_sql, invoices

QUERIES, ORACLES = {}, {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, module, flags, confidence: eight rows for each order."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    with_all = lambda rows: keys.join(rows.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left").drop("d")
    k = F.col("doc_id")
    levels = F.array(F.struct(F.lit(1).alias("page"), ((k % 10) / 100.0 - 0.0001).alias("suspicious_ratio"), F.lit(2).alias("n_zones")))
    found = [
        metadata.analyse(texts.metadata_docs(spark, sf_dir)),
        texts.content_modules(spark, sf_dir),
        texts.visual_modules(spark, sf_dir),
        fonts.analyse(with_all(registries.font_docs(spark, sf_dir))),
        images.analyse(with_all(registries.image_docs(spark, sf_dir))),
        structure.analyse(structures.files(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz")),
        forensics.analyse(keys.withColumn("ela", levels)),
        external.analyse(invoices(spark, sf_dir).select("doc_id", "text"), registries.companies(spark, sf_dir)),
    ]
    return reduce(lambda a, b: a.unionByName(b), (f.withColumn("confidence", F.col("confidence").cast("double")) for f in found))


_FONT_COUNT = f"WITH {registries._FONTS} SELECT doc_id, count(*) AS n_fonts FROM fonts GROUP BY 1"
_ALL = f"""WITH {texts.invoice_sql(Dialect(False), 'orders')}, {texts._CONTENT_RULES}, {texts._VISUAL_RULES}, {facts_sql(Dialect(False), 'orders')}, {texts._META_RULES}, {texts._MISSING_RULES},
struct_ AS ({structures.ORACLES["structure_flags"]}), image_ AS ({registries.ORACLES["image_flags"]}), font_ AS ({registries.ORACLES["font_flags"]}), external_ AS ({registries.ORACLES["registry_lookup"]}),
sure AS ({registries.ORACLES["registry_confidence"]}), counted AS ({_FONT_COUNT}),
all_docs AS (SELECT f.doc_id, k, producer, creator, coalesce(n_fonts, 0) AS n_fonts, sure.confidence AS external_sure, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = f.doc_id) AS pictured
             FROM facts f JOIN sure ON sure.doc_id = f.doc_id LEFT JOIN counted ON counted.doc_id = f.doc_id),
flags AS (SELECT doc_id, 'content' AS module, severity, code FROM content UNION ALL SELECT doc_id, 'visual', severity, code FROM visual
          UNION ALL SELECT doc_id, 'metadata', severity, code FROM meta UNION ALL SELECT doc_id, 'metadata', severity, code FROM missing
          UNION ALL SELECT doc_id, 'structure', severity, code FROM struct_
          UNION ALL SELECT doc_id, 'images', severity, code FROM image_, range(n) WHERE doc_id IN (SELECT o_orderkey FROM orders)
          UNION ALL SELECT doc_id, 'fonts', severity, code FROM font_, range(n) WHERE doc_id IN (SELECT o_orderkey FROM orders)
          UNION ALL SELECT doc_id, 'external', severity, code FROM external_
          UNION ALL SELECT o_orderkey, 'forensics', CASE WHEN o_orderkey % 10 > 5 THEN 'high' ELSE 'medium' END, CASE WHEN o_orderkey % 10 > 5 THEN 'FORENSICS_ELA_MAJOR_EDIT' ELSE 'FORENSICS_ELA_MINOR_EDIT' END
            FROM orders WHERE o_orderkey % 10 > 3)"""
_CONFIDENCE = """CASE module WHEN 'content' THEN 0.9 WHEN 'visual' THEN 0.7 WHEN 'metadata' THEN CASE WHEN producer <> '' OR creator <> '' THEN 1.0 ELSE 0.7 END
  WHEN 'fonts' THEN CASE WHEN n_fonts >= 3 THEN 0.9 WHEN n_fonts > 0 THEN 0.7 ELSE 0.3 END WHEN 'images' THEN CASE WHEN pictured THEN 0.8 ELSE 0.5 END
  WHEN 'structure' THEN 0.95 WHEN 'forensics' THEN 0.6 ELSE external_sure END"""
_SCORED = f"{_ALL}, {scored_sql('flags', 'all_docs', _CONFIDENCE)}"


@_query(f"{_SCORED} SELECT * FROM final")
def trust_score(spark, sf_dir):
    """Flagship: every derived document through eight modules to its trust score and risk level."""
    return scoring.results(modules(spark, sf_dir))


QUERIES["final_score"] = lambda spark, sf_dir: trust_score(spark, sf_dir).select("doc_id", "base_score")
ORACLES["final_score"] = f"{_SCORED} SELECT doc_id, base_score FROM final"
QUERIES["risk_override"] = lambda spark, sf_dir: trust_score(spark, sf_dir).select("doc_id", "base_score", "trust_score", "risk_level").where("n_critical > 0")
ORACLES["risk_override"] = f"{_SCORED} SELECT doc_id, base_score, trust_score, risk_level FROM final WHERE n_critical > 0"
QUERIES["flag_count"] = lambda spark, sf_dir: trust_score(spark, sf_dir).select("doc_id", "trust_score", "risk_level", "n_flags")
ORACLES["flag_count"] = f"{_SCORED} SELECT doc_id, trust_score, risk_level, n_flags FROM final"


@_query(f"{_SCORED} SELECT doc_id, n_critical, n_high, n_medium, n_low FROM counts")
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(modules(spark, sf_dir))


@_query(f"{_SCORED} SELECT doc_id, module, score FROM scores")
def module_score(spark, sf_dir):
    return scoring.with_scores(modules(spark, sf_dir)).select("doc_id", "module", "score")


@_query(f"{_SCORED} SELECT doc_id, module, confidence FROM scores")
def module_confidence(spark, sf_dir):
    return modules(spark, sf_dir).select("doc_id", "module", "confidence")


_GROUPS = ", ".join(f"('{m}', '{g}')" for m, g in dims.MODULE_GROUPS.items())


@_query(
    f"""{_SCORED} SELECT doc_id, module_group, round_even(sum(score * (weight * confidence) ORDER BY spot) / sum(weight * confidence ORDER BY spot), 0)::INT AS score
    FROM scores JOIN (VALUES {_GROUPS}) g(module, module_group) USING (module) GROUP BY 1, 2"""
)
def group_scores(spark, sf_dir):
    """Scores of the four display groups."""
    return scoring.group_scores(modules(spark, sf_dir))


_RANKED = f"{_SCORED}, {ranked_sql('flags')}"


@_query(f"{_RANKED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rank, spot, seq) - 1)::BIGINT AS place, module, severity, code FROM r")
def sorted_flags(spark, sf_dir):
    """All flags of a document, most severe first, then by module and rule."""
    return scoring.all_flags(modules(spark, sf_dir)).select("doc_id", F.col("place").cast("long").alias("place"), "module", "severity", "code")


@_query(f"{_ALL} SELECT module, severity, count(*) AS n_flags FROM flags GROUP BY ROLLUP (module, severity)")
def flag_volume(spark, sf_dir):
    return scoring.volume(modules(spark, sf_dir))


_THEMES = "[" + ", ".join(f"{{'code': '{c}', 'theme': '{t}'}}" for c, t in dims.THEME_OF.items()) + "]"
#: The theme with most points; of equal ones that whose first flag comes first in the order of all flags.
_LEAD = f"""{_RANKED}, names AS (SELECT unnest({_THEMES}, recursive := true)),
themed AS (SELECT r.*, coalesce(theme, 'other') AS theme, {POINTS} AS points FROM r LEFT JOIN names USING (code)),
lead_ AS (SELECT doc_id, theme, sum(points) AS p, min(rank * 10000 + spot * 100 + seq) AS first_ FROM themed WHERE theme IN {tuple(dims.VERDICT_THEMES)} GROUP BY 1, 2),
top AS (SELECT doc_id, theme FROM lead_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, first_) = 1)"""


@_query(f"{_LEAD} SELECT doc_id, top.theme FROM all_docs JOIN flags USING (doc_id) LEFT JOIN top USING (doc_id) GROUP BY ALL UNION ALL SELECT doc_id, NULL FROM all_docs WHERE doc_id NOT IN (SELECT doc_id FROM flags)")
def dominant_theme(spark, sf_dir):
    """The leading theme of every document, null where no flag has one."""
    flags = scoring.merged_flags(modules(spark, sf_dir))
    return flags.select("doc_id", summary.leading_theme(F.col("flags")).alias("theme"))


_VERDICT = "CASE " + " ".join(f"WHEN risk_level = '{r}' AND theme = '{t}' THEN '{s}'" for r, v in dims.VERDICTS.items() for t, s in v.items() if t != "default")
_VERDICT += " " + " ".join(f"WHEN risk_level = '{r}' THEN '{v['default']}'" for r, v in dims.VERDICTS.items()) + " END"


@_query(f"{_LEAD} SELECT doc_id, risk_level, {_VERDICT} AS verdict FROM final LEFT JOIN top USING (doc_id)")
def verdict(spark, sf_dir):
    """The sentence for the risk and the leading theme of every document."""
    rows = modules(spark, sf_dir)
    lead = scoring.merged_flags(rows).select("doc_id", summary.leading_theme(F.col("flags")).alias("theme"))
    return scoring.results(rows).join(lead, "doc_id").select("doc_id", "risk_level", summary.verdict(F.col("risk_level"), F.col("theme")).alias("verdict"))


@_query()
def summaries(spark, sf_dir):
    """Verdict and sentences for every document; the tests hold sentences and bullets against hand-made documents."""
    return summary.summaries(modules(spark, sf_dir)).withColumn("bullets", F.to_json("bullets"))


_POSITIVE = ", ".join("('{}', '{}')".format(m, t.replace("'", "''")) for m, t in dims.POSITIVE.items())


@_query(
    f"""{_LEAD}, clean AS (SELECT doc_id, said, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS n FROM scores JOIN (VALUES {_POSITIVE}) p(module, said) USING (module) WHERE found = 0),
    signed AS (SELECT DISTINCT doc_id FROM flags WHERE code = 'STRUCT_SIGNATURE_TRUSTED'), bad AS (SELECT DISTINCT doc_id FROM themed WHERE theme NOT IN ('signature', 'fonts')),
    told AS (SELECT doc_id, 0 AS n, '{dims.SIGNATURE_POSITIVE.replace("'", "''")}' AS said FROM signed
      UNION ALL SELECT doc_id, n, CASE WHEN n = 1 AND doc_id NOT IN (SELECT doc_id FROM signed) THEN 'On the positive side, ' || lower(said) ELSE said END FROM clean WHERE n <= 2 AND doc_id IN (SELECT doc_id FROM bad))
    SELECT doc_id, to_json(coalesce(list(said ORDER BY n) FILTER (said IS NOT NULL), [])::VARCHAR[])::VARCHAR AS signals FROM all_docs LEFT JOIN told USING (doc_id) GROUP BY 1"""
)
def positive_signals(spark, sf_dir):
    """A trusted signature, and up to two clean modules of documents with negative findings."""
    return summary.positive_signals(modules(spark, sf_dir)).withColumn("signals", F.to_json("signals"))


