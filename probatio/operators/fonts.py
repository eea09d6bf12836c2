"""Rules over the fonts of a document and of the spans on its lines."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import any_of, every, flag, judged, none, when
from probatio.functions.text import strip


def base_name(name: Column) -> Column:
    """The name without the prefix of a subset."""
    return F.when(is_subset(name), F.substring(name, 8, 10_000)).otherwise(name)


def is_subset(name: Column) -> Column:
    return name.rlike(r"^[A-Z]{6}\+")


def family(base: Column) -> Column:
    return F.lower(strip(F.element_at(F.split(base, "[-,]", 2), 1)))


def span_family(name: Column) -> Column:
    """Family of a span's font: generic names are one family, aliases are resolved."""
    plain = family(base_name(name))
    alias = F.create_map(*(F.lit(x) for x in chain.from_iterable(dims.FAMILY_ALIASES.items())))
    return F.when(plain.startswith("cidfont"), F.lit("_cidfont")).otherwise(F.coalesce(F.try_element_at(alias, plain), plain))


def gather_fonts(uses: DataFrame) -> DataFrame:
    """(doc_id, page, name, embedded) rows to one array of fonts per document; a font's pages and uses are summed."""
    fonts = uses.groupBy("doc_id", "name").agg(F.array_sort(F.collect_set("page")).alias("pages_used"), F.count(F.lit(1)).alias("usage_count"), F.bool_or("embedded").alias("embedded"))
    name = F.col("name")
    font = F.struct(name, base_name(name).alias("base_name"), is_subset(name).alias("is_subset"), (F.col("embedded") | is_subset(name)).alias("is_embedded"), "pages_used", "usage_count")
    return fonts.groupBy("doc_id").agg(F.array_sort(F.collect_list(font)).alias("fonts"))


def diversity(fonts: Column) -> Column:
    families = F.array_sort(F.array_distinct(F.transform(fonts, lambda f: family(f["base_name"]))))
    n = F.size(families)
    facts = {"font_count": n, "fonts": F.array_join(families, ",")}
    most = flag("high", "FONTS_EXCESSIVE_DIVERSITY", F.concat(F.lit("Document uses "), n, F.lit(" different font families (suspicious for an invoice)")), **facts)
    many = flag("medium", "FONTS_HIGH_DIVERSITY", F.concat(F.lit("Document uses "), n, F.lit(" different font families")), **facts)
    return F.when(n > dims.VERY_MANY_FAMILIES, F.array(most)).when(n > dims.MANY_FAMILIES, F.array(many)).otherwise(none())


def _one(fonts: Column, chosen, code: str, message: str, key: str) -> Column:
    names = F.array_sort(F.array_distinct(F.transform(F.filter(fonts, chosen), lambda f: f["base_name"])))
    listed = F.array_join(names, ", ")
    return when(F.size(names) > 0, flag("low", code, F.concat(F.lit(message), listed), **{key: listed}))


def system_fonts(fonts: Column) -> Column:
    chosen = lambda f: any_of(F.lower(f["base_name"]), dims.SYSTEM_FONTS) & ~any_of(F.lower(f["base_name"]), dims.PROFESSIONAL_FONTS)
    return _one(fonts, chosen, "FONTS_SYSTEM_FONTS", "Document uses common system fonts: ", "system_fonts")


def embedding(fonts: Column) -> Column:
    chosen = lambda f: ~f["is_embedded"] & ~any_of(F.lower(f["base_name"]), dims.STANDARD_FONTS)
    return _one(fonts, chosen, "FONTS_NOT_EMBEDDED", "Some fonts are not embedded: ", "non_embedded_fonts")


def mixed_subsets(fonts: Column) -> Column:
    """Each font (names compared without case) that is there both whole and as a subset."""
    names = F.array_distinct(F.transform(fonts, lambda f: F.lower(f["base_name"])))
    has = lambda name, subset: F.exists(fonts, lambda f: (F.lower(f["base_name"]) == name) & (f["is_subset"] == subset))
    mixed = F.filter(names, lambda n: has(n, F.lit(True)) & has(n, F.lit(False)))
    return F.transform(mixed, lambda n: flag("low", "FONTS_MIXED_SUBSETS", F.concat(F.lit("Font '"), n, F.lit("' appears both as subset and non-subset (possible editing)")), font_name=n))


def changed_lines(lines: Column) -> Column:
    """Lines (page, spans array<struct<text, font>>) that change their family between spans that show something."""

    def described(line):
        shown = F.filter(line["spans"], lambda s: strip(s["text"]) != "")
        families = F.array_remove(F.array_distinct(F.transform(shown, lambda s: span_family(s["font"]))), F.lit("_cidfont"))
        text = F.array_join(F.transform(shown, lambda s: strip(s["text"])), " ")
        fonts = F.array_sort(F.array_distinct(F.transform(shown, lambda s: s["font"])))
        return F.struct(line["page"].alias("page"), text.alias("text"), fonts.alias("fonts"), (F.size(families) > 1).alias("changed"))

    return F.filter(F.transform(lines, described), lambda x: x["changed"])


def midline(lines: Column) -> Column:
    """One flag for a document with lines that change family: high from three such lines on."""
    changed = changed_lines(lines)
    first, n = F.try_element_at(changed, F.lit(1)), F.size(changed)
    message = F.concat(F.lit("Font changes mid-line on page "), first["page"], F.lit(": '"), F.left(first["text"], F.lit(60)), F.lit("' uses "), F.size(first["fonts"]), F.lit(" different fonts"))
    shown = F.to_json(F.slice(changed, F.lit(1), F.lit(5)))
    return when(n > 0, flag(F.when(n >= 3, "high").otherwise("medium"), "FONTS_MIDLINE_CHANGE", message, total_suspicious_lines=n, suspicious_lines=shown))


def judge() -> tuple[Column, Column]:
    """Flags and confidence of the fonts module, from the columns that analyse names."""
    empty = F.size(F.coalesce(F.col("fonts"), F.array())) <= 0
    rules = every(*(F.coalesce(rule, none()) for rule in (diversity(F.col("fonts")), system_fonts(F.col("fonts")), embedding(F.col("fonts")), mixed_subsets(F.col("fonts")), midline(F.col("lines")))))
    confidence = F.when(empty, 0.3).when(F.size("fonts") >= 3, 0.9).otherwise(0.7)
    return F.when(empty, none()).otherwise(rules), confidence


def analyse(docs: DataFrame) -> DataFrame:
    """doc_id, module, flags, confidence of the fonts module. ``docs``: doc_id, fonts, lines (arrays, null as empty)."""
    return judged(docs, "fonts", judge())
