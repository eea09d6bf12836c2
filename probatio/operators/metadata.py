"""Rules over a document's metadata: the software that made it, missing fields, and its dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import any_of, every, first_word, flag, judged, none, when
from probatio.functions.text import duration


def combined(producer: Column, creator: Column) -> Column:
    return F.concat(F.lower(F.coalesce(producer, F.lit(""))), F.lit(" "), F.lower(F.coalesce(creator, F.lit(""))))


def producer_rules(producer: Column, creator: Column) -> Column:
    """Image editor, or AI tool, online converter, unusual producer (the first that applies); image conversion goes
    with any but the first."""
    both = combined(producer, creator)
    tool = lambda words: first_word(both, words)
    facts = {"producer": producer, "creator": creator}
    editor, ai, online, unusual = map(tool, (dims.IMAGE_EDITORS, dims.AI_PRODUCERS, dims.ONLINE_CONVERTERS, dims.UNUSUAL_PRODUCERS))
    scanned = flag("low", "META_IMAGE_CONVERSION", "Document was created by converting an image to PDF (possible scan)", **facts)
    told = lambda severity, code, message, name: F.array(flag(severity, code, F.concat(F.lit(message), name), detected_tool=name, **facts))
    maker = (
        F.when(ai.isNotNull(), told("critical", "META_AI_GENERATED", "Document appears to be generated by AI tool: ", ai))
        .when(online.isNotNull(), told("high", "META_ONLINE_CONVERTER", "Document was processed by online converter: ", online))
        .when(unusual.isNotNull(), told("medium", "META_SUSPICIOUS_PRODUCER", "Document created with unusual software for invoices: ", unusual))
        .otherwise(none())
    )
    edited = told("high", "META_IMAGE_EDITOR", "Document was produced by image editor: ", editor)
    return F.when(editor.isNotNull(), edited).otherwise(every(when(any_of(both, dims.IMAGE_CONVERSION), scanned), maker))


def missing_rules(raw: Column) -> Column:
    """No metadata at all, or neither producer nor creator. ``raw``: map of the fields as read."""
    value = lambda k: F.coalesce(F.try_element_at(raw, F.lit(k)), F.lit(""))
    filled = F.size(F.map_filter(raw, lambda k, v: F.coalesce(v, F.lit("")) != ""))
    bare = F.coalesce(filled, F.lit(0)) <= 0
    return F.when(bare, F.array(flag("medium", "META_NO_METADATA", "Document has no metadata (possibly stripped)"))).otherwise(
        when((value("producer") == "") & (value("creator") == ""), flag("low", "META_NO_PRODUCER", "Document has no producer or creator information"))
    )


def date_rules(created: Column, modified: Column, as_of: Column) -> Column:
    """Created in the future, modified later than two seconds after creation, modified before. Part of structure."""
    iso = lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    apart = F.timestamp_diff("SECOND", created, modified).cast("long")
    future = flag("critical", "META_FUTURE_CREATION_DATE", "Document creation date is in the future", creation_date=iso(created), current_date=iso(as_of))
    changed = flag(
        "critical", "META_DOCUMENT_MODIFIED", F.concat(F.lit("Document was modified "), duration(apart)),
        creation_date=iso(created), modification_date=iso(modified), time_difference_hours=F.bround(apart / 3600, 2),
    )
    earlier = flag("high", "META_IMPOSSIBLE_DATES", "Modification date is before creation date (impossible)", creation_date=iso(created), mod_date=iso(modified))
    return every(when(created > as_of + F.expr("INTERVAL 1 DAY"), future), when(apart > 2, changed), when(modified < created, earlier))


def judge() -> tuple[Column, Column]:
    """Flags and confidence of the metadata module, from the columns that analyse names."""
    m = F.col("metadata")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    made, dated = has(m["producer"]) | has(m["creator"]), m["creation_date"].isNotNull()
    flags = every(producer_rules(m["producer"], m["creator"]), missing_rules(F.col("raw_metadata")))
    return flags, F.when(made & dated, 1.0).when(made | dated, 0.7).otherwise(0.3)


def analyse(docs: DataFrame) -> DataFrame:
    """doc_id, module, flags, confidence of the metadata module.

    ``docs``: doc_id, metadata struct (producer, creator, creation_date, ...), raw_metadata map.
    """
    return judged(docs, "metadata", judge())
