"""Company and VAT numbers of documents held against snapshots of the registries.

A remote lookup becomes a left join: one short row for each number a document shows, joined to the snapshot by that
number. A number that very many documents share makes one side skewed, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.flags import FLAGS, every, flag, none, unnest, when
from probatio.functions.entities import entities
from probatio.functions.text import names_match
from probatio.operators import content


def asked(vat: bool = False) -> Column:
    """array<struct<kind, number>>: what is looked up for a document, in order, from the columns of content.identifiers.

    Numbers that fail their check are not looked up. A SIREN that begins a SIRET of the document, and a loose number
    that is a known SIREN of it, are not looked up again.
    """
    heads = F.transform("sirets", lambda x: F.substring(x["value"], 1, 9))
    known = F.concat(heads, F.transform("sirens", lambda x: x["value"]))
    ask = lambda items, kind: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("number")))
    wanted = [
        ask(F.filter("sirets", lambda x: x["is_valid"]), "siret"),
        ask(F.filter("sirens", lambda x: x["is_valid"] & ~F.array_contains(heads, x["value"])), "siren"),
        ask(F.filter("loose", lambda x: ~F.array_contains(known, x["value"])), "loose"),
    ]
    if vat:
        wanted.append(ask(F.filter("vats", lambda x: x["is_valid"]), "vat"))
    return F.concat(*wanted)


def requests(docs: DataFrame, vat: bool = False, name: str | None = None) -> DataFrame:
    """doc_id, ord, kind, number, company: what is looked up for each document (doc_id, text), in order."""
    company = F.col(name) if name else F.lit(None).cast("string")
    found = docs.select("doc_id", company.alias("company"), entities(F.col("text"), "sirets", "sirens", "potential_sirens", "vats").alias("e"))
    read = found.select("doc_id", "company", *(ids.alias(n) for n, ids in content.identifiers(F.col("e")).items()))
    rows = unnest(read, asked(vat), "r", "doc_id", "company", place="ord")
    return rows.select("doc_id", "ord", "r.kind", "r.number", "company")


def lookups(asked: DataFrame, companies: DataFrame, vat_numbers: DataFrame | None = None, *keep: str) -> DataFrame:
    """``asked`` (with columns to keep) with name, status, error, is_vat_valid and found of the registries.

    ``companies``: siren, siret, name, status, error (why the lookup failed, or null) and, if it is known, is_seat. A
    SIRET finds its own establishment, else the seat of its company; a SIREN the seat (where no establishment is marked
    as seat, that with the smallest SIRET). ``vat_numbers``: vat, is_valid, error.
    """
    told = F.struct("name", "status", "error")
    seat = F.coalesce(F.col("is_seat"), F.lit(False)) if "is_seat" in companies.columns else F.lit(False)
    exact = companies.where("siret IS NOT NULL").groupBy(F.col("siret").alias("e_number")).agg(F.min(told).alias("exact"))
    head = companies.where("siren IS NOT NULL").groupBy(F.col("siren").alias("h_number")).agg(F.min_by(told, F.struct(~seat, "siret", "name")).alias("head"))
    rows = asked.join(exact, (F.col("kind") == "siret") & (F.col("number") == F.col("e_number")), "left")
    rows = rows.join(head, (F.col("kind") != "vat") & (F.substring("number", 1, 9) == F.col("h_number")), "left")
    info = F.coalesce("exact", "head")
    if vat_numbers is None:
        rows = rows.withColumn("is_vat_valid", F.lit(None).cast("boolean")).withColumn("vat_error", F.lit(None).cast("string"))
    else:
        vats = vat_numbers.groupBy(F.col("vat").alias("v_number")).agg(F.bool_or("is_valid").alias("is_vat_valid"), F.min("error").alias("vat_error"))
        rows = rows.join(vats, (F.col("kind") == "vat") & (F.col("number") == F.col("v_number")), "left")
    failed = F.coalesce(info["error"], "vat_error")
    found = F.when(F.col("kind") == "vat", F.col("is_vat_valid")).otherwise(info.isNotNull()) & failed.isNull()
    return rows.select("doc_id", "ord", "kind", "number", "company", info["name"].alias("name"), info["status"].alias("status"), failed.alias("error"), "is_vat_valid", F.coalesce(found, F.lit(False)).alias("found"), *keep)


def _rules() -> Column:
    """The flags of one lookup."""
    kind, number, error = F.col("kind"), F.col("number"), F.col("error")
    missing = F.col("error").isNull() & ~F.col("found") & (kind != "vat")
    label = F.when(kind == "siret", "SIRET").otherwise("SIREN")
    not_found = flag("critical", F.concat(F.lit("EXTERNAL_"), label, F.lit("_NOT_FOUND")), F.concat(label, F.lit(" "), number, F.lit(" not found in official registry")), **{"number": number})
    upper = F.when(kind == "vat", "VAT").otherwise(label)
    failed = flag("low", F.concat(F.lit("EXTERNAL_"), upper, F.lit("_VERIFICATION_FAILED")), F.concat(F.lit("Could not verify "), upper, F.lit(" "), number, F.lit(": "), error), number=number, error=error)
    closed = flag("high", "EXTERNAL_COMPANY_CLOSED", F.concat(F.lit("Company with "), label, F.lit(" "), number, F.lit(" is closed/inactive")), number=number, company_name=F.col("name"), status=F.col("status"))
    other = flag("high", "EXTERNAL_COMPANY_NAME_MISMATCH", "Company name doesn't match SIRET registry", number=number, name_in_document=F.col("company"), name_in_registry=F.col("name"))
    invalid = flag("high", "EXTERNAL_VAT_INVALID", F.concat(F.lit("VAT number "), number, F.lit(" is not valid according to VIES")), vat=number)
    named = (kind == "siret") & F.col("found") & (F.col("company") != "") & (F.col("name") != "")
    found = [
        when(missing & (kind != "loose"), not_found),
        when(error.isNotNull() & (kind != "loose"), failed),
        when(F.col("found") & (F.col("status") == "closed"), closed),
        when(named & ~names_match(F.col("company"), F.col("name")), other),
        when((kind == "vat") & error.isNull() & (F.col("is_vat_valid") == F.lit(False)), invalid),
    ]
    # The number is told under its own name, as the sentences expect it.
    renamed = lambda d: F.transform_keys(d, lambda k, v: F.when(k == "number", F.lower(upper)).otherwise(k))
    return F.transform(every(*found), lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code"), f["message"].alias("message"), renamed(f["details"]).alias("details")))


def analyse(docs: DataFrame, companies: DataFrame, vat_numbers: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """doc_id, module, flags, confidence of the external module; documents (doc_id, text) without numbers included.

    Confidence: 0.1 without a lookup, else from 0.5 to 1 with the part that succeeded. ``name``: the column with the
    company's name as the document gives it. A loose number that no registry has counts as a failed lookup only.
    """
    by_doc = _by_doc(lookups(requests(docs, vat_numbers is not None, name), companies, vat_numbers)).withColumnRenamed("doc_id", "d")
    joined = docs.select("doc_id").join(by_doc, F.col("doc_id") == F.col("d"), "left")
    flags, confidence = _judge()
    return joined.select("doc_id", F.lit("external").alias("module"), flags.alias("flags"), confidence.alias("confidence"))


def _by_doc(looked: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, asked, answered, told of lookups, and what is kept; a lookup without kind stands for none."""
    item = lambda f, i: F.struct(F.col("ord").alias("ord"), i.alias("i"), f["severity"].alias("severity"), f["code"].alias("code"), f["message"].alias("message"), F.to_json(f["details"]).alias("details"))
    rows = looked.withColumn("flags", F.transform(_rules(), item))
    return rows.groupBy("doc_id").agg(F.count("kind").alias("asked"), F.count_if("found").alias("answered"), F.array_sort(F.flatten(F.collect_list("flags"))).alias("told"), *kept)


def _judge() -> tuple[Column, Column]:
    """Flags and confidence of the external module, from the columns of _by_doc, null without a lookup."""
    back = F.transform("told", lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code"), f["message"].alias("message"), F.from_json(f["details"], "map<string,string>").alias("details")))
    confidence = F.when(F.coalesce("asked", F.lit(0)) == 0, 0.1).otherwise(0.5 + F.col("answered") * 0.5 / F.col("asked"))
    return F.coalesce(back.cast(FLAGS), none()), confidence


def with_external(docs: DataFrame, companies: DataFrame, vat_numbers: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, modules, asked) as doc_id, modules, with the external module behind the others.

    The modules travel with the first lookup of a document, so what was read for them is not read again for the
    lookups. A document without one has a row that matches nothing, under a number of its own: nulls would meet in one task.
    """
    number = F.coalesce("r.number", F.hex(F.xxhash64("doc_id")))
    rows = docs.select("doc_id", "modules", F.posexplode_outer("asked").alias("ord", "r"))
    rows = rows.select("doc_id", "ord", "r.kind", number.alias("number"), F.lit(None).cast("string").alias("company"), F.when(F.coalesce("ord", F.lit(0)) == 0, F.col("modules")).alias("modules"))
    found = _by_doc(lookups(rows, companies, vat_numbers, "modules"), F.collect_list("modules").alias("modules"))
    flags, confidence = _judge()
    module = F.struct(F.lit("external").alias("module"), flags.alias("flags"), confidence.alias("confidence"))
    return found.select("doc_id", F.concat(F.flatten("modules"), F.array_repeat(module, F.size("modules"))).alias("modules"))


def reputation(files: DataFrame, scans: DataFrame, link: str = "") -> DataFrame:
    """``files`` (file_hash) with reputation: what a scanning service said of the file, or null.

    ``scans``: file_hash, http_status, body (JSON). 404 is a file the service does not know, 200 one that it knows
    (malicious if any engine finds it malicious or suspicious), anything else no answer. ``link``: what the hash is put
    behind to make a link. Of several answers for a hash a known one counts, else the smallest status.
    """
    best = scans.groupBy(F.col("file_hash").alias("h")).agg(F.min_by(F.struct("http_status", "body"), F.struct((F.col("http_status") != 200), "http_status", "body")).alias("scan"))
    stats = F.from_json(F.get_json_object("scan.body", "$.data.attributes.last_analysis_stats"), "map<string,int>")
    count = lambda kind: F.coalesce(F.try_element_at(stats, F.lit(kind)), F.lit(0))
    bad, total = count("malicious") + count("suspicious"), F.aggregate(F.map_values(stats), F.lit(0), lambda a, x: a + x)
    told = lambda status, malicious, n: F.struct(status.alias("status"), malicious.alias("malicious"), n.alias("total"), F.concat(F.lit(link), F.col("file_hash")).alias("link"))
    known = F.when(stats.isNotNull(), told(F.when(bad > 0, "malicious").otherwise("clean"), bad, total))
    status = F.col("scan.http_status")
    answer = F.when(status == 404, told(F.lit("unknown"), F.lit(0), F.lit(0))).when(status == 200, known)
    return files.join(best, F.col("file_hash") == F.col("h"), "left").withColumn("reputation", answer).drop("h", "scan")
