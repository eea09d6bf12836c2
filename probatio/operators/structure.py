"""Rules over the bytes and the objects of a PDF file.

``body`` is the file decoded as ISO-8859-1, one character a byte, so offsets in it are offsets in the file. Names of
objects are looked for in that text; objects inside compressed streams are seen only where the reader has unpacked them.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import any_of, every, flag, judged, none, when
from probatio.functions.text import find_all, let
from probatio.operators import metadata

EOF = r"%%EOF[\r\n]*"
#: What a report on a signature holds.
SIGNATURE = "struct<signer:string,level:string,is_trusted:boolean,is_fully_valid:boolean,is_valid:boolean,unverifiable:boolean>"


def decoded(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def version_ends(body: Column) -> Column:
    """Offsets after each end marker and the line ends that follow it: where the versions of the file end."""
    return F.transform(find_all(body, EOF), lambda m: m["start"] + F.length(m["match"]))


def has_signature(body: Column) -> Column:
    named = any_of(body, ("/Sig", "/SubFilter"))  # a plain search, which most files end with
    return named & body.rlike(r"/Type\s*/Sig\b|/SubFilter\s*/adbe\.pkcs7|/SubFilter\s*/ETSI")


def is_trusted(signed: Column, signature: Column) -> Column:
    return signed & F.coalesce(signature["is_trusted"], F.lit(False))


def with_marks(docs: DataFrame) -> DataFrame:
    """``docs`` (body, or marks as files.marks gives them) with eof_count, has_signature and free_objects.

    The bytes are searched once for each of them. The rules name each several times; written out in them, every mention
    searched the whole file again.
    """
    if "marks" in docs.columns:
        return docs.withColumns({name: F.col("marks")[name] for name in ("eof_count", "has_signature", "free_objects")})
    body = F.coalesce(F.col("body"), F.lit(""))
    return docs.withColumns({"eof_count": F.regexp_count(body, F.lit("%%EOF")), "has_signature": has_signature(body), "free_objects": F.regexp_count(body, F.lit(dims.FREE_OBJECT))})


def signature_report(status: Column, body: Column) -> Column:
    """What a validation service answered, as SIGNATURE; null where it did not answer.

    ``status``: of the HTTP answer; ``body``: its JSON. Another status than 200 is an invalid signature. A qualified
    certificate (QC or QES in the level) makes a signature trusted and valid, even where its validity is indeterminate.
    """
    get = lambda path: F.get_json_object(body, f"$.SimpleReport.{path}")
    first = "signatureOrTimestampOrEvidenceRecord[0]"
    level = F.coalesce(get(f"{first}.Signature.SignatureLevel.value"), get(f"{first}.Signature.SignatureLevel"), F.lit(""))
    level = F.when(level.startswith("{"), "").otherwise(level)
    qualified, counted = level.rlike("QC|QES"), F.coalesce(get("ValidSignaturesCount").try_cast("int"), F.lit(0)) > 0
    yes, no = F.lit(True), F.lit(False)

    def told(signer, level_, trusted, fully, valid, unverifiable):
        names = ("signer", "level", "is_trusted", "is_fully_valid", "is_valid", "unverifiable")
        return F.struct(*(v.alias(n) for n, v in zip(names, (signer, level_, trusted, fully, valid, unverifiable)))).cast(SIGNATURE)

    nothing = F.lit(None).cast("string")
    empty = told(nothing, nothing, no, no, no, yes)
    found = told(F.coalesce(get(f"{first}.Signature.SignedBy"), F.lit("")), level, qualified, counted, counted | qualified, no)
    return F.when(status.isNull(), None).when(status != 200, told(nothing, nothing, no, no, no, no)).when(get(first).isNull(), empty).otherwise(found)


def with_reports(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """``docs`` (file_hash, body) with the column signature, from a table of answers: file_hash, http_status, body.

    Files without a signature have no report. Of several answers of a hash that with the smallest status counts.
    """
    answers = reports.groupBy(F.col("file_hash").alias("h")).agg(F.min_by(F.struct("http_status", "body"), F.struct("http_status", "body")).alias("answer"))
    joined = docs.join(answers, F.col("file_hash") == F.col("h"), "left")
    report = signature_report(F.col("answer.http_status"), F.col("answer.body"))
    signed = F.col("marks.has_signature") if "marks" in docs.columns else has_signature(F.col("body"))
    return joined.withColumn("signature", F.when(signed, report)).drop("h", "answer")


def incremental_updates(saves: Column, signed: Column, signature: Column) -> Column:
    """What is known of a signature, and the saves after the first; a trusted signature excuses one of them.

    Nothing is told of files that were saved once. ``signature`` is null where no report exists.
    """
    trusted, edits = is_trusted(signed, signature), saves - 1
    left = edits - F.when(trusted, 1).otherwise(0)
    signer = F.coalesce(signature["signer"], F.lit("Unknown"))
    yes = lambda name: F.coalesce(signature[name], F.lit(False))
    told = lambda severity, kind, message: F.array(flag(severity, f"STRUCT_SIGNATURE_{kind}", message, signer=signer))
    report = (
        F.when(yes("is_trusted") & yes("is_fully_valid"), told("low", "TRUSTED", F.concat(F.lit("Document has EU trusted signature: "), signer, F.lit(" ("), F.coalesce(signature["level"], F.lit("")), F.lit(")"))))
        .when(yes("is_trusted"), told("low", "TRUSTED_EXPIRED", F.concat(F.lit("Document has EU trusted signature (certificate may be expired): "), signer)))
        .when(yes("is_valid"), told("medium", "NOT_TRUSTED", F.concat(F.lit("Document has signature but NOT from EU trusted list: "), signer)))
        .when(yes("unverifiable"), told("medium", "UNVERIFIABLE", F.lit("Document has signature but format not recognized by EU DSS")))
        .otherwise(told("high", "INVALID", F.lit("Document has INVALID digital signature")))
    )
    severity = F.when(left >= 3, "critical").when(left == 2, "high").otherwise("medium")
    edited = F.when(left >= 3, F.concat(F.lit("PDF has been edited "), left, F.lit(" times (very suspicious)"))).when(left == 2, F.lit("PDF has been edited 2 times")).otherwise(F.concat(F.lit("PDF has "), left, F.lit(" incremental update(s)")))
    edited = F.concat(edited, F.when(signed & ~trusted, " (signature present but NOT trusted)").otherwise(""))
    update = flag(severity, "STRUCT_INCREMENTAL_UPDATES", edited, eof_count=saves, edit_count=edits, has_signature=signed, signature_trusted=trusted, effective_edits=left)
    rules = every(F.when(signed & signature.isNotNull(), report).otherwise(none()), when(left > 0, update))
    return F.when(saves > 1, rules).otherwise(none())


def javascript(body: Column, annotations: Column | None = None) -> Column:
    """Scripts in objects, or named in what an annotation (page, type, opacity, info) says."""
    found = any_of(body, ("/JavaScript", "/JS"))
    if annotations is not None:
        found = found | F.coalesce(F.exists(annotations, lambda a: F.contains(F.lower(a["info"]), F.lit("javascript"))), F.lit(False))
    return when(found, flag("critical", "STRUCT_JAVASCRIPT_DETECTED", "PDF contains JavaScript code (very suspicious for documents)"))


def annotation_rules(annotations: Column) -> Column:
    """Invisible annotations, and kinds that carry files or media; one flag each."""
    hidden = F.size(F.filter(annotations, lambda a: a["opacity"] == 0))
    risky = F.filter(annotations, lambda a: a["type"].isin(*dims.RISKY_ANNOTATIONS))
    kinds = F.array_join(F.transform(risky, lambda a: a["type"]), ",")
    return every(
        when(hidden > 0, flag("high", "STRUCT_HIDDEN_ANNOTATIONS", F.concat(F.lit("PDF contains "), hidden, F.lit(" hidden annotation(s)")), count=hidden)),
        when(F.size(risky) > 0, flag("high", "STRUCT_SUSPICIOUS_ANNOTATIONS", "PDF contains suspicious annotation types", types=kinds)),
    )


def embedded_files(files: Column) -> Column:
    """Attached files (name, size); critical if one can be executed."""
    n = F.size(files)
    runs = F.exists(files, lambda f: F.lower(f["name"]).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in dims.DANGEROUS_EXTENSIONS) + r")\z"))
    message = F.when(runs, "PDF contains embedded executable files (malware risk!)").otherwise(F.concat(F.lit("PDF contains "), n, F.lit(" embedded file(s)")))
    return when(n > 0, flag(F.when(runs, "critical").otherwise("high"), "STRUCT_EMBEDDED_FILES", message, file_count=n, files=F.to_json(files)))


def acroform(widgets: Column) -> Column:
    """Form fields (page, type, name) other than signatures; the first ten are listed."""
    fields = F.filter(widgets, lambda w: w["type"] != "Signature")
    n = F.size(fields)
    message = F.concat(F.lit("PDF contains "), n, F.lit(" interactive form field(s)"))
    return when(n > 0, flag("medium", "STRUCT_ACROFORM_DETECTED", message, fields=F.to_json(F.slice(fields, F.lit(1), F.lit(10))), total_count=n))


def deleted_objects(n: Column, trusted: Column) -> Column:
    most = F.when(trusted, dims.FREE_OBJECTS_SIGNED).otherwise(dims.FREE_OBJECTS_PLAIN)
    return when(n > most, flag("medium", "STRUCT_DELETED_OBJECTS", F.concat(F.lit("PDF contains "), n, F.lit(" deleted objects (ghost data)")), free_objects=n, threshold=most))


def xmp_toolkit(body: Column) -> Column:
    """The toolkit that the XMP block names, or null."""
    found = F.regexp_extract(body, r'x:xmptk="([^"]+)"', 1)
    return F.when(found != "", found)


def toolkit_editor(toolkit: Column) -> Column:
    """The editor a toolkit belongs to, or null."""
    low = F.lower(toolkit)
    return F.coalesce(*(F.when(F.contains(low, F.lit(mark)), F.lit(editor)) for mark, editor in dims.XMP_TOOLKITS))


def xmp_mismatch(body: Column, producer: Column, creator: Column) -> Column:
    """The toolkit's editor is named by neither producer nor creator; less grave after a scanner."""
    text = lambda c: F.coalesce(c, F.lit(""))
    named = F.concat(F.lower(text(producer)), F.lit(" "), F.lower(text(creator)))
    first = F.coalesce(F.when(text(producer) != "", producer), F.when(text(creator) != "", creator), F.lit("unknown"))
    scanned = any_of(named, dims.SCANNERS)

    def told(toolkit):
        editor = toolkit_editor(toolkit)
        message = F.when(scanned, F.concat(F.lit("Scanned document ("), first, F.lit(") later opened in "), editor)).otherwise(F.concat(F.lit("Document created by "), first, F.lit(" but later modified with "), editor))
        found = flag(F.when(scanned, "medium").otherwise("high"), "STRUCT_XMP_EDITOR_MISMATCH", message, xmp_toolkit=toolkit, detected_editor=editor, is_scanned=scanned)
        return when(editor.isNotNull() & ~F.contains(named, F.substring_index(F.lower(editor), " ", 1)), found)

    return let(xmp_toolkit(body), told)


def object_kind(text: Column, page: Column) -> Column:
    """What a changed object is, by the first of the marks in its text; ``page`` is where its stream is shown, or null."""
    has = lambda mark: F.contains(text, F.lit(mark))
    return (
        F.when(page.isNotNull() & (has("/Length") | (text == "")), "content_stream")
        .when(has("/Font"), "font")
        .when(has("/Image") | has("/XObject"), "image")
        .when(has("/Type /Page"), "page_definition")
        .when(has("/Catalog"), "catalog")
        .when(has("/Info"), "metadata")
        .otherwise("unknown")
    )


def tool(body: Column, producer: Column, creator: Column) -> Column:
    """What made the file, and the editor that its toolkit gives away where the producer does not name it."""
    filled = lambda c: F.when(c != "", c)
    base, low = F.coalesce(filled(producer), filled(creator), F.lit("Unknown")), F.lower(xmp_toolkit(body))
    editor = F.coalesce(*(F.when(F.contains(low, F.lit(mark)), F.lit(name)) for mark, name in dims.TOOLKIT_EDITORS))
    named = F.contains(F.lower(F.coalesce(producer, F.lit(""))), F.substring_index(F.lower(editor), " ", 1))
    return F.when(editor.isNotNull() & ~named, F.concat(base, F.lit(" → modified with "), editor)).otherwise(base)


def line_diff(versions: DataFrame) -> DataFrame:
    """doc_id, from_version, to_version, page, removed, added for each page that changed between neighbouring versions.

    ``versions``: doc_id, version, page, text. Lines are compared by matching blocks (difflib), so a moved line is
    both removed and added. A page that one version lacks counts as empty. A document's pages are compared where they
    are: one group is one document and page.
    """
    schema = "doc_id long, from_version long, to_version long, page long, removed array<string>, added array<string>"
    numbers = versions.groupBy("doc_id").agg(F.array_sort(F.collect_set("version")).alias("all"))
    pages = versions.groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_set(F.struct("version", "text"))).alias("texts"))
    rows = pages.join(numbers, "doc_id")
    step = F.struct(F.col("all")[F.col("i")].alias("a"), F.col("all")[F.col("i") + 1].alias("b"))
    pairs = rows.where(F.size("all") > 1).select("doc_id", "page", "texts", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 2)).alias("i")).select("doc_id", "page", "texts", step.alias("s"))
    text = lambda v: F.coalesce(F.try_element_at("texts", F.col(f"s.{v}")), F.lit(""))
    wanted = pairs.select("doc_id", F.col("s.a").alias("from_version"), F.col("s.b").alias("to_version"), "page", text("a").alias("old"), text("b").alias("new")).where("old <> new")

    def compare(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                old, new = ([line for line in t.split("\n") if line.strip()] for t in (row.old, row.new))
                removed, added = [], []
                for tag, i, j, k, m in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                    if tag != "equal":
                        removed += old[i:j]
                        added += new[k:m]
                if removed or added:
                    out.append((row.doc_id, row.from_version, row.to_version, row.page, removed, added))
            yield pd.DataFrame(out, columns=["doc_id", "from_version", "to_version", "page", "removed", "added"])

    return wanted.mapInPandas(compare, schema)


def judge(docs: DataFrame, as_of: Column) -> tuple[Column, Column]:
    """Flags and confidence of the structure module, from the columns that analyse names and those of with_marks."""
    objects, xmp = (F.coalesce(F.col(c if c in docs.columns else "body"), F.lit("")) for c in ("objects", "xmp"))
    signed, signature = F.col("has_signature"), F.col("signature").cast(SIGNATURE)
    rules = [
        incremental_updates(F.col("eof_count"), signed, signature),
        javascript(objects, F.col("annotations")),
        annotation_rules(F.col("annotations")),
        embedded_files(F.col("files")),
        acroform(F.col("widgets")),
        deleted_objects(F.col("free_objects"), is_trusted(signed, signature)),
        metadata.date_rules(F.col("created"), F.col("modified"), as_of),
        xmp_mismatch(xmp, F.col("producer"), F.col("creator")),
    ]
    return every(*(F.coalesce(r, none()) for r in rules)), F.lit(0.95)


def analyse(docs: DataFrame, as_of: Column) -> DataFrame:
    """doc_id, module, flags, confidence of the structure module.

    ``docs``: doc_id, body, producer, creator, created, modified, signature, annotations, files, widgets; the last
    four may be null. Where a reader gives the text of the objects (objects) and the metadata stream (xmp), scripts and
    the toolkit are looked for there and not among the bytes of streams.
    """
    docs = with_marks(docs)
    return judged(docs, "structure", judge(docs, as_of))
