"""Rules over what is seen on a page: watermarks in the text and the targets of QR codes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import any_of, every, flag, judged, none, when
from probatio.functions.text import CASELESS, domain


def sender_domains(text: Column) -> Column:
    """Hosts of e-mail addresses and, social networks aside, of links; sorted."""
    mail = F.transform(F.regexp_extract_all(text, F.lit(CASELESS + dims.EMAIL_DOMAIN), F.lit(1)), lambda d: F.regexp_replace(F.lower(d), r"^www\.", ""))
    web = F.transform(F.regexp_extract_all(text, F.lit(CASELESS + dims.URL_DOMAIN), F.lit(1)), F.lower)
    return F.array_sort(F.array_union(mail, F.filter(web, lambda d: ~any_of(d, dims.NOT_SENDERS))))


def watermarks(text: Column) -> Column:
    """One flag for each kind of watermark word in the text."""
    upper = F.upper(text)
    found = []
    for words, kind, severity in dims.WATERMARKS:
        shown = flag(severity, f"VISUAL_WATERMARK_{kind.replace(' ', '_')}", f"Document contains '{kind}' watermark", watermark_type=kind)
        found.append(when(upper.rlike(rf"{CASELESS}\b(?:{words})\b"), shown))
    return every(*found)


def converter_marks(text: Column) -> Column:
    """Marks that free tools leave; the first match of each kind."""
    lower = F.lower(text)
    found = []
    for pattern, kind, severity in dims.CONVERTER_MARKS:
        shown = F.regexp_extract(lower, CASELESS + pattern, 0)
        head = {"online_converter": "Visible online converter watermark: '", "trial_version": "Document created with trial software: '"}.get(kind, "Converter watermark detected: '")
        found.append(when(shown != "", flag(severity, "VISUAL_CONVERTER_WATERMARK", F.concat(F.lit(head), shown, F.lit("'")), matched_text=shown, watermark_type=kind)))
    return every(*found)


def qr_rules(codes: Column, expected: Column) -> Column:
    """For each code (data, page) that is a link: a shortener (and nothing more), else a suspicious ending and a host
    that is none of the expected ones."""

    def told(qr):
        host = domain(qr["data"])
        tld = F.coalesce(*(F.when(host.endswith(x), F.lit(x)) for x in dims.SUSPICIOUS_TLDS))
        known = F.exists(expected, lambda e: (host == e) | host.endswith(F.concat(F.lit("."), e)))
        facts = {"qr_data": qr["data"], "page": qr["page"]}
        short = F.array(flag("high", "VISUAL_QR_URL_SHORTENER", F.concat(F.lit("QR code uses URL shortener: "), host), domain=host, **facts))
        odd = flag("medium", "VISUAL_QR_SUSPICIOUS_TLD", F.concat(F.lit("QR code points to suspicious domain: "), host), domain=host, suspicious_tld=tld, **facts)
        other = flag("critical", "VISUAL_QR_DOMAIN_MISMATCH", F.concat(F.lit("QR code domain ("), host, F.lit(") doesn't match expected domains")), qr_domain=host, **facts)
        rest = every(when(tld.isNotNull(), odd), when((F.size(expected) > 0) & ~known, other))
        link = qr["data"].startswith("http://") | qr["data"].startswith("https://")
        return F.when(~F.coalesce(link, F.lit(False)) | host.isNull(), none()).when(any_of(host, dims.URL_SHORTENERS), short).otherwise(rest)

    return F.flatten(F.transform(codes, told))


def judge(check_qr: bool = True, expected: Column | None = None) -> tuple[Column, Column]:
    """Flags and confidence of the visual module, from the columns that analyse names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rules = [watermarks(text), converter_marks(text)]
    if check_qr:
        rules.append(F.coalesce(qr_rules(F.col("qr_codes"), expected if expected is not None else sender_domains(text)), none()))
    return every(*rules), F.lit(0.9 if check_qr else 0.7)


def analyse(docs: DataFrame, check_qr: bool = True, expected: Column | None = None) -> DataFrame:
    """doc_id, module, flags, confidence of the visual module. ``docs``: doc_id, text, qr_codes array<struct<data, page>>.

    Hosts expected of QR codes are those that the text names, unless given.
    """
    return judged(docs, "visual", judge(check_qr, expected))


def amount_regions(blocks: Column, zoom: float = 2.0) -> Column:
    """Boxes (x0, y0, x1, y1 in pixels) of text blocks (spans, bbox) that hold an amount."""
    shown = F.filter(blocks, lambda b: F.concat(F.array_join(b["spans"], " "), F.lit(" ")).rlike("(?U)" + dims.AMOUNT_BLOCK))
    return F.transform(shown, lambda b: F.transform(b["bbox"], lambda x: (x * zoom).cast("int")))


