"""Normalisers of identifiers as column expressions.  A null is treated as an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of amount suffixes.
AMOUNT_SUFFIXES = {
    "k": 1e3, "lac": 1e5, "lakh": 1e5, "lacs": 1e5, "lakhs": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7,
    "m": 1e6, "million": 1e6,
}
#: Month names of three letters or more, "sept" included.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
#: Honorifics that are written with a dot.
HONORIFICS = ("mr", "mrs", "ms", "dr", "sri", "sh", "smt")


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def phone(c: Column) -> Column:
    t, d = _text(c), digits(_text(c))
    n = F.length(d)
    return (
        F.when((t == "") | (d == ""), t)
        .when((n == 12) & d.startswith("91"), F.substring(d, 3, 10))
        .when((n == 11) & d.startswith("0"), F.substring(d, 2, 10))
        .when(n == 10, d)
        .when(t.startswith("+") & (n > 10), F.concat(F.lit("+"), d))
        .otherwise(d)
    )


def email(c: Column) -> Column:
    t = F.lower(_text(c))
    bare = F.when(t.startswith("<") & t.endswith(">"), F.regexp_replace(t, "^<|>$", "")).otherwise(t)
    return F.trim(F.regexp_replace(bare, "[.,;:!?]+$", ""))


def upi(c: Column) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[;,:.]+$", "")


def compact_upper(c: Column) -> Column:
    """Upper-cased without white space: IFSC, PAN and passport numbers."""
    return F.regexp_replace(F.upper(_text(c)), "\\s+", "")


def dashless_upper(c: Column) -> Column:
    """Upper-cased without white space and hyphens: GSTINs and vehicle plates."""
    return F.regexp_replace(F.upper(_text(c)), "[\\s-]+", "")


def ip(c: Column) -> Column:
    t = _text(c)
    parts = F.transform(F.split(t, "\\."), lambda x: x.cast("int"))
    ok = t.rlike("^[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(ok, F.array_join(F.transform(parts, lambda x: x.cast("string")), ".")).otherwise(t)


def url(c: Column) -> Column:
    """scheme://host in lower case; http where no scheme is given."""
    t = _text(c)
    full = F.when(t.rlike("^[A-Za-z]+://"), t).otherwise(F.concat(F.lit("http://"), t))
    scheme = F.lower(F.regexp_extract(full, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(full, "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(t == "", t).when(host == "", F.lower(full)).otherwise(F.concat(scheme, F.lit("://"), host))


def domain(c: Column) -> Column:
    t = F.regexp_replace(F.lower(_text(c)), "/+$", "")
    return F.regexp_replace(t, "^www\\.", "")


def account(c: Column) -> Column:
    t = dashless_upper(c)
    return F.when(t.rlike("^X+[0-9]+"), t).otherwise(digits(t))


def imei(c: Column) -> Column:
    return F.substring(digits(c), 1, 15)


def mac(c: Column) -> Column:
    h = F.regexp_replace(F.upper(_text(c)), "[^0-9A-F]", "")
    return F.when(F.length(h) == 12, F.regexp_replace(h, "(..)(?=.)", "$1:")).otherwise(F.upper(_text(c)))


def wallet(c: Column) -> Column:
    t = _text(c)
    return F.when(t.rlike("^0x[0-9a-fA-F]{40}$") | t.rlike("(?i)^bc1[ac-hj-np-z02-9]{6,87}$"), F.lower(t)).otherwise(t)


def amount(c: Column) -> Column:
    """A number with currency marks and an optional suffix; null where there is none."""
    t = F.lower(_text(c))
    bare = F.trim(F.regexp_replace(t, "₹|rs\\.?|inr|/-|=", ""))
    ok = bare.rlike("^[0-9.,]+\\s*([a-z]+)?$")
    number = F.regexp_extract(F.regexp_replace(F.regexp_extract(bare, "^([0-9.,]+)", 1), ",", ""), "^([0-9]*\\.?[0-9]+|[0-9]+)", 1)
    suffix = F.regexp_extract(bare, "([a-z]+)$", 1)
    factor = F.lit(1.0)
    for name, value in AMOUNT_SUFFIXES.items():
        factor = F.when(suffix == name, value).otherwise(factor)
    return F.when(ok & (number != ""), number.cast("double") * factor)


def person(c: Column) -> Column:
    t = organization(c)

    def word(w: Column) -> Column:
        cap = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        return F.when(F.lower(w).isin(*HONORIFICS), F.concat(cap, F.lit("."))).otherwise(cap)

    return F.array_join(F.transform(F.split(t, " "), word), " ")


def organization(c: Column) -> Column:
    return F.regexp_replace(_text(c), "\\s+", " ")


def aadhaar(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 12, d).otherwise("")


def is_row_glue(c: Column) -> Column:
    """A table row that was wrapped into one value."""
    t = _text(c)
    return t.rlike(",.*,") & (t.rlike("^[A-Za-z][A-Za-z0-9_-]*[0-9][-_,]") | t.rlike(",[A-Z][A-Z_]{3,23},"))


def entity(kind: Column, c: Column) -> Column:
    """The normaliser of an entity type."""
    by = {
        "phone": phone, "email": email, "upi": upi, "ifsc": compact_upper, "ip": ip, "url": url, "domain": domain,
        "account": account, "imei": imei, "mac": mac, "wallet": wallet, "vehicle": dashless_upper, "person": person,
        "organization": organization,
    }
    out = _text(c)
    for name, f in by.items():
        out = F.when(kind == name, f(c)).otherwise(out)
    return out


def date_iso(c: Column) -> Column:
    """ISO date of ISO, day-first, "Jan 5, 2024" and "5 January 2024" dates; null for others."""
    t = _text(c)
    iso, dmy = "^([0-9]{4})-([0-9]{2})-([0-9]{2})(T([0-9]{2}:[0-9]{2}(:[0-9]{2})?))?", "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
    g = lambda p, i: F.regexp_extract(t, p, i)
    core = F.concat_ws("-", g(iso, 1), g(iso, 2), g(iso, 3))
    day, month, year = (g(dmy, i).cast("int") for i in (1, 2, 3))
    full = F.when(year < 100, year + 2000).otherwise(year)
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    fine = month.between(1, 12) & day.between(1, 31) & full.between(1950, 2100)
    named, dayfirst = "^([A-Za-z]{3,9})\\s+([0-9]{1,2}),?\\s+([0-9]{4})$", "^([0-9]{1,2})\\s+([A-Za-z]{3,9})\\s+([0-9]{4})$"

    def by_name(name: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, m in enumerate(MONTHS, 1):
            known = [m, m[:3]] + (["sept"] if m == "september" else [])
            out = F.when(F.lower(name).isin(*known), i).otherwise(out)
        return out

    m1, m2 = by_name(g(named, 1)), by_name(g(dayfirst, 2))
    return (
        F.when(t.rlike(iso), F.when(g(iso, 5) != "", F.concat(core, F.lit("T"), g(iso, 5), F.lit("Z"))).otherwise(core))
        .when(t.rlike(dmy), F.when(fine, F.concat_ws("-", full.cast("string"), pad(month), pad(day))))
        .when(t.rlike(named), F.when(m1.isNotNull(), F.concat_ws("-", g(named, 3), pad(m1), pad(g(named, 2)))))
        .when(t.rlike(dayfirst), F.when(m2.isNotNull(), F.concat_ws("-", g(dayfirst, 3), pad(m2), pad(g(dayfirst, 1)))))
    )


#: Fixed value: labels that are stripped off a value.
LABELS = (
    "aadhaa?r(?:\\s*(?:no|number|card))?|pan(?:\\s*(?:no|number|card))?|passport(?:\\s*(?:no|number))?|ifsc(?:\\s*code)?|"
    "gstin(?:\\s*no)?|utr(?:\\s*(?:no|number))?|account(?:\\s*(?:no|number))?|acct(?:\\s*no)?|ref(?:erence)?(?:\\s*(?:no|number))?|"
    "reg(?:istration)?(?:\\s*(?:no|number))?|roll(?:\\s*(?:no|number))?|enrol{1,2}ment(?:\\s*(?:no|number))?|"
    "employee(?:\\s*(?:id|no|number))?|student(?:\\s*(?:id|no|number))?|txn(?:\\s*id)?|transaction(?:\\s*id)?|"
    "phone(?:\\s*(?:no|number))?|mobile(?:\\s*(?:no|number))?|email(?:\\s*(?:id|address))?|upi(?:\\s*id)?|vpa|imei|dl|license|licence"
)
#: Fixed value: letters and digits of a merge key or a quotation.
KEY_CHARS = "a-z0-9\u00c0-\u024f\u0900-\u097f\u4e00-\u9fff"


def strip_label(c: Column) -> Column:
    """A value without a label such as "IFSC: " before it."""
    return F.trim(F.regexp_replace(_text(c), f"(?i)^\\s*(?:{LABELS})\\s*[:#=]\\s*", ""))


def merge_key(c: Column) -> Column:
    """Digits alone where they are at least half of the letters and digits, else the letters and digits."""
    t = F.lower(strip_label(c))
    d = digits(t)
    half = F.length(d) >= F.length(F.regexp_replace(t, "[^a-z0-9]", "")) / 2
    return F.when((F.length(d) >= 4) & half, d).otherwise(F.regexp_replace(t, f"[^{KEY_CHARS}]+", ""))


def quotation(c: Column) -> Column:
    """Lower-cased letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), f"[^{KEY_CHARS}]+", " "))


def quoted(quote: Column, content: Column) -> Column:
    """Whether a quotation of eight characters or more is in a text, but for case and punctuation."""
    q = quotation(quote)
    return (F.length(q) >= 8) & quotation(content).contains(q)


def is_reference(c: Column) -> Column:
    """Tokens such as PER-002, DOC-CDR-003 and E0001."""
    return F.coalesce(c, F.lit("")).rlike("^[A-Za-z][A-Za-z0-9]{0,11}([-_][A-Za-z0-9]{1,11})*[-_]?[0-9]{1,8}$")


def reference_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9_-]", "")


#: Glyphs that stand for digits in scanned reference tokens, and those digits.
GLYPHS, GLYPH_DIGITS = "OQØ○ILilJSsBZzGbTAhgq", "000011111558226674499"


def reference_token(c: Column) -> Column:
    """A letter and digits from a scanned token, or null where it can't be one."""
    compact = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9£€]", "")
    lead = F.upper(F.substring(compact, 1, 1))
    tail = compact.substr(F.lit(2), F.length(compact))
    mapped = F.translate(tail, GLYPHS, GLYPH_DIGITS)
    ok = F.length(compact).between(2, 9) & lead.rlike("^[A-Z£€]$") & mapped.rlike("^[0-9]+$")
    return F.when(ok, F.concat(F.when(lead.isin("£", "€"), "E").otherwise(lead), mapped))


def guess_type(c: Column) -> Column:
    """Entity type by the shape of a value."""
    v = _text(c)
    return (
        F.when(v.rlike("(?i)^[^\\s@]+@[^\\s@]+\\.[a-z]{2,}$"), "email")
        .when(v.rlike("(?i)^0x[0-9a-f]{40}$"), "wallet")
        .when(v.rlike("(?i)@[a-z]{2,}(?![a-z0-9_])") & ~v.contains("."), "upi")
        .when(v.rlike("^\\+?[0-9][0-9\\s-]{7,}$"), "phone")
        .when(v.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), "ifsc")
        .when(v.rlike("^[0-9]{4}\\s?[0-9]{4}\\s?[0-9]{4}$") | v.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "document_id")
        .when(F.regexp_replace(v, "\\s", "").rlike("^[0-9]{9,18}$"), "account")
        .when(v.rlike("(?i)^https?://"), "url")
        .when(v.rlike("(?i)^([a-z0-9-]+\\.)+[a-z]{2,}$"), "domain")
        .when(v.rlike("(?i)(?<![a-z0-9_])(pvt|ltd|llp|inc|corp|bank|enterprises|traders|college|university|institute|school)(?![a-z0-9_])"), "organization")
        .when(v.rlike("^[A-Z][a-z]+(\\s+[A-Z][a-z]+){1,3}$"), "person")
        .otherwise("other")
    )


def verb(c: Column) -> Column:
    """Upper snake case, at most 48 characters."""
    t = F.regexp_replace(F.regexp_replace(_text(c), "[\\s-]+", "_"), "[^A-Za-z0-9_]", "")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")
    return F.substring(F.upper(t), 1, 48)


def well_formed_verb(v: Column) -> Column:
    """Up to five snake-case words that start with a letter; one word needs three letters."""
    return v.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+){0,4}$") & (F.length(v) >= F.when(v.contains("_"), 2).otherwise(3)) & (F.length(v) <= 48)
