"""Texts of QR codes, and password and permission reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import WS, trim


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def escape_microformat(c: Column) -> Column:
    return F.regexp_replace(c, r'([\;,:"])', r"\\$1")


def wifi_payload(ssid: Column, password: Column, auth: Column, hidden: Column) -> Column:
    parts = F.concat_ws(
        ";", F.concat(F.lit("WIFI:S:"), escape_microformat(trim(ssid))), F.concat(F.lit("T:"), auth),
        F.when((auth != "nopass") & given(password), F.concat(F.lit("P:"), escape_microformat(password))), F.when(hidden, F.lit("H:true")),
    )
    return F.when(given(trim(ssid)), F.concat(parts, F.lit(";;"))).otherwise("")


def escape_card(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(trim(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), "([,;])", r"\\$1")


def vcard_payload(name: Column, org: Column, title: Column, phone: Column, email: Column, url: Column) -> Column:
    whole = trim(name)
    words = F.split(whole, f"{WS}+")
    several = F.size(words) > 1
    family = F.when(several, F.element_at(words, -1)).otherwise("")
    first = F.when(several, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(whole)
    line = lambda label, c: F.when(given(c), F.concat(F.lit(label), escape_card(c)))
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("N:"), escape_card(family), F.lit(";"), escape_card(first), F.lit(";;;")), F.concat(F.lit("FN:"), escape_card(whole)),
        line("ORG:", org), line("TITLE:", title), line("TEL;TYPE=CELL:", phone), line("EMAIL;TYPE=INTERNET:", email), line("URL:", url), F.lit("END:VCARD"),
    )
    return F.when(given(whole), lines).otherwise("")


def email_payload(to: Column, subject: Column, body: Column) -> Column:
    part = lambda label, c: F.when(given(trim(c)), F.concat(F.lit(label), F.replace(F.url_encode(trim(c)), F.lit("+"), F.lit("%20"))))
    query = F.concat_ws("&", part("subject=", subject), part("body=", body))
    return F.when(given(trim(to)), F.concat(F.lit("mailto:"), trim(to), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise("")


def normalize_urlish(c: Column) -> Column:
    s = trim(c)
    bare = r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:[/:?#].*)?$"
    return F.when(s.rlike("(?i)^[a-z][a-z0-9+.-]*:"), s).when(s.rlike(bare), F.concat(F.lit("https://"), s)).otherwise(s)


#: Fixed texts, by score.
STRENGTH = ("Very weak", "Weak", "Fair", "Good", "Strong")
HINTS = (
    "Trivially guessable.", "Add length — a short phrase beats a mangled word.", "More length helps more than more symbols.",
    "A few more words would make it strong.", "Store it somewhere you will not lose it.",
)
#: Fixed: ciphers (id, label, hint) and what a file allows unless told otherwise.
CIPHERS = (
    ("AES-256", "AES-256", "Strongest. Needs Acrobat 9 or newer — effectively everything current."),
    ("AES-128", "AES-128", "For very old readers. Still sound, but prefer AES-256."),
)
OPEN_PERMISSIONS = {"printing": "full", "modifying": True, "copying": True, "annotating": True, "filling": True}


def password_strength(c: Column) -> Column:
    """(score 0 to 4, label, hint)."""
    n = F.length(c)
    kinds = sum(c.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    score = F.when(n >= 20, 4).when(n >= 14, 3).when(n >= 10, 2).otherwise(1)
    more = F.when((kinds >= 3) & (score < 4), score + 1).otherwise(score)
    less = F.when((kinds == 1) & (n < 16) & (more > 1), more - 1).otherwise(more)
    final = F.when(n < 6, 0).otherwise(less)
    label = F.when(F.coalesce(n, F.lit(0)) == 0, "Empty").when(n < 6, "Too short").otherwise(F.element_at(F.array(*map(F.lit, STRENGTH)), final + 1))
    by_score = F.element_at(F.array(*map(F.lit, HINTS)), final + 1)
    hint = F.when(F.coalesce(n, F.lit(0)) == 0, "Anyone can open the file.").when(n < 6, "Use at least 8 characters.").otherwise(by_score)
    return F.struct(F.coalesce(final, F.lit(0)).alias("score"), label.alias("label"), hint.alias("hint"))


def describe_permissions(printing: Column, copying: Column, modifying: Column, annotating: Column, filling: Column) -> Column:
    """printing is none, low or full; the others are booleans."""
    off = F.array_compact(F.array(
        F.when(printing == "none", "printing").when(printing == "low", "high-quality printing"), F.when(~copying, "copying text"), F.when(~modifying, "editing"),
        F.when(~annotating, "commenting"), F.when(~filling, "filling forms"),
    ))
    several = F.concat(F.array_join(F.slice(off, 1, F.greatest(F.size(off) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(off, -1))
    listed = F.when(F.size(off) == 1, F.get(off, F.lit(0))).otherwise(several)
    return F.when(F.size(off) == 0, "No restrictions — the password is only needed to open the file.").otherwise(F.concat(F.lit("Readers that honour permissions will block "), listed, F.lit(".")))
