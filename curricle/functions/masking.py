"""Masking of contacts and detection of personal data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_phone(x: Column) -> Column:
    """199****0003 of a number with 11 digits; anything else as it is, null as an empty string."""
    digits = F.regexp_replace(x, r"(?U)\D", "")
    return F.coalesce(F.when(F.length(digits) == 11, F.concat(F.substring(digits, 1, 3), F.lit("****"), F.substring(digits, 8, 4))).otherwise(x), F.lit(""))


def mask_email(x: Column) -> Column:
    """z******3@example.com: first and last character of the local part (the first alone of a single one); without an @ as it is."""
    return F.coalesce(F.regexp_replace(x, r"^([^@])(?:[^@]*([^@]))?@(.*)$", r"$1******$2@$3"), F.lit(""))


def is_probable_phone(x: Column) -> Column:
    """A number of eleven digits, whatever spaces and hyphens stand in it."""
    return F.regexp_replace(x, r"(?U)[\s-]", "").rlike(r"^1[3-9][0-9]{9}$")


#: Patterns of the audit, allowed email domains, and the allowed numbers.
AUDIT_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,63}"
AUDIT_PHONE = r"\b1[3-9]\d{9}\b"
ALLOWED_PHONE = r"^199000[05]\d{4}"
IDCARD = r"\b\d{17}[\dXx]\b"
USERPATH = r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]+Users[\\/]+"
DRIVEPATH = r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]+"
SECRET = r"""(?i:api[_-]?key|secret|passwd|password|token)\s*[=:]\s*["'][^"']{8,}["']"""
SECRET_KEY = r"sk-[A-Za-z0-9]{16,}"
INTRANET_IP = r"\b(?:10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}|192\.168\.\d{1,3})\.\d{1,3}\b"
ALLOWED_DOMAINS = ["example.com", "example.net", "github.com", "users.noreply.github.com"]
HARD = ["EMAIL", "PHONE", "IDCARD", "USERPATH", "SECRET", "SISTER", "INTRANET_IP", "EMAIL_META", "BINARY_UNREGISTERED", "BINARY_HASH_MISMATCH"]
REVIEW = ["DRIVEPATH", "PROGDATA"]


def line_findings(line: Column, words: list[str] = (), system_folder: str = "ProgramData", domains: list[str] = ALLOWED_DOMAINS) -> dict[str, Column]:
    """Counts of one line by category: all email addresses and phone numbers that aren't allowed, and once each of the others."""
    emails = F.filter(F.regexp_extract_all(line, F.lit(f"({AUDIT_EMAIL})"), 1), lambda m: ~F.lower(F.regexp_extract(m, "@(.*)$", 1)).isin(list(domains)))
    phones = F.filter(F.regexp_extract_all(line, F.lit(f"({AUDIT_PHONE})"), 1), lambda m: ~m.rlike(ALLOWED_PHONE))
    once = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    low = F.lower(line)
    said = F.lit(False)
    for w in words:
        said = said | low.contains(w.lower())
    user = line.rlike(USERPATH)
    return {"EMAIL": F.size(emails), "PHONE": F.size(phones), "IDCARD": once(line.rlike(IDCARD)), "USERPATH": once(user), "DRIVEPATH": once(~user & line.rlike(DRIVEPATH)),
            "SECRET": once(line.rlike(SECRET) | line.rlike(SECRET_KEY)), "SISTER": once(said), "INTRANET_IP": once(line.rlike(INTRANET_IP)), "PROGDATA": once(line.contains(system_folder))}


def binary_findings(content: Column, words: list[str] = (), system_folder: str = "ProgramData") -> dict[str, Column]:
    """Counts of raw bytes, read as Latin-1: all user folders, and once each of the others."""
    text = F.decode(content, "ISO-8859-1")
    said = F.lit(False)
    for w in words:
        said = said | F.lower(text).contains(w.lower())
    return {"USERPATH": F.regexp_count(text, F.lit(USERPATH)), "SISTER": said.cast("int"), "PROGDATA": text.contains(system_folder).cast("int"), "SECRET": text.rlike(SECRET_KEY).cast("int")}


def may_have_findings(line: Column, words: list[str] = (), system_folder: str = "ProgramData") -> Column:
    """Whether a line has any of the characters without which line_findings() are all 0: one cheap pass before its patterns."""
    low, out = F.lower(line), line.rlike(r"[@:=0-9]|sk-") | line.contains(system_folder)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def not_allowed(email: Column, domains: list[str] = ALLOWED_DOMAINS) -> Column:
    return F.coalesce(~F.lower(F.regexp_extract(email, "@(.*)$", 1)).isin(list(domains)), F.lit(False))
