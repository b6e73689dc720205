"""Text predicates and extracts: personal data, risk, dates, file names, cues."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Personal data: resident numbers, mobile numbers, mail addresses (fixed values, letters, digits and blanks spelt out for every engine).
_W = r"[\p{L}\p{N}_]"
_S = r"[\s\p{Z}\x1C-\x1F\x85]"
PII_NUMBER = rf"(?:\p{{Nd}}{{6}}{_S}*-{_S}*[1-8]\p{{Nd}}{{6}}|01[016789][- .]?\p{{Nd}}{{3,4}}[- .]?\p{{Nd}}{{4}})"
PII_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
PII = rf"(?<!{_W}){PII_NUMBER}(?!{_W})|{PII_MAIL}"
#: What any personal number or address holds; a text without it needs no pattern.
PII_HINT = r"@|\p{Nd}{6}|01[016789]"
PII_MARK = "[개인정보 검토 필요]"
#: Dates, amounts, heads, fees, deadlines and consents (fixed values).
RISK = r"20\d{2}|\d{1,2}월|\d{1,2}일|[\d,]+\s*원|\d+\s*명|무료|유료|제외|마감|기한|동의|서명"
#: Marks of a page that asks for a login (fixed values).
LOGIN = r"""(?i)fm_xb_login|loginpost\.php|name=["']?(?:mem_id|userid)["']?|input[^>]+type=["']?password"""
FORM_NAME = r"신청서|동의서|양식|서식|참고자료|신청양식"
FILE_TOKEN = r"""(?i)[^\s/\\:*?"<>|]{1,120}\.(?:pdf|hwpx?|docx?|xlsx?|pptx?|png|jpe?g|webp|zip|txt)"""
FILE_END = r"(?i)\.(?:pdf|hwpx?|docx|png|jpe?g|webp)(?:$|[?&#\s(])"
DATE = r"(20\d{2})[.\-/]\s*(\d{1,2})[.\-/]\s*(\d{1,2})"


def has_pii(text: Column) -> Column:
    return F.when(text.rlike(PII_HINT), text.rlike(PII)).when(text.isNotNull(), False)


def mask_pii(text: Column) -> Column:
    """The text with each number or address replaced by the mark; neighbours that share one blank are both replaced."""
    return F.when(text.rlike(PII_HINT), F.regexp_replace(text, PII, PII_MARK)).otherwise(text)


def login_required(html: Column) -> Column:
    return html.rlike(LOGIN)


def is_decorative(text: Column) -> Column:
    """Whether a paragraph is ornament: without a letter or digit, or a school's name five times or more."""
    bare = F.regexp_replace(text, rf"{_S}+", "")
    name = r"^([가-힣]{2,30}학교)(?:\1|[·ㆍ])*$"
    return ~bare.rlike(_W) | (bare.rlike(name) & (F.size(F.split(bare, "학교")) > 5))


def is_risky(text: Column) -> Column:
    return text.rlike(RISK)


def default_role(filename: Column) -> Column:
    return F.when(filename.rlike(FORM_NAME), "attachment").otherwise("convert")


def last_date(text: Column) -> Column:
    """The last date of a text as a DATE; null without one, and for one that no calendar has."""
    found = F.element_at(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), -1)
    part = lambda i: F.lpad(F.regexp_extract(found, DATE, i), 4 if i == 1 else 2, "0")
    return F.when(F.size(F.regexp_extract_all(text, F.lit(DATE), F.lit(0))) > 0, F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"))


def attachment_name(label: Column, url: Column) -> Column:
    """The file name in a link's label, else the one its path ends in, else the label, the path's end, or 'attachment'."""
    named = F.regexp_extract(label, FILE_TOKEN, 0)
    tail = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", 0)
    return (
        F.when(named != "", named).when(tail.rlike(FILE_END), tail)
        .when(F.trim(label) != "", F.trim(label)).when(tail != "", tail).otherwise("attachment")
    )


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def like_ascii(text: Column, wanted: str) -> Column:
    """Whether a text holds a string, the case of A-Z aside."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper, lower).contains(wanted.translate(str.maketrans(upper, lower)))
