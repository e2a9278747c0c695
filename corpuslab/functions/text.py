"""Column expressions over text. All of them stay in the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that the word tokenizer replaces by blanks, and the patterns of the corpus audit.
WORD_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
ARTIFACTS = {
    "XXXX redaction": r"\bX{2,}\b",
    "XX/XX date": r"XX/XX/",
    "year> placeholder": r"year>",
    "{$...} amount": r"\{\$[\d.,]+\}",
    "bytes repr wrapper": r"^b['\"]",
    "url": r"https?://|www\.",
    "email": r"\S+@\S+\.\w+",
    "html tag": r"<[a-z/][^>]*>",
    "non-ascii": r"[^\x00-\x7f]",
    "blank line": r"\n\s*\n",
}
# Words by which complaints name their own product.
CUES = {
    "Checking or savings account": "checking account|savings account|overdraft",
    "Credit card": "credit card",
    "Debt collection": "debt collector|collection agency|fdcpa",
    "Money transfer, virtual currency, or money service": "zelle|venmo|paypal|cash app|crypto|wire transfer",
    "Student loan": "student loan|navient|mohela|nelnet",
}
BLANKS = r"[\s\p{Z}]+"


def label_key(c: Column) -> Column:
    """A label without regard to case and to the kind and number of blanks."""
    return F.trim(F.regexp_replace(F.lower(c), BLANKS, " "))


def split_words(t: Column, lower: bool = True) -> Column:
    """Words between blanks after the filter characters became blanks. Only the blank itself separates, so a
    carriage return or no-break space stays within a word."""
    return F.filter(F.split(F.translate(F.lower(t) if lower else t, WORD_FILTERS, " " * len(WORD_FILTERS)), " "), lambda w: w != "")


def blank_words(t: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def terms(t: Column) -> Column:
    """Lower-cased terms of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def bigrams(ws: Column) -> Column:
    """Neighbouring words joined by a blank; none for fewer than two words."""
    none = F.array().cast("array<string>")
    return F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none)


def strip_wrapper(t: Column) -> Column:
    """Undo the printed form of a byte string around a whole text (one trailing line break is allowed, and dropped) and the
    escapes of line breaks and quotes; other text is unchanged."""
    body = F.regexp_extract(t, r"(?sd)^b(['\"])(.*)\1$", 2)
    bare = F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    return F.when(t.rlike(r"(?sd)^b(?:'.*'|\".*\")$"), bare).otherwise(t)


def mask_pii(t: Column) -> Column:
    """E-mail addresses and runs of six or more digits masked."""
    return F.regexp_replace(F.regexp_replace(t, r"\S+@\S+\.\w+", "[email]"), r"[0-9]{6,}", "[number]")


def excerpt(t: Column, n: int = 180) -> Column:
    return F.substring(mask_pii(t), 1, n)


@functools.lru_cache(1)
def accents() -> tuple[str, str]:
    """Characters below U+3000 that Unicode decomposes into one character with or without accents, and these characters; after them
    the combining accents themselves, which stand for nothing."""
    of = {c: d[0] for c in map(chr, range(0x80, 0x3000)) if (d := unicodedata.normalize("NFKD", c)) != c and not unicodedata.combining(d[0]) and all(map(unicodedata.combining, d[1:]))}
    marks = "".join(c for c in map(chr, range(0x80, 0x3000)) if unicodedata.combining(c))
    return "".join(of) + marks, "".join(of.values())


def strip_accents(t: Column) -> Column:
    """Characters with accents as plain ones. Those that decompose into several characters, as ligatures, stay. ASCII texts are not searched."""
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, *accents()))


def pad(seq: Column, n: int, padding: str = "pre", truncating: str = "post", value: int = 0) -> Column:
    """Sequences of exactly ``n``: cut and filled at the given ends."""
    if padding not in ("pre", "post") or truncating not in ("pre", "post"):
        raise ValueError("padding and truncating are pre or post")
    size = F.size(seq)
    cut = F.slice(seq, 1, n) if truncating == "post" else F.slice(seq, F.greatest(size - n + 1, F.lit(1)), n)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - size, F.lit(0)))
    return F.concat(fill, cut) if padding == "pre" else F.concat(cut, fill)


def short_label(c: Column) -> Column:
    """The label up to its first comma, and of that up to the first `` or ``."""
    return F.substring_index(F.substring_index(c, ",", 1), " or ", 1)


def format_delta(c: Column) -> Column:
    """Signed with four decimals; a dash for null."""
    return F.when(c.isNull(), "—").otherwise(F.concat(F.when(c < 0, "-").otherwise("+"), F.format_string("%.4f", F.abs(c))))


def format_metric(mean: Column, std: Column) -> Column:
    """Mean, with the deviation where there is one."""
    return F.when(std.isNull(), F.format_string("%.4f", mean)).otherwise(F.format_string("%.4f ± %.4f", mean, std))
