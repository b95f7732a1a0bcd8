"""Column functions over text. Patterns are Unicode-aware where the semantics are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the keyword filter rejects by default.
BLOCKED = ("image", "data")


def strip(text: Column) -> Column:
    """Without white space at either end, line ends included; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\n\s*", "\n")


def special_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space."""
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")).cast("double") / F.length(text)


def count_of(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def clean_extra_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def clean_dashes(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[-\x{2013}]", " "))


def clean_bullets(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x{2022}\x{25E6}\x{25AA}\x{00B7}*]\s*", "")


def clean_ordered_bullets(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(\d+\.)+\d*\s+", "")


def clean_trailing_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[.,:;]+$", "")


def clean_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{P}", "")


def replace_unicode_quotes(text: Column) -> Column:
    return F.translate(text, "\u2018\u2019\u201c\u201d", "''\"\"")


def group_broken_paragraphs(text: Column) -> Column:
    """Single line feeds become spaces; empty lines stay paragraph breaks."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " "), r"\n{2,}", "\n\n")


CLEANERS = {
    "extra_whitespace": clean_extra_whitespace,
    "bullets": clean_bullets,
    "ordered_bullets": clean_ordered_bullets,
    "dashes": clean_dashes,
    "trailing_punctuation": clean_trailing_punctuation,
    "non_ascii": clean_non_ascii,
    "punctuation": remove_punctuation,
    "unicode_quotes": replace_unicode_quotes,
    "broken_paragraphs": group_broken_paragraphs,
}


def clean(text: Column, steps: tuple[str, ...] = ("unicode_quotes", "non_ascii", "broken_paragraphs", "extra_whitespace")) -> Column:
    """Applies cleaners in order; an unknown one raises."""
    for step in steps:
        if step not in CLEANERS:
            raise ValueError(f"unknown cleaner {step!r}")
        text = CLEANERS[step](text)
    return text


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))


def ip_addresses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:\d{1,3}\.){3}\d{1,3}"), F.lit(0))


def us_phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\+?\d?[ -]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of three letters or more, and acronyms, by name."""
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[A-Z]{2,}"), F.lit(0)))))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def gateway_token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 100).cast("long")


def node_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9\x{4E00}-\x{9FA5}]", "")


def relation_type(text: Column) -> Column:
    return F.upper(F.replace(text, F.lit(" "), F.lit("_")))


def strip_section_number(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"^(?:\d+\.)+\s*", ""))


def boxed_simple(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\\boxed\{(.*?)\}", 1), F.lit(""))


def normalise_number(text: Column) -> Column:
    """A number without $, % and thousands commas; infinity where it is none."""
    return F.coalesce(F.translate(text, "$%,", "").try_cast("double"), F.lit(float("inf")))


def normalise_answer(text: Column) -> Column:
    """Without white space and ASCII punctuation, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\s", "")), r"[!-/:-@\[-`{-~]", "")


def final_answer(text: Column, mark: str = "FINAL ANSWER: ") -> Column:
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1)).otherwise(text)


def clean_prefix(text: Column, pattern: str) -> Column:
    """Without ``pattern`` at the start, and the white space and punctuation after it."""
    return F.regexp_replace(text, rf"^{pattern}[\s.,]*", "")


def clean_postfix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, rf"[\s.,]*{pattern}\z", "")


def bytes_string(text: Column) -> Column:
    r"""The text of a byte literal such as b'caf\xc3\xa9': escapes are taken as bytes of UTF-8."""
    inner = F.regexp_replace(text, r"^b['\"]|['\"]$", "")
    hexed = F.transform(F.split(F.regexp_replace(inner, r"(\\x[0-9a-f]{2})", "\u0001$1\u0001"), "\u0001"), lambda x: F.when(F.rlike(x, F.lit(r"^\\x[0-9a-f]{2}$")), F.substring(x, 3, 2)).otherwise(F.hex(x.cast("binary"))))
    return F.decode(F.unhex(F.array_join(hexed, "")), "UTF-8")


def mapi_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), F.lit(0))


def ordered_bullet_parts(text: Column) -> Column:
    """The three parts of a leading section number such as 2.1.c; missing ones are empty."""
    first = F.substring_index(text, " ", 1)
    parts = F.split(first, r"\.")
    return F.when(F.rlike(first, F.lit(r"^\w{1,2}(\.\w{0,2}){1,2}$")), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(parts, i), F.lit(""))))


def text_before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def text_after(text: Column, mark: str) -> Column:
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.instr(text, mark) + len(mark), F.length(text))).otherwise("")


def han_grams(text: Column, n: int, step: int = 1) -> Column:
    """Strings of ``n`` Han characters of each run of them, every ``step`` characters."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FA5}]+"), F.lit(0))
    of = lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - n + 1, F.lit(step)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, of))


def image_tokens(width: Column, height: Column) -> Column:
    """85, and 170 for each tile of 512 after scaling into 2048, then to 768 on the short side."""
    w, h = width.cast("double"), height.cast("double")
    fit = F.least(F.lit(1.0), F.lit(2048.0) / F.greatest(w, h))
    w, h = w * fit, h * fit
    fit = F.least(F.lit(1.0), F.lit(768.0) / F.least(w, h))
    return (85 + 170 * F.ceil(h * fit / 512) * F.ceil(w * fit / 512)).cast("long")


def finite_values(values: Column) -> Column:
    """An array with nulls for NaN and infinities."""
    return F.transform(values, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
