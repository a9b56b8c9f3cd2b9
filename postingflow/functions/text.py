"""Text folding and cleaning as native column expressions."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column, functions as F

# Regex class body for white space beyond ASCII; Java's \s alone is ASCII only.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE_CHARS = "".join(
    chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_KEEP_SPACE = SPACE.replace(" ", "", 1)


def _accent_pairs() -> tuple[str, str]:
    """Characters that decompose and, without their marks, recompose to another single character, with that one; then all marks.

    `translate` drops what has no counterpart, so one pass folds the characters and removes loose marks.
    """
    source, target, marks = [], [], []
    for code in [*range(0xC0, 0xD800), *range(0xE000, 0x30000)]:
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
        elif ch == ch.lower() and unicodedata.decomposition(ch)[:1] not in ("", "<"):
            base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
            base = unicodedata.normalize("NFC", base)
            if len(base) == 1 and base != ch:
                source.append(ch)
                target.append(base)
    return "".join(source + marks), "".join(target)


_ACCENTED, _BASE = _accent_pairs()


def trim_space(c: Column) -> Column:
    """Trim any white space, not only U+0020."""
    return F.btrim(c, F.lit(_SPACE_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{SPACE}]")


def null_if_blank(c: Column) -> Column:
    """The value itself, or null when it is blank."""
    return F.when(~is_blank(c), c)


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def fold_letters(c: Column) -> Column:
    """Fold case and accents only; null gives ''. A word of letters, also as a whole word, is found here when it is in `normalize_text`."""
    return F.translate(F.lower(trim_space(F.coalesce(c, F.lit("")))), _ACCENTED, _BASE)


# What `normalize_text` makes one blank.
_GAP = rf"[^\p{{L}}\p{{Nd}}{_KEEP_SPACE}]+"


def normalize_text(c: Column) -> Column:
    """Fold case, accents and punctuation; blank or null gives ''. Tabs and line breaks inside survive."""
    return F.trim(F.regexp_replace(fold_letters(c), _GAP, " "))


def folded_contains(letters: Column, phrase: str) -> Column:
    """Whether `normalize_text` holds a phrase of letters and single blanks, from `fold_letters`: punctuation is looked at only where words are."""
    words = phrase.split(" ")
    found = letters.contains(words[0])
    for word in words[1:]:
        found = found & letters.contains(word)
    return found if len(words) == 1 else found & letters.rlike(_GAP.join(words))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`; keeps deep expressions small."""
    return F.transform(F.array(value), body)[0]


def _entity_table() -> Column:
    """Name to code point; one foldable expression, so plans stay small."""
    pairs = dict(html.entities.name2codepoint, apos=39)
    return F.str_to_map(F.lit(" ".join(f"{n}:{c}" for n, c in sorted(pairs.items()))), F.lit(" "), F.lit(":"))


def html_unescape(c: Column) -> Column:
    """Decode named and numeric character references in one pass; unknown ones stay as they are."""
    table = _entity_table()
    reference = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def decoded(ref: Column) -> Column:
        body, text = ref["body"], ref["text"]
        code = (
            F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10))
            .when(body.startswith("#"), F.substring(body, 2, 8))
            .otherwise(F.try_element_at(table, body))
        )
        rest = text.substr(F.length(body) + F.lit(2), F.length(text))
        return let(code.cast("int"), lambda n: F.when(
            n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF),
            F.concat(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"), rest),
        ).otherwise(F.concat(F.lit("&"), text)))

    def segment(s: Column) -> Column:
        return let(F.struct(F.regexp_extract(s, reference, 1).alias("body"), s.alias("text")), decoded)

    parts = F.split(c, "&")
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), segment), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


def html_text(c: Column) -> Column:
    """Markup to plain text: tags become blanks, references decoded, white space collapsed; null gives ''."""
    return collapse_space(html_unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))


NO_DESCRIPTION = "Descrição não disponível."


def strip_html_ui(c: Column) -> Column:
    """Display clean-up: style/script bodies and tags removed, five references decoded."""
    t = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, char in [("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')]:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(NO_DESCRIPTION))
        .when(c.rlike(r"(?is)<[a-z].*>"), trim_space(t))
        .otherwise(c)
    )


def normalize_tags(tags: Column) -> Column:
    """Drop blanks, trim, lower-case, keep the first of each; null gives an empty array."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~is_blank(t))
    return F.array_distinct(F.transform(kept, lambda t: F.lower(trim_space(t))))


def parse_tag_csv(c: Column) -> Column:
    """Comma list to distinct lower-case tags; null gives an empty array."""
    return normalize_tags(F.split(F.coalesce(c, F.lit("")), ","))


def normalize_email(c: Column) -> Column:
    """Null to '', trimmed, lower-cased."""
    return F.lower(trim_space(F.coalesce(c, F.lit(""))))


def parse_date(c: Column) -> Column:
    """ISO dates and date-times, read as UTC when no offset is given; anything else is null."""
    text = trim_space(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def posted_from(run_at: Column, days: int) -> Column:
    """The floor a 'posted within N days' choice stands for."""
    return run_at - F.make_interval(days=F.lit(days))
