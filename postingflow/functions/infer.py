"""Inference of enum values, tags, languages, salary and country from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from postingflow.functions.text import fold_letters, is_blank, let, normalize_text, trim_space
from postingflow.schema import ENUMS, SALARY_TYPE


def _joined(*cols: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def _any_in(text: Column, needles: list[str], whole_words: bool = False) -> Column:
    inside = reduce(lambda a, b: a | b, [text.contains(n) for n in needles])
    if whole_words:
        # The plain test is much cheaper and rules most texts out.
        return inside & text.rlike(r"(^|[^\p{L}\p{Nd}])(" + "|".join(needles) + r")($|[^\p{L}\p{Nd}])")
    return inside


def _first_label(text: Column, rules: list[tuple[str, list[str]]], whole_words: bool = False) -> Column:
    def choose(t: Column) -> Column:
        out = F.lit("Unknown")
        for label, needles in reversed(rules):
            out = F.when(_any_in(t, needles, whole_words), F.lit(label)).otherwise(out)
        return out

    return let(text, choose)


# Words that decide each label, in order of priority.
WORK_MODE_WORDS = [
    ("Remote", ["remote", "remoto"]),
    ("Hybrid", ["hybrid", "hibrido"]),
    ("Onsite", ["onsite", "presencial"]),
]
EMPLOYMENT_WORDS = [
    ("Internship", ["intern", "estagio"]),
    ("Contractor", ["contractor", "pj"]),
    ("Temporary", ["temporary", "temporario"]),
    ("CLT", ["clt"]),
]
EMPLOYMENT_WORDS_WORKDAY = [
    ("Internship", ["intern"]),
    ("Temporary", ["temp"]),
    ("Contractor", ["contract"]),
]
TAG_WORDS = [
    (".net", "dotnet"), ("asp.net", "dotnet"), ("c#", "csharp"), ("react", "react"),
    ("typescript", "typescript"), ("javascript", "javascript"), ("azure", "azure"), ("aws", "aws"),
    ("postgres", "postgres"), ("postgresql", "postgres"), ("kafka", "kafka"), ("docker", "docker"),
    ("kubernetes", "kubernetes"), ("golang", "golang"), ("java", "java"), ("python", "python"),
]
SAMPLE_TAG_WORDS = [
    (".net", "dotnet"), ("c#", "csharp"), ("react", "react"), ("typescript", "typescript"),
    ("postgres", "postgresql"), ("kafka", "kafka"), ("azure", "azure"), ("aws", "aws"), ("docker", "docker"),
]
SAMPLE_SOURCE_TYPES = {
    "linkedin": "LinkedIn", "greenhouse": "Greenhouse", "lever": "Lever", "indeed": "Indeed",
    "infojobs": "InfoJobs", "vagas": "Vagas", "careerspage": "CareersPage",
}
PORTUGUESE_LETTERS = "ãõçáéíóú"


def infer_work_mode(*cols: Column) -> Column:
    """Work mode from the joined hint, location and description."""
    return _first_label(fold_letters(_joined(*cols)), WORK_MODE_WORDS)


def infer_work_mode_location(location: Column) -> Column:
    """Sample-file rule: location only, no on-site value."""
    low = F.lower(F.coalesce(location, F.lit("")))
    return _first_label(low, [("Remote", ["remote", "remoto"]), ("Hybrid", ["híbrido", "hibrido"])])


def infer_employment(kind: Column, description: Column, mode: str = "compat") -> Column:
    """Employment type; 'compat' matches inside words, 'token' needs whole words and knows PJ."""
    text = fold_letters(_joined(kind, description))
    if mode == "compat":
        return _first_label(text, EMPLOYMENT_WORDS)
    rules = [
        ("Internship", ["intern", "internship", "estagio"]), ("Contractor", ["contractor"]), ("PJ", ["pj"]),
        ("Temporary", ["temporary", "temporario"]), ("CLT", ["clt"]),
    ]
    return _first_label(text, rules, whole_words=True)


def infer_employment_workday(kind: Column) -> Column:
    """Employment type from a Workday time-type text."""
    return _first_label(normalize_text(kind), EMPLOYMENT_WORDS_WORKDAY)


def infer_languages(text: Column, blank: list[str] | None = None) -> Column:
    """['pt-BR'] when a Portuguese letter occurs, else ['en']; `blank` is what blank text gives."""
    found = F.when(F.lower(text).rlike(f"[{PORTUGUESE_LETTERS}]"), F.array(F.lit("pt-BR"))).otherwise(F.array(F.lit("en")))
    if blank is None:
        return found
    empty = F.array(*[F.lit(b) for b in blank]).cast("array<string>")
    return F.when(is_blank(text), empty).otherwise(found)


def _tags(hits: list[tuple[Column, str]]) -> Column:
    flagged = F.array(*[F.when(hit, F.lit(tag)) for hit, tag in hits])
    return F.array_distinct(F.filter(flagged, lambda t: t.isNotNull()))


def infer_tags(title: Column, description: Column, mode: str = "token") -> Column:
    """Technology tags. 'compat' matches folded needles inside words; 'token' needs word bounds."""
    joined = _joined(title, description)
    if mode == "compat":
        table = {".net": "net", "asp.net": "asp net", "c#": "c"}
        both = F.struct(F.lower(joined).alias("raw"), normalize_text(joined).alias("folded"))
        return let(both, lambda t: _tags([(t["raw"].contains(n) | t["folded"].contains(table.get(n, n)), tag) for n, tag in TAG_WORDS]))

    def bounded(raw: Column, needle: str) -> Column:
        left = "" if needle.startswith(".") else r"(?<![\p{L}\p{Nd}])"
        return raw.contains(needle) & raw.rlike(left + needle.replace(".", r"\.") + r"(?![\p{L}\p{Nd}#+])")

    return let(F.lower(joined), lambda raw: _tags([(bounded(raw, n), tag) for n, tag in TAG_WORDS]))


def infer_tags_sample(title: Column, description: Column) -> Column:
    """Sample-file tags: raw text only, nine words."""
    return let(F.lower(_joined(title, description)), lambda raw: _tags([(raw.contains(n), tag) for n, tag in SAMPLE_TAG_WORDS]))


def parse_amount(c: Column) -> Column:
    """A number with Brazilian separators first, then with English ones; else null."""
    brazilian = c.rlike(r"^[^,]*(,[^.,]*)?$")
    english = c.rlike(r"^[^.]*(\.[^.,]*)?$")
    return (
        F.when(brazilian, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(english, F.replace(c, F.lit(","), F.lit("")))
        .try_cast("decimal(18,2)")
    )


def parse_salary(text: Column) -> Column:
    """min, max, currency and period of a salary text; blank text gives all nulls."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+[\d.,]*)"), F.lit(1))
    numbers = F.filter(F.transform(found, parse_amount), lambda n: n.isNotNull())
    low = F.try_element_at(numbers, F.lit(1))
    return F.struct(
        low.alias("min"),
        F.coalesce(F.try_element_at(numbers, F.lit(2)), low).alias("max"),
        F.when(F.upper(text).contains("R$"), F.lit("BRL")).alias("currency"),
        F.when(normalize_text(text).contains("mes"), F.lit("month")).alias("period"),
    ).cast(SALARY_TYPE)


def infer_country(location: Column) -> Column:
    """'BR' for a location that names Brazil or one of two states; else null."""
    hit = let(normalize_text(location), lambda t: _any_in(t, ["brazil", "brasil", "sp", "pr"]))
    return F.when(~is_blank(location) & hit, F.lit("BR"))


def parse_enum(c: Column, enum: str, default: str = "Unknown") -> Column:
    """Enum name from a case-insensitive name or a defined code."""
    table = {name.lower(): name for name in ENUMS[enum]}
    table.update({str(code): name for name, code in ENUMS[enum].items()})
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.lower(trim_space(c))), F.lit(default))


def source_type_from_name(c: Column) -> Column:
    """Source type of a sample file by its source name."""
    lookup = F.create_map(*[F.lit(x) for kv in SAMPLE_SOURCE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.lower(trim_space(c))), F.lit("Fixture"))
