"""Variants: HGVS text, alleles, and INFO fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import letters

# Clinical significance by order of the test, and stars of review.
SIGNIFICANCE = (("likely_pathogenic", "likely_pathogenic"), ("pathogenic", "pathogenic"), ("benign", "benign"), ("uncertain", "uncertain"))
REVIEW = (("practice guideline", 4), ("reviewed by expert panel", 3), ("multiple submitters", 2), ("single submitter", 1), ("no assertion", 0))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def hgvs(text: Column) -> dict[str, Column]:
    """Level, position, intronic offset, and change of a description such as c.123+4A>G or c.76_77del."""
    change = F.regexp_extract(text, r"[cg]\.[-*]?\d+(?:[+-]\d+)?(?:_[-*]?\d+(?:[+-]\d+)?)?(.*)$", 1)
    return {
        "level": _part(text, r"([cg])\.", 1),
        "base": _part(text, r"[cg]\.([-*]?\d+)", 1).try_cast("long"),
        "intronic": F.coalesce(_part(text, r"[cg]\.[-*]?\d+([+-]\d+)", 1).try_cast("long"), F.lit(0).cast("long")),
        "ref": _part(change, r"^([ACGT]+)>", 1),
        "alt": _part(change, r">([ACGT]+)$", 1),
        "change": F.when(change.contains(">"), "sub").when(change.startswith("delins"), "delins").when(change.startswith("del"), "del").when(change.startswith("ins"), "ins").when(change.startswith("dup"), "dup").otherwise("unknown"),
    }


def intronic_site(offset: Column, most: int = 20) -> Column:
    """donor after an exon, acceptor before one, null for exons and deep introns."""
    return F.when((offset == 0) | (F.abs(offset) > most), None).when(offset > 0, "donor").otherwise("acceptor")


def site_hint(offset: Column) -> tuple[Column, Column]:
    """(site, confidence) that an intronic offset hints at."""
    site = F.when(offset == 0, None).when((offset > 0) & (offset <= 10), "donor").when((offset < 0) & (offset >= -25), "acceptor").otherwise("deep_intronic")
    trust = F.when(offset == 0, None).when(F.abs(offset) <= 2, "high").when((offset > 0) & (offset <= 10), "medium").when((offset < 0) & (offset >= -25), "medium").otherwise("low")
    return site, trust


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the letters before the first that differ."""
    same = F.zip_with(letters(a), letters(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.length(a)).otherwise(first - 1).cast("int")


def trim_alleles(ref: Column, alt: Column) -> tuple[Column, Column]:
    """Upper case, without the common prefix and then the common suffix; an empty allele is -."""
    ref, alt = F.upper(ref), F.upper(alt)
    n = _common(ref, alt)
    ref, alt = F.substring(ref, n + 1, F.length(ref)), F.substring(alt, n + 1, F.length(alt))
    m = _common(F.reverse(ref), F.reverse(alt))
    ref, alt = F.substring(ref, F.lit(1), F.length(ref) - m), F.substring(alt, F.lit(1), F.length(alt) - m)
    return F.when(ref == "", "-").otherwise(ref), F.when(alt == "", "-").otherwise(alt)


def variant_class(ref: Column, alt: Column) -> Column:
    """SNV, insertion, deletion or indel of trimmed alleles."""
    r, a = F.when(ref == "-", 0).otherwise(F.length(ref)), F.when(alt == "-", 0).otherwise(F.length(alt))
    return F.when((r == 1) & (a == 1), "SNV").when(r == 0, "insertion").when(a == 0, "deletion").otherwise("indel")


def variant_end(position: Column, ref: Column, alt: Column) -> Column:
    """Last base that the trimmed reference allele covers."""
    kind = variant_class(ref, alt)
    return F.when(kind.isin("SNV", "insertion"), position).otherwise(position + F.length(ref) - 1)


def record_class(ref: Column, alt: Column) -> Column:
    """SNV, deletion, insertion or complex of alleles as a record has them; unknown without an alternative (`.`)."""
    r, a = F.length(ref), F.length(alt)
    return F.when(alt == ".", "unknown").when((r == 1) & (a == 1), "SNV").when(r > a, "deletion").when(r < a, "insertion").otherwise("complex")


def info_map(info: Column) -> Column:
    """Keys and values of key=value;key=value."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def first_contained(text: Column, choices: tuple[tuple[str, object], ...], default: object) -> Column:
    """The value of the first key that the text contains, in lower case; the order counts."""
    low = F.lower(text)
    out: Column | None = None
    for key, value in choices:
        out = F.when(low.contains(key), F.lit(value)) if out is None else out.when(low.contains(key), F.lit(value))
    return out.otherwise(F.lit(default))


def review_stars(text: Column) -> Column:
    """The most stars of the review states that the text names, in any case; 0 where it names none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(F.lit(0), *(F.when(low.contains(state), F.lit(stars)).otherwise(F.lit(0)) for state, stars in REVIEW))


def affects_splicing(consequences: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of the terms, comma- or ampersand-separated in any case, is named as a whole."""
    named = F.transform(F.split(F.lower(F.coalesce(consequences, F.lit(""))), r"[,&|]"), F.trim)
    return F.arrays_overlap(named, F.array(*(F.lit(t.lower()) for t in terms)))


def gtf_attribute(attribute: Column, key: str) -> Column:
    """The value of key "value"; in a GTF attribute column; null where it is missing."""
    return _part(attribute, rf'(?:^|[;\s]){key} "([^"]*)"', 1)
