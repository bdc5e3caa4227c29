"""VCF and variant tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variants import SIGNIFICANCE, first_contained, hgvs, info_map, intronic_site, record_class
from .annotation import write_track

# Sequence ontology terms of splicing by accession, first those of the strict mode, then the others.
CORE_TERMS = (
    ("SO:0001575", "splice_donor_variant"),
    ("SO:0001574", "splice_acceptor_variant"),
    ("SO:0001630", "splice_region_variant"),
    ("SO:0001629", "splice_polypyrimidine_tract_variant"),
)
FURTHER_TERMS = (
    ("SO:0001627", "intron_variant"),
    ("SO:0002019", "start_lost"),
    ("SO:0001624", "5_prime_UTR_variant"),
    ("SO:0001623", "3_prime_UTR_variant"),
    ("SO:0001583", "missense_variant"),
    ("SO:0001819", "synonymous_variant"),
    ("SO:0001587", "stop_gained"),
    ("SO:0001578", "stop_lost"),
    ("SO:0001968", "splice_donor_5th_base_variant"),
    ("SO:0001969", "splice_donor_region_variant"),
    ("SO:0001970", "splice_acceptor_region_variant"),
    ("SO:0001822", "inframe_insertion"),
    ("SO:0001821", "inframe_deletion"),
)
# Words that hint at splicing, and those that count in the permissive mode too.
SPLICE_WORDS = ("splice", "donor", "acceptor", "intron", "exon", "splice_site", "canonical_splice", "cryptic_splice", "branch_point", "polypyrimidine", "splicing", "splice_region", "exon_boundary")
BROAD_WORDS = ("variant", "mutation")
# Mechanism and confidence of the first line of which a term is found.
MECHANISMS = (
    (("splice_donor_variant", "splice_acceptor_variant"), "direct_splice_site", "high"),
    (("splice_region_variant",), "exonic_boundary_effect", "high"),
    (("splice_polypyrimidine_tract_variant",), "polypyrimidine_tract_effect", "high"),
    (("intron_variant",), "intronic_cryptic_site", "medium"),
    (("missense_variant", "synonymous_variant", "stop_gained", "stop_lost"), "exonic_ese_ess_effect", "low"),
    (("splice_donor_region_variant", "splice_acceptor_region_variant", "splice_donor_5th_base_variant"), "exonic_extended_region", "low"),
    (("5_prime_UTR_variant", "3_prime_UTR_variant"), "utr_regulatory_effect", "low"),
    (("inframe_insertion", "inframe_deletion"), "structural_splice_effect", "low"),
)
INDIRECT, BY_WORD = ("indirect_splice_effect", "low"), ("keyword_based_detection", "low")
STRICT, COMPREHENSIVE, PERMISSIVE = "strict", "comprehensive", "permissive"


def read_vcf(spark: SparkSession, path: str, info: Sequence[str] = (), first_alt_only: bool = False) -> DataFrame:
    """Records with INFO keys as columns INFO_*, the class of the alleles, and what they do to splicing.

    A record of several alternative alleles is a row for each, or with first_alt_only a row for the first one.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    alts = F.split(f[4], ",")
    alt = alts[0] if first_alt_only else F.explode(alts)
    rows = lines.filter(F.size(f) >= 5).select(f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), alt.alias("alt"), F.get(f, 5).alias("qual"), F.get(f, 6).alias("filter"), F.get(f, 7).alias("info"))
    keys = info_map(F.coalesce("info", F.lit("")))
    rows = rows.withColumns({f"INFO_{k}": F.try_element_at(keys, F.lit(k)) for k in info})
    return with_splice_impact(rows.withColumn("variant_type", record_class(F.col("ref"), F.col("alt"))), F.col("info"))


def with_splice_impact(rows: DataFrame, *texts: Column, mode: str = COMPREHENSIVE) -> DataFrame:
    """splice_terms (accessions), affects_splicing, splice_mechanism and splice_confidence by what the texts name.

    A term is found by accession or name in any case. Without one, a word is enough in all modes but STRICT, which knows the
    core terms alone. A text that is null or `.` names nothing; rows without terms and words have mechanism and confidence
    `none`.
    """
    if mode not in (STRICT, COMPREHENSIVE, PERMISSIVE):
        raise ValueError(f"no such mode: {mode}")
    low = [F.when(t != ".", F.lower(t)) for t in texts]

    def has(*words: str) -> Column:
        return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t.contains(w.lower()), F.lit(False)) for t in low for w in words], F.lit(False)), F.lit(False))

    terms = CORE_TERMS if mode == STRICT else CORE_TERMS + FURTHER_TERMS
    found = {name: has(accession, name) for accession, name in terms}
    word = F.lit(False) if mode == STRICT else has(*SPLICE_WORDS, *(BROAD_WORDS if mode == PERMISSIVE else ()))
    known = reduce(lambda a, b: a | b, found.values())
    mechanism, trust = (F.when(known, INDIRECT[k]).when(word, BY_WORD[k]).otherwise("none") for k in (0, 1))
    for names, *what in reversed(MECHANISMS):
        here = reduce(lambda a, b: a | b, [found[n] for n in names if n in found], F.lit(False))
        mechanism, trust = (F.when(here, what[k]).otherwise(x) for k, x in enumerate((mechanism, trust)))
    named = F.array_compact(F.array(*(F.when(found[name], accession) for accession, name in terms)))
    return rows.withColumns({"splice_terms": named, "affects_splicing": known | word, "splice_mechanism": mechanism, "splice_confidence": trust})


def read_mutations(spark: SparkSession, path: str, hgvs_col: str, significance_col: str) -> DataFrame:
    """A tab-separated mutation table with its HGVS text taken apart, the site that it hints at, and its significance; rows that don't parse are marked."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    parts = hgvs(F.col(hgvs_col))
    rows = rows.withColumns({f"hgvs_{k}": v for k, v in parts.items()})
    return rows.withColumns({"site_type": intronic_site(F.col("hgvs_intronic")), "parsed": F.col("hgvs_base").isNotNull(), "significance": first_contained(F.col(significance_col), SIGNIFICANCE, "unknown")})


def split_location(col: Column) -> dict[str, Column]:
    """chrom-pos-ref-alt as four columns."""
    p = F.split(col, "-")
    return {"chrom": F.get(p, 0), "pos": F.get(p, 1).try_cast("long"), "ref": F.get(p, 2), "alt": F.get(p, 3)}


def delta_annotation(col: Column) -> dict[str, Column]:
    """ALLELE|SYMBOL|DS_AG|DS_AL|DS_DG|DS_DL|DP_AG|DP_AL|DP_DG|DP_DL as columns."""
    p = F.split(col, r"\|")
    names = ("allele", "symbol", "DS_AG", "DS_AL", "DS_DG", "DS_DL", "DP_AG", "DP_AL", "DP_DG", "DP_DL")
    return {n: F.get(p, k) if k < 2 else F.get(p, k).try_cast("double" if n.startswith("DS") else "int") for k, n in enumerate(names)}


def write_vcf(rows: DataFrame, path: str, single: bool = False) -> None:
    """(chrom, pos, id, ref, alt, qual, filter, info) as text, the header first, then by place; see `write_track`."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")]
    lines = rows.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), F.concat_ws("\t", *cols).alias("value"))
    write_track(lines, path, "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", single)
