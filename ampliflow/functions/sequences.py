"""Scalar expressions over sequences, names and file names; all JVM-side columns."""

from __future__ import annotations

from keyword import kwlist

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 31
#: The bases behind each IUPAC nucleotide code.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: First words of names that are no species.
REJECTED_FIRST = ("unclassified", "uncultured", "unidentified")
#: Fixed value: markers cannot be called like the report over all of them.
RESERVED_MARKER = "pooled"


def md5_key(seq: Column) -> Column:
    """A sequence's identity: MD5 of its upper-case form."""
    return F.md5(F.upper(seq))


def reverse_complement(seq: Column) -> Column:
    """Of an upper-case sequence, IUPAC codes included."""
    return F.translate(F.reverse(seq), "ACGTRYKMBVDH", "TGCAYRMKVBHD")


def primer_clean(primer: Column) -> Column:
    """Upper case, inosine read as any base."""
    return F.translate(F.upper(primer), "I", "N")


def is_iupac(seq: Column) -> Column:
    """Only nucleotide codes, no gaps."""
    return seq.rlike("^[GATCRYWSMKHBVDN]+$")


def kmers(seq: Column, k: int = K) -> Column:
    """All k-mers by position, repeats included; none for a shorter sequence."""
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def expand_iupac(seq: Column) -> Column:
    """All unambiguous sequences that a sequence with IUPAC codes stands for, in order of its codes' bases."""
    table = F.create_map(*[x for code, bases in IUPAC.items() for x in (F.lit(code), F.array(*[F.lit(b) for b in bases]))])
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    start = F.array(F.lit(""))
    return F.aggregate(letters, start, lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(F.coalesce(F.element_at(table, c), F.array(c)), lambda b: F.concat(p, b)))))


def one_base_substitutions(seq: Column) -> Column:
    """Distinct sequences one substitution away."""
    places = F.sequence(F.lit(1), F.length(seq))
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    found = F.flatten(F.transform(places, lambda i: F.transform(bases, lambda b: F.concat(F.substring(seq, F.lit(1), i - 1), b, F.substring(seq, i + 1, F.length(seq))))))
    return F.when(F.length(seq) > 0, F.array_distinct(F.filter(found, lambda s: s != seq))).otherwise(F.array().cast("array<string>"))


def one_base_deletions(seq: Column) -> Column:
    """Distinct sequences one deletion away."""
    places = F.sequence(F.lit(1), F.length(seq))
    found = F.transform(places, lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.substring(seq, i + 1, F.length(seq))))
    return F.when(F.length(seq) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def one_base_insertions(seq: Column) -> Column:
    """Distinct sequences one insertion away."""
    places = F.sequence(F.lit(0), F.length(seq))
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(bases, lambda b: F.concat(F.substring(seq, F.lit(1), i), b, F.substring(seq, i + 1, F.length(seq)))))))


def read_abundance(name: Column) -> Column:
    """The number after the last underscore of a read name; 1 where there is none."""
    return F.when(F.instr(name, "_") > 0, F.coalesce(F.try_to_number(F.regexp_extract(name, r"_(\d{1,18})$", 1), F.lit("999999999999999999")).cast("long"), F.lit(1))).otherwise(F.lit(1)).cast("long")


def read_prefix(name: Column) -> Column:
    """A read name without its abundance; the whole name where it has none."""
    return F.when(name.rlike(r"_\d{1,18}$"), F.regexp_replace(name, r"_\d{1,18}$", "")).otherwise(name)


def sample_name(path: Column) -> Column:
    """A file's sample: its base name without .gz, method and type suffixes."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.gz$", "")
    tables = F.regexp_replace(base, r"(\.[^.]*)?\.tsv$", "")
    return F.when(base.rlike(r"\.tsv$"), tables).otherwise(F.regexp_replace(base, r"\.[^.]+$", ""))


def binomial(genus: Column, species: Column) -> Column:
    """Genus and species in one name; either may be empty."""
    return F.trim(F.concat_ws(" ", F.coalesce(genus, F.lit("")), F.coalesce(species, F.lit(""))))


def genus_of(name: Column) -> Column:
    return F.split(name, " ", 2)[0]


def species_of(name: Column) -> Column:
    """What follows the first space; empty for a genus alone."""
    return F.coalesce(F.get(F.split(name, " ", 2), F.lit(1)), F.lit(""))


def is_species(name: Column) -> Column:
    """A name is on species level if it has a space."""
    return F.coalesce(name.contains(" "), F.lit(False))


def is_rejected_name(name: Column) -> Column:
    first = F.lower(F.split(F.trim(name), r"\s+")[0])
    return F.coalesce(name == "", F.lit(True)) | first.isin(*REJECTED_FIRST) | (name == "environmental samples") | name.contains(";")


def is_marker_name(name: Column) -> Column:
    """Letters, digits and dashes; no number, no word of the Python language, and not the pooled report's name."""
    return name.rlike(r"^-*[\p{L}\p{N}][\p{L}\p{N}-]*$") & ~name.rlike(r"^\p{N}+$") & ~name.isin(*kwlist, RESERVED_MARKER)


def species_display(name: Column) -> Column:
    """Report text of a species list entry."""
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").when(~is_species(name), F.concat(name, F.lit(" (unknown species)"))).otherwise(name)


def species_order(name: Column) -> Column:
    """Sort key that puts named species first, then genera, then the unknown."""
    return F.when(name.contains(" "), name).when(name != "", F.concat(name, F.lit(" {unknown species}"))).otherwise("{Unknown}")


def unique_or_joined(values: Column, sep: str = ";") -> Column:
    """One value if all are equal, else all of them joined."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.element_at(values, 1)).otherwise(F.array_join(values, sep))


def dequoted(field: Column) -> Column:
    return F.regexp_replace(field, '^"([^"]*)"$', "$1")


def taxid_in(text: Column) -> Column:
    """The first taxid=<digits> after a separator or 'ncbi'; 0 where there is none."""
    found = F.regexp_extract(text, r"(?:ncbi|[ _:;({\[\-\t])taxid=(\d+)", 1)
    return F.when(found == "", 0).otherwise(found.cast("int"))


def month_text(text: Column) -> Column:
    """'Mar-2016' or 'April-2016' as '2016-03'; other text as it is."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")])
    month = F.element_at(months, F.substring(text, 1, 3))
    return F.when(text.rlike(r"^[A-Z][a-z]{2,}-\d{4}$") & month.isNotNull(), F.concat_ws("-", F.regexp_extract(text, r"(\d{4})$", 1), month)).otherwise(text)


def size_header(name: Column) -> Column:
    """'id_12' in the style 'id;size=12'."""
    return F.regexp_replace(name, r"^(\S+)_(\d+)", "$1;size=$2")


def sintax_taxonomy(text: Column) -> Column:
    """'k__Bacteria; p__...; s__' in the style 'd:Bacteria,p:...'; empty ranks are left out."""
    fields = F.transform(F.split(text, r";\s*"), lambda f: F.regexp_replace(F.regexp_replace(f, "^k__", "d:"), "^([a-z])__", "$1:"))
    return F.array_join(F.filter(fields, lambda f: F.length(f) > 2), ",")


def yes_no(count: Column) -> Column:
    return F.when(count > 0, "Y").otherwise("N")
