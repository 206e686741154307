"""Small Column helpers on names, sequences and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter and its complement, with lower case for clipped bases; all other letters keep.
BASES, COMPLEMENT = "ACGTacgt", "TGCAtgca"


def chr_of(rname: Column, separator: str = "/") -> Column:
    """Chromosome part of ``chr/sequence``; an error where the separator is missing."""
    if len(separator) != 1:
        raise ValueError("the separator is one character")
    at = F.instr(rname, separator)
    return F.when(at > 0, F.substring(rname, F.lit(1), at - 1)).otherwise(F.raise_error(F.concat(F.lit("no separator in reference name "), rname)))


def seq_of(rname: Column, separator: str = "/") -> Column:
    """Sequence part of ``chr/sequence``, all after the first separator."""
    at = F.instr(rname, separator)
    return F.when(at > 0, F.substring(rname, at + 1, F.length(rname))).otherwise(F.raise_error(F.concat(F.lit("no separator in reference name "), rname)))


def dna5(seq: Column) -> Column:
    """Upper-case bases, U as T, anything but A C G T as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENT)


def ungapped(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def tag(tags: Column, name: str) -> Column:
    """Value of a tag without its type letter, null if there is none."""
    return F.regexp_extract(F.try_element_at(tags, F.lit(name)), "^[^:]*:(.*)$", 1) if name else F.lit(None)


def with_tags(tags: Column, **new: Column) -> Column:
    """Tags set or replaced; a null value leaves the tag out."""
    names = list(new)
    kept = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*names))
    added = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*new.values())), lambda k, v: v.isNotNull())
    return F.map_concat(kept, added)
