"""Value maps, rounding, scores and array helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark import constants as C


def value_map(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Look `col` up in a constant mapping; what is not in it gives `default` (NULL if none)."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(pairs, col)
    return found if default is None else F.coalesce(found, default)


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def in_set(col: Column, values: Iterable) -> Column:
    """Membership; a missing value is in no set."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def gene_intersect(genes: Column, wanted: Iterable[str]) -> Column:
    """The sorted part of a gene array that is in a constant set."""
    return F.sort_array(F.array_intersect(genes, literal_array(wanted)))


def join_genes(genes: Column) -> Column:
    return F.array_join(genes, "|")


def split_genes(text: Column) -> Column:
    """Inverse of `join_genes`: empty and missing text both give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda g: g != "")


def round_even(col: Column, digits: int) -> Column:
    """Round half to even on the scaled binary value: 0.12345 becomes 0.1234 at four digits."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f+/-%.4f", mean, std)


def is_low_confidence(score: Column) -> Column:
    return score.between(*C.LOW_CONFIDENCE_RANGE)


def priority_score(status: Column, confidence: Column, burden: Column, max_burden: Column) -> Column:
    """Weighted sum of target status, confidence and scaled gene count, to four digits."""
    weights = C.PRIORITY_WEIGHTS
    targetable = F.coalesce((status == C.TARGETABLE).cast("double"), F.lit(0.0))
    scaled = burden / F.nullif(max_burden.cast("double"), F.lit(0.0))
    return round_even(
        targetable * weights["targetable"] + confidence * weights["confidence"] + scaled * weights["burden"], 4
    )


def follow_up(status: Column, confidence: Column) -> Column:
    """Follow-up text of a status, with a note where the confidence is in the doubtful range."""
    text = value_map(status, C.FOLLOW_UP)
    return F.when(is_low_confidence(confidence), F.concat(text, F.lit(C.LOW_CONFIDENCE_NOTE))).otherwise(text)


def mutation_status(n_targetable: Column, n_genes: Column) -> Column:
    return (
        F.when(n_targetable > 0, C.TARGETABLE).when(n_genes > 0, C.NON_TARGETABLE).otherwise(C.NO_MUTATION)
    )
