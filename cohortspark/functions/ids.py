"""Patient identifiers and the cohort derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark import constants as C


def patient_id_prefix(col: Column, length: int = C.ID_LENGTH) -> Column:
    """Identifier by position: the first `length` characters."""
    return F.substring(col, 1, length)


def patient_id_barcode(col: Column) -> Column:
    """Identifier at the start of a sample barcode, up to the dash behind the participant.

    Participants beyond four characters keep them all; what is no such barcode gives its first characters.
    """
    whole = F.nullif(F.regexp_extract(col, C.ID_IN_BARCODE, 1), F.lit(""))
    return F.coalesce(whole, patient_id_prefix(col))


def patient_id_extract(col: Column) -> Column:
    """Identifier by pattern, wherever it stands in the value; NULL without a match."""
    return F.nullif(F.regexp_extract(col, C.ID_CAPTURE, 1), F.lit(""))


def is_valid_id(col: Column) -> Column:
    """Whether the whole value has the identifier format; one trailing newline is let through."""
    return col.rlike(rf"^{C.ID_FORMAT}\n?\z")


def cohort(col: Column) -> Column:
    """Cohort, the stand-in for the cancer type: the site part of the identifier."""
    return F.substring(col, 1, C.COHORT_LENGTH)
