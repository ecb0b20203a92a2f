"""String functions with the semantics of the corpus format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points counted as white space when a text is stripped.
WHITESPACE = "".join(
    map(
        chr,
        [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760]
        + list(range(8192, 8203))
        + [8232, 8233, 8239, 8287, 12288],
    )
)


def strip(c: Column) -> Column:
    """Remove white space at both ends; a plain ``trim`` would remove blanks only."""
    return F.trim(c, F.lit(WHITESPACE))


def one_line(c: Column) -> Column:
    """Strip, then delete line breaks (no blank is put in their place)."""
    return F.replace(strip(c), F.lit("\n"), F.lit(""))


def capitalise(c: Column) -> Column:
    """First letter upper case, all others lower case (``MoralValue`` gives ``Moralvalue``)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def word_list(c: Column) -> Column:
    """Lower-case runs of letters, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+", -1), lambda w: w != "")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later steps use more than once.

    Merged projections and pushed-down filters would copy its expression to every use. A
    generator of one element is a border they do not cross.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
