"""op5: quality of each document."""

from .common import table
from .quality import quality


def QUERY(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
