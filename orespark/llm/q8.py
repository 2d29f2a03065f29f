"""op8: benchmark items that documents hold."""

from .common import table
from .decontaminate import contaminated


def QUERY(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
