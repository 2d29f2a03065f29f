"""op7: personal data of each document."""

from .common import table
from .pii import pii_digests


def QUERY(spark, sf_dir):
    return pii_digests(table(spark, sf_dir, "documents"))
