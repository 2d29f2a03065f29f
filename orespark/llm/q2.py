"""op2: licenses of each document."""

from .common import table
from .licenses import license_scan


def QUERY(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
