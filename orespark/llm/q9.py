"""op9: the language of each document."""

from .common import table
from .langid import language_id


def QUERY(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
