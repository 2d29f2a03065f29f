"""op10: each document encoded and decoded again."""

from .bpe import bpe_digests
from .common import table


def QUERY(spark, sf_dir):
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
