"""op3: tokens of each document."""

from .common import table
from .token_counts import token_counts


def QUERY(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
