"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from .ann import op1_ann
from .bpe import op10_bpe
from .clusters import lloyd_sql, op11_lloyd
from .jaccard import op8_jaccard
from .langid import op6_langid
from .lm import op5_lm
from .media import op9_media
from .mixing import op7_mixing
from .quality import op4_quality
from .repair import REPAIR_SQL, op13_repair
from .sharding import op2_sharding
from .tokencount import op3_token_counts
from .tokenfile import op12_tokenfile

QUERIES = {
    "op1_ann": op1_ann,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_lm": op5_lm,
    "op6_langid": op6_langid,
    "op7_mixing": op7_mixing,
    "op8_jaccard": op8_jaccard,
    "op9_media": op9_media,
    "op10_bpe": op10_bpe,
    "op11_lloyd": op11_lloyd,
    "op12_tokenfile": op12_tokenfile,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {"op11_lloyd": lloyd_sql(), "op13_repair": REPAIR_SQL}
