"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from .chat import op6_chat
from .decontaminate import op9_decontaminate
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .html_text import op4_page_texts
from .licences import op2_licences
from .mixing import OP8_SQL, op8_mix
from .ngram_join import OP1_SQL, op1_ngram_join
from .quality import op7_quality
from .secrets import OP3_SQL, op3_secrets
from .url_filter import op10_url_filter

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_licences": op2_licences,
    "op3_secrets": op3_secrets,
    "op4_page_texts": op4_page_texts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_mix": op8_mix,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op1_ngram_join": OP1_SQL,
    "op3_secrets": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_mix": OP8_SQL,
}
