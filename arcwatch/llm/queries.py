"""The corpus operators as registered queries, with their SQL where SQL can say it."""

from __future__ import annotations

from .codes import OP12_SQL, op12_codes
from .decontamination import op9_decontamination
from .embeddings import op7_embeddings
from .language import op10_language
from .language_model import op5_language_model
from .minhash import op2_minhash
from .mixing import OP1_SQL, op1_mixing
from .pii import op11_pii
from .quality import op3_quality
from .sharding import op6_sharding
from .suffixes import op4_suffixes
from .toxicity import op8_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_suffixes": op4_suffixes,
    "op5_language_model": op5_language_model,
    "op6_sharding": op6_sharding,
    "op7_embeddings": op7_embeddings,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
    "op11_pii": op11_pii,
    "op12_codes": op12_codes,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op12_codes": OP12_SQL,
}
