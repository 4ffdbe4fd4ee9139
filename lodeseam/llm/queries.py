"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodeseam.llm.bpe import op5_byte_bpe
from lodeseam.llm.chat import OP8_SQL, op8_chat_formatting
from lodeseam.llm.exactdup import OP10_SQL, op10_exact_dedup
from lodeseam.llm.fingerprints import op4_document_fingerprints
from lodeseam.llm.licenses import op1_license_scan
from lodeseam.llm.mixing import OP2_SQL, op2_mix_sources
from lodeseam.llm.neardup import OP9_SQL, op9_minhash_near_dedup
from lodeseam.llm.packing import op11_packing
from lodeseam.llm.periodic import op12_periodic_runs
from lodeseam.llm.secrets import op6_secret_scan
from lodeseam.llm.spelling import op13_spelling_variants
from lodeseam.llm.substrings import OP3_SQL, op3_substring_dedup
from lodeseam.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_mix_sources,
        op3_substring_dedup,
        op4_document_fingerprints,
        op5_byte_bpe,
        op6_secret_scan,
        op7_toxicity,
        op8_chat_formatting,
        op9_minhash_near_dedup,
        op10_exact_dedup,
        op11_packing,
        op12_periodic_runs,
        op13_spelling_variants,
    )
}

#: Learned scores, merges, fingerprints and automata have none: their tests have brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
