"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, brown, decontamination, exact_dedup, gif, jaccard, language, packing, quality, sort_means, spelling, token_files, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1,
    "op2_warc": warc.op2,
    "op3_harmonic_packing": packing.op3,
    "op4_gif_media": gif.op4,
    "op5_brown_lm": brown.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_language_id": language.op7,
    "op8_quality": quality.op8,
    "op9_ngram_jaccard": jaccard.op9,
    "op10_token_files": token_files.op10,
    "op11_decontamination": decontamination.op11,
    "op12_spelling": spelling.op12,
    "op13_sort_means": sort_means.op13,
}
ORACLE_SQL = {
    "op2_warc": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_ngram_jaccard": jaccard.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_sort_means": sort_means.ORACLE,
}
