"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import oracles
from .decontaminate import op7_benchmark_decontamination
from .decontaminate import oracle as decontaminate_sql
from .langid import op3_language_id
from .licenses import op2_license_scans
from .licenses import oracle as licenses_sql
from .neardup import op1_ngram_jaccard, op1_ngram_jaccard_links
from .packing import op8_best_fit_packing
from .quality import op10_quality_rules
from .secrets import op5_secret_scans
from .secrets import oracle as secrets_sql
from .substrings import op4_substring_dedup
from .suffixes import op6_suffix_array_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
    "op2_license_scans": op2_license_scans,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.JACCARD,
    "op4_substring_dedup": oracles.WORD_WINDOWS,
    "op10_quality_rules": oracles.quality_rules(),
    "op2_license_scans": licenses_sql(),
    "op5_secret_scans": secrets_sql(),
    "op7_benchmark_decontamination": decontaminate_sql(),
}
