"""The queries of this subpackage, opN_<name>, and SQL where it can express them."""

from __future__ import annotations

from valora.llm.decontaminate import op6_decontaminate, op6_short_items
from valora.llm.language_id import op1_language_id
from valora.llm.license_scan import BASE_SQL, license_base, op3_license_scan
from valora.llm.lm_score import op5_lm_score
from valora.llm.media_chunks import op10_media_chunks
from valora.llm.mixing import TARGETS_SQL, mixing_targets, op2_mixing
from valora.llm.ngram_join import op7_ngram_join
from valora.llm.quality import op4_quality
from valora.llm.substring_dedup import OP8_SQL, op8_substring_dedup
from valora.llm.token_counts import op9_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_lm_score": op5_lm_score,
    "op6_decontaminate": op6_decontaminate,
    "op6_short_items": op6_short_items,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_media_chunks": op10_media_chunks,
    # parts of 2 and 3 that SQL can express
    "mixing_targets": mixing_targets,
    "license_base": license_base,
}
ORACLE: dict[str, str] = {"op8_substring_dedup": OP8_SQL, "mixing_targets": TARGETS_SQL, "license_base": BASE_SQL}
