"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from docloom.llm import decontaminate, filter_audit
from docloom.llm.bpe import op8_bpe_round_trip
from docloom.llm.decontaminate import op11_wu_manber_decontamination
from docloom.llm.embed_dedup import op5_projection_passes
from docloom.llm.filter_audit import op12_filter_interaction_audit
from docloom.llm.html_extract import op10_html_extraction
from docloom.llm.langid import op2_language_id
from docloom.llm.license_scan import op9_license_scan
from docloom.llm.mixing import op1_pfair_mixing
from docloom.llm.quality_rules import op4_mcd_quality
from docloom.llm.resample import op13_importance_resampling
from docloom.llm.sharding import op6_vector_bin_packing
from docloom.llm.simhash import op3_simhash_near_dedup
from docloom.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_pfair_mixing,
        op2_language_id,
        op3_simhash_near_dedup,
        op4_mcd_quality,
        op5_projection_passes,
        op6_vector_bin_packing,
        op7_toxicity,
        op8_bpe_round_trip,
        op9_license_scan,
        op10_html_extraction,
        op11_wu_manber_decontamination,
        op12_filter_interaction_audit,
        op13_importance_resampling,
    )
}

#: The other methods have no SQL form that DuckDB could run; tests hold them against brute force instead.
ORACLES = {"op11_wu_manber_decontamination": decontaminate.ORACLE, "op12_filter_interaction_audit": filter_audit.ORACLE}
