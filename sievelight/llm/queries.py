"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from sievelight.llm import license_scan, merkle, near_dedup, substring_dedup, vector_codes, warc
from sievelight.llm.bpe import op10_bpe
from sievelight.llm.decontaminate import op6_decontamination
from sievelight.llm.fingerprint import op7_fingerprint
from sievelight.llm.license_scan import op4_license_scan
from sievelight.llm.merkle import op12_merkle_manifest
from sievelight.llm.near_dedup import op9_near_dedup
from sievelight.llm.pigeonring import op13_simhash
from sievelight.llm.sharding import op3_sharding
from sievelight.llm.substring_dedup import op2_substring_dedup
from sievelight.llm.token_counts import op5_token_counts
from sievelight.llm.toxicity import op1_toxicity
from sievelight.llm.vector_codes import op11_vector_codes
from sievelight.llm.warc import op8_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_fingerprint": op7_fingerprint,
    "op8_warc": op8_warc,
    "op9_near_dedup": op9_near_dedup,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_license_scan": license_scan.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
