"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, fingerprints, jaccard, language, licenses, negatives, packing, pii, quality, records, tries, urls

QUERIES = {
    f.__name__: f
    for f in (pii.op1_pii, urls.op2_urls, language.op3_language, records.op4_records, licenses.op5_licenses, decontaminate.op6_decontaminate, jaccard.op7_jaccard, chat.op8_chat, quality.op9_quality, packing.op10_packing, fingerprints.op11_fingerprints, tries.op12_tries, negatives.op13_negatives)
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op5_licenses": licenses.ORACLE, "op8_chat": chat.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
