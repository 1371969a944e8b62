"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from skerry.llm.queries_bpe import op6_tokenfile, op10_bpe
from skerry.llm.queries_decontaminate import OP1_SQL, op1_decontaminate
from skerry.llm.queries_fingerprint import op2_fingerprint
from skerry.llm.queries_html import op3_html
from skerry.llm.queries_language import op11_language
from skerry.llm.queries_licenses import op5_license
from skerry.llm.queries_pii import op8_pii
from skerry.llm.queries_quality import op4_quality
from skerry.llm.queries_simhash import op7_simhash
from skerry.llm.queries_variants import OP12_SQL, op12_variants
from skerry.llm.queries_warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_fingerprint": op2_fingerprint,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_license": op5_license,
    "op6_tokenfile": op6_tokenfile,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_language": op11_language,
    "op12_variants": op12_variants,
}

SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op9_warc": OP9_SQL, "op12_variants": OP12_SQL}
