"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from barograph.llm.conversation_repair import op12_conversation_repair
from barograph.llm.cross_tokenizer import op11_cross_tokenizer
from barograph.llm.decontamination import op2_decontamination
from barograph.llm.html_text import op10_html_text
from barograph.llm.language_id import op1_language_id
from barograph.llm.line_dedup import OP8_SQL, op8_line_dedup
from barograph.llm.minhash_dedup import op7_minhash_dedup
from barograph.llm.order_minhash import op4_order_minhash
from barograph.llm.packing import op6_packing
from barograph.llm.passage_dedup import op9_passage_dedup
from barograph.llm.secret_scan import op13_secret_scan
from barograph.llm.url_filter import op5_url_filter
from barograph.llm.warc_zip import op3_warc_zip

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_warc_zip, op4_order_minhash, op5_url_filter, op6_packing, op7_minhash_dedup, op8_line_dedup, op9_passage_dedup, op10_html_text,
        op11_cross_tokenizer, op12_conversation_repair, op13_secret_scan,
    )
}
SQL = {"op8_line_dedup": OP8_SQL}
