"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessella.llm.decontaminate import op1_decontaminate
from tessella.llm.html_main import op2_main_text
from tessella.llm.language_id import op8_language
from tessella.llm.lm_score import op9_lm_score
from tessella.llm.neighbours import OP7_SQL, op7_neighbours
from tessella.llm.packing import op5_pack
from tessella.llm.quality import op6_quality
from tessella.llm.secret_scan import op4_secrets
from tessella.llm.simhash import op10_simhash
from tessella.llm.token_files import op3_token_files

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_main_text, op3_token_files, op4_secrets, op5_pack, op6_quality, op7_neighbours, op8_language, op9_lm_score, op10_simhash)}
SQL = {"op7_neighbours": OP7_SQL}
