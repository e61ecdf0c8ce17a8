"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from nuntia.llm.chat import op1_chat
from nuntia.llm.decontaminate import op2_decontaminate
from nuntia.llm.divergence import ORACLE as OP12
from nuntia.llm.divergence import op12_divergence
from nuntia.llm.language import op4_language
from nuntia.llm.licences import op5_licences
from nuntia.llm.mixing import ORACLE as OP9
from nuntia.llm.mixing import op9_mix
from nuntia.llm.near_dup import op6_near_dup
from nuntia.llm.neighbours import op10_neighbours
from nuntia.llm.quality import op7_quality
from nuntia.llm.secrets import op3_secrets
from nuntia.llm.substrings import op11_substrings
from nuntia.llm.toxicity import op8_toxicity
from nuntia.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_chat, op2_decontaminate, op3_secrets, op4_language, op5_licences, op6_near_dup, op7_quality, op8_toxicity, op9_mix, op10_neighbours, op11_substrings, op12_divergence, op13_whitening)}
ORACLES: dict[str, str] = {"op9_mix": OP9, "op12_divergence": OP12}
