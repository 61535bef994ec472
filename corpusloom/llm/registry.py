"""The queries of this subpackage and, where SQL can state them, their SQL."""

from .bitsliced import OP6_SQL, op6_bit_sliced
from .chat import OP8_SQL, op8_reply_trees
from .collocations import OP11_SQL, op11_collocations
from .decontaminate import op1_decontaminate
from .langid import op4_language
from .mixing import OP5_SQL, op5_fair_queue
from .neardup import op10_bagminhash
from .pii import OP9_SQL, op9_disclosure
from .prefixtrie import OP12_SQL, op12_prefix_trie
from .sharding import op7_virtual_slots
from .simhash import op13_simhash
from .substrings import op3_suffix_dedup
from .toxicity import op2_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language": op4_language,
    "op5_fair_queue": op5_fair_queue,
    "op6_bit_sliced": op6_bit_sliced,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_reply_trees": op8_reply_trees,
    "op9_disclosure": op9_disclosure,
    "op10_bagminhash": op10_bagminhash,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL = {
    "op5_fair_queue": OP5_SQL,
    "op6_bit_sliced": OP6_SQL,
    "op8_reply_trees": OP8_SQL,
    "op9_disclosure": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
