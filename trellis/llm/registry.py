"""The queries of this subpackage, and the SQL of those that SQL can express."""

from .embeddings import op6_embedding_near_dedup
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .lines import OP3_SQL, op3_line_dedup
from .mixing import op5_mix_sources
from .packing import op8_best_fit_packing
from .sharding import op9_shards
from .simhash import op7_simhash_near_dedup
from .substrings import op2_substring_dedup
from .toxicity import op10_toxicity
from .warc import OP1_SQL, op1_warc_archives

QUERIES = {
    "op1_warc_archives": op1_warc_archives,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_shards": op9_shards,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {"op1_warc_archives": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL}
