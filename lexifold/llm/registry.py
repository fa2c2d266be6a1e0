"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontamination import OP3_SQL, op3_benchmark_leaks
from .fingerprints import op2_winnow_prints
from .licenses import op5_license_scan
from .lm_scoring import op10_gru_likelihood
from .mixing import OP1_SQL, op1_mix_sources
from .ngram_join import OP9_LINKS_SQL, OP9_SQL, op9_jaccard_groups, op9_jaccard_links
from .pii import op6_personal_data
from .runs import op13_periodic_runs
from .sharding import op4_shard_slots
from .token_counts import op11_token_counts
from .toxicity import op8_toxicity
from .turn_repair import op12_turn_repair
from .warc import OP7_SQL, op7_warc_bundles

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_winnow_prints": op2_winnow_prints,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_shard_slots": op4_shard_slots,
    "op5_license_scan": op5_license_scan,
    "op6_personal_data": op6_personal_data,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_groups": op9_jaccard_groups,
    "op9_jaccard_links": op9_jaccard_links,
    "op10_gru_likelihood": op10_gru_likelihood,
    "op11_token_counts": op11_token_counts,
    "op12_turn_repair": op12_turn_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {"op1_mix_sources": OP1_SQL, "op3_benchmark_leaks": OP3_SQL, "op7_warc_bundles": OP7_SQL, "op9_jaccard_groups": OP9_SQL, "op9_jaccard_links": OP9_LINKS_SQL}
