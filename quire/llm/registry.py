"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.alignment import op11_token_alignment
from quire.llm.chosen_path import op13_chosen_path_join
from quire.llm.decontamination import op4_latent_decontamination
from quire.llm.fingerprint import op5_order_minhash
from quire.llm.langid import op6_bitmask_langid
from quire.llm.packing import op7_vector_best_fit
from quire.llm.repair import OP12_SQL, op12_conversation_repair
from quire.llm.secrets import op2_network_secret_scan
from quire.llm.sharding import OP1_SQL, op1_rendezvous_shards
from quire.llm.simhash import op10_golay_simhash
from quire.llm.suffix_model import op8_suffix_tree_scores
from quire.llm.token_files import op9_token_files
from quire.llm.toxicity import op3_noisy_channel_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_network_secret_scan,
        op3_noisy_channel_toxicity,
        op4_latent_decontamination,
        op5_order_minhash,
        op6_bitmask_langid,
        op7_vector_best_fit,
        op8_suffix_tree_scores,
        op9_token_files,
        op10_golay_simhash,
        op11_token_alignment,
        op12_conversation_repair,
        op13_chosen_path_join,
    )
}
ORACLES: dict[str, str] = {"op1_rendezvous_shards": OP1_SQL, "op12_conversation_repair": OP12_SQL}
