"""Registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .audio import op1_audio_features
from .hpylm import op5_pitman_yor
from .html import op3_template_removal
from .mixing import op2_soft_membership_mixing
from .neardup import op9_weighted_minhash
from .pieces import op10_piece_nbest
from .shards import op7_hypergeometric_shards
from .toxicity import op4_toxicity_cnn
from .urls import op8_link_trust
from .vafile import OP6_SQL, op6_vector_approximation


def queries():
    return {
        "op1_audio_features": op1_audio_features,
        "op2_soft_membership_mixing": op2_soft_membership_mixing,
        "op3_template_removal": op3_template_removal,
        "op4_toxicity_cnn": op4_toxicity_cnn,
        "op5_pitman_yor": op5_pitman_yor,
        "op6_vector_approximation": op6_vector_approximation,
        "op7_hypergeometric_shards": op7_hypergeometric_shards,
        "op8_link_trust": op8_link_trust,
        "op9_weighted_minhash": op9_weighted_minhash,
        "op10_piece_nbest": op10_piece_nbest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_vector_approximation": OP6_SQL}
