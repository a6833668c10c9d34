"""The queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from weft.llm.embeddings import OP8_SQL, op8_rotation_codes
from weft.llm.langid import op3_mixture_langid
from weft.llm.licenses import op1_license_patience
from weft.llm.merkle import EDITS_SQL, merkle_edits, op6_merkle
from weft.llm.mixing import OP5_SQL, op5_systematic_mix
from weft.llm.ngramjoin import OP4_SQL, op4_signature_trees
from weft.llm.pieces import op10_lattice_sampling
from weft.llm.pii import OP2_SQL, op2_anchor_pii
from weft.llm.suffixes import OP9_SQL, op9_suffix_family
from weft.llm.toxicity import op7_max_segments

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_patience,
        op2_anchor_pii,
        op3_mixture_langid,
        op4_signature_trees,
        op5_systematic_mix,
        op6_merkle,
        op7_max_segments,
        op8_rotation_codes,
        op9_suffix_family,
        op10_lattice_sampling,
        merkle_edits,
    )
}

SQL = {
    "op2_anchor_pii": OP2_SQL,
    "op4_signature_trees": OP4_SQL,
    "op5_systematic_mix": OP5_SQL,
    "op8_rotation_codes": OP8_SQL,
    "op9_suffix_family": OP9_SQL,
    "merkle_edits": EDITS_SQL,
}
