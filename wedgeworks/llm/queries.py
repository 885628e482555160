"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .chunking import op4_gear_chunks
from .contamination import op9_latent_decontamination
from .language import op3_hyperdimensional_language
from .minhash import op5_minhash
from .mixing import OP6_SQL, op6_hierarchical_mix
from .neighbours import op7_nn_descent
from .phrases import op13_lempel_ziv_fingerprint
from .quality import op1_compression_quality
from .runs import op12_dyadic_runs
from .secrets import op10_randomness_tests
from .sharding import op8_virtual_slots
from .substrings import op2_suffix_array
from .whitening import op11_ogita_aishima_whitening

QUERIES = {
    "op1_compression_quality": op1_compression_quality,
    "op2_suffix_array": op2_suffix_array,
    "op3_hyperdimensional_language": op3_hyperdimensional_language,
    "op4_gear_chunks": op4_gear_chunks,
    "op5_minhash": op5_minhash,
    "op6_hierarchical_mix": op6_hierarchical_mix,
    "op7_nn_descent": op7_nn_descent,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_latent_decontamination": op9_latent_decontamination,
    "op10_randomness_tests": op10_randomness_tests,
    "op11_ogita_aishima_whitening": op11_ogita_aishima_whitening,
    "op12_dyadic_runs": op12_dyadic_runs,
    "op13_lempel_ziv_fingerprint": op13_lempel_ziv_fingerprint,
}

ORACLES: dict[str, str] = {"op6_hierarchical_mix": OP6_SQL}
