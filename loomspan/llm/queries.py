"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that has the function of that name
MODULES = {
    "op2_licences": "licenses",
    "op1_warc": "warc",
    "op9_lines": "lines",
    "op7_quality": "quality",
    "op10_language_model": "language_model",
    "op4_decontaminate": "decontaminate",
    "op8_embeddings": "embeddings",
    "op3_simhash": "simhash",
    "op5_packing": "packing",
    "op6_token_ids": "token_output",
    "op11_mixing": "mixing",
    "op12_phrases": "phrases",
    "op13_whitening": "whitening",
}


def _query(name: str):
    return getattr(import_module(f"{__package__}.{MODULES[name]}"), name)


QUERIES = {name: _query(name) for name in MODULES}
ORACLES: dict[str, str] = {"op1_warc": import_module(f"{__package__}.warc").OP1_SQL, "op9_lines": import_module(f"{__package__}.lines").OP9_SQL}
ORACLES |= {"op11_mixing": import_module(f"{__package__}.mixing").OP11_SQL, "op12_phrases": import_module(f"{__package__}.phrases").OP12_SQL}
