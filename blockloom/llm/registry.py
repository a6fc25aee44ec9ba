"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontamination, embeddings, infill, language, licenses, merkle, mixing, pii, quality, sharding, simhash, tokens, toxicity

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_tokens": tokens.query,
    "op3_licenses": licenses.query,
    "op4_decontamination": decontamination.query,
    "op5_quality": quality.query,
    "op6_pii": pii.query,
    "op7_mixing": mixing.query,
    "op8_simhash": simhash.query,
    "op9_embeddings": embeddings.query,
    "op10_toxicity": toxicity.query,
    "op11_infill": infill.query,
    "op12_language": language.query,
    "op13_merkle": merkle.query,
}
SQL = {
    "op1_sharding": sharding.sql(),
    "op3_licenses": licenses.sql(),
    "op7_mixing": mixing.sql(),
    "op9_embeddings": embeddings.sql(),
    "op11_infill": infill.sql(),
    "op13_merkle": merkle.sql(),
}
