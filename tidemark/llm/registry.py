"""All queries of this subpackage."""

from __future__ import annotations

from tidemark.llm import decontamination, gru_lm, language_id, licenses, mixing, mpeg_audio, near_dup, repeats, sharding, warc_zip

MODULES = (mpeg_audio, sharding, warc_zip, mixing, gru_lm, decontamination, language_id, licenses, repeats, near_dup)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items() if v}
