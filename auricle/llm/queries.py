"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import bpe, decontaminate, licences, lines, manifest, media, mixing, mixture, near, resample, substring, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_media": media.op2_media,
    "op3_context_mixing": mixing.op3_context_mixing,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_minhash": near.op7_minhash,
    "op8_warc": warc.op8_warc,
    "op9_license_scan": licences.op9_license_scan,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_mixture": mixture.op11_mixture,
    "op12_manifest": manifest.op12_manifest,
    "op13_resample": resample.op13_resample,
}

ORACLE_SQL = {
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op7_minhash": near.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_substring_dedup": substring.OP10_SQL,
    "op11_mixture": mixture.OP11_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_resample": resample.OP13_SQL,
}
