"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, divergence, infilling, interpolation, langid, pii, secrets, simhash, substrings, topk, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_urlfilter": urlfilter.op2_urlfilter,
        "op3_secrets": secrets.op3_secrets,
        "op4_topk": topk.op4_topk,
        "op5_bpe": bpe.op5_bpe,
        "op6_substrings": substrings.op6_substrings,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_simhash": simhash.op8_simhash,
        "op9_warc": warc.op9_warc,
        "op10_pii": pii.op10_pii,
        "op11_divergence": divergence.op11_divergence,
        "op12_infilling": infilling.op12_infilling,
        "op13_interpolation": interpolation.op13_interpolation,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_urlfilter": urlfilter.SQL, "op4_topk": topk.SQL, "op6_substrings": substrings.SQL, "op7_decontamination": decontamination.SQL, "op9_warc": warc.SQL, "op10_pii": pii.SQL, "op11_divergence": divergence.SQL, "op12_infilling": infilling.SQL}
