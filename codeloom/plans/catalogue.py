"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import cases, diffs, evaluation, facts, mechanisms, source, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**facts.QUERIES, **evaluation.QUERIES, **texts.QUERIES, **cases.QUERIES, **diffs.QUERIES, **source.QUERIES, **mechanisms.QUERIES}

ORACLES: dict[str, str] = {**facts.ORACLES, **evaluation.ORACLES, **texts.ORACLES, **cases.ORACLES, **diffs.ORACLES, **source.ORACLES, **mechanisms.ORACLES}
