"""Token limits and memory estimates, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .predicates import is_reasoning_model

#: Name -> ((most, least, factor, plus) for reasoning models, the same for others).
LIMITS = {
    "prediction": ((4096, 2048, 2.2, 1024), (6144, 1024, 0.55, 800)),
    "retry_prediction": ((8192, 4096, 3.0, 2048), (2400, 900, 1.8, 0)),
    "context": ((32768, 8192, 1.4, 8192), (32768, 8192, 1.2, 8192)),
    "batch_prediction": ((16384, 3072, 1.8, 1024), (12000, 1800, 1.25, 1024)),
    "structured_batch_prediction": ((8192, 1536, 1.3, 768), (4096, 512, 0.9, 512)),
    "retry_batch_prediction": ((20000, 6144, 2.4, 2048), (16000, 3000, 1.6, 2048)),
    "retry_structured_batch_prediction": ((12000, 3072, 1.7, 1024), (6000, 900, 1.15, 900)),
}


def limit(name: str, chars: Column, model: Column) -> Column:
    def of(most: int, least: int, factor: float, plus: int) -> Column:
        return F.least(F.lit(most), F.greatest(F.lit(least), (chars * F.lit(factor)).cast("int") + plus))

    reasoning, other = LIMITS[name]
    return F.when(is_reasoning_model(model), of(*reasoning)).otherwise(of(*other)).cast("long")


def job_memory_mb(model: Column, engine: Column, settings: Settings = DEFAULT) -> Column:
    """Memory to reserve for a job: by engine, else by the first ``<number>b`` in the model's name."""
    size = F.try_to_number(F.regexp_extract(F.lower(F.coalesce(model, F.lit(""))), r"(\d+(?:\.\d+)?)\s*b", 1), F.lit("999999999.999999")).cast("double")
    tier = F.when(size.isNull() | (size <= 0), settings.default_job_mb)
    for most, mb in settings.model_tiers:
        tier = tier.when(size <= most, mb)
    return F.when(engine == "nmt", settings.nmt_job_mb).otherwise(tier.otherwise(settings.default_job_mb)).cast("long")


def mb_to_gb(mb: Column) -> Column:
    return F.bround(mb / 1024, 2)
