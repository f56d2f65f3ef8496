"""Configuration and credentials: environment first, then a secret store's object, else an error. Never in data."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

DEFAULT_REGION = "us-east-1"


@dataclass(frozen=True)
class Credentials:
    access_key: str
    secret_key: str
    region: str

    def __repr__(self) -> str:
        return f"Credentials(...{self.access_key[-4:]}, {self.region})"


def credentials(secret: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> Credentials:
    """Each value from the environment or else from the secret; empty counts as missing."""
    env, held = os.environ if environment is None else environment, secret or {}
    names = {"access_key": "OBJECT_STORE_ACCESS_KEY", "secret_key": "OBJECT_STORE_SECRET_KEY", "region": "OBJECT_STORE_REGION"}
    found = {k: env.get(v) or held.get(v) or held.get(k) for k, v in names.items()}
    missing = [names[k] for k in ("access_key", "secret_key") if not found[k]]
    if missing:
        raise ValueError(f"missing credentials: {', '.join(missing)}")
    return Credentials(found["access_key"], found["secret_key"], found["region"] or DEFAULT_REGION)


def use_object_store(spark: SparkSession, given: Credentials) -> None:
    """Hands credentials to Spark's object-store connector, so that paths of it can be read and written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.access.key", given.access_key)
    conf.set("fs.s3a.secret.key", given.secret_key)
    conf.set("fs.s3a.endpoint.region", given.region)
